import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions import kernels as k
from vellum.functions import vocab

WORDS = st.text(alphabet="abs", max_size=30)


def table(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_edit_counts(a, b):
    d, ins, dele, sub = k.edit_counts(a, b)
    assert d == table(a, b)[-1][-1] == ins + dele + sub and ins - dele == len(b) - len(a)


def test_edit_counts_settle_ties_by_kind():
    assert k.edit_counts("kitten", "sitting") == (3, 1, 0, 2)
    assert k.edit_counts("the quick brown fox".split(), "the swift brown fox".split()) == (1, 0, 0, 1)
    assert k.edit_counts("", "ab") == (2, 2, 0, 0)
    r = random.Random(0)
    a = "".join(r.choices("abcd", k=3000))
    b = a[:500] + "zz" + a[510:2000] + a[2400:]
    assert k.edit_counts(a, b)[0] <= 412


def test_accuracy():
    assert k.accuracy([], ["1", "2"]) == (1.0, 0, 0)
    assert k.accuracy(["12"], ["1", "2", "3"]) == (-2.0, 1, 3)


def test_bleu():
    t = "the cat sat on the mat".split()
    assert k.bleu(t, t) == 1.0 and k.bleu([], t) == 0.0 and k.bleu(["a"], ["b"]) == 0.0
    assert 0 < k.bleu(t, t[:3]) < k.bleu(t, t[:5]) < 1


def test_hallucinations():
    assert k.hallucinations("the quick brown fox".split(), "the swift brown fox".split(), {"swift"}) == (0.25, 1, 1)
    assert k.hallucinations("hello world".split(), "hel1o w0rld".split(), {"hello"}) == (0.0, 0, 0)


def test_taxonomy():
    assert {x: n for x, n in k.error_taxonomy("sin", "fin").items() if n} == {"long_s_to_f": 1, "long_s_total": 1, "total_errors": 1}
    got = k.error_taxonomy("ab cd", "abb cd!")
    assert got["artifact_duplicate"] == 1 and got["artifact_punctuation"] == 1 and got["total_errors"] == 2
    assert k.artifact_taxonomy("abc", "axc")["substitutions"] == 1


def test_entity_text():
    assert k.entity_text("The Slaves.", person=True, singular=True) == "slave"
    assert k.entity_text("St. Paul’s", abbreviations=True) == "saint paul's"
    assert k.entity_text("  “Ja-maica” ") == "'ja-maica'"


def test_align():
    got = k.align({("jamaica", "T"), ("sugar", "C")}, {("jamaica", "T"), ("sugar", "T"), ("rum", "C")})
    assert [x[0] for x in got] == ["strict", "substitution", "spurious"]
    assert k.align({("new england", "T")}, {("england", "T"), ("old england", "T")})[0] == ("partial", "new england", "T", "england", "T")


def test_partial_counts():
    assert k.partial_counts({"lords of trade and plantations"}, {"lords of trade", "rum"}) == (1, 1, 0)


def test_sentence_chunks():
    text = ("word " * 30 + "end. ") * 40
    got = k.sentence_chunks(text)
    assert len(got) > 1 and all(len(c) <= 2000 for c in got) and text.startswith(got[0]) and text.endswith(got[-1])
    assert k.sentence_chunks("short") == ["short"]


def test_rejoin():
    assert k.rejoin(["Im-", "porter of goods"], {"importer"}) == (["Importer", "of goods"], 1)
    assert k.rejoin(["sur", "prise"], set())[1] == 0
    assert k.rejoin(["a consi", "der it"], {"consider"}) == (["a consider", "it"], 1)


def test_occurrences():
    assert k.occurrences("Sugar, sugar", "SUGAR") == [(0, 5), (7, 12)]
    assert k.first_unused("a b a", ["a", "a", "a"]) == [(0, 1), (4, 5), (None, None)]
    assert k.first_unused("New\n England", ["New England"]) == [(0, 12)]
    assert k.first_unused("New England and New", ["New England", "New"]) == [(0, 11), (16, 19)]
    assert k.first_unused("aaa", ["aa", "aa", "aa"]) == [(0, 2), (1, 3), (None, None)]


def test_diverse():
    v = np.array([[1, 0], [1, 0.01], [0, 1]])
    assert k.diverse(v, [1.0, 0.99, 0.5], 2) == [0, 2]


def test_edits_of_one_kind_need_no_band():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(2))
        found = k.plain_edits(a, b)
        if found:
            assert found == k.plain_edits(list(a), list(b))
            rows = k._banded(np.array(list(a)), np.array(list(b)), len(a) + len(b))
            assert found[0] == rows[len(a), 2 * len(b)] == sum(found[1:])
    text = "".join(r.choice("this men ") for _ in range(200_000))
    assert k.edit_counts(text, text.replace("s", "f")) == (n := text.count("s"), 0, 0, n)
    assert k.edit_counts(text, text.replace("th", "t")) == (n := text.count("th"), 0, n, 0)
    assert k.edit_counts(text, text.replace("en", "een")) == (n := text.count("en"), n, 0, 0)


def test_longest_blocks_are_those_of_difflib():
    r = random.Random(4)
    words = ["the", "then", "es", "oves", "een", "en", "stad", "mist"]
    for n in range(60):
        a = " ".join(r.choice(words) for _ in range(r.randrange(2, 120)))
        b = [a.replace("s", "f"), a.replace("th", "t"), " ".join(r.choice(words) for _ in range(80)), a[50:] + a[:70]][n % 4]
        assert k.longest_blocks(a, b, 8, 3).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    line = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(7)) for _ in range(12_000))
    began = time.process_time()
    assert k.error_taxonomy(line, line.replace("s", "f"))["long_s_to_f"] == line.count("s")
    assert time.process_time() - began < 20


def test_changes_are_those_of_difflib():
    import difflib
    import random
    import time

    r = random.Random(8)
    for n, letters in [(9, "ab"), (60, "abc"), (150, "etaoin shrdlu"), (199, "abcdefghijklmnopqrstuvwxyz "), (200, "abcdefghijklmnopqrstuvwxyz "), (260, "ab" + "".join(map(chr, range(200, 320)))), (900, "etaoinshrdlu  " + "".join(map(chr, range(200, 500))))]:
        for _ in range(25):
            a = "".join(r.choice(letters) for _ in range(r.randint(0, n)))
            b = r.choice([a.replace("s", "f"), a.replace("e", "ee"), a.replace("th", "t"), "".join(r.choice([c, c, c, "", r.choice(letters)]) for c in a), "".join(r.choice(letters) for _ in range(n))])
            want = [x[1:] for x in difflib.SequenceMatcher(None, a, b).get_opcodes() if x[0] != "equal"]
            assert list(k.changes(a, b)) == want, (a, b)
    lines = ["".join(r.choice("etaoinshrdlu  ") for _ in range(190)) for _ in range(60)]
    t = time.process_time()
    want = [[x[1:] for x in difflib.SequenceMatcher(None, x, x.replace("s", "f")).get_opcodes() if x[0] != "equal"] for x in lines]
    u = time.process_time()
    assert [list(k.changes(x, x.replace("s", "f"))) for x in lines] == want
    assert time.process_time() - u < (u - t) / 2


def test_a_scanners_habits_are_read_off_in_one_pass():
    import random

    r = random.Random(2)
    for _ in range(300):
        ref = "".join(r.choice("sfthen é") for _ in range(r.randint(0, 60)))
        for a, b in (("s", "f"), ("th", "t"), ("en", "een"), ("", "")):
            assert k.plain_edits(ref, ref.replace(a, b) if a else ref) is not None


def test_distance_is_the_whole_table():
    r = random.Random(11)
    for _ in range(400):
        a, b = ([r.choice("abcdé") for _ in range(r.randint(0, 90))] for _ in "ab")
        b = b if r.random() < 0.3 else [x for x in a if r.random() > 0.1] + b[: r.randint(0, 3)]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        assert k.distance(a, b) == k.distance("".join(a), "".join(b)) == row[-1]
    long = "the southern seas " * 3000
    assert k.distance(long, "x" + long.replace("the", "teh", 40)[:-1]) == 82  # a table of three billion cells


def test_page_measures_are_those_of_each_measure():
    r = random.Random(12)
    stop = set(vocab.STOP_WORDS)
    some = ["the", "sor", "for", "is", "if", "Been", "been", "ben", "st.", "--", "12,5", "£3", "É1", "Élan", "\x1dx", "tthe", "naïve", "Ⓐb", "Who", "á", "½", "ǅa", "", "A", "McA"]
    lexicon = {"ben", "for", "seen", "12,5", "naïve"}
    letters = lambda w: "".join(c for c in w if unicodedata.category(c)[0] in "LN")
    tells = lambda ws: [w for w in ws if letters(w) and w not in stop]
    caps = lambda ws: [w.lower() for w in ws if w and unicodedata.category(w[0]) == "Lu" and w.lower() not in stop]
    swaps = [("s", "f"), ("th", "t"), ("en", "een"), ("", ""), ("f", "s"), (" ", " \t"), ("Be", "be ")]
    measured = k.page_measures(lexicon=lexicon)
    for _ in range(1500):
        raw = r.choice(["", " "]) + r.choice([" ", "  ", "\n"]).join(r.choice(some) for _ in range(r.randint(1, 25)))
        swap = r.choice(swaps)
        other = raw.replace(*swap) if swap[0] else raw
        if r.random() < 0.2:
            other += " seen"
        ref, hyp = raw.lower(), other.lower()
        rw, hw = k.words(ref), k.words(hyp)
        want = k.edit_counts(ref, hyp) + k.edit_counts(rw, hw) + k.accuracy(tells(rw), tells(hw)) + k.accuracy(caps(k.words(raw)), caps(k.words(other)))
        want += k.accuracy(*(re.findall(vocab.NUMBER_GROUP, t, re.ASCII) for t in (ref, hyp)))
        made = [w for w in hw if w not in rw and letters(w) and {w.lower(), letters(w).lower()} & lexicon]
        assert measured(ref, hyp, raw, other) == (*want, k.bleu(rw, hw), len(rw), len(hw), len(made), len(set(made)))


def test_unlike_ranges_are_those_of_difflib():
    r = random.Random(3)
    swaps = [lambda t: t.replace("s", "f"), lambda t: t.replace("th", "t"), lambda t: t.replace("en", "een"), lambda t: "".join(r.choice("aen") if r.random() < 0.05 else c for c in t), lambda t: t[::-1]]
    for _ in range(250):
        word = "".join(r.choice("aens th") for _ in range(r.randint(1, 9))) * r.choice([0, 1, 40])
        ref = "".join(c for c in word if r.random() > 0.004) + "".join(r.choice("aenst h") for _ in range(r.randint(0, 250)))
        hyp = r.choice(swaps)(ref)
        want = [o[1:] for o in SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes() if o[0] != "equal"]
        assert list(k.unlike(ref, hyp)) == want


def test_unlike_ranges_of_a_repeated_word():
    line = "annt " * 12_000
    began = time.time()
    assert sum(1 for _ in k.unlike(line, line.replace("n ", "nn ").replace("nt", "n"))) == 12_000
    assert time.time() - began < 5  # from one longest match to the next it took minutes
