"""Divergence of sources, prefix trie, SimHash: each held against a brute-force version on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import divergence, prefix_trie, simhash

DOCS = "doc_id long, text string, lang string, source string, n long, p long, z long, term string, item string, value string, rank string, fp string, label string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def doc_rows():
    r = random.Random(5)
    words = [r.choice("abcdefgh") + r.choice(["an", "é", "OR", "ß", "日"]) * r.randint(1, 3) for _ in range(40)]
    out = [(i, " ".join(r.choice(words) + r.choice(["", ".", "1", "\n", "\x00"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "é"])) for i in range(120)]
    out += [(200, LONG, "en", "s1"), (201, LONG, "en", "s2"), (202, LONG.upper(), "en", "s9"), (203, None, "fr", "s1"), (204, "", "fr", "s2"), (205, "only here", "it", "s1"), (None, None, None, None)]
    out += [(206, "Tie tie TIE", "xx", "a"), (206, "Tie tie TIE", "xx", "a"), (207, "tie", "xx", "b"), (208, "a b c", "en", "s1"), (209, "a b c", "en", "s1")]
    return [(*x, 1, 2, 3, "t", "i", "v", "r", "f", "l") for x in out]


def brute_divergence(rows, least=3, top=200):
    df, n, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold)
        groups.add((lang, source))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]
        v = len(kept)

        def p(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept) + v
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        own, every = p(n[lang, source]), p(sum((n[g] for g in groups if g[0] == lang), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(own[t], q[t]) for t in kept)) for (la, s) in groups if la == lang and s != source for q in [p(n[la, s])]]
        terms = [(t, f(own[t], every[t])) for t in kept if n[lang, source][t] and own[t] > every[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 5)])
def test_divergence(spark, least, top):
    docs = spark.createDataFrame(doc_rows(), DOCS).repartition(3)
    got = [tuple(r) for r in divergence.divergences(docs, least, top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_divergence(doc_rows(), least, top)


def test_divergence_empty_and_pieces(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).count() == 0
    raw = ("Añb c1d " * 50).encode().translate(divergence.FOLD)
    cut = list(divergence.pieces(raw, 7))
    assert b"".join(cut) == raw and [w for c in cut for w in c.split()] == raw.split()


def test_smoothed_beyond_64_bits(spark):
    big = spark.range(1).select(divergence.smoothed(F.lit(5 * 10**12), F.lit(7 * 10**12)).alias("p")).first()["p"]
    assert big == 1 + 10**9 * (5 * 10**12 + 1) // (7 * 10**12)


TURNS = "conv_id long, turn long, role string, text string, pos string, ids string, bucket string, depth string"


def turn_rows(n=90, seed=4):
    r = random.Random(seed)
    out = [(c, t, ["user", "assistant", None][t % 3], r.choice(["ok", "no", "é" * r.randint(0, 3), None])) for c in range(n) for t in range(r.choice([1, 2, 3, 9, 14]))]
    out += [(500 + c, t, "user", "same") for c in range(60) for t in range(12)]
    out += [(700, None, "user", "first"), (700, 0, "user", "then"), (700, 0, "user", "then"), (700, 0, "assistant", "tie"), (None, 0, "user", "lost"), (-7, 0, "user", "minus"), (705, 0, "user", "x" * 300_000)]
    r.shuffle(out)
    return [(*x, "p", "i", "b", "d") for x in out]


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((0, 0) if turn is None else (1, turn), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(x[1], x[3]) for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in children[path])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("local", [60, 16_384])
def test_trie(spark, local, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    turns = spark.createDataFrame(turn_rows(), TURNS).repartition(3)
    got = sorted(tuple(-99 if v is None else v for v in r) for r in prefix_trie.trie(turns, local).collect())
    assert got == brute_trie(turn_rows())


def test_trie_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Places to the least place reachable."""
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4] for i in range(len(fps))]
    changed = True
    while changed:
        changed = False
        for i, some in enumerate(near):
            low = min(label[j] for j in some)
            if low < label[i]:
                label[i], changed = low, True
    return label


def simhash_rows():
    r = random.Random(8)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "été"]) + str(r.randint(0, 300)) for _ in range(150)) for _ in range(25)]
    texts = [*base, *(t.replace("alpha1", "omega1", 1) for t in base), *(t + " tail" for t in base), base[0], base[0].upper(), None, "", " \n", "one two", "ONE\x0btwo", LONG, LONG + " more", "Ünï\xa0x y"]
    return [(i if i != 3 else None, t, "en", "s", 1, 2, 3, "t", "i", "v", "r", "f", "l") for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [2_000_000, 5])
def test_simhash(spark, most):
    rows = simhash_rows()
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, DOCS).repartition(3), most, 1).collect()}
    fps = [brute_fingerprint(x[1]) for x in rows]
    label = brute_components(fps)
    least = {k: min((x[0] for x, c in zip(rows, label, strict=True) if c == k and x[0] is not None), default=None) for k in set(label)}
    assert got == {(x[0], f"{f:016x}"): least[k] for x, f, k in zip(rows, fps, label, strict=True)}
    assert len(set(label)) < len(rows) - 30  # near copies do meet


def test_simhash_cells(spark):
    """Whatever the cells' size, all that is joined by links within four bits is joined; clustered and spread fingerprints."""
    r = np.random.default_rng(3)
    spread, seeds = r.integers(0, 2**64, 400, dtype=np.uint64), r.integers(0, 2**64, 12, dtype=np.uint64)
    close = np.concatenate([seeds ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(20)])
    fps = np.unique(np.concatenate([spread, close, np.array([0, 1, 2**64 - 1, 1 << 63], np.uint64)]))
    label = brute_components([int(x) for x in fps])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for most, first in ((2_000_000, 4), (20, 1), (3, 2)):
        pairs = [(row["a"] % 2**64, row["b"] % 2**64) for row in simhash.linked(df, most, first).collect()]
        own = {int(x): i for i, x in enumerate(fps)}
        parent = list(range(len(fps)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            x, y = root(own[a]), root(own[b])
            parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(fps))] == label


@pytest.mark.parametrize("dense", [False, True])
def test_near_places(dense):
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 900, dtype=np.uint64)
    if dense:
        a = a[:1] ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64))
    a = np.unique(a)
    for b, same in ((a, True), (np.unique(a[::2] ^ np.uint64(9)), False)):
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
        want = sorted((i, j) for i, j in zip(*np.nonzero(near), strict=True) if not same or i < j)
        assert sorted(p for i, j in simhash.near_places(a, b, same) for p in zip(i.tolist(), j.tolist(), strict=True)) == want


def test_simhash_empty(spark):
    assert simhash.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity_scores_by_definition(spark, tmp_path):
    """The query against a fit of the same rows and a sum over all pairs of terms, absent ones too, term by term."""
    from vellum.llm import toxicity_fm

    r = random.Random(12)
    calm, rude, group = ["Walk", "tea", "house", "river", "window"], ["trashy", "awful"], ["northern", "folk"]
    texts = [" ".join(r.choices(calm, k=r.randint(0, 12)) + (r.choices(rude, k=1) if i % 3 == 0 else []) + (r.choices(group, k=1) if i % 2 == 0 else [])) for i in range(90)]
    texts += [None, "", "trashy, (Northern) trashy", "unseen words only", "tie", "tie", "folk " * 30_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 7, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {x["doc_id"]: x for x in toxicity_fm.toxicity_scores(spark, str(tmp_path)).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    machine = toxicity_fm.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")).filter((F.crc32(F.col("doc_id").cast("string")) % 4) != 2))
    live = np.flatnonzero(machine.p)
    assert len(live) > 5 and len(got) == len(texts)
    for i, text in enumerate(texts):
        counts: collections.Counter = collections.Counter()
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            bare = word.lower().strip(".,;:!?\"'()[]{}#*$%&|<>_-")
            counts[zlib.crc32(bare.encode()) % 2**18] += 1
            if len(bare) > 4:
                counts[zlib.crc32(b"^" + bare[:4].encode()) % 2**18] += 1
        x = {t: n * machine.scale[t] for t, n in counts.items()}
        size = np.sqrt(max(sum(v * v for v in x.values()), 1e-12))
        z = machine.bias + sum(machine.w[t] * v for t, v in x.items()) / size
        c = {t: (t in counts) - machine.p[t] for t in live.tolist()}
        pairs = sum(c[a] * c[b] * float(machine.v[a] @ machine.v[b]) for k, a in enumerate(c) for b in list(c)[:k])
        z += pairs / np.sqrt(max(sum(t in c for t in counts), 1))
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["held_out"] == (fold(i) == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert got[94]["score"] == got[95]["score"]
