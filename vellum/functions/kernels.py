"""Algorithms that no Column expression covers, on plain Python values."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import repeat
from math import exp, log
from operator import contains

from vellum.functions import vocab


def plain_edits(ref, hyp) -> tuple[int, int, int, int] | None:
    """``edit_counts`` where two bounds meet, in one reading; else None.

    The distance is at least the difference in length, which is all there is to it where the shorter is left of the longer
    by leaving out. Of equal lengths, it is at most the number of places that differ, and at least that if what stands
    there in one stands there nowhere in the other. In each case all best paths are of one kind of edit.
    """
    n, m = len(ref), len(hyp)
    if n == m:
        if isinstance(ref, str) and isinstance(hyp, str):
            import numpy as np

            a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (ref, hyp))
            at = np.flatnonzero(a != b)
            gone, come = set(a[at].tolist()), b[at].tolist()
            k = len(at)
        else:
            changed = [(x, y) for x, y in zip(ref, hyp, strict=True) if x != y]
            gone, come, k = {x for x, _ in changed}, [y for _, y in changed], len(changed)
        return (k, 0, 0, k) if gone.isdisjoint(come) else None
    short, long = (hyp, ref) if m < n else (ref, hyp)
    if all(map(contains, repeat(iter(long)), short)):
        return abs(n - m), max(0, m - n), max(0, n - m), 0
    return None


def distance(ref, hyp) -> int:
    """The edit distance of two strings or lists of tokens, a column of the table at a time as the bits of whole numbers (Hyyro 2003)."""
    at, n, m = 0, len(ref), len(hyp)
    while at < n and at < m and ref[at] == hyp[at]:
        at += 1
    while n > at and m > at and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    ref, hyp = ref[at:n], hyp[at:m]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    places: dict = {}
    for i, x in enumerate(ref):
        places[x] = places.get(x, 0) | 1 << i
    n = len(ref)
    every, last = (1 << n) - 1, 1 << (n - 1)
    more, less, d = every, 0, n  # where a row's cost is one more, or one less, than the row's above
    for y in hyp:
        same = places.get(y, 0)
        across = ((((same & more) + more) ^ more) | same) & every
        up, down = less | (every ^ (across | more)), more & across
        d += 1 if up & last else -1 if down & last else 0
        up, down = (up << 1 | 1) & every, (down << 1) & every
        along = same | less
        more, less = down | (every ^ (along | up)), up & along
    return d


def edit_counts(ref, hyp) -> tuple[int, int, int, int]:
    """(distance, insertions, deletions, substitutions) of two strings or lists of tokens.

    Ties in the path are settled from the end: match, then substitution, deletion, insertion. Of equal lengths with no more
    places that differ than the distance, that path is the diagonal. Else only a band around the diagonal is filled: a path of
    cost d strays at most d from it, so a band of d holds all best paths.
    """
    import numpy as np

    n, m = len(ref), len(hyp)
    if ref == hyp:
        return 0, 0, 0, 0
    if not n or not m:
        return n + m, m, n, 0
    if found := plain_edits(ref, hyp):
        return found
    k = distance(ref, hyp)
    if n == m and k == sum(x != y for x, y in zip(ref, hyp, strict=True)):
        return k, 0, 0, k
    codes: dict = {}
    a = np.array([codes.setdefault(x, len(codes)) for x in ref])
    b = np.array([codes.setdefault(x, len(codes)) for x in hyp])
    rows, d = _banded(a, b, k), k
    i, j, ins, dele, sub = n, m, 0, 0, 0
    while i or j:
        c = j - i + k
        here = rows[i, c]
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and rows[i - 1, c] + 1 == here:
            i, j, sub = i - 1, j - 1, sub + 1
        elif i and c < 2 * k and rows[i - 1, c + 1] + 1 == here:
            i, dele = i - 1, dele + 1
        else:
            j, ins = j - 1, ins + 1
    return d, ins, dele, sub


def _banded(a, b, k: int):
    """Costs by row and place in the band (column = row + place - k)."""
    import numpy as np

    n, m, wide = len(a), len(b), 2 * k + 1
    far = n + m + 1
    rows = np.full((n + 1, wide), far, np.int32)
    place = np.arange(wide)
    rows[0] = np.where((place >= k) & (place - k <= m), place - k, far)
    padded = np.full(m + 2 * k + n + 2, -1, a.dtype)
    padded[k : k + m] = b
    for i in range(1, n + 1):
        lo, hi = max(0, k - i), min(wide, m - i + k + 1)  # columns 0 to m
        if lo >= hi:
            continue
        before = rows[i - 1]
        step = before[lo:hi] + (padded[i + lo - 1 : i + hi - 1] != a[i - 1])
        up = np.concatenate([before[lo + 1 : hi + 1], [far] * max(0, hi + 1 - wide)]) + 1
        best = np.minimum(step, up)
        if lo == k - i:
            best[0] = i
        at = place[lo:hi]
        rows[i, lo:hi] = np.minimum.accumulate(best - at) + at
    return rows


def rate(distance: int, length: int) -> float:
    return distance / length if length else 0.0


def accuracy(ref, hyp) -> tuple[float, int, int]:
    """(1 - distance / length, length, distance); 1 where nothing was there to be found. Can be negative."""
    if not ref:
        return 1.0, 0, 0
    found = (0,) if ref == hyp else plain_edits(ref, hyp)
    d = found[0] if found else distance(ref, hyp)
    return 1.0 - d / len(ref), len(ref), d


def bleu(ref: list, hyp: list, order: int = 4, epsilon: float = 0.1, changed: list[int] | None = None) -> float:
    """Sentence BLEU with uniform weights; a count of zero becomes epsilon (Chen and Cherry 2014, method 1).

    ``changed``: the places where lists of one length differ, if what stands there in ``hyp`` stands nowhere in ``ref``. Then
    a gram of ``hyp`` counts as often as it lies between two of them.
    """
    if not ref or not hyp:
        return 0.0
    total = 0.0
    runs = [b - a - 1 for a, b in zip([-1, *changed], [*changed, len(ref)], strict=True)] if changed is not None else None
    for n in range(1, order + 1):
        every = max(0, len(hyp) - n + 1)
        if runs is None:
            grams = lambda t: Counter(zip(*(t[i:] for i in range(n)), strict=False))  # noqa: B023, E731
            have, want = grams(hyp), grams(ref)
            hits = sum(min(c, want[g]) for g, c in have.items())
        else:
            hits = sum([r - n + 1 for r in runs if r >= n])
        if n == 1 and not hits:
            return 0.0
        total += log((hits or epsilon) / max(1, every)) / order
    return exp(total) * (1.0 if len(hyp) > len(ref) else exp(1 - len(ref) / len(hyp)))


#: Unicode's white space, as ``\s`` of Java's regular expressions under ``(?U)``.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NUMBERS, _DIGIT, _CAPITAL = re.compile(vocab.NUMBER_GROUP, re.ASCII), re.compile("[0-9]"), re.compile("[A-Z][^ ]*")


def words(text: str) -> list[str]:
    """White-space tokens, as ``text.words`` has them. In a printable text a space is the only white space."""
    if text.isprintable():
        return text.split()
    return _WHITE.sub(" ", text).strip(" ").split(" ") if text.strip(" ") else []


class Judged(dict):
    """A judgement of words that is looked up once it was made; forgotten when there are too many of them."""

    def __init__(self, judge, most: int = 1 << 17):
        self.judge, self.most = judge, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.judge(word)
        return found


def _bare(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if unicodedata.category(c)[0] in "LN")


KINDS = ("distance", "insertions", "deletions", "substitutions")
ACCURACY = ("accuracy", "total", "errors")
#: What is measured of a page, by part.
PAGE = {"char": KINDS, "word": KINDS, "significant": ACCURACY, "capitalized": ACCURACY, "numbers": ACCURACY, "bleu": ("score",), "words": ("ref", "hyp"), "made": ("up", "up_types")}


def page_measures(parts=tuple(PAGE), lexicon=frozenset()):
    """A function of (ref, hyp, ref_raw, hyp_raw) to the measures of one page, the parts of PAGE that are asked for in order.

    Texts are read once. Where ``hyp`` has as many words as ``ref``, and new ones where they differ (``changed``), word errors
    and BLEU follow from those places, and the errors among telling words too if none of them became one that isn't.
    """
    stop = frozenset(vocab.STOP_WORDS)
    capital = Judged(lambda w: w.lower() if unicodedata.category(w[0]) == "Lu" and w.lower() not in stop else None)
    real = Judged(lambda w: bool(bare := _bare(w)) and (w.lower() in lexicon or bare.lower() in lexicon))
    tells = lambda w: w not in stop and bool(w[:1].isalpha() or _bare(w))
    numbers = lambda t: _NUMBERS.findall(t) if _DIGIT.search(t) else []

    def capitals(text):
        if text.isascii() and text.isprintable():
            ws = [m[0] for m in _CAPITAL.finditer(text) if not m.start() or text[m.start() - 1] == " "]
        else:
            ws = [w for w in words(text) if w[:1].isupper()]
        return [c for w in ws if (c := capital[w]) is not None]

    def telling(rw, hw, same, changed):
        known = [w for w in rw if w not in stop and (w[:1].isalpha() or _bare(w))]
        if same or not known:
            return 1.0, len(known), 0
        if changed is not None:
            now = [(tells(rw[i]), tells(hw[i])) for i in changed]
            if (True, False) not in now:
                d = len(now) - now.count((False, False))
                return 1.0 - d / len(known), len(known), d
        return accuracy(known, [w for w in hw if tells(w)])

    def measured(ref, hyp, ref_raw, hyp_raw):
        same, rw = ref == hyp, words(ref)
        hw, there, changed, out = rw, None, [] if same else None, ()
        if not same:
            hw, there = words(hyp), set(rw)
            if len(rw) == len(hw):
                changed = [i for i, (x, y) in enumerate(zip(rw, hw, strict=True)) if x != y]
                changed = changed if there.isdisjoint([hw[i] for i in changed]) else None
        for part in parts:
            if part == "char":
                out += (0, 0, 0, 0) if same else edit_counts(ref, hyp)
            elif part == "word":
                out += (len(changed), 0, 0, len(changed)) if changed is not None else edit_counts(rw, hw)
            elif part == "significant":
                out += telling(rw, hw, same, changed)
            elif part == "capitalized":
                known = capitals(ref_raw or "")
                out += accuracy(known, known if ref_raw == hyp_raw else capitals(hyp_raw or ""))
            elif part == "numbers":
                known = numbers(ref)
                out += accuracy(known, known if same or not known else numbers(hyp))
            elif part == "bleu":
                out += (bleu(rw, hw, changed=changed),)
            elif part == "words":
                out += len(rw), len(hw)
            else:
                made = [] if same else [w for w in hw if w not in there and real[w]]
                out += len(made), len(set(made))
        return out

    return measured


_BASE = 0xD6E8FEB86659FD93
_POWERS: list = []


def _hashes(*texts: str):
    """A function of (side, lo, hi, n) to hashes of all grams of n characters within a range of a text."""
    import numpy as np

    size = max(map(len, texts)) + 1
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * size, x, np.uint64), dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    power, inverse = _POWERS
    sums = []
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)], dtype=np.uint64)]))
    return lambda side, lo, hi, n: (sums[side][lo + n : hi + 1] - sums[side][lo : hi - n + 1]) * inverse[lo : hi - n + 1]


def _grown(ref: str, hyp: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest piece that two ranges share, the first in ``ref``, then in ``hyp``: it grows while it still stands in the other range."""
    other, x, i, size = hyp[blo:bhi], alo, alo, 0
    while i + size < ahi:
        while i + size < ahi and ref[i : i + size + 1] in other:
            size, x = size + 1, i
        i += 1
    return x, blo + other.find(ref[x : x + size]), size


def longest_blocks(ref: str, hyp: str, least: int = 160, gram: int = 12):
    """difflib's matcher without junk, with the same blocks, for texts of any length.

    difflib walks, for each character, all its places in the whole other text. Here a range is cut to pieces where a gram
    isn't found in the other's range, and the longest piece, if it stands there whole, is the longest match; if not, its
    length is found by halving over hashes. What is found is looked up in the text, so hashes only speed it up. In ranges
    of at most ``least`` characters pieces grow.
    """
    from difflib import Match, SequenceMatcher

    import numpy as np

    grams = _hashes(ref, hyp)

    class Blocks(SequenceMatcher):
        def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
            ahi, bhi = len(ref) if ahi is None else ahi, len(hyp) if bhi is None else bhi
            shorter = min(ahi - alo, bhi - blo)
            if shorter and max(ahi - alo, bhi - blo) > least:
                lo, hi = 0, min(gram, shorter + 1)
                if shorter >= gram and (known := np.isin(grams(0, alo, ahi, gram), grams(1, blo, bhi, gram))).any():
                    edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
                    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    i = int(np.argmax(ends - starts))
                    at, n = alo + int(starts[i]), int(ends[i] - starts[i]) + gram - 1
                    if (j := hyp.find(ref[at : at + n], blo, bhi)) >= 0:
                        return Match(at, j, n)
                    lo, hi = gram, min(n, shorter) + 1  # matches are within pieces
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if np.isin(grams(0, alo, ahi, mid), grams(1, blo, bhi, mid)).any() else (lo, mid)
                for n in range(lo, 0, -1):
                    for at in np.flatnonzero(np.isin(grams(0, alo, ahi, n), grams(1, blo, bhi, n))).tolist():
                        if (j := hyp.find(ref[alo + at : alo + at + n], blo, bhi)) >= 0:
                            return Match(alo + at, j, n)
                return Match(alo, blo, 0)
            return Match(*_grown(ref, hyp, alo, ahi, blo, bhi))

    return Blocks(None, ref, hyp, autojunk=False)


def _chain(ref: str, hyp: str) -> list[list[int]] | None:
    """Pieces (i, j, size) that two texts share in order where they differ in one kind of edit, each as long as it can be; else None.

    Pieces may overlap where a gap could lie in more than one place, but none reaches over the whole of a neighbour's own part.
    """
    n, m, i, j, own = len(ref), len(hyp), 0, 0, []
    if n == m:
        import numpy as np

        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (ref, hyp))
        for at in [*np.flatnonzero(a != b).tolist(), n]:
            if i < at:
                own.append([i, i, at - i])
            i = at + 1
        return own
    while i < n and j < m:
        at = i
        while ref[i : i + 16] == hyp[j : j + 16] and i + 16 <= n:
            i, j = i + 16, j + 16
        for k in (8, 4, 2, 1):
            if ref[i : i + k] == hyp[j : j + k] and i + k <= n:
                i, j = i + k, j + k
        if i > at:
            own.append((at, j - (i - at), i - at))
        i, j = i + (n > m), j + (m > n)
    if n > m and j < m or m > n and i < n:
        return None
    found = []
    for k, (x, y, size) in enumerate(own):
        left, right = own[k - 1][:2] if k else (0, 0), (own[k + 1][0] + own[k + 1][2], own[k + 1][1] + own[k + 1][2]) if k + 1 < len(own) else (n, m)
        while x and y and ref[x - 1] == hyp[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < n and y + size < m and ref[x + size] == hyp[y + size]:
            size += 1
        if x < left[0] or y < left[1] or x + size > right[0] or y + size > right[1]:
            return None
        found.append([x, y, size])
    return found


def _anchors(ref: str, hyp: str) -> list[tuple[int, int, int]]:
    """Blocks that difflib's matcher finds, in order: those of the chain that are as long as a gram which is shared nowhere else.

    Whatever range is left, its longest match is then the longest piece of the chain in it, cut where a longer one was taken.
    """
    from heapq import heapify, heappop, heappush

    import numpy as np

    pieces = _chain(ref, hyp)
    if not pieces:
        return []
    most, grams = max([p[2] for p in pieces]), None

    def elsewhere(n):
        nonlocal grams
        if len(ref) < 1000:
            a, b = ([t[i : i + n] for i in range(len(t) - n + 1)] for t in (ref, hyp))
            once = set(b)
            met = sum(map(once.__contains__, a)) if len(once) == len(b) else sum(map(dict(Counter(b)).get, a, repeat(0)))
            return met != sum([p[2] - n + 1 for p in pieces if p[2] >= n])
        grams = grams or _hashes(ref, hyp)
        a, b = grams(0, 0, len(ref), n), np.sort(grams(1, 0, len(hyp), n))
        return (np.searchsorted(b, a, "right") - np.searchsorted(b, a)).sum() != sum([p[2] - n + 1 for p in pieces if p[2] >= n])

    least = min(10, most)
    if elsewhere(least):
        if elsewhere(most):
            return []
        shared, least = least, most
        while least - shared > 1:
            n = (shared + least) // 2
            shared, least = (n, least) if elsewhere(n) else (shared, n)
    if len(ref) == len(hyp):
        return [tuple(p) for p in pieces if p[2] >= least]  # on one diagonal: none overlap
    heap = [(-p[2], p[0], p[1], k) for k, p in enumerate(pieces)]
    heapify(heap)
    taken: dict[int, tuple] = {}
    while heap:
        size, x, y, k = heappop(heap)
        if k in taken or pieces[k] != [x, y, -size]:
            continue
        if -size < least:
            break
        size, taken[k] = -size, (x, y, -size)
        for step in (-1, 1):
            q = k + step
            while 0 <= q < len(pieces) and q not in taken:
                p = pieces[q]
                over = max(p[0] + p[2] - x, p[1] + p[2] - y) if step < 0 else max(x + size - p[0], y + size - p[1])
                if over <= 0:
                    break
                pieces[q] = p = [p[0] + over * (step > 0), p[1] + over * (step > 0), max(0, p[2] - over)]
                heappush(heap, (-p[2], p[0], p[1], q))
                q += step
    return [taken[k] for k in sorted(taken)]


def _swept(ref: str, hyp: str, least: int) -> list[tuple[int, int, int]]:
    """The longest match of two texts, and those as long that difflib's matcher finds behind it, one after the other; what is left of the texts shares nothing as long."""
    import numpy as np

    i, j, n = longest_blocks(ref, hyp, least).find_longest_match()
    if not n:
        return []
    grams = _hashes(ref, hyp)
    a, b = grams(0, 0, len(ref), n), grams(1, 0, len(hyp), n)
    order = np.argsort(b, kind="stable")
    b = b[order]
    lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, "right")
    found, x, y = [], 0, 0
    for i in np.flatnonzero(lo < hi).tolist():
        if i < x:
            continue
        here = order[lo[i] : hi[i]]
        for j in here[np.searchsorted(here, y) :].tolist():
            if ref[i : i + n] == hyp[j : j + n]:
                found.append((i, j, n))
                x, y = i + n, j + n
                break
    return found


def unlike(ref: str, hyp: str, least: int = 160):
    """What difflib's matcher without junk gives as opcodes but for equal ranges, as (a, b, c, d) without a kind."""
    blocks, todo = [(len(ref), len(hyp), 0)], [(0, len(ref), 0, len(hyp))]
    while todo:
        x, to, y, end = todo.pop()
        if max(to - x, end - y) <= (least if len(blocks) > 1 else 40):
            i, j, n = _grown(ref, hyp, x, to, y, end)
            found = [(i, j, n)] if n else []
        else:
            a, b = ref[x:to], hyp[y:end]
            found = [(x + i, y + j, n) for i, j, n in _anchors(a, b) or _swept(a, b, least)]
        blocks += found
        for i, j, n in [*found, (to, end, 0)] if found else ():
            if x < i and y < j and (i - x > 1 or j - y > 1 or ref[x] == hyp[y]):
                todo.append((x, i, y, j))
            x, y = i + n, j + n
    i = j = 0
    for x, y, n in sorted(blocks):
        if i < x or j < y:
            yield i, x, j, y
        i, j = x + n, y + n


TAXONOMY = ["long_s_to_f", "long_s_to_l", "long_s_total", "artifact_phantom", "artifact_duplicate", "artifact_punctuation", "other_insertions", "deletions", "substitutions_other", "total_errors"]


def error_taxonomy(ref: str, hyp: str) -> dict[str, int]:
    """Character errors by kind, from a longest-match alignment; blocks of unlike length are paired from their fronts."""
    n = dict.fromkeys(TAXONOMY, 0)
    total = fewer = other = 0
    for a, b, c, d in unlike(ref, hyp) if ref != hyp else ():
        gone, come = b - a, d - c
        if gone and come:
            for x, y in zip(ref[a:b], hyp[c:d], strict=False):
                if x == "s" and y in "fl":
                    n["long_s_to_" + y] += 1
                else:
                    other += 1
        if come > gone:
            total += come
            reach = 2 if gone else 3
            near = ref[max(0, a - reach) : b + reach].lower()
            for y in hyp[c + gone : d]:
                if y in vocab.PUNCTUATION:
                    n["artifact_punctuation"] += 1
                elif not y.isalpha():
                    n["other_insertions"] += 1
                else:
                    n["artifact_duplicate" if y.lower() in near else "artifact_phantom"] += 1
        else:
            total += gone
            fewer += gone - come
    n["long_s_total"] = n["long_s_to_f"] + n["long_s_to_l"]
    n["total_errors"], n["deletions"], n["substitutions_other"] = total, fewer, other
    return n


ARTIFACTS = ["phantom", "duplicate", "punctuation", "other_insertions", "deletions", "substitutions"]


def changes(ref: str, hyp: str):
    """What ``difflib.SequenceMatcher(None, ref, hyp).get_opcodes()`` gives but for equal ranges, as (a, b, c, d) without a kind.

    In a ``hyp`` of 200 characters or more difflib starts no match at one that makes up over a hundredth; it still reads all
    characters of a range for every block, and here only those that can start one are read. In shorter ones it walks all
    places of each character in Python; here the longest common piece grows while it still stands in the other range, which
    is a search for a string.
    """
    from bisect import bisect_left

    n, places, starts = len(hyp), {}, []
    if n >= 200:
        for j, c in enumerate(hyp):
            places.setdefault(c, []).append(j)
        places = {c: js for c, js in places.items() if len(js) <= n // 100 + 1}
        starts = [i for i, c in enumerate(ref) if c in places]

    def longest(alo, ahi, blo, bhi):
        if n < 200:
            return _grown(ref, hyp, alo, ahi, blo, bhi)
        x, y, size = alo, blo, 0
        before, last = {}, -1
        for i in starts[bisect_left(starts, alo) : bisect_left(starts, ahi)]:
            here = {}
            for j in places[ref[i]]:
                if j >= bhi:
                    break
                if j >= blo:
                    k = here[j] = before.get(j - 1, 0) + 1 if last == i - 1 else 1
                    if k > size:
                        x, y, size = i - k + 1, j - k + 1, k
            before, last = here, i
        while x > alo and y > blo and ref[x - 1] == hyp[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < ahi and y + size < bhi and ref[x + size] == hyp[y + size]:
            size += 1
        return x, y, size

    blocks, todo = [], [(0, len(ref), 0, n)]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        x, y, size = longest(alo, ahi, blo, bhi)
        if size:
            blocks.append((x, y, size))
            if alo < x and blo < y:
                todo.append((alo, x, blo, y))
            if x + size < ahi and y + size < bhi:
                todo.append((x + size, ahi, y + size, bhi))
    i = j = 0
    for x, y, size in [*sorted(blocks), (len(ref), n, 0)]:
        if i < x or j < y:
            yield i, x, j, y
        i, j = x + size, y + size


def artifact_taxonomy(ref: str, hyp: str) -> dict[str, int]:
    """The older, coarser kinds: whole replaced blocks count as substitutions, contexts reach two characters."""
    n: Counter = Counter()
    for a, b, c, d in changes(ref, hyp):
        if a < b and c < d:
            n["substitutions"] += max(b - a, d - c)
        elif a < b:
            n["deletions"] += b - a
        else:
            near = ref[max(0, a - 2) : a + 2].lower()
            for y in hyp[c:d]:
                n["punctuation" if y in vocab.PUNCTUATION else "other_insertions" if not y.isalpha() else "duplicate" if y.lower() in near else "phantom"] += 1
    return {k: n[k] for k in ARTIFACTS}


def hallucinations(ref: list, hyp: list, lexicon) -> tuple[float, int, int]:
    """(rate, tokens, types) of words that are in the lexicon, as written or bare, but nowhere in the reference."""
    known = set(ref)
    made = [w for w in hyp if w not in known and (bare := "".join(filter(str.isalnum, w))) and (w.lower() in lexicon or bare.lower() in lexicon)]
    return (len(made) / len(hyp) if hyp else 0.0), len(made), len(set(made))


def entity_text(text: str, *, person: bool = False, abbreviations: bool = False, singular: bool = False, possessive: bool = False, hyphens: bool = False) -> str:
    """Compatibility form, lower case, squeezed, quotes and dashes folded, surrounding punctuation off; then the rules asked for, in this order."""
    import re

    if not text:
        return ""
    t = " ".join(unicodedata.normalize("NFKC", text).lower().split())
    t = t.translate({ord(c): "'" for c in vocab.QUOTES} | {ord(c): "-" for c in vocab.DASHES}).strip(vocab.SURROUNDING).strip()
    if person:
        t = t.removeprefix("the ").strip() if t.startswith("the ") else t
    if abbreviations:
        t = " ".join(vocab.ABBREVIATIONS.get(w) or vocab.ABBREVIATIONS.get(w.rstrip(".")) or w for w in t.split())
    if singular:
        t = vocab.SINGULARS.get(t, t)
    if possessive:
        t = " ".join(re.sub(r"'s\b", "", t).split())
    if hyphens:
        t = " ".join(t.replace("-", " ").split())
    return t


def align(gold, pred) -> list[tuple]:
    """(category, gold text, gold label, predicted text, predicted label) over two sets of (text, label).

    Exact pairs first; then, each one to one in sorted order: containment under one label, equal texts
    under different labels, containment under different labels; the rest is missing or spurious.
    """
    g, p = set(gold), set(pred)
    out = [("strict", *x, *x) for x in sorted(g & p)]
    left, right = sorted(g - p), sorted(p - g)
    inside = lambda a, b: a in b or b in a
    rules = [
        ("partial", lambda a, b: a[1] == b[1] and inside(a[0], b[0])),
        ("substitution", lambda a, b: a[1] != b[1] and a[0] == b[0]),
        ("substitution", lambda a, b: a[1] != b[1] and inside(a[0], b[0])),
    ]
    for name, fits in rules:
        rest = []
        for a in left:
            b = next((b for b in right if fits(a, b)), None)
            if b is None:
                rest.append(a)
            else:
                right.remove(b)
                out.append((name, *a, *b))
        left = rest
    return out + [("missing", *a, None, None) for a in left] + [("spurious", None, None, *b) for b in right]


def partial_counts(gold: set, pred: set) -> tuple[int, int, int]:
    """(TP, FP, FN) where a prediction inside a gold text, or around it, counts; several may share one. Sorted order settles ties."""
    extra, missed = sorted(pred - gold), sorted(gold - pred)
    hits = {a: b for a in extra for b in [next((b for b in missed if a in b or b in a), None)] if b is not None}
    return len(gold & pred) + len(hits), len(extra) - len(hits), len(missed) - len(set(hits.values()))


def sentence_chunks(text: str, size: int = 2000, overlap: int = 200, look_back: int = 100) -> list[str]:
    """Windows that end behind a sentence, a paragraph or a line where one ends near."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            found = ((text.rfind(s, end - look_back, end), len(s)) for s in (". ", "\n\n", "\n"))
            end = next((p + n for p, n in found if p >= 0), end)
        out.append(text[at:end])
        if end == len(text):
            return out
        at = end - overlap


def rejoin(lines: list[str], lexicon: set) -> tuple[list[str], int]:
    """Words split over line ends put together on the upper line, from the top down, so that repairs chain. (lines, repairs)"""
    import re

    valid = lambda w: not lexicon or w.strip(".,;:!?'\"()-").lower() in lexicon
    lines, n = list(lines), 0
    for i in range(len(lines) - 1):
        head = re.match(r"\S+", lines[i + 1])
        if not head:
            continue
        cut = re.search(r"(\S+)-\s*$", lines[i])
        if not (cut and valid(cut[1] + head[0])):
            cut = re.search(r"(\S+)\s*$", lines[i])
            part = cut[1] if cut else ""
            whole = len(part) <= 3 or len(part) >= 8 or part.endswith(("ing", "ed", "er", "ly", "tion"))
            if whole or not valid(part + head[0]) or len(head[0]) >= 4 and valid(head[0]):
                continue
        lines[i] = lines[i][: cut.start()] + cut[1] + head[0]
        lines[i + 1] = re.sub(r"^\S+\s*", "", lines[i + 1])
        n += 1
    return lines, n


def occurrences(text: str, name: str) -> list[tuple[int, int]]:
    """Places of a name in a text in any case, left to right, not overlapping."""
    import re

    return [m.span() for m in re.finditer(re.escape(name), text, re.I)] if name else []


def first_unused(text: str, names: list[str]) -> list[tuple]:
    """(start, end) for each name in turn: the first place, overlapping ones too, at whose start no earlier name stands; else one with any white space; else (None, None)."""
    import re

    taken: set = set()
    out = []
    for name in names:
        at = text.find(name)
        while at in taken:
            at = text.find(name, at + 1)
        place = (at, at + len(name)) if at >= 0 else None
        if place is None:
            loose = "".join(r"\s+" if c.isspace() else re.escape(c) for c in name)
            place = next((m.span() for m in re.finditer(loose, text) if m.start() not in taken), None)
        if place:
            taken.add(place[0])
        out.append(place or (None, None))
    return out


def diverse(vectors, relevance, k: int) -> list[int]:
    """Greedy maximum a posteriori choice of a determinantal point process (Chen et al. 2018)."""
    import numpy as np

    x, q = np.asarray(vectors, float), np.asarray(relevance, float)
    kernel = q[:, None] * (x @ x.T) * q
    gain, rows, chosen = np.diag(kernel).copy(), [], []
    for _ in range(min(k, len(x))):
        j = int(np.argmax(gain))
        if gain[j] <= 1e-12:
            break
        c = np.array(rows) if rows else np.zeros((0, len(x)))
        e = (kernel[j] - c.T @ c[:, j]) / np.sqrt(gain[j])
        rows.append(e)
        gain = gain - e**2
        gain[j] = -np.inf
        chosen.append(j)
    return chosen
