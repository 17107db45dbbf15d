"""Packing into fixed windows: non-negative least squares over length combinations, then greedy residuals.

A document's ids are cut at window multiples: full windows stand alone, and only the remainder (1 to
window-1 ids) has to be combined with others. Each task packs what its scan split holds, in blocks of
bounded size, so there is no shuffle and no global state: for every block it takes the histogram of
remainder lengths, enumerates pairs and triples of lengths that fill a window exactly, solves the
repeat counts against the histogram by non-negative least squares, rounds them down and lays the
documents out; what rounding leaves is packed greedily, largest piece that fits first, cutting one
document where none fits. What stays open at a block's end goes into the next block. At the end of a
split the last, partly filled window is cut into sequences of power-of-two length, which need no
padding; every other sequence is full.

Defined results: a null text is empty; every document has its end id, so an empty one is one piece of
one id; a text of any length is cut into as many pieces as it needs; among documents of one length, which
are ties, the last to come is placed first; repeated rows are packed like any other; an empty table gives no
rows; extra columns are ignored. Sequence ids are unique and stable: the split's number, shifted, plus a counter.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def combinations(window: int):
    """Lengths (patterns x 3, 0 for none) that sum to the window: all pairs, and for each length a few spread triples."""
    import numpy as np

    pairs = {(a, window - a, 0) for a in range(1, window // 2 + 1)}
    triples = set()
    for a in range(1, window - 1):
        rest = window - a
        for share in (0.5, 0.35, 0.2, 0.08):
            b = max(1, round(rest * share))
            if 0 < rest - b < window:
                triples.add(tuple(sorted((a, b, rest - b))))
    return np.array(sorted(pairs) + sorted(triples), np.int64)


def solve_counts(histogram, window: int, rounds: int = 60):
    """Repeat counts x >= 0 that minimise ||A x - histogram||, by multiplicative updates, rounded so that no length is overdrawn."""
    import numpy as np

    combos = combinations(window)
    usable = combos[(np.where(combos > 0, histogram[combos], 1) > 0).all(1)]
    if not len(usable):
        return usable, np.zeros(0, np.int64)
    h = histogram.astype(float)
    h[0] = 0
    live = usable > 0
    seen = lambda v: (v[usable] * live).sum(1)  # noqa: E731  A' v
    made = lambda x: np.bincount(usable.ravel(), (x[:, None] * live).ravel(), window + 1)  # noqa: E731  A x
    goal, x = seen(h), np.full(len(usable), h.sum() / (2.0 * len(usable)))
    for _ in range(rounds):
        now = made(x)
        now[0] = 0
        x *= goal / np.maximum(seen(now), 1e-12)
    left, whole = histogram.copy(), np.zeros(len(usable), np.int64)
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 0.5:
            break
        need: dict[int, int] = {}
        for a in usable[p]:
            if a:
                need[int(a)] = need.get(int(a), 0) + 1
        n = min(int(x[p] + 0.5), *(int(left[a]) // k for a, k in need.items()))
        for a, k in need.items():
            left[a] -= n * k
        whole[p] = n
    return usable, whole


class Packer:
    """Packs one split. ``add`` and ``finish`` give rows (document, start, length, sequence, offset)."""

    def __init__(self, window: int, block_docs: int, first: int):
        self.window, self.block_docs, self.next = window, block_docs, first
        self.open: list = []  # remainders not yet laid out: (document, start, length)

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, n: int) -> list:
        """Full windows at once; the remainder waits for its block."""
        w, full = self.window, n // self.window
        rows = [(doc, k * w, w, self._sequence(), 0) for k in range(full)]
        if n % w:
            self.open.append((doc, full * w, n % w))
        return rows

    def block(self) -> list:
        import bisect

        import numpy as np

        w, rows = self.window, []
        by: dict[int, list] = {}
        for piece in self.open:
            by.setdefault(piece[2], []).append(piece)
        histogram = np.zeros(w + 1, np.int64)
        for a, pieces in by.items():
            histogram[a] = len(pieces)
        usable, counts = solve_counts(histogram, w)
        for p in np.flatnonzero(counts):
            lengths = [int(a) for a in usable[p] if a]
            for _ in range(int(counts[p])):
                seq, at = self._sequence(), 0
                for a in lengths:
                    doc, start, _n = by[a].pop()
                    rows.append((doc, start, a, seq, at))
                    at += a
        left = sum(a * len(v) for a, v in by.items())
        present = sorted(a for a, v in by.items() if v)
        while left >= w:
            seq, at = self._sequence(), 0
            while at < w:
                k = bisect.bisect_right(present, w - at) - 1
                a = present[max(k, 0)] if k >= 0 else present[-1]
                doc, start, n = by[a].pop()
                if not by[a]:
                    present.remove(a)
                take = min(n, w - at)
                rows.append((doc, start, take, seq, at))
                at += take
                if take < n:
                    by.setdefault(n - take, []).append((doc, start + take, n - take))
                    if len(by[n - take]) == 1:
                        bisect.insort(present, n - take)
            left -= w
        self.open = [piece for a in present for piece in by[a]]
        return rows

    def finish(self) -> list:
        rows = self.block()
        left, k = sum(p[2] for p in self.open), 0
        queue = list(self.open)[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            seq, at = self._sequence(), 0
            while at < size:
                doc, start, n = queue.pop()
                take = min(n, size - at)
                rows.append((doc, start, take, seq, at))
                at += take
                if take < n:
                    queue.append((doc, start + take, n - take))
            left -= size
            k += 1
        self.open = []
        return rows


def pack_partition(path: str | None, end_id: int, window: int, block_docs: int, with_ids: bool, frugal: bool = True):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = tokens.encoder(path, 250_000 if frugal else 800_000)
        packer = Packer(window, block_docs, TaskContext.get().partitionId() << 32)
        def out(rows):
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                cut = [r[0][2][4 * (r[1] - r[0][3]) : 4 * (r[1] - r[0][3] + r[2])] for r in some]
                columns = [
                    pa.array([r[0][0] for r in some], pa.int64()),
                    pa.array([r[1] for r in some], pa.int64()),
                    pa.array([r[2] for r in some], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array([r[0][1] for r in some], pa.int64()),
                    pa.array([r[3] for r in some], pa.int64()),
                    pa.array([r[4] for r in some], pa.int64()),
                ]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if with_ids:
                    columns.append(tokens.id_lists(np.cumsum([0, *(len(c) // 4 for c in cut)]), np.frombuffer(b"".join(cut), "<i4")))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for whole in batches:
            for b in tokens.slices(whole, 1024 if frugal else 2048):
                rows = []  # a document is its id, its length, the ids at hand and where they start
                starts, every = enc.encode(b.column(1), end_id)
                for doc_id, lo, hi in zip(b.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    ids, n = every[lo:hi].tobytes(), hi - lo
                    tail = n - n % window
                    rows += [((doc_id, n, ids, 0), *r[1:]) for r in packer.add(None, n)]
                    if n % window:
                        packer.open[-1] = ((doc_id, n, ids[4 * tail :], tail), *packer.open[-1][1:])
                yield from out(rows)
                if len(packer.open) >= block_docs:
                    yield from out(packer.block())
                if frugal:
                    common.give_back()
        yield from out(packer.finish())

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, window: int = 1024, block_docs: int = 8192, with_ids: bool = True, frugal: bool = True) -> DataFrame:
    """One row per piece, in the sequence and at the offset it was given, with its ids unless told not to.

    ``frugal`` workers know fewer words and hand memory back after every slice, at some CPU: for sessions in
    which other stages have filled the executors.
    """
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pack_partition(tokenizer, end_id, window, block_docs, with_ids, frugal), PIECES + ", ids array<int>" * with_ids)


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every piece of every document with the checksum of its ids."""
    return pack(common.table(spark, sf_dir, "documents"), with_ids=False, frugal=False)
