"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

1. Fingerprints: XXH64 (seed 42) of every shingle of four words, repeats included; a bit is set if it is in over half of
   them. Texts are read whole; bits are added up a block of shingles at a time.
2. Equal fingerprints are one row with their least doc_id, so copies cost nothing further on.
3. The trie's upper part is laid out by counts: a node of at most ``CELL`` fingerprints, at depth ``FIRST`` or below, is
   a cell; larger ones are split by their next eight bits until none is left. Two nodes are joined by their children:
   equal bits keep the number of differing bits, unequal ones add one, and a pair over ``BITS`` is dropped. What is left
   at the cells is the list of cell pairs, some ``N / CELL`` of them times the cells within four bits.
4. Each cell's fingerprints, sorted, are packed into blobs; a pair's blobs meet in one task, which goes on with the
   same traversal: all node pairs of a level at once, in arrays, until few fingerprints are left on both sides, whose
   differing bits are counted. Memory is bounded by two cells and ``STEP`` node pairs.
5. In a dense group everything links to everything, so a task keeps labels and returns one row per fingerprint that
   links to another (with the least it can reach there), not one per pair.
6. Components of these rows over all cell pairs by minimum label and pointer jumping over stored tables.

Only counts of trie nodes come to the driver (at most 256 a node that is split), never fingerprints or links.

Defined results: null and blank texts have the fingerprint zero and link like any other; texts of one to three words
have one shingle, all their words; repeated rows each give a row; documents without an id take part but name no
component unless it has no other; a text may be of any length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, near_dedup, tokens

SHINGLE, BITS, SEED = 4, 4, 42
#: Least depth of a cell and most fingerprints of one; fingerprints of a blob.
FIRST, CELL, BLOB = 4, 2_000_000, 65_536
#: Node pairs that are followed at once, and comparisons.
STEP, COMPARE, LEAF = 100_000, 2_000_000, 12


def fingerprint(raw: bytes, block: int = 65_536) -> int:
    """Of a text in UTF-8; shingles are cut from the words joined by one space."""
    import numpy as np
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(sizes + 1) - 1
    starts, k = ends - sizes, min(SHINGLE, len(sizes))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    of, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        some = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)
        hashes = np.array([of(joined[a:b], SEED) for a, b in some], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for b in tokens.slices(whole, 128):
            found = [fingerprint(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        common.give_back()


def cell_layout(fps: DataFrame, most: int = CELL, first: int = FIRST) -> dict:
    """(depth, prefix) to count of the trie's nodes down to its cells; only counts are read, some 256 for each node that is split."""
    nodes: dict = {}
    open_, depth = {(0, 0)}, 0
    while open_ and depth < 64:
        step = min(8, 64 - depth)
        at = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
        under = fps if not depth else fps.join(F.broadcast(fps.sparkSession.createDataFrame([(p,) for _, p in open_], "p long")), at(depth) == F.col("p"), "left_semi")
        counts = under.groupBy(at(depth + step).alias("p")).count().collect()  # at most 256 rows for each node of ``open_``
        for d in range(depth + 1, depth + step + 1):
            for p, n in counts:
                key = (d, p % (1 << 64) >> (depth + step - d))
                nodes[key] = nodes.get(key, 0) + n
        depth += step
        open_ = {(depth, p % (1 << 64)) for p, n in counts if n > most}
    return {k: n for k, n in nodes.items() if k[0] <= first or nodes.get((k[0] - 1, k[1] >> 1), 0) > most}


def cell_pairs(nodes: dict, budget: int = BITS) -> tuple[list, list]:
    """Cells (depth, prefix), and pairs of their places whose common bits differ in at most ``budget``: the trie's upper part joined with itself."""
    inner = {(d - 1, p >> 1) for d, p in nodes} - {(0, 0)}
    cells = sorted((k for k in nodes if k not in inner), key=lambda k: k[1] << (64 - k[0]))  # in the order of fingerprints
    place = {k: i for i, k in enumerate(cells)}
    down = lambda k: [c for c in ((k[0] + 1, 2 * k[1]), (k[0] + 1, 2 * k[1] + 1)) if c in nodes] if k == (0, 0) or k in inner else [k]
    pairs, todo = [], [((0, 0), (0, 0), 0)]
    while todo:
        a, b, differ = todo.pop()
        if a in place and b in place:
            pairs.append((place[a], place[b]))
            continue
        if a == b:
            own = down(a)
            todo += [(c, c, 0) for c in own] + ([(*own, 1)] if len(own) == 2 else [])
            continue
        # the upper of two goes down, at equal depth both do; where one is a cell, the other
        lefts, rights = (down(a) if a[0] <= b[0] or b in place else [a]), (down(b) if b[0] <= a[0] or a in place else [b])
        for x in lefts:
            for y in rights:
                d = min(x[0], y[0])
                now = ((x[1] >> (x[0] - d)) ^ (y[1] >> (y[0] - d))).bit_count()
                if now <= budget:
                    todo.append((x, y, now))
    return cells, pairs


def packed(cells: list):
    """Sorted signed fingerprints to (cell, fps) blobs; cells are runs of them."""
    import numpy as np

    starts = np.array([p << (64 - d) for d, p in cells], np.uint64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            cell = np.searchsorted(starts, fps, side="right") - 1
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(fps)]]) if len(fps) else np.zeros(1, int)
            runs = [(i, min(i + BLOB, hi)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for i in range(lo, hi, BLOB)]
            yield pa.RecordBatch.from_arrays([pa.array([int(cell[i]) for i, _ in runs], pa.int32()), pa.array([fps[i:j].tobytes() for i, j in runs], pa.binary())], names=["cell", "fps"])

    return run


def near_places(a, b, same: bool, budget: int = BITS):
    """(places in a, places in b) within ``budget`` bits, in portions: two tries in sorted arrays, traversed together."""
    import numpy as np

    if not len(a) or not len(b):
        return
    one = np.uint64(1)

    def split(x, lo, hi, depth):
        """Where the bit at ``depth`` turns to one within runs that agree above it."""
        bit = one << np.uint64(63 - depth)
        high = x[lo] >> np.uint64(63 - depth) >> one << one << np.uint64(63 - depth) if depth else np.zeros(len(lo), np.uint64)
        return np.clip(np.searchsorted(x, high | bit), lo, hi)

    todo = [(0, *(np.array([v], np.int64) for v in (0, len(a), 0, len(b))), np.zeros(1, np.int8))]
    while todo:
        depth, al, ah, bl, bh, differ = todo.pop()
        if len(al) > STEP:
            half = len(al) // 2
            todo += [(depth, *(v[:half] for v in (al, ah, bl, bh, differ))), (depth, *(v[half:] for v in (al, ah, bl, bh, differ)))]
            continue
        few = (np.maximum(ah - al, bh - bl) <= LEAF) | (depth == 64)
        if few.any():
            yield from _compared(a, b, al[few], ah[few], bl[few], bh[few], same, budget)
        al, ah, bl, bh, differ = (v[~few] for v in (al, ah, bl, bh, differ))
        if not len(al):
            continue
        am, bm = split(a, al, ah, depth), split(b, bl, bh, depth)
        own = same & (al == bl) & (ah == bh)  # a node with itself: one of its two unequal pairs is enough
        kids = [(al, am, bl, bm, differ, None), (am, ah, bm, bh, differ, None), (al, am, bm, bh, differ + 1, None), (am, ah, bl, bm, differ + 1, ~own)]
        parts = []
        for kal, kah, kbl, kbh, kd, also in kids:
            keep = (kah > kal) & (kbh > kbl) & (kd <= budget)
            if also is not None:
                keep &= also
            parts.append([v[keep] for v in (kal, kah, kbl, kbh, kd)])
        joined = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        if len(joined[0]):
            todo.append((depth + 1, *joined))


def _compared(a, b, al, ah, bl, bh, same, budget):
    import numpy as np

    wide = bh - bl
    combos = (ah - al) * wide
    total = np.cumsum(combos)
    at = 0
    while at < len(al):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + COMPARE, side="right")))
        n = combos[at:end]
        which = np.repeat(np.arange(at, end), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        row = k // wide[which]
        i, j = al[which] + row, bl[which] + k - row * wide[which]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        at = end


class Labels:
    """Least label of each place, as links come in."""

    def __init__(self, n: int):
        import numpy as np

        self.of = np.arange(n)

    def link(self, i, j) -> None:
        import numpy as np

        of = self.of
        while True:
            x, y = of[i], of[j]
            open_ = x != y
            if not open_.any():
                return
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while True:  # to the roots
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def pair_links(batch):
    """A pair's blobs to (a, b): each fingerprint that links to another here, and the least one it reaches here."""
    import numpy as np
    import pyarrow as pa

    side, blobs = batch.column("side").to_pylist(), batch.column("fps")
    load = lambda s: np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(blobs[i].as_buffer(), np.uint64) for i, x in enumerate(side) if x == s)]))
    a, b = load(0), load(1)
    same = 1 not in side
    labels = Labels(len(a) + (0 if same else len(b)))
    for i, j in near_places(a, a if same else b, same):
        labels.link(i, j if same else j + len(a))
    every = a if same else np.concatenate([a, b])
    own = np.flatnonzero(labels.of != np.arange(len(every)))
    out = pa.table({"a": pa.array(every[own].view(np.int64)), "b": pa.array(every[labels.of[own]].view(np.int64))})
    del a, b, every
    common.give_back()
    return out


def linked(fps: DataFrame, most: int = CELL, first: int = FIRST) -> DataFrame:
    """(a, b) of distinct fingerprints ``fps`` (fp): enough rows to join all that links of at most ``BITS`` bits join."""
    spark = fps.sparkSession
    cells, pairs = cell_pairs(cell_layout(fps, most, first))
    blobs = fps.select("fp").repartitionByRange("fp").sortWithinPartitions("fp").mapInArrow(packed(cells), "cell int, fps binary")
    blobs = common.materialize(blobs, "cells")
    sides = [(k, s, c) for k, (i, j) in enumerate(pairs) for s, c in ((0, i), (1, j)) if s == 0 or i != j]
    listed = spark.createDataFrame(sides, "pair int, side int, cell int")
    met = blobs.join(common.sent_if_small(listed), "cell").select("pair", "side", "fps")
    return met.groupBy("pair").applyInArrow(pair_links, "a long, b long")


def near_copies(docs: DataFrame, most: int = CELL, first: int = FIRST) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    common.small_batches(docs.sparkSession)
    rows = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    fps = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    count = fps.count()
    links = common.materialize(linked(fps, most, first), "links")
    found = near_dedup.components(links, count)
    named = fps.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    heads = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = common.materialize(named.join(heads.hint("merge"), "label").select("fp", "component_id"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of_fp.hint("merge"), "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: fingerprint and component of every document."""
    return near_copies(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
