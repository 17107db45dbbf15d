"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Copies: texts are keyed by MD5, and one node stands for all rows of a text.
2. Weights: a shingle of five words weighs its count in the text times its inverse document frequency,
   1 + ln(1 + N / df) / ln(1 + 1 / rare), from one for shingles of every document to two for rare ones. The
   range is narrow on purpose: the passages of a large group of near copies are frequent for being copied, and
   an undamped IDF would tear such groups apart. Document frequencies are exact: a first pass over all rows names
   whatever may reach the edge (each task counts some 4 million shingles at a time and leaves out what too few rows
   hold for that), a second one counts what was named; so they don't depend on how rows are dealt. Shingles in
   fewer than ``rare`` of the rows share the weight of that edge. At most ``MOST`` shingles are sent to the tasks,
   whatever the corpus: as df sums to the number of shingles of all rows, the edge is set where no more can pass.
3. Sketch: for sample k, the element that minimises ln c - r (t - b) - r, with t = floor(ln w / r + b),
   r and c gamma, b uniform, all functions of element and k (Ioffe 2010). Two texts agree in a sample
   with odds of their weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` samples make buckets.
4. Candidates: in a bucket every node is paired with the bucket's first node, not with all others; pairs that
   agree in less than half of all samples are dropped (at a similarity of 0.8 with odds of 5 in 100,000). After
   the first components are known, buckets that still hold several are looked at again, and all pairs across
   components are tested. Where a bucket has more than ``small`` nodes, its nodes are dealt into blocks by
   their hash, those of its largest component apart from the others; each pair of blocks that can hold a pair
   across components is one cell, compared and verified at once, so that no row is made per pair and no task
   holds a bucket.
5. Verification: the texts of a pair are read and their weighted Jaccard similarity is computed exactly; 0.8
   or more is a link.
6. Components of the links by minimum label and pointer jumping over stored tables; each round at least
   halves the depth of every tree.

Joins on buckets and hubs are sort-merge joins, whose hot partitions Spark splits as it runs.

Defined results: one row per document with the least doc_id of its class. Equal texts, the empty one
too, are one class; a null text is in no class but its own; texts of one to four words have one shingle,
all their words; a text may be of any length and is read whole; repeated rows are in one class, and ties
for its head go by the text's key; documents without an id take part but name no class unless it has no
other; an empty table gives no rows; extra columns are ignored (kept by ``keep_first``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

BANDS, ROWS, SHINGLE, RARE = 10, 3, 5, 1e-3
HALF = BANDS * ROWS // 2
#: The weighted Jaccard similarity of a link.
LEAST = 0.8
#: Shingles whose frequency is sent to all tasks, 12 bytes each.
MOST = 500_000
#: Half the rows that a task reads at least to count shingles, and shingles that it counts at a time.
CHUNK, CHUNK_SHINGLES = 2_000, 4_000_000
#: Nodes and bytes of text of a block, about.
BLOCK, BLOCK_BYTES = 512, 2 << 20
_NONE = -(1 << 63)


class Words(dict):
    """Word to a place in the column of hashes; emptied when full."""

    def __init__(self, limit: int = 250_000):
        from array import array

        self.limit, self.hashes = limit, array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at

    def mixed(self, text: bytes):
        """The shingle hashes of a text, repeats included, in its order."""
        import numpy as np

        if len(self) > self.limit:
            self.clear()
            del self.hashes[:]
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        places = np.fromiter(map(self.__getitem__, words), np.int64, n)
        hashes = np.frombuffer(self.hashes, np.uint64)[places]
        k = min(SHINGLE, n)
        mixed = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ hashes[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return mixed

    def shingles(self, text: bytes):
        """Distinct shingle hashes of a text, sorted, and their counts."""
        import numpy as np

        mixed = self.mixed(text)
        if not len(mixed):
            return mixed, np.zeros(0, np.int64)
        mixed.sort()
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        return mixed[first], np.diff(first, append=len(mixed))


class Known:
    """Sorted hashes; most others are told by their first bits, so that few are searched for."""

    def __init__(self, hashes, bits: int = 22):
        import numpy as np

        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[hashes >> self.shift] = True

    def places(self, found):
        """(i, at): found[i] is the hash at place ``at``, for every one that is known."""
        import numpy as np

        i = np.flatnonzero(self.some[found >> self.shift])
        at = np.searchsorted(self.hashes, found[i])
        same = self.hashes[np.minimum(at, len(self.hashes) - 1)] == found[i]
        return i[same], at[same]


class Vectors:
    """Texts to (shingles, weights). ``sent``: the frequent shingles, sorted, and their inverse document frequencies; any other weighs 2."""

    def __init__(self, sent):
        frequent, self.idf = sent
        self.known, self.words = Known(frequent), Words()

    def of(self, text: bytes):
        found, n = self.words.shingles(text)
        weight = n * 2.0
        i, at = self.known.places(found)
        weight[i] = n[i] * self.idf[at]
        return found, weight


class Sampler:
    """The random numbers of all samples, looked up by parts of an element's hash."""

    def __init__(self, samples: int, bits: int = 12):
        import numpy as np

        rng = np.random.default_rng(20)
        size = (1 << bits, samples)
        self.bits = bits
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.b = rng.random(size).astype(np.float32)

    def sketch(self, elements, weights):
        """32-bit codes of the chosen (element, t), one per sample."""
        import numpy as np

        best = code = None
        for at in range(0, len(elements), 4096):
            e = elements[at : at + 4096]
            m, s = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
            r, ln_c, b = self.r[e & m], self.ln_c[e >> s & m], self.b[e >> (s + s) & m]
            t = np.floor(np.log(weights[at : at + 4096]).astype(np.float32)[:, None] / r + b)
            a = ln_c - r * (t - b + 1)
            k = a.argmin(0)
            cols = np.arange(a.shape[1])
            low, chosen = a[k, cols], ((e[k] >> np.uint64(30)) ^ (t[k, cols].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1))).astype(np.uint32)
            if best is None:
                best, code = low, chosen
            else:
                code = np.where(low < best, chosen, code)
                best = np.minimum(low, best)
        return code.view(np.int32)


def count_shingles(batches, rare: float = RARE, most: int = MOST):
    """(h, n) for what may be frequent, and in one row without a hash the number of all shingles of all rows and the slack.

    Some three quarters of ``CHUNK_SHINGLES`` shingles or more, where a task has as many, are counted at a time, and never twice that. A chunk leaves out what at most ``slack`` of its rows hold, a
    quarter of its part of either edge of frequency; n is the count less the slack. So sum(n) plus all chunks' slack is no
    less than a shingle's frequency, and the slack is at most half the edge, however rows are dealt and wherever chunks end.
    """
    import numpy as np
    import pyarrow as pa

    tokens.release()
    words, full, held, rows, size, total, slacks = Words(), None, [], 0, 0, 0, 0
    batch = lambda h, n, slack: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(slack, pa.int64())], names=["h", "n", "slack"])
    slack_of = lambda rows, size: int((rare * rows + size / most) / 4)

    def out(held, slack):
        found, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        keep = n > slack
        return batch(found[keep].view(np.int64), n[keep] - slack, np.zeros(keep.sum(), np.int64))

    for whole in batches:
        for b in tokens.slices(whole, 128):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                rows += 1
                if t:
                    held.append(words.shingles(t)[0])
                    size += len(held[-1])
                    total += len(held[-1])
                if size >= CHUNK_SHINGLES * 3 // 4:
                    if full:
                        slack = slack_of(*full[1:])
                        yield out(full[0], slack)
                        slacks += slack
                    full, held, rows, size = (held, rows, size), [], 0, 0
        common.give_back()
    # what is left at the end is counted with the chunk before it: alone it would have no slack and leave out nothing
    if full:
        held, rows, size = full[0] + held, full[1] + rows, full[2] + size
    slack = slack_of(rows, size)
    yield out(held, slack)
    del held, full
    common.give_back()
    yield batch([None], [total], [slacks + slack])


def count_known(sent):
    """(h, n): how many rows hold each of the shingles sent."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens.release()
        words, known = Words(), Known(sent.value)
        counts = np.zeros(len(sent.value), np.int64)
        for whole in batches:
            for b in tokens.slices(whole, 128):
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    if t and len(counts):
                        counts[known.places(words.mixed(t))[1]] += 1  # once a row, however often the place is named
            common.give_back()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(counts[some])], names=["h", "n"])

    return run


def shingle_weights(docs: DataFrame, rare: float = RARE, most: int = MOST) -> tuple:
    """The frequent shingles' hashes, sorted, and inverse document frequencies: ``most`` at most, since frequencies sum to the number of shingles."""
    import numpy as np

    spark, n = docs.sparkSession, docs.count()
    # small tables in many splits are read by few tasks, so that each sees enough rows to count
    texts = docs.select("text").coalesce(max(1, n // (2 * CHUNK)))
    perhaps = texts.mapInArrow(lambda batches: count_shingles(batches, rare, most), "h long, n long, slack long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    perhaps = common.materialize(perhaps.filter((F.col("n") >= rare * n / 2) | F.col("h").isNull()), "perhaps", rows=most)
    total, slack = perhaps.filter("h is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("slack"), F.lit(0))).first()
    edge = max(rare * n, total / most)
    known = perhaps.filter(F.col("h").isNotNull() & (F.col("n") >= edge - slack)).select("h").toArrow().column("h").to_numpy()  # 2 * ``most`` at most
    sent = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    counted = texts.mapInArrow(count_known(sent), "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    got = common.materialize(counted.filter(F.col("df") >= edge), "frequent", rows=most).toArrow()  # at most ``most`` rows
    hashes = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], 1 + np.log1p(n / got.column("df").to_numpy()[order]) / math.log1p(1 / rare)


def sketch_batches(sent, samples: int):
    def run(batches):
        import pyarrow as pa

        tokens.release()
        vectors, sampler = Vectors(sent.value), Sampler(samples)
        for whole in batches:
            for b in tokens.slices(whole, 128):
                sketches = []
                for t in b.column(2).cast(pa.binary()).to_pylist():
                    e, weight = vectors.of(t or b"")
                    sketches.append(sampler.sketch(e, weight) if len(e) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sketches, pa.list_(pa.int32()))], names=["doc_id", "key", "sketch"])
            common.give_back()

    return run


def verify_batches(sent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        vectors, held = Vectors(sent.value), {}

        def vector(key, text):
            if key not in held:
                if len(held) > 64:
                    held.clear()
                held[key] = vectors.of(text)
            return held[key]

        for whole in batches:
            for b in tokens.slices(whole, 256):
                keep = []
                for i, (kb, ta, tb) in enumerate(zip(b.column(1).to_pylist(), *(b.column(c).cast(pa.binary()).to_pylist() for c in (2, 3)), strict=True)):
                    (ea, wa), (eb, wb) = vectors.of(ta), vector(kb, tb)
                    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                    shared = np.minimum(wa[ia], wb[ib]).sum()
                    if shared >= LEAST * (wa.sum() + wb.sum() - shared):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])
            common.give_back()

    return run


def likely_pairs(sketches, labels, sides, band: int):
    """(a, later bs) of a cell: of two labels and sides (one side: all), half their samples alike, and no earlier band in common."""
    import numpy as np

    two = sides.min() != sides.max()
    for a in range(len(sketches) - 1):
        other = labels[a + 1 :] != labels[a]
        if two:
            other &= sides[a + 1 :] != sides[a]
        bs = a + 1 + np.flatnonzero(other)
        same = sketches[bs] == sketches[a]
        bs = bs[(same.sum(1) >= HALF) & ~same.reshape(len(bs), BANDS, ROWS).all(2)[:, :band].any(1)]
        if len(bs):
            yield a, bs


def linked_pairs(vectors: dict, likely: list, labels, least: float = LEAST):
    """The likely pairs whose weighted similarity is ``least`` or more, but for pairs that earlier links already joined; vectors are (shingles, weights) by node."""
    import numpy as np

    nodes = list(vectors)
    ids = np.unique(np.concatenate([vectors[i][0] for i in nodes]), return_inverse=True)[1]
    ends = np.cumsum([len(vectors[i][0]) for i in nodes])
    places = dict(zip(nodes, np.split(ids, ends[:-1]), strict=True))
    totals = {i: vectors[i][1].sum() for i in nodes}
    weight, label = np.zeros(int(ids.max()) + 1), labels.copy()
    for a, bs in likely:
        bs = bs[label[bs] != label[a]]
        if not len(bs):
            continue
        weight[places[a]] = vectors[a][1]
        sizes = np.array([len(places[b]) for b in bs])
        both = np.minimum(weight[np.concatenate([places[b] for b in bs])], np.concatenate([vectors[b][1] for b in bs]))
        weight[places[a]] = 0
        starts = np.cumsum(sizes) - sizes
        shared = np.add.reduceat(both, starts)
        for b in bs[shared >= least * (totals[a] + np.array([totals[b] for b in bs]) - shared)]:
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                yield a, b


def cell_links(sent):
    held: list = []

    def run(cell):
        import numpy as np
        import pyarrow as pa

        if not held:
            tokens.release()
            held.append(Vectors(sent.value))
        labels = np.unique(np.array(cell.column("label").to_pylist(), object), return_inverse=True)[1]
        sketches = cell.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, BANDS * ROWS)
        likely = list(likely_pairs(sketches, labels, cell.column("block").to_numpy(), cell.column("band")[0].as_py()))
        keys, texts, out = cell.column("key"), cell.column("text").cast(pa.binary()), []
        if likely:
            used = np.unique(np.concatenate([np.concatenate(([a], bs)) for a, bs in likely]))
            vectors = {int(i): held[0].of(texts[int(i)].as_py()) for i in used}
            out = [(keys[int(a)].as_py(), keys[int(b)].as_py()) for a, b in linked_pairs(vectors, likely, labels)]
            common.give_back()
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """(node, label): the least node of each component, for every node with an edge; at most ``nodes`` of them."""
    both = common.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", rows=2 * nodes)
    labels = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", rows=nodes)
    while True:
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("over"))
        moved = common.materialize(stepped.join(up.hint("merge"), stepped.label == up.up).select("node", F.least("label", "over").alias("label"), "was"), "labels", rows=nodes)
        labels = moved.select("node", "label")
        if not moved.filter("label <> was").limit(1).count():
            return labels


def cells_of(hot: DataFrame) -> DataFrame:
    """bucket, i, j, block, band, key and label of every node in every pair of blocks (i <= j) of its bucket that can hold two labels; hot: bucket, band, key, label, n_bytes."""
    of_label = hot.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    total = of_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.max(F.struct("n", "label", "n_bytes")).alias("main"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("long")
    parts = total.select("bucket", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.n_bytes")).alias("p"), blocks(F.col("n") - F.col("main.n"), F.col("n_bytes") - F.col("main.n_bytes")).alias("q"))
    parts = common.sent_if_small(common.materialize(parts, "blocks", rows=hot.count()))
    dealt = hot.join(parts, "bucket").withColumn("block", F.expr("if(label = main, pmod(xxhash64(key), p), p + pmod(xxhash64(key), q))"))
    meets = F.expr("sequence(if(label = main, p, 0L), p + q - 1)")  # blocks of the largest component need not meet each other
    return dealt.select("bucket", "block", "band", "key", "label", F.explode(meets).alias("with")).select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "band", "key", "label")


def link_nodes(docs: DataFrame, nodes: DataFrame, count: int, sent, small: int = 64) -> DataFrame:
    """Verified links (a, b) between nodes, ``count`` in number, as far as components need them."""
    sampled = [F.col("sketch")[i] for i in range(BANDS * ROWS)]
    buckets = F.array(*(F.xxhash64(F.lit(i), *sampled[ROWS * i : ROWS * i + ROWS]) for i in range(BANDS)))
    banded = nodes.filter(F.col("sketch").isNotNull()).select("key", F.posexplode(buckets).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub")).filter("n > 1")
    members = common.materialize(banded.join(sizes.hint("merge"), "bucket"), "buckets", rows=BANDS * count)

    def texts_of(need: DataFrame) -> DataFrame:
        need = common.sent_if_small(common.materialize(need.distinct(), "need", rows=count))
        texts = docs.filter("text is not null").select(F.unhex(F.md5("text")).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("first_id"), "text")
        return common.materialize(texts.join(need, ["key", "first_id"], "left_semi").dropDuplicates(["key", "first_id"]).select("key", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (nodes.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"), F.col("first_id").alias(f"i{c}")) for c in "ab")
        alike = F.expr("aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (p, q) -> p + q)")
        likely = pairs.join(left, "a").join(right.hint("merge"), "b").filter(alike >= HALF).select("a", "b", "ia", "ib")
        likely = common.materialize(likely, "pairs", rows=BANDS * count)
        texts = texts_of(likely.select(F.col("a").alias("key"), F.col("ia").alias("first_id")).union(likely.select("b", "ib")))
        rows = likely.select("a", "b").join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a")
        rows = rows.join(texts.withColumnsRenamed({"key": "b", "text": "tb"}).hint("merge"), "b").select("a", "b", "ta", "tb")
        return common.materialize(rows.mapInArrow(verify_batches(sent), "a binary, b binary"), "links", rows=BANDS * count)

    first = members.filter("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    links = verified(first)
    found = components(links, count)
    placed = members.join(found, members.key == found.node, "left").select("bucket", "band", "n", "key", F.coalesce("label", "key").alias("label"))
    split = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = common.materialize(placed.join(split.hint("merge"), "bucket"), "open", rows=BANDS * count)
    few = open_.filter(F.col("n") <= small).select("bucket", "key", "label")
    crossed = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")))
    again = crossed.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.union(verified(again.join(tested, ["a", "b"], "left_anti")))
    hot = open_.filter(F.col("n") > small)
    if not hot.limit(1).count():
        return links
    hot_nodes = common.materialize(nodes.join(hot.select("key").distinct(), "key", "left_semi"), "hot", rows=count)
    texts = texts_of(hot_nodes.select("key", "first_id"))
    known = hot_nodes.select("key", "sketch").join(texts, "key")
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    cells = cells_of(hot.select("bucket", "band", "key", "label").join(texts.select("key", n_bytes), "key"))
    found = cells.join(known, "key").groupBy("bucket", "i", "j").applyInArrow(cell_links(sent), "a binary, b binary")
    return links.union(common.materialize(found, "links", rows=BANDS * count))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_key of every row: the class's least doc_id, and the key of that document's text."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs))
    key = F.unhex(F.md5("text")).alias("key")
    sketched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, "text").mapInArrow(sketch_batches(sent, BANDS * ROWS), "doc_id long, key binary, sketch array<int>")
    rows = common.materialize(sketched, "sketches")
    least = F.min(F.coalesce("doc_id", F.lit(_NONE)))  # a missing id stands last among ids, below
    least = F.coalesce(F.min("doc_id"), least)
    total = rows.count()
    nodes = common.materialize(rows.filter("key is not null").groupBy("key").agg(least.alias("first_id"), F.first("sketch").alias("sketch")), "nodes", rows=total)
    count = nodes.count()
    found = components(link_nodes(docs, nodes, count, sent), count)
    named = nodes.select("key", F.when(F.col("first_id") != _NONE, F.col("first_id")).alias("first_id")).join(found, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("head"))
    of_key = named.join(heads.hint("merge"), "label").select("key", F.col("head.first_id").alias("class_id"), F.col("head.key").alias("class_key"))
    of_key = common.materialize(of_key, "classes", rows=count)
    with_key = rows.select("doc_id", "key").filter("key is not null").join(of_key.hint("merge"), "key").select("doc_id", "key", "class_id", "class_key")
    return with_key.unionByName(rows.filter("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key")))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the least id, with the columns it came with; rows with a null text stay.

    What goes is less than what stays, so the texts are held against the rows to drop; only rows that
    repeat an id and a text have to meet.
    """
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_id")
    head = (F.col("key") == F.col("class_key")) & own_id.eqNullSafe(F.coalesce("class_id", F.lit(_NONE)))
    placed = classes(docs).filter("key is not null").select(own_id, F.col("key").alias("_key"), head.alias("head"))
    counted = placed.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n"), F.first("head").alias("head")).filter("not head or n > 1")
    counted = common.materialize(counted, "drop", rows=docs.count())
    drop = common.sent_if_small(counted.filter("not head").select("_id", "_key"))
    repeated = common.sent_if_small(counted.filter("head").select("_id", "_key"))
    keyed = common.wrapped(docs, "doc_id", "text").select("_row", own_id, F.unhex(F.md5("text")).alias("_key"))
    kept = keyed.join(drop, ["_id", "_key"], "left_anti")
    if counted.filter("head").limit(1).count():
        kept = kept.join(repeated, ["_id", "_key"], "left_anti").unionByName(kept.join(repeated, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))
    return common.unwrapped(kept)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the class of every document."""
    return classes(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
