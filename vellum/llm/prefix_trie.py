"""Conversations that share their beginnings, as a trie of turns, by MSD radix partitioning.

1. Turns are dictionary-encoded: each distinct (role, text), known by its SHA-256, gets a number; all later steps move
   numbers, not texts. A conversation becomes the array of its turns' numbers, with their texts' bytes.
2. Equal sequences are one row with their count, least conversation and the digest of all their ids, so copies cost
   nothing further on. A digest is fed in numeric order: ids are joined to chunks of at most ``CHUNK`` in parallel,
   and only chunks of a sequence are hashed one after the other, streamed.
3. Radix rounds: all sequences are one bucket at first. A bucket of more than ``LOCAL`` remaining turns is split by its
   next turn, on Spark. What all its sequences share before that is skipped at once: the longest common prefix of a
   set is that of its least and its greatest array, which are aggregates. Such a stretch is a segment: a chain of
   nodes with one set of members. Copies being one row, every round splits each bucket in two or more.
4. A bucket at or below ``LOCAL`` is finished in one place: multikey quicksort parts its sequences three ways by a turn
   (less, equal, greater), and each equal part is a node; sums over subtrees follow in reverse. Buckets are dealt by
   hash, many to a task, and stream through it, one in memory at a time.
5. Sums of subtrees rise from the local buckets to the segments, round by round, last round first.

A conversation's numbers are one row (12 bytes a turn, no texts); other groups are never gathered. What is known of
large buckets is broadcast only if a count finds it small.

Defined results: rows without a conv_id are no conversation and are left out; null roles and texts are empty; turns
are ordered by turn, null first, then by role and then by the SHA-256 of the text; repeated rows are turns of their
own; a text may be of any length; c - c % 5 rounds towards zero, as SQL does; conversations without turns end at the
root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.llm import common

#: Remaining turns of a bucket that is finished in one place, and ids of a chunk of a digest.
LOCAL, CHUNK = 16_384, 8_192
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bucket binary"


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, n_bytes: turns in order, their (role, text) as a number; stored."""
    known = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", digest).cast("binary"), 256))
    rows = known.select("conv_id", "turn", "role", F.unhex(digest).alias("digest"), key.alias("key"), F.octet_length("text").alias("n_bytes"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    rows = common.materialize(rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "key", "n_bytes"), "turns")
    numbers = common.materialize(rows.select("key").distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    return common.materialize(rows.join(common.sent_if_small(numbers), "key").select("conv_id", "pos", "id", "n_bytes"), "encoded")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the first h turns of conversation c - c % 5, then the own turns after the first h; h = crc32(c) % 9. turns: as ``encoded`` gives them."""
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    lent = turns.filter("pos <= 8").select(F.col("conv_id").alias("base"), "pos", "id", "n_bytes")
    turn = lambda part: F.struct(F.lit(part).alias("part"), "pos", "id", "n_bytes")
    first = convs.join(lent, "base").filter("pos <= h").select("conv_id", turn(0).alias("turn"))
    own = turns.filter(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).select("conv_id", turn(1).alias("turn"))
    none = convs.select("conv_id", F.lit(None).cast("struct<part:int,pos:int,id:long,n_bytes:int>").alias("turn"))
    gathered = first.unionByName(own).unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return gathered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.n_bytes").alias("sizes"))


def joined_ids(batches):
    """Sorted (seq, conv_id) to chunks (seq, first, text) of ids joined by commas."""
    import pyarrow as pa

    seq, ids = None, []
    for b in batches:
        out: list = []
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (s != seq or len(ids) >= CHUNK):
                out.append((seq, ids[0], ",".join(map(str, ids))))
                ids = []
            seq = s
            ids.append(c)
        yield _batch(out, [pa.binary(), pa.int64(), pa.string()], ["seq", "first", "text"])
    if ids:
        yield _batch([(seq, ids[0], ",".join(map(str, ids)))], [pa.binary(), pa.int64(), pa.string()], ["seq", "first", "text"])


def hashed_chunks(batches):
    """Sorted (seq, first, text) to (seq, ends): SHA-256 of all chunks of a sequence, joined by commas."""
    import hashlib

    import pyarrow as pa

    seq, h = None, None
    for b in batches:
        out: list = []
        for s, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s != seq:
                if h:
                    out.append((seq, h.hexdigest()))
                seq, h = s, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield _batch(out, [pa.binary(), pa.string()], ["seq", "ends"])
    if h:
        yield _batch([(seq, h.hexdigest())], [pa.binary(), pa.string()], ["seq", "ends"])


def _batch(rows: list, kinds: list, names: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """ids, sizes, conv (the least), n, ends: each sequence once; stored."""
    keyed = common.materialize(convs.select("conv_id", "ids", "sizes", F.unhex(F.sha2(F.array_join("ids", ",").cast("binary"), 256)).alias("seq")), "sequences")
    once = keyed.groupBy("seq", "ids", "sizes").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"))
    chunks = keyed.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined_ids, "seq binary, first long, text string")
    ends = chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed_chunks, "seq binary, ends string")
    return common.materialize(once.join(ends.hint("merge"), "seq").drop("seq"), "distinct")


def bucket_nodes(rows: list, depth: int, none: str) -> list:
    """Nodes of a bucket: rows (ids, sizes, conv, n, ends) of distinct sequences that agree in their first ``depth`` turns. Lists of the output's columns, the bucket's top first."""
    conv, deep, parent, n_convs, children, leaves, saved, ended = ([] for _ in range(8))

    def node(members, d, above):
        at = len(conv)
        n = sum(r[3] for r in members)
        conv.append(min(r[2] for r in members))
        deep.append(d)
        parent.append(above)
        n_convs.append(n)
        children.append(0)
        leaves.append(0)
        saved.append((n - 1) * members[0][1][d - 1] if d else 0)
        ended.append(next((r[4] for r in members if len(r[0]) == d), none))
        return at

    todo = [([r for r in rows if len(r[0]) > depth], depth, node(rows, depth, -1))]
    while todo:
        members, d, above = todo.pop()
        if not members:
            continue
        if len(members) == 1:  # a chain to its end
            for k in range(d + 1, len(members[0][0]) + 1):
                above = node(members, k, above)
            continue
        pivot = members[len(members) // 2][0][d]
        less, equal, more = [], [], []
        for r in members:
            (equal if r[0][d] == pivot else less if r[0][d] < pivot else more).append(r)
        todo += [(less, d, above), (more, d, above)]
        todo.append(([r for r in equal if len(r[0]) > d + 1], d + 1, node(equal, d + 1, above)))
    for at in range(len(conv) - 1, -1, -1):  # a node stands behind its parent
        leaves[at] = leaves[at] or 1
        if (up := parent[at]) >= 0:
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    return [conv, deep, [None if up < 0 else conv[up] for up in parent], n_convs, children, leaves, saved, ended]


def node_batches(none: str):
    """Rows sorted by bucket to nodes; the top of a bucket carries the bucket's key, and no parent yet."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("bucket", pa.binary())])

        def out(bucket, depth, rows):
            columns = bucket_nodes(rows, depth, none)
            return pa.RecordBatch.from_arrays([*(pa.array(c, k.type) for c, k in zip(columns, schema, strict=False)), pa.array([bucket] + [None] * (len(columns[0]) - 1), pa.binary())], schema=schema)

        own, at, rows = None, 0, []
        for b in batches:
            ids, sizes = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, (bucket, depth) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if bucket != own and rows:
                    yield out(own, at, rows)
                    rows = []
                own, at = bucket, depth
                rows.append((ids[i], sizes[i], *(b.column(c)[i].as_py() for c in (4, 5, 6))))
        if rows:
            yield out(own, at, rows)

    return run


def trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes of all rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    import hashlib

    none = hashlib.sha256(b"").hexdigest()
    rows = distinct_sequences(rebuilt(encoded(turns))).select(F.lit(b"").alias("bucket"), F.lit(0).alias("depth"), "ids", "sizes", "conv", "n", "ends")
    segments, small = [], []
    while True:
        least = F.min(F.struct("ids", "sizes", "ends"))
        stats = rows.groupBy("bucket", "depth").agg(F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("ids") - F.col("depth")).alias("rest"), F.count(F.lit(1)).alias("kinds"), least.alias("lo"), F.max("ids").alias("hi"))
        shared = F.array_position(F.zip_with(F.col("lo.ids"), F.col("hi"), lambda x, y: x.eqNullSafe(y)), False) - 1
        large = stats.filter((F.col("rest") > local) & (F.col("kinds") > 1)).select("bucket", "depth", "conv_id", "n_convs", shared.alias("to"), "lo")
        large = common.materialize(large.select("*", F.when(F.size("lo.ids") == F.col("to"), F.col("lo.ends")).alias("ends")).select("bucket", "depth", "conv_id", "n_convs", "to", "ends", F.slice("lo.sizes", 1, F.col("to").cast("int")).alias("sizes")), "segments")
        if not large.limit(1).count():
            small.append(rows)
            break
        segments.append(large)
        split = common.sent_if_small(large.select("bucket", "to"))
        small.append(rows.join(split, "bucket", "left_anti"))
        on = rows.join(split, "bucket").filter(F.size("ids") > F.col("to"))
        key = F.unhex(F.sha2(F.concat_ws(":", F.hex("bucket"), "to", F.element_at("ids", (F.col("to") + 1).cast("int")).cast("string")).cast("binary"), 256))
        on = on.select(F.col("bucket").alias("above"), key.alias("bucket"), (F.col("to") + 1).cast("int").alias("depth"), "ids", "sizes", "conv", "n", "ends")
        rows = common.materialize(on.select("bucket", "depth", "ids", "sizes", "conv", "n", "ends", "above"), "buckets")
        segments[-1] = (large, rows.select("bucket", "above").distinct())
        rows = rows.drop("above")
    found = small[0]
    for more in small[1:]:
        found = found.unionByName(more)
    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    nodes = common.materialize(dealt.mapInArrow(node_batches(none), _NODE), "nodes")
    inner, tops = nodes.filter("bucket is null"), nodes.filter("bucket is not null")
    done = [inner.drop("bucket")]
    for large, children in reversed(segments):
        up = large.select(F.col("bucket").alias("above"), F.col("conv_id").alias("up"), "to")
        below = common.materialize(tops.join(children.hint("merge"), "bucket").join(up.hint("merge"), "above"), "risen")
        done.append(below.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
        sums = below.groupBy("above").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")).withColumnRenamed("above", "bucket")
        chain = large.join(sums.hint("merge"), "bucket")
        own = F.transform(F.sequence("depth", F.col("to").cast("int")), lambda d: F.when(d > 0, F.element_at("sizes", F.greatest(d, F.lit(1)))).otherwise(0).cast("long"))
        total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)
        chain = chain.select("bucket", "conv_id", "depth", "to", "n_convs", "n_children", "n_leaves", "below", "ends", F.posexplode(own).alias("k", "size"), (total(own)).alias("all"))
        gone = F.coalesce(F.sum("size").over(W.partitionBy("bucket").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = F.col("k") + F.col("depth") == F.col("to")
        chain = chain.withColumn("rest", F.col("all") - gone).select(
            "conv_id", (F.col("depth") + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") > 0, F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            ((F.col("n_convs") - 1) * F.col("rest") + F.col("below")).alias("saved_tokens"), F.coalesce(F.when(last, F.col("ends")), F.lit(none)).alias("ends_sha256"), F.when(F.col("k") == 0, F.col("bucket")).alias("bucket"),
        )
        chain = common.materialize(chain, "chains")
        done.append(chain.filter("bucket is null").drop("bucket"))
        rest = tops.join(children.select("bucket").hint("merge"), "bucket", "left_anti")
        tops = rest.unionByName(chain.filter("bucket is not null").select(rest.columns))
    done.append(tops.drop("bucket"))  # the root
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the prefix trie of all conversations."""
    return trie(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The same from the definition: every prefix of every conversation; CRC-32 bit by bit.
SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
built AS (SELECT conv_id, list(md5(role || chr(0) || text) ORDER BY part, pos) AS keys, list(strlen(text) ORDER BY part, pos) AS sizes FROM parts GROUP BY conv_id),
every AS (SELECT conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM convs LEFT JOIN built USING (conv_id)),
prefixes AS (SELECT conv_id, d AS depth, array_to_string(keys[1:d], ',') AS path, array_to_string(keys[1:d - 1], ',') AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, len(keys) = d AS ends FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM every)),
nodes AS (SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
with_children AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
paths AS (SELECT DISTINCT path AS low, depth AS low_depth, unnest(range(0, depth + 1)) AS depth FROM nodes),
sums AS (SELECT p.depth, CASE WHEN p.depth = 0 THEN '' ELSE left(p.low, 33 * p.depth - 1) END AS path, sum(n.own) AS saved, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM paths p JOIN with_children n ON n.path = p.low AND n.depth = p.low_depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM with_children n JOIN sums s USING (depth, path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.above AND n.depth > 0"""
