"""The knowledge graph: nodes, mentions, co-occurrence, trade and typed relations, and what is asked of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum import storage
from vellum.functions import text as X
from vellum.sources import writers
from vellum.streaming.ingest import scratch


def with_ids(mentions: DataFrame) -> DataFrame:
    """Mentions (doc_id, ord, text, type) with a node id and label; empty texts and types are out."""
    ok = mentions.filter((F.trim("text") != "") & (F.trim("type") != ""))
    return ok.withColumn("id", X.entity_id(F.col("text"), F.col("type"))).withColumn("label", X.node_label(F.col("type")))


def nodes(mentions: DataFrame) -> DataFrame:
    """id, label, name: the first spelling by document and position names a node."""
    first = F.min_by(F.struct("label", "text"), F.struct("doc_id", "ord"))
    return with_ids(mentions).groupBy("id").agg(first.alias("f")).select("id", F.col("f.label").alias("label"), F.col("f.text").alias("name"))


def mention_edges(mentions: DataFrame, distinct: bool = False) -> DataFrame:
    """Document to entity; one edge per mention unless told otherwise."""
    edges = with_ids(mentions).select(F.concat(F.lit("doc__"), F.col("doc_id").cast("string")).alias("source"), F.col("id").alias("target"), F.lit("MENTIONS").alias("type"))
    return edges.distinct() if distinct else edges


#: Pairs of names that a cell holds, about, and pairs that are sorted at a time within it.
CELL, AT_ONCE = 16_000_000, 4_000_000
#: More than a document has kinds of mentions.
KINDS = 1 << 20


def _cell_pairs(most: int, distinct_docs: bool, at_once: int):
    """Rows of cells (i, j, b, doc, a bucket's names and what is known of each) in order of cell and document to (source, target, weight, types, docs) of each pair of a cell."""

    def emit(names, types, docs, left, right, n, t, doc):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(left):
            return
        key = left * np.int64(len(names)) + right
        order = np.argsort(key, kind="stable")  # documents stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(first, append=len(key))
        weight = size.astype(np.int64) if distinct_docs else np.add.reduceat(n[order], first)
        few = order[np.arange(len(key)) - np.repeat(first, size) < most]
        ends = np.concatenate([[0], np.cumsum(np.minimum(size, most))]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), docs.take(pa.array(doc[few]))), "|")
        top = order[first]
        low, high = np.minimum(left[top], right[top]), np.maximum(left[top], right[top])
        for at in range(0, len(top), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(low[part])), names.take(pa.array(high[part])), pa.array(weight[part]), types.take(pa.array(t[top[part]])), joined[part]], names=["source", "target", "weight", "types", "docs"])

    def whole(one: bool, held: list):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        text = lambda k: pa.chunked_array([h[k] for h in held]).unify_dictionaries().combine_chunks()

        def ranked(a):
            order = pc.sort_indices(a.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return a.dictionary.take(pa.array(order)), rank[a.indices.to_numpy()]

        names, code = ranked(text(0))
        kinds, kind = ranked(pa.chunked_array([text(1), text(2)]).unify_dictionaries().combine_chunks())
        kind, kind2 = kind[: len(code)], kind[len(code) :]
        n, place, size, side = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5, 6))
        docs = pa.concat_arrays([h[7] for h in held])
        new = np.concatenate([h[8] for h in held])
        docs, row_doc = docs.filter(pa.array(new)), np.cumsum(new) - 1
        both = kinds.cast(pa.string()).to_pylist()
        types = pa.array([f"{x}-{y}" for x in both for y in both], pa.string())
        row = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size)
        if one:
            order = np.lexsort((code, row))
            code, kind, kind2, n, place = (x[order] for x in (code, kind, kind2, n, place))
            lo, hi, left = np.arange(len(row)) + 1, ends[row], np.arange(len(row))
            some = np.flatnonzero(n > 1)
            yield from emit(names, types, docs, code[some], code[some], n[some] * (n[some] - 1) // 2, kind[some] * len(both) + kind2[some], row_doc[row[some]])
        else:
            met = np.flatnonzero((row_doc[1:] == row_doc[:-1]) & (side[1:] > side[:-1]))  # a document's two rows
            other = np.full(len(size), -1)
            other[met] = met + 1
            left = np.flatnonzero(other[row] >= 0)
            lo, hi = (ends - size)[other[row]], ends[other[row]]
        left = left[np.argsort(code[left], kind="stable")]
        count = (hi - lo)[left]
        left, count = left[count > 0], count[count > 0]
        through = np.cumsum(count)
        starts = np.flatnonzero(np.concatenate([[True], code[left[1:]] != code[left[:-1]]])) if len(left) else np.zeros(0, np.int64)
        before = through[starts] - count[starts] if len(left) else starts
        cuts = starts[np.flatnonzero(np.concatenate([[True], before[1:] // at_once != before[:-1] // at_once]))] if len(left) else starts
        for at, to in zip(cuts, [*cuts[1:], len(left)], strict=True):  # a name's pairs are in one part
            x, c = left[at:to], count[at:to]
            y = np.repeat(lo[x] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            x = np.repeat(x, c)
            t = np.where(place[x] < place[y], kind[x] * len(both) + kind[y], kind[y] * len(both) + kind[x])
            yield from emit(names, types, docs, code[x], code[y], n[x] * n[y], t, row_doc[row[x]])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cell, held, last = None, [], None
        for b in batches:
            ij = b.column(0).to_numpy().astype(np.int64) * (1 << 32) + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(ij[1:] != ij[:-1]) + 1), len(ij)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                if ij[at] != cell:
                    if held:
                        yield from whole(cell >> 32 == cell & 0xFFFFFFFF, held)
                    cell, held, last = ij[at], [], None
                part = b.slice(at, to - at)
                docs, names, *lists = part.columns[3:]
                size = pc.list_value_length(lists[0]).to_numpy().astype(np.int64)
                length, n, place, t, kinds = (x.flatten() for x in lists)
                data = b"".join(names.cast(pa.binary()).to_pylist())
                ends = np.concatenate([[0], np.cumsum(length.to_numpy(), dtype=np.int64)]).astype(np.int32)
                name = pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(data))
                many = pc.list_value_length(lists[4]).to_numpy().astype(np.int64)
                t, base = t.to_numpy(), np.repeat(np.cumsum(many) - many, size)
                kind, kind2 = (kinds.take(pa.array(base + k)) for k in (t // KINDS, t % KINDS))
                new = np.concatenate([[docs[0].as_py() != last], pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)]) if len(docs) > 1 else np.array([docs[0].as_py() != last])
                last = docs[-1].as_py()
                held.append([x.dictionary_encode() for x in (name, kind, kind2)] + [n.to_numpy().astype(np.int64), place.to_numpy(), size, (part.column(2).to_numpy() != cell >> 32).astype(np.int8), docs, new])
        if held:
            yield from whole(cell >> 32 == cell & 0xFFFFFFFF, held)

    return run


def cooccurrence(mentions: DataFrame, distinct_docs: bool = False, most: int = 5, cell: int = CELL, at_once: int = AT_ONCE) -> DataFrame:
    """Entity pairs of a document: weight (pairs of mentions, or documents), the first pair's types, the first documents.

    A document's mentions are counted by id first, so two names that stand there a hundred times each are one pair and not
    ten thousand. Neither pairs nor copies of ids are shuffled: ids are dealt into buckets, a folder each, which are stored
    once; a cell is two buckets, and a task reads both and makes and sums their pairs ``at_once`` at a time. So disk grows
    with the documents' ids, however many cells their pairs take.
    """
    own = W.partitionBy("doc_id", "id").orderBy("ord")
    m = with_ids(mentions).filter("doc_id is not null").select("doc_id", "ord", "id", "type").withColumn("_r", F.row_number().over(own))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.struct("ord", "type")))
    ids = m.groupBy("doc_id", "id").agg(F.count(F.lit(1)).cast("int").alias("n"), at(1).alias("p"), at(2).alias("q"))
    docs = storage.kept(ids.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p.ord", "p.type", "id", "n", F.coalesce("q.type", "p.type").alias("type2")))).alias("e")), "ids")
    spark, pairs = docs.sparkSession, docs.agg(F.sum(F.size("e").cast("long") * (F.size("e") + 1) / 2).alias("n")).first()["n"] or 0
    p = max(1, math.ceil(math.sqrt(2 * pairs / cell)), math.ceil(math.sqrt(min(2 * spark.sparkContext.defaultParallelism, pairs / at_once))))
    kind = lambda c: F.array_position("kinds", c) - 1
    each = F.transform("e", lambda x, i: F.struct(x["id"].alias("id"), x["n"].alias("n"), i.alias("place"), (kind(x["type"]) * KINDS + kind(x["type2"])).alias("t")))
    rows = docs.withColumn("kinds", F.array_distinct(F.concat("e.type", "e.type2"))).withColumn("e", each).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    rows = rows.withColumn("e", F.filter("e", lambda x: F.pmod(F.xxhash64(x["id"]), F.lit(p)) == F.col("b"))).filter(F.size("e") > 0)
    rows = rows.select("doc_id", "b", F.array_join("e.id", "").alias("names"), F.transform("e.id", F.octet_length).alias("bytes"), F.col("e.n").alias("n"), F.col("e.place").alias("place"), F.col("e.t").alias("t"), "kinds")
    path = scratch(spark, "buckets")
    rows.withColumn("bucket", F.col("b")).write.partitionBy("bucket").parquet(path)
    buckets = [spark.read.schema(rows.schema).parquet(f"{path}/bucket={b}") if writers.there(spark, f"{path}/bucket={b}") else None for b in range(p)]
    # No rows in two partitions: a union of nothing but single partitions would be one partition, of all cells.
    found = spark.range(0, 2, 1, 2).filter("id < 0").selectExpr("'' AS source", "'' AS target", "id AS weight", "'' AS types", "'' AS docs")
    for i, j in ((i, j) for i in range(p) for j in range(i, p) if buckets[i] is not None and buckets[j] is not None):
        both = (buckets[i] if i == j else buckets[i].union(buckets[j])).coalesce(1).sortWithinPartitions("doc_id", "b")
        both = both.select(F.lit(i).alias("i"), F.lit(j).alias("j"), "b", F.col("doc_id").cast("string").alias("doc"), "names", "bytes", "n", "place", "t", "kinds")
        found = found.union(both.mapInArrow(_cell_pairs(most, distinct_docs, at_once), "source string, target string, weight long, types string, docs string"))
    return found


#: Names whose pairs are rows of documents; more of them are paired in cells.
FEW = 1024


def top_pairs(mentions: DataFrame, k: int, few: int = FEW, seen: int = 64) -> DataFrame:
    """The k pairs of most weight of ``cooccurrence``, without its types and documents.

    By Cauchy and Schwarz the weight of two names is at most the root of the product of their sums of squared counts. The
    pairs of the ``seen`` names of the largest sums give a k-th weight; only names that could reach it are paired at all.
    """
    m = with_ids(mentions).filter("doc_id is not null").select("doc_id", "ord", "id", "text", "type")
    counts = storage.kept(m.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")), "counts")
    sums = storage.kept(counts.groupBy("id").agg(F.sum(F.col("n") * F.col("n")).alias("q")), "sums")

    def best(names: DataFrame) -> DataFrame:
        lists = counts.join(F.broadcast(names), "id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("e"))
        pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice(F.col("e"), i + 1, F.size("e")), lambda y: F.struct(x["id"].alias("source"), y["id"].alias("target"), F.when(x["id"] == y["id"], F.floor(x["n"] * (x["n"] - 1) / 2)).otherwise(x["n"] * y["n"]).alias("w")))))
        each = lists.select(F.explode(pairs).alias("p")).select("p.*").filter("w > 0")
        return top(each.groupBy("source", "target").agg(F.sum("w").alias("weight")), "weight", k, "source", "target")

    least = best(sums.orderBy(F.desc("q"), "id").limit(seen).select("id")).collect()
    bound = least[-1]["weight"] if len(least) == k else 0
    most = sums.agg(F.max("q")).first()[0] or 0
    names = storage.kept(sums.filter(F.col("q").cast("double") * most >= float(bound) ** 2 * (1 - 1e-9)).select("id"), "names")
    if names.limit(few + 1).count() <= few:
        return best(names)
    return top(cooccurrence(m.join(names, "id", "left_semi").select("doc_id", "ord", "text", "type")), "weight", k, "source", "target").select("source", "target", "weight")


def trade_edges(ledger: DataFrame) -> DataFrame:
    """Four edges a shipment: exports, imported to, traded with, and one exported-in per place and year."""
    place, good = (lambda c: F.concat(F.lit("location__"), X.sanitize_id(F.col(c)))), F.concat(F.lit("commodity__"), X.sanitize_id(F.col("commodity")))
    edge = lambda a, b, t: F.struct(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
    each = ledger.select(F.explode(F.array(edge(place("from_location"), good, "EXPORTS"), edge(good, place("to_location"), "IMPORTED_TO"), edge(place("from_location"), place("to_location"), "TRADED_WITH"))).alias("e"), "year").select("e.*", "year")
    yearly = ledger.select("from_location", "year").distinct().select(place("from_location").alias("source"), F.concat(F.lit("year__"), F.col("year").cast("string")).alias("target"), F.lit("EXPORTED_IN").alias("type"), "year")
    return each.unionByName(yearly)


def typed_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations (entity_a, type_a, entity_b, type_b, subject, relation) as edges whose ends are both nodes.

    The subject, in any case, says the direction; one that is neither entity is taken for the second. Where relations
    carry uri_a and uri_b, the edges carry source_uri and target_uri, turned the same way.
    """
    a, b = X.entity_id(F.col("entity_a"), F.col("type_a")), X.entity_id(F.col("entity_b"), F.col("type_b"))
    forward = F.lower(F.trim("subject")) == F.lower(F.trim("entity_a"))
    rel = relations.withColumn("relation", X.relation_of(F.col("relation"))).filter("relation is not null")
    turned = lambda x, y: F.when(forward, x).otherwise(y)
    uris = [turned(F.col(x), F.col(y)).alias(n) for x, y, n in (("uri_a", "uri_b", "source_uri"), ("uri_b", "uri_a", "target_uri"))] if {"uri_a", "uri_b"} <= set(relations.columns) else []
    edges = rel.select(*uris, F.when(forward, a).otherwise(b).alias("source"), F.when(forward, b).otherwise(a).alias("target"), F.col("relation").alias("type"), X.relation_tier(F.col("relation")).alias("tier"), X.relation_property(F.col("relation")).alias("property"))
    known = nodes.select("id")
    return edges.join(known, edges.source == known.id, "left_semi").join(known, F.col("target") == known.id, "left_semi")


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, measure: str, k: int, *then: str) -> DataFrame:
    return df.orderBy(F.desc(measure), *then).limit(k)


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, hop: nodes that start.id reaches over undirected edges in at most so many steps.

    What a hop reaches is added to a stored table, so every hop's plan is as long as the first one's; it ends where
    nothing new is reached. Edges are stored both ways once; a vertex with very many is split by the join.
    """
    spark = edges.sparkSession
    both = storage.kept(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct(), "edges")
    path, kind = scratch(spark, "reached"), start.schema["id"].dataType.simpleString()
    reached = lambda: spark.read.schema(f"id {kind}, hop int").parquet(path)
    start.select("id").distinct().withColumn("hop", F.lit(0)).write.parquet(path)
    for hop in range(1, hops + 1):
        front = reached().filter(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        found = storage.kept(both.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(reached().select("id"), "id", "left_anti"), "front")
        if not found.limit(1).count():
            break
        found.withColumn("hop", F.lit(hop)).write.mode("append").parquet(path)
    return reached()


def full_text(nodes: DataFrame, needle: str, columns: tuple = ("name",)) -> DataFrame:
    """Nodes that hold a string, in any case, in one of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower()))
    return nodes.filter(hit)


def close_pairs(mentions: DataFrame, window: int = 500, most: int = 20) -> DataFrame:
    """The closest occurrence of each pair of names in a document whose gap is below the window; the closest pairs of each document.

    A band join over stretches of ``window`` characters: one side stands in each stretch that it touches, the other
    in each that lies within the window before or behind it. So every pair below the window shares a stretch, however
    long its names are, and far-apart mentions never pair; one that shares several counts once, by its minimum.
    """
    m = mentions.select("doc_id", "text", "type", "start", "end", F.lower("text").alias("key"))
    # gap < window means that each starts before the other's end plus the window
    step = F.lit(window)
    x = m.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))))
    y = m.withColumn("cell", F.explode(F.sequence(F.floor((F.greatest(F.col("start") - window, F.lit(0))) / step), F.floor(F.col("end") / step) + 1)))
    x, y = x.alias("x"), y.alias("y")
    gap = F.greatest(F.lit(0), F.greatest("x.start", "y.start") - F.least("x.end", "y.end"))
    near = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.key") < F.col("y.key"))).withColumn("gap", gap).filter(F.col("gap") < window)
    best = near.groupBy(F.col("x.doc_id").alias("doc_id"), F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.min(F.struct("gap", F.least("x.start", "y.start").alias("lo"), F.greatest("x.end", "y.end").alias("hi"))).alias("m")).select("doc_id", "a", "b", F.col("m.gap").alias("distance"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"))
    w = W.partitionBy("doc_id").orderBy("distance", "a", "b")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def evidence(pairs: DataFrame, docs: DataFrame, around: int = 200) -> DataFrame:
    """Pairs with the text from before the first mention to behind the second."""
    lo = F.greatest(F.col("lo") - around, F.lit(0))
    return pairs.join(docs.select("doc_id", "text"), "doc_id").withColumn("evidence", F.trim(F.substring(F.col("text"), (lo + 1).cast("int"), (F.col("hi") + around - lo).cast("int")))).drop("text")
