"""Queries on what replaces gathered groups and whole rewrites: exact ranks by refined histograms, versioned tables, sweeps, best and worst by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import graph, ledger, ner, ner_eval, ocr, quantiles, retrieval
from vellum.plans.views import MENTIONS, PAGES, SIDES, Registry, gold, mentions, pages, predicted, table
from vellum.sources import versions
from vellum.streaming import ingest

query = Registry()


@query("exact_quantiles", "SELECT event_type, share, round(CASE share WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.95) END, 6) AS quantile FROM events, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS s(share) GROUP BY event_type, share")
def _(spark, d):
    """Interpolated quartile, median and 95th of each type's values; the histograms are refined until 64 values are left."""
    return quantiles.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", (0.25, 0.5, 0.95), few=64).withColumn("quantile", F.round("quantile", 6))


@query("throughput_profile", "WITH t AS (SELECT source, n_chars, 0.1 + n_chars % 97 / 10.0 AS s FROM documents) SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(list_sort(list(s))[CAST(count(*) // 2 AS BIGINT) + 1], 6) AS median, round(list_sort(list(s))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))], 6) AS p95, round(sum(n_chars) / sum(s), 4) AS chars_per_s FROM t GROUP BY source")
def _(spark, d):
    """Time taken per document: mean, element n // 2 and element int(0.95 n) of the sorted times, and characters a second."""
    t = table(spark, d, "documents").select("source", "n_chars", (0.1 + F.col("n_chars") % 97 / 10).alias("s"))
    return quantiles.latencies(t, ["source"], "s", "n_chars").select("source", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")), F.round("chars_per_s", 4).alias("chars_per_s"))


@query("per_doc_extremes", f"WITH {PAGES}, s AS (SELECT doc_id, 'line ' || line_no % 5 AS system, avg(levenshtein(ref, hyp) / len(ref)) AS rate FROM pages GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rate, 9), system) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY round(rate, 9) DESC, system) AS w FROM s) SELECT doc_id, min(system) FILTER (b = 1) AS best, round(min(rate), 6) AS best_rate, min(system) FILTER (w = 1) AS worst, round(max(rate), 6) AS worst_rate, CAST(count(*) AS BIGINT) AS systems FROM r GROUP BY doc_id")
def _(spark, d):
    """Best and worst of five readers of each document, by mean character error rate; ties by name."""
    rows = ocr.with_distance(pages(spark, d)).withColumn("reader", F.concat(F.lit("line "), (F.col("line_no") % 5).cast("string")))
    out = ocr.best_and_worst(rows, "doc_id", "reader", "cer")
    return out.select("doc_id", "best", F.round("best_rate", 6).alias("best_rate"), "worst", F.round("worst_rate", 6).alias("worst_rate"), "systems")


@query("span_sweep", f"""WITH {SIDES} SELECT doc_id, label, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.label = g.label AND p.start < g."end" + 20 AND g.start - 20 < p."end") AS hit FROM gold g""")
def _(spark, d):
    """Gold spans, 20 characters wider either way, and whether a predicted one of their label overlaps."""
    m = mentions(spark, d)
    wide = gold(m).withColumn("start", F.col("start") - 20).withColumn("end", F.col("end") + 20)
    return ner_eval.hit_spans(wide, predicted(m)).withColumn("start", F.col("start") + 20).withColumn("end", F.col("end") - 20)


@query("versioned_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS round FROM customer UNION ALL SELECT -1 - c_custkey, 'new', 1 FROM customer WHERE c_custkey % 7 = 0")
def _(spark, d):
    """A keyed table merged twice: every third row changed, others added."""
    path, c = ingest.scratch(spark, "versions"), table(spark, d, "customer")
    versions.merge(spark, path, {"customers": (c.select("c_custkey", F.col("c_name").alias("name"), F.lit(0).alias("round")), "c_custkey")})
    changed = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("changed").alias("name"), F.lit(1).alias("round"))
    added = c.filter("c_custkey % 7 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("name"), F.lit(1).alias("round"))
    versions.merge(spark, path, {"customers": (changed.unionByName(added), "c_custkey")})
    return versions.read(spark, path, "customers")


@query("versioned_graph", """WITH n AS (SELECT p_partkey AS id FROM part), e AS (SELECT DISTINCT 'p' || l_partkey AS source, 'p' || (l_suppkey + l_partkey) AS target FROM lineitem)
SELECT 'node' AS kind, CAST(count(*) AS BIGINT) AS n FROM n UNION ALL SELECT 'edge', CAST(count(*) AS BIGINT) FROM e WHERE source IN (SELECT 'p' || id FROM n) AND target IN (SELECT 'p' || id FROM n)""")
def _(spark, d):
    """Nodes and edges loaded in two parts, each part one version: edges come in once both their ends are there."""
    path = ingest.scratch(spark, "graph")
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("key"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("l_suppkey") + F.col("l_partkey")).cast("string")).alias("target"), F.lit("NEAR").alias("type"))
    for part in (nodes.filter("key % 2 = 0"), nodes):
        versions.load_graph(spark, path, part.select("id"), edges)
    return versions.read(spark, path, "nodes").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(versions.read(spark, path, "edges").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("graph_reach", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), both_ AS (SELECT 'o' || o AS a, 'p' || p AS b FROM e UNION SELECT 'p' || p, 'o' || o FROM e),
h0 AS (SELECT 'p1' AS id), h1 AS (SELECT DISTINCT b AS id FROM both_ JOIN h0 ON a = h0.id), h2 AS (SELECT DISTINCT b AS id FROM both_ JOIN h1 ON a = h1.id), h3 AS (SELECT DISTINCT b AS id FROM both_ JOIN h2 ON a = h2.id)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id""")
def _(spark, d):
    """Orders and parts within three steps of one part."""
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    return graph.within_hops(edges, spark.createDataFrame([("p1",)], "id string"), 3)


_SHIPPED = """rows AS (SELECT l_orderkey AS id, l_linenumber AS line, 'good_' || l_partkey % 7 AS commodity, 'port_' || l_suppkey % 5 AS from_location, 'London' AS to_location, 1700 + l_orderkey % 50 AS year,
  CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE 0 END AS hh, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 4 END AS ton, CASE WHEN l_linenumber % 5 = 0 THEN l_quantity END AS quarter, CASE WHEN l_linenumber % 7 = 1 THEN l_extendedprice END AS lb,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice END AS total_pounds, CASE WHEN l_linenumber % 4 = 1 THEN l_quantity / 8 END AS weight_tons FROM lineitem)"""


@query("ledger_sentences", f"""WITH {_SHIPPED}, said AS (SELECT *, concat_ws(', ', CASE WHEN hh <> 0 THEN CAST(trunc(hh) AS BIGINT) || ' hogsheads' END, CASE WHEN ton <> 0 THEN printf('%.2f tons', ton) END, CASE WHEN quarter <> 0 THEN CAST(trunc(quarter) AS BIGINT) || ' quarters' END, CASE WHEN lb <> 0 THEN CAST(trunc(lb) AS BIGINT) || ' lb' END) AS q FROM rows)
SELECT id, line, '- **' || commodity || '**: ' || CASE WHEN q = '' THEN 'quantity unspecified' ELSE q END || CASE WHEN total_pounds <> 0 THEN ' (' || CAST(trunc(total_pounds) AS BIGINT) || ' total pounds)' ELSE '' END || CASE WHEN weight_tons <> 0 THEN printf(' [%.3f weight tons]', weight_tons) ELSE '' END AS item,
  'In ' || year || ', ' || from_location || ' exported ' || CASE WHEN hh <> 0 THEN CAST(trunc(hh) AS BIGINT) || ' hogsheads' WHEN weight_tons > 0.01 THEN printf('%.2f weight tons', weight_tons) WHEN total_pounds > 0 THEN CAST(trunc(total_pounds) AS BIGINT) || ' pounds' END || ' of ' || commodity || ' to ' || to_location || '.' AS sentence FROM said""")
def _(spark, d):
    """Every shipment as a list item and as a sentence."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), n.alias("line"), F.concat(F.lit("good_"), (F.col("l_partkey") % 7).cast("string")).alias("commodity"), F.concat(F.lit("port_"), (F.col("l_suppkey") % 5).cast("string")).alias("from_location"), F.lit("London").alias("to_location"), (1700 + F.col("l_orderkey") % 50).alias("year"),
        F.when(n % 3 == 0, q).otherwise(0).alias("hh"), F.when(n % 2 == 0, q / 4).alias("ton"), F.when(n % 5 == 0, q).alias("quarter"), F.when(n % 7 == 1, F.col("l_extendedprice")).alias("lb"), F.when(n % 4 != 0, F.col("l_extendedprice")).alias("total_pounds"), F.when(n % 4 == 1, q / 8).alias("weight_tons"),
    )
    return rows.select("id", "line", ledger.quantity_line().alias("item"), ledger.export_sentence().alias("sentence"))


@query("retrieval_coverage", "SELECT event_type AS system, CAST(count(DISTINCT user_id) AS BIGINT) AS docs, round(100 * count(DISTINCT user_id) / (SELECT count(DISTINCT c_custkey) FROM customer), 2) AS coverage_pct FROM events SEMI JOIN customer ON c_custkey = user_id GROUP BY event_type")
def _(spark, d):
    """Share of the corpus that each system surfaced."""
    surfaced = table(spark, d, "events").select(F.col("event_type").alias("system"), F.col("user_id").alias("doc_id"))
    return retrieval.coverage(surfaced, table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), "system")


_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ner.SAID.items())


@query("hard_examples", f"""WITH {MENTIONS}, kinds AS (SELECT unnest({list(ner.SAID)!r}) AS type), held AS (SELECT DISTINCT doc_id, type FROM mentions)
SELECT d.doc_id, k.type, 'negative' AS kind, CAST(len(d.text) AS BIGINT) AS chars, '' AS answer FROM documents d JOIN (SELECT DISTINCT doc_id FROM held) USING (doc_id), kinds k WHERE (d.doc_id, k.type) NOT IN (SELECT (doc_id, type) FROM held)
UNION ALL SELECT doc_id, type, 'positive', CAST(len(replace(CASE type {_SAID} END, '{{}}', text)) AS BIGINT), text FROM (SELECT DISTINCT doc_id, type, text FROM mentions)""")
def _(spark, d):
    """Hard negatives and positives of every document by type: how long each is, and its answer."""
    made = ner.hard_examples(table(spark, d, "documents"), mentions(spark, d))
    return made.select("doc_id", "type", "kind", F.length("text").cast("long").alias("chars"), F.array_join("texts", ",").alias("answer"))


QUERIES, ORACLE = query.queries, query.oracle
