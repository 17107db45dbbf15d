"""Graph construction and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import graph, retrieval
from vellum.operators.ledger import ledger
from vellum.plans.ledger import LEDGER
from vellum.plans.views import MENTIONS, Registry, mentions, table

query = Registry()
_IDS = MENTIONS + """,
ids AS (SELECT *, CASE type WHEN 'PERSON' THEN 'person__' WHEN 'TOPONYM' THEN 'location__' WHEN 'ORGANIZATION' THEN 'org__' ELSE 'commodity__' END || lower(text) AS id,
  CASE type WHEN 'PERSON' THEN 'Person' WHEN 'TOPONYM' THEN 'Location' WHEN 'ORGANIZATION' THEN 'Organization' ELSE 'Commodity' END AS label FROM mentions)"""
_NODES = _IDS + ", nodes AS (SELECT id, arg_min(label, (doc_id, ord)) AS label, arg_min(text, (doc_id, ord)) AS name FROM ids GROUP BY id)"
_PAIRS = _IDS + """,
pairs AS (SELECT x.doc_id, least(x.id, y.id) AS source, greatest(x.id, y.id) AS target, x.ord AS o1, y.ord AS o2, x.type || '-' || y.type AS types FROM ids x JOIN ids y ON x.doc_id = y.doc_id AND x.ord < y.ord),
docs5 AS (SELECT source, target, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS docs FROM (SELECT source, target, doc_id, row_number() OVER (PARTITION BY source, target ORDER BY doc_id) AS r FROM (SELECT DISTINCT source, target, doc_id FROM pairs)) WHERE r <= 5 GROUP BY ALL),
co AS (SELECT source, target, CAST(count(*) AS BIGINT) AS weight, arg_min(types, (doc_id, o1, o2)) AS types FROM pairs GROUP BY source, target),
cooccurs AS (SELECT co.*, docs5.docs FROM co JOIN docs5 USING (source, target))"""


@query("graph_nodes", f"WITH {_NODES} SELECT id, label, name FROM nodes")
def _(spark, d):
    return graph.nodes(mentions(spark, d))


@query("graph_mentions", f"WITH {_IDS} SELECT 'doc__' || doc_id AS source, id AS target, 'MENTIONS' AS type FROM ids")
def _(spark, d):
    return graph.mention_edges(mentions(spark, d))


@query("graph_cooccurs", f"WITH {_PAIRS} SELECT * FROM cooccurs")
def _(spark, d):
    return graph.cooccurrence(mentions(spark, d))


@query("graph_top_pairs", f"WITH {_PAIRS} SELECT source, target, weight FROM cooccurs ORDER BY weight DESC, source, target LIMIT 10")
def _(spark, d):
    return graph.top_pairs(mentions(spark, d), 10)


@query("graph_label_counts", f"WITH {_NODES} SELECT label, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY label")
def _(spark, d):
    return graph.histogram(graph.nodes(mentions(spark, d)), "label")


@query("graph_fulltext", f"WITH {_NODES} SELECT id, label, name FROM nodes WHERE contains(lower(name), 'and')")
def _(spark, d):
    return graph.full_text(graph.nodes(mentions(spark, d)), "And")


_SAN = lambda c: f"regexp_replace(lower(trim({c})), '[^a-z0-9_\\-]', '_', 'g')"
_TRADE = LEDGER + f""", edges AS (
  SELECT 'location__' || {_SAN("from_location")} AS source, 'commodity__' || {_SAN("commodity")} AS target, 'EXPORTS' AS type, year FROM ledger
  UNION ALL SELECT 'commodity__' || {_SAN("commodity")}, 'location__' || {_SAN("to_location")}, 'IMPORTED_TO', year FROM ledger
  UNION ALL SELECT 'location__' || {_SAN("from_location")}, 'location__' || {_SAN("to_location")}, 'TRADED_WITH', year FROM ledger
  UNION ALL SELECT DISTINCT 'location__' || {_SAN("from_location")}, 'year__' || year, 'EXPORTED_IN', year FROM ledger)"""


@query("graph_trade_edges", _TRADE + " SELECT source, target, type, CAST(count(*) AS BIGINT) AS n, min(year) AS first_year, max(year) AS last_year FROM edges GROUP BY source, target, type")
def _(spark, d):
    return graph.trade_edges(ledger(spark, d)).groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("graph_k_hop", _TRADE + """, both_ AS (SELECT source AS a, target AS b FROM edges WHERE type = 'EXPORTED_IN' OR type = 'TRADED_WITH' UNION SELECT target, source FROM edges WHERE type = 'EXPORTED_IN' OR type = 'TRADED_WITH'),
h1 AS (SELECT DISTINCT b AS id FROM both_ WHERE a = 'location__nation_0'), h2 AS (SELECT DISTINCT b AS id FROM both_ JOIN h1 ON a = h1.id)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT 'location__nation_0' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def _(spark, d):
    edges = graph.trade_edges(ledger(spark, d)).filter(F.col("type").isin("EXPORTED_IN", "TRADED_WITH")).select("source", "target").distinct()
    return graph.within_hops(edges, spark.createDataFrame([("location__nation_0",)], "id string"), 2)


@query("graph_typed_edges", f"""WITH {_NODES}, rel AS (SELECT x.text AS a, x.type AS ta, x.id AS ia, y.text || CASE WHEN x.doc_id % 5 = 0 THEN 'zzz' ELSE '' END AS b, y.id || CASE WHEN x.doc_id % 5 = 0 THEN 'zzz' ELSE '' END AS ib, x.doc_id % 2 = 0 AS fwd FROM ids x JOIN ids y ON x.doc_id = y.doc_id AND y.ord = x.ord + 1),
e AS (SELECT CASE WHEN fwd OR lower(a) = lower(b) THEN ia ELSE ib END AS source, CASE WHEN fwd OR lower(a) = lower(b) THEN ib ELSE ia END AS target FROM rel)
SELECT source, target, 'HAS_OWNER' AS type, 'cidoc_standard' AS tier, 'P52' AS property FROM e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)""")
def _(spark, d):
    m = mentions(spark, d)
    a, b = m.alias("a"), m.alias("b")
    rel = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.ord") == F.col("a.ord") + 1)).select(F.col("a.text").alias("entity_a"), F.col("a.type").alias("type_a"), F.concat("b.text", F.when(F.col("a.doc_id") % 5 == 0, "zzz").otherwise("")).alias("entity_b"), F.col("b.type").alias("type_b"), F.col("a.doc_id").alias("doc_id"))
    rel = rel.withColumn("subject", F.when(F.col("doc_id") % 2 == 0, F.upper("entity_a")).otherwise(F.col("entity_b"))).withColumn("relation", F.lit("has_owner"))
    return graph.typed_edges(rel, graph.nodes(m))


@query("close_pairs", f"""WITH {MENTIONS}, near AS (SELECT x.doc_id, lower(x.text) AS a, lower(y.text) AS b, greatest(0, greatest(x.start, y.start) - least(x."end", y."end")) AS gap, least(x.start, y.start) AS lo, greatest(x."end", y."end") AS hi
  FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND lower(x.text) < lower(y.text) WHERE greatest(0, greatest(x.start, y.start) - least(x."end", y."end")) < 500),
best AS (SELECT doc_id, a, b, arg_min(gap, (gap, lo, hi)) AS distance, arg_min(lo, (gap, lo, hi)) AS lo, arg_min(hi, (gap, lo, hi)) AS hi FROM near GROUP BY doc_id, a, b)
SELECT doc_id, a, b, CAST(distance AS BIGINT) AS distance, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, a, b) AS rank FROM best) WHERE rank <= 20""")
def _(spark, d):
    return graph.close_pairs(mentions(spark, d))


@query("graph_descendants", """WITH RECURSIVE down AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, depth + 1 FROM down JOIN part p ON p.p_partkey <> 1 AND CAST(floor(p.p_partkey / 4) AS BIGINT) = down.id AND p.p_partkey >= 4)
SELECT CAST(id AS BIGINT) AS id, CAST(depth AS INTEGER) AS depth FROM down""")
def _(spark, d):
    """Everything below one collection of a tree of four branches, by a recursive query."""
    table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.floor(F.col("p_partkey") / 4).cast("long").alias("parent")).filter("id = 1 or id >= 4").createOrReplaceTempView("_collections")
    return spark.sql("WITH RECURSIVE down AS (SELECT id, 0 AS depth FROM _collections WHERE id = 1 UNION ALL SELECT c.id, depth + 1 FROM down JOIN _collections c ON c.parent = down.id AND c.id <> 1) SELECT id, depth FROM down")


@query("chunks_fixed", r"SELECT format('{}__chunk{:04d}', doc_id, i) AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_idx, c AS text FROM (SELECT doc_id, cs[i + 1] AS c, i FROM (SELECT *, unnest(range(len(cs))) AS i FROM (SELECT doc_id, list_filter(list_transform(range(0, len(text), 4400), lambda s: trim(substr(text, s + 1, 4800), ' ')), lambda c: c <> '') AS cs FROM documents)))")
def _(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.chunk_rows(docs, retrieval.fixed_chunks(F.col("text"), 4800, 400))


#: Where a window of 2000 characters that isn't the last ends: behind the last full stop and space, empty line or line feed of its last 100 characters.
_END = " ".join(f"WHEN strpos(reverse(w), {back}) > 0 THEN pos_ + 1900 + 100 - (strpos(reverse(w), {back}) - 1)" for back in ("' .'", "chr(10) || chr(10)", "chr(10)"))
_SENTENCES = f"""WITH RECURSIVE cut AS (
  SELECT doc_id, 0 AS i, 0 AS pos_, CASE WHEN len(text) <= 2000 THEN len(text) ELSE (SELECT CASE {_END} ELSE pos_ + 2000 END FROM (SELECT 0 AS pos_, substr(text, 1901, 100) AS w)) END AS e FROM documents
  UNION ALL SELECT doc_id, i + 1, pos_, CASE WHEN pos_ + 2000 >= len(text) THEN len(text) ELSE CASE {_END} ELSE pos_ + 2000 END END
  FROM (SELECT c.doc_id, c.i, c.e - 200 AS pos_, d.text, substr(d.text, c.e - 200 + 1901, 100) AS w FROM cut c JOIN documents d ON c.doc_id = d.doc_id WHERE c.e < len(d.text)))
SELECT format('{{}}__chunk{{:04d}}', c.doc_id, i) AS chunk_id, c.doc_id, CAST(i AS INTEGER) AS chunk_idx, substr(text, pos_ + 1, e - pos_) AS text FROM cut c JOIN documents d ON c.doc_id = d.doc_id"""


@query("chunks_sentence", _SENTENCES)
def _(spark, d):
    return retrieval.sentence_chunks(table(spark, d, "documents"))


_TOP = "WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings, q), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"


def _nearest(spark, d, k=5):
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query("vector_topk", _TOP)
def _(spark, d):
    return _nearest(spark, d)


@query("hybrid_rows", f"SELECT query_id AS id, CAST(vec_id AS VARCHAR) AS found, 'vector' AS source FROM ({_TOP}) UNION ALL SELECT n_nationkey, n_name, 'graph' FROM nation WHERE contains(lower(n_name), 'an')")
def _(spark, d):
    vector = _nearest(spark, d).select(F.col("query_id").alias("id"), F.col("vec_id").cast("string").alias("found"))
    hits = graph.full_text(table(spark, d, "nation"), "AN", ("n_name",)).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("found"))
    return retrieval.hybrid(vector, hits)


@query("dpp_select")
def _(spark, d):
    return retrieval.diverse(_nearest(spark, d, 20).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id"), 5)


@query("retrieval_reuse", "SELECT event_type AS system, CAST(count(*) AS BIGINT) AS surfaced, CAST(count(DISTINCT floor(value)) AS BIGINT) AS unique_chunks, CAST(count(DISTINCT user_id) AS BIGINT) AS unique_docs, round(100 * (count(*) - count(DISTINCT floor(value))) / count(*), 4) AS reuse_pct, round(count(DISTINCT floor(value)) / count(DISTINCT user_id), 4) AS chunks_per_doc FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("system"), F.floor("value").alias("chunk_id"), F.col("user_id").alias("doc_id"))
    return retrieval.reuse(e, "system")


@query("pairwise_winrate", "WITH s AS (SELECT user_id AS question, event_type AS system, max(floor(value)) AS score FROM events GROUP BY ALL), g AS (SELECT a.system, a.score > b.score AS won FROM s a JOIN s b ON a.question = b.question AND a.system <> b.system AND a.score <> b.score) SELECT system, CAST(count(*) FILTER (won) AS BIGINT) AS wins, CAST(count(*) AS BIGINT) AS games, round(count(*) FILTER (won) / count(*), 6) AS win_rate FROM g GROUP BY system")
def _(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("system")).agg(F.max(F.floor("value")).alias("score"))
    return retrieval.win_rates(s)


QUERIES, ORACLE = query.queries, query.oracle
