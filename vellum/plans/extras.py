"""The smaller operators: names, prompts, guards, mixes, regional repairs, second-level summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions import udfs, vocab
from vellum.operators import graph, ner, ocr, retrieval
from vellum.operators.ledger import ledger
from vellum.plans.graphs import _TOP, _nearest
from vellum.plans.ledger import LEDGER
from vellum.plans.views import MENTIONS, PAGES, Registry, mentions, pages, table
from vellum.sources import writers
from vellum.streaming import ingest

query = Registry()


@query("entity_normalize", f"WITH {MENTIONS} SELECT doc_id, ord, '''' || lower(text) || '''' AS text FROM mentions")
def _(spark, d):
    """Compatibility forms and folded punctuation of every mention."""
    return mentions(spark, d).select("doc_id", "ord", udfs.entity_text(F.concat(F.lit("“"), "text", F.lit("”."))).alias("text"))


@query("mention_occurrences", f"WITH {MENTIONS} SELECT m.doc_id, m.text AS name, CAST(len(regexp_extract_all(d.text, '(?i)' || m.text)) AS BIGINT) AS n FROM mentions m JOIN documents d ON m.doc_id = d.doc_id WHERE m.ord = 0")
def _(spark, d):
    """Every place of each document's first mention, in any case."""
    first = mentions(spark, d).filter("ord = 0").select("doc_id", F.col("text").alias("name"))
    return table(spark, d, "documents").join(first, "doc_id").select("doc_id", "name", F.size(udfs.occurrences("text", "name")).cast("long").alias("n"))


@query("mention_offsets")
def _(spark, d):
    """Each mention's first place that no earlier one took."""
    names = mentions(spark, d).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("names"))
    found = table(spark, d, "documents").join(names, "doc_id").select("doc_id", F.posexplode(udfs.first_unused("text", "names")).alias("ord", "x"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


@query("clean_names", "SELECT o_orderkey, substr(regexp_replace(o_orderpriority, '[<>:\"/\\\\|?*]', '', 'g'), 1, 120) || ' - ' || CAST(year(o_orderdate) AS VARCHAR) || ' - Order ' || o_orderkey || '.pdf' AS name FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.clean_filename(F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), F.concat(F.lit("Order: "), F.col("o_orderkey").cast("string"))).alias("name"))


@query("ledger_narrative", LEDGER + "SELECT commodity, from_location, to_location, year, CAST(count(*) AS BIGINT) AS n, 'In ' || year || ', ' || from_location || ' sent ' || CAST(CAST(trunc(round(sum(quantity), 2)) AS BIGINT) AS VARCHAR) || ' units of ' || commodity || ' to ' || to_location || '.' AS sentence FROM ledger GROUP BY commodity, from_location, to_location, year")
def _(spark, d):
    per = ledger(spark, d).groupBy("commodity", "from_location", "to_location", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("q"))
    say = F.concat(F.lit("In "), F.col("year").cast("string"), F.lit(", "), "from_location", F.lit(" sent "), F.col("q").cast("long").cast("string"), F.lit(" units of "), "commodity", F.lit(" to "), "to_location", F.lit("."))
    return per.withColumn("sentence", say).drop("q")


@query("prompt_build", "SELECT doc_id, k.type, 'List every ' || lower(k.type) || ' in the text as JSON.' || chr(10) || 'TEXT: ' || text AS prompt FROM documents CROSS JOIN (SELECT unnest(['TOPONYM', 'PERSON', 'ORGANIZATION', 'COMMODITY']) AS type) k")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, vocab.ENTITY_TYPES))).alias("type"))
    return docs.select("doc_id", "type", F.concat(F.lit("List every "), F.lower("type"), F.lit(" in the text as JSON.\nTEXT: "), "text").alias("prompt"))


@query("document_guards", f"WITH {MENTIONS} SELECT x.doc_id, CAST(count(*) AS BIGINT) AS entities FROM documents x JOIN mentions m ON x.doc_id = m.doc_id WHERE len(x.text) >= 50 GROUP BY x.doc_id HAVING count(*) >= 2")
def _(spark, d):
    n = mentions(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities")).filter("entities >= 2")
    return n.join(table(spark, d, "documents").filter(F.length("text") >= 50).select("doc_id"), "doc_id", "left_semi")


@query("synthetic_mix", "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(body)) AS BIGINT) AS chars FROM (SELECT 'gold' AS kind, text AS body FROM documents UNION ALL SELECT 'negative', replace(text, 'a', 'o') FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'positive', 'Of sugar: ' || text FROM documents WHERE doc_id % 4 = 1) GROUP BY kind")
def _(spark, d):
    """Gold examples with negatives and positives made from them, each once."""
    docs = table(spark, d, "documents")
    kind = lambda df, k, body: df.select(F.lit(k).alias("kind"), body.alias("body"))
    mixed = kind(docs, "gold", F.col("text")).unionByName(kind(docs.filter("doc_id % 4 = 0"), "negative", F.replace("text", F.lit("a"), F.lit("o")))).unionByName(kind(docs.filter("doc_id % 4 = 1"), "positive", F.concat(F.lit("Of sugar: "), "text")))
    return mixed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@query("dehyphenate")
def _(spark, d):
    """Lines of each document with words rejoined over line ends."""
    lexicon = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word"))
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("region"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ocr.rejoin_lines(lines, lexicon)


@query("adjacent_lines", f"WITH {PAGES} SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, ref, lead(ref) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM pages) WHERE NOT ends_with(ref, '.') AND nxt IS NOT NULL GROUP BY doc_id")
def _(spark, d):
    """Lines that run on into the next one."""
    from pyspark.sql.window import Window as W

    p = pages(spark, d).withColumn("nxt", F.lead("ref").over(W.partitionBy("doc_id").orderBy("line_no")))
    return p.filter(~F.col("ref").endswith(".") & F.col("nxt").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("artifact_taxonomy")
def _(spark, d):
    return pages(spark, d).filter("ref <> hyp").select("system", udfs.artifact_taxonomy("ref", "hyp").alias("e")).select("system", "e.*").groupBy("system").agg(*(F.sum(c).alias(c) for c in udfs.kernels.ARTIFACTS))


_OPS = PAGES + ", per AS (SELECT system, CAST(sum(levenshtein(ref, hyp)) AS DOUBLE) / sum(len(ref)) AS share FROM pages GROUP BY system)"


@query("error_share_overview", f"WITH {_OPS} SELECT round(avg(share), 6) AS mean, round(min(share), 6) AS least, round(max(share), 6) AS most FROM per")
def _(spark, d):
    """Shares per system, then across systems."""
    per = ocr.with_distance(pages(spark, d)).groupBy("system").agg((F.sum("distance") / F.sum("ref_chars")).alias("share"))
    return per.agg(F.round(F.avg("share"), 6).alias("mean"), F.round(F.min("share"), 6).alias("least"), F.round(F.max("share"), 6).alias("most"))


@query("vocabulary_overlap", f"WITH {PAGES} SELECT system, CAST(sum(len(list_filter(list_distinct(string_split(hyp, ' ')), lambda w: NOT list_contains(string_split(ref, ' '), w)))) AS BIGINT) AS new_words FROM pages GROUP BY system")
def _(spark, d):
    return pages(spark, d).groupBy("system").agg(F.sum(F.size(F.array_except(X.words(F.col("hyp")), X.words(F.col("ref"))))).alias("new_words"))


@query("median_order", f"WITH {PAGES} SELECT system, round(quantile_cont(levenshtein(ref, hyp) / len(ref), 0.5), 6) AS median, CAST(row_number() OVER (ORDER BY round(quantile_cont(levenshtein(ref, hyp) / len(ref), 0.5), 6), system) AS INTEGER) AS place FROM pages GROUP BY system")
def _(spark, d):
    from pyspark.sql.window import Window as W

    per = ocr.summary(ocr.with_distance(pages(spark, d)), ["system"], ["cer"]).select("system", F.col("median_cer").alias("median"))  # refined histograms beyond some millions of pages
    return per.withColumn("place", F.row_number().over(W.orderBy("median", "system")))


_FILES = """files AS (SELECT s_name || CASE s_suppkey % 3 WHEN 0 THEN '_page_001.md' WHEN 1 THEN ' the rest of a title.md' ELSE '.md' END AS file_name FROM supplier UNION ALL SELECT 'Supplier.md'),
golds AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN s_name || ' and more' WHEN 1 THEN substr(s_name, 3) ELSE s_name END AS gold_name FROM supplier),
based AS (SELECT file_name, replace(replace(file_name, '_page_001.md', ''), '.md', '') AS base FROM files)"""


@query("filename_match_opening", f"WITH {_FILES} SELECT gold_name, min(file_name) AS file_name FROM (SELECT DISTINCT gold_name FROM golds) LEFT JOIN based ON starts_with(gold_name, base) OR starts_with(base, gold_name) OR contains(file_name, left(gold_name, 50)) OR contains(gold_name, left(file_name, 50)) GROUP BY gold_name")
def _(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    files = s.select(F.concat("s_name", F.when(k % 3 == 0, "_page_001.md").when(k % 3 == 1, " the rest of a title.md").otherwise(".md")).alias("file_name"))
    files = files.union(spark.createDataFrame([("Supplier.md",)], "file_name string"))
    gold = s.select(F.when(k % 4 == 0, F.concat("s_name", F.lit(" and more"))).when(k % 4 == 1, F.substring("s_name", 3, 1000)).otherwise(F.col("s_name")).alias("gold_name"))
    return ocr.match_by_opening(gold, files)


@query("chunks_by_date", "SELECT CASE WHEN y BETWEEN 1400 AND 2100 THEN y || '-01-01' ELSE 'unknown' END AS observed, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(sum(greatest(1, ceil(len(text) / 2800))) AS BIGINT) AS chunks FROM (SELECT doc_id, text, CAST(1300 + doc_id % 900 AS INTEGER) AS y FROM documents) GROUP BY observed")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.iso_date((1300 + F.col("doc_id") % 900).cast("int")).alias("observed"), F.explode(retrieval.fixed_chunks(F.col("text"), 3000, 200, strip=False)).alias("c"))
    return docs.groupBy("observed").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))


@query("pair_evidence", f"""WITH {MENTIONS}, near AS (SELECT x.doc_id, lower(x.text) AS a, lower(y.text) AS b, greatest(0, greatest(x.start, y.start) - least(x."end", y."end")) AS gap, least(x.start, y.start) AS lo, greatest(x."end", y."end") AS hi
  FROM mentions x JOIN mentions y ON x.doc_id = y.doc_id AND lower(x.text) < lower(y.text) WHERE greatest(0, greatest(x.start, y.start) - least(x."end", y."end")) < 500),
best AS (SELECT doc_id, a, b, min((gap, lo, hi)) AS m FROM near GROUP BY doc_id, a, b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m[1], a, b) AS rank FROM best)
SELECT r.doc_id, a, b, md5(trim(substr(text, CAST(greatest(m[2] - 200, 0) + 1 AS BIGINT), CAST(m[3] + 200 - greatest(m[2] - 200, 0) AS BIGINT)), ' ')) AS evidence_md5 FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE rank <= 20""")
def _(spark, d):
    found = graph.evidence(graph.close_pairs(mentions(spark, d)), table(spark, d, "documents"))
    return found.select("doc_id", "a", "b", F.md5("evidence").alias("evidence_md5"))


@query("context_lines", f"SELECT query_id, rank, format('[{{}}] (doc: {{}}, relevance: {{:.3f}})', rank, vec_id, score) AS line FROM ({_TOP})")
def _(spark, d):
    return retrieval.context_lines(_nearest(spark, d).withColumnRenamed("vec_id", "doc_id")).select("query_id", "rank", "line")


@query("grading_summary", "SELECT event_type AS system, CAST(user_id % 3 AS BIGINT) AS tier, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(min(value), 6) AS least, round(max(value), 6) AS most, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def _(spark, d):
    r = lambda c: F.round(c, 6)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("system"), (F.col("user_id") % 3).cast("long").alias("tier")).agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("deviation"), r(F.min("value")).alias("least"), r(F.max("value")).alias("most"), F.count(F.lit(1)).alias("n"))


@query("sparse_nodes", "SELECT 'location__' || lower(n_name) AS id, 'Location' AS label, n_name AS name, NULL AS segment, CAST(n_regionkey AS INTEGER) AS region FROM nation UNION ALL SELECT 'person__' || lower(replace(c_name, '#', '_')), 'Person', c_name, c_mktsegment, NULL FROM customer")
def _(spark, d):
    """Tables of different columns under the union of them."""
    places = table(spark, d, "nation").select(X.entity_id(F.col("n_name"), F.lit("TOPONYM")).alias("id"), F.lit("Location").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"))
    people = table(spark, d, "customer").select(X.entity_id(F.col("c_name"), F.lit("PERSON")).alias("id"), F.lit("Person").alias("label"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return writers.with_all_columns([places, people], ["id", "label", "name"])


@query("crm_classes", f"WITH {MENTIONS} SELECT CASE type WHEN 'TOPONYM' THEN 'E53_Place' WHEN 'PERSON' THEN 'E21_Person' WHEN 'ORGANIZATION' THEN 'E74_Group' ELSE 'E55_Type' END AS crm_class, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY 1")
def _(spark, d):
    return mentions(spark, d).groupBy(X.crm_class(F.col("type")).alias("crm_class")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, s""")
def _(spark, d):
    """Extension: sessions of a user's events, over the stored table with the stream's expression."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "6 hours", "user_id")


@query("approx_distinct")
def _(spark, d):
    """Extension: distinct words per language by sketch."""
    return table(spark, d, "documents").select("lang", F.explode(X.words(F.lower("text"))).alias("w")).groupBy("lang").agg(F.approx_count_distinct("w", 0.01).alias("words"))


QUERIES, ORACLE = query.queries, query.oracle
