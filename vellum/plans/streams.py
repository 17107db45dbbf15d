"""Streams run over all that is there; each is checked like any query."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import ner
from vellum.plans.views import MENTIONS, NAME, Registry, table
from vellum.sources import writers
from vellum.streaming import chain, ingest

query = Registry()


def _stream(spark, d, name):
    rows = ingest.arrivals(spark, f"{d}/{name}.parquet*", table(spark, d, name).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("stream_ingest", "SELECT doc_id, len(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS n FROM documents")
def _(spark, d):
    return ingest.drain(_stream(spark, d, "documents").select("doc_id", F.length(X.normalize(F.col("text"))).cast("long").alias("n")), "ingest")


@query("stream_resume", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    """The same arrivals twice under two checkpoints: the sink holds each document once."""
    out = ingest.scratch(spark, "resume")
    for k in ("a", "b"):
        ingest.process_once(_stream(spark, d, "documents").select("doc_id", "lang"), "doc_id", lambda df: df, out + "/rows", f"{out}/{k}")
    return spark.read.parquet(out + "/rows").drop("batch")


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL")
def _(spark, d):
    """Extension: daily windows. Every window that was updated is written; the last state of each is kept."""
    e = _stream(spark, d, "events").select("ts", "event_type", "value")
    return ingest.latest(ingest.tumbling(e, "1 day", "event_type", late="60 days"), "tumbling", ["start", "event_type"]).withColumn("v", F.round("v", 2))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    """Extension: one row per user and type within the watermark."""
    return ingest.drain(ingest.distinct_within(_stream(spark, d, "events"), "user_id", "event_type", late="365 days").select("user_id", "event_type"), "dedup")


_LINKED = f"""WITH {MENTIONS}, linked AS (SELECT doc_id, ord, text, CASE WHEN len(text) % 2 = 0 THEN 'Q' || len(text) END AS authority FROM mentions),
relations AS (SELECT a.doc_id, count(*) AS n FROM linked a JOIN linked b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 WHERE a.authority IS NOT NULL AND b.authority IS NOT NULL GROUP BY a.doc_id)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS entities, CAST(count(authority) AS BIGINT) AS linked, CAST(coalesce(any_value(r.n), 0) AS BIGINT) AS relations, 'recognised,entities,links,relations' AS stopped FROM linked l LEFT JOIN relations r ON r.doc_id = l.doc_id GROUP BY l.doc_id"""


def _related(df):
    a, b = df.filter("authority is not null"), df.filter("authority is not null").select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("text").alias("target"))
    return a.join(b, ["doc_id", "ord"]).select("doc_id", F.col("text").alias("source"), "target")


@query("stream_four_stages", _LINKED)
def _(spark, d):
    """Recognition, entities, links and relations as four streams, each fed by the one before."""
    root = ingest.scratch(spark, "stages")
    mentioned = F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("ord", "text")
    none = spark.createDataFrame([], "norm string, type string, authority string")
    linked = lambda df: ner.link(df, none, lambda text, kind: f"Q{len(text)}" if len(text) % 2 == 0 else None)
    stages = [
        chain.Stage("recognised", lambda df: df.select("doc_id", "text"), "doc_id long, text string"),
        chain.Stage("entities", lambda df: df.select("doc_id", mentioned), "doc_id long, ord int, text string"),
        chain.Stage("links", lambda df: linked(df.withColumn("type", F.lit("PERSON"))).select("doc_id", "ord", "text", "authority"), "doc_id long, ord int, text string, authority string"),
        chain.Stage("relations", _related, "doc_id long, source string, target string"),
    ]
    writers.named(spark, f"{root}/all.sentinel", "done\n")
    stopped = chain.run(_stream(spark, d, "documents"), stages, root, lambda: writers.there(spark, f"{root}/all.sentinel"), poll=0.2)
    found, related = chain.rows(spark, root, stages[2]), chain.rows(spark, root, stages[3])
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"), F.count("authority").alias("linked"))
    return counts.join(related.groupBy("doc_id").agg(F.count(F.lit(1)).alias("relations")), "doc_id", "left").fillna(0, ["relations"]).withColumn("stopped", F.lit(",".join(stopped)))


QUERIES, ORACLE = query.queries, query.oracle
