"""Mixing sources to target weights by nested hash-threshold histograms.

Every document has a 36-bit hash of its id and text. Sizes are summed by source and by the hash's first
12 bits; where a source's budget ends, only the documents of that one bucket are summed again by the
next 12 bits, and again by the last 12. That gives each source a threshold, and a document is in when
its hash is below it: no sort, no state that grows with the documents, the same choice on every run.

Targets: sources in code-point order, null last, weigh ``weights`` in rotation and share ``share`` of
all sizes; a target stops at ``most`` times its source's size and the excess goes to the others by
weight, until none is above. A target of k whole sizes and a rest takes every document k times, and
those under the threshold of the rest once more.

Defined results: a null text has size 0; a text of any length is counted whole; a null source is a source of
its own; rows alike in id and text share a hash, so such ties are in or out together, and the mix can miss a
target by the size of one block of them; an empty table gives no rows; extra columns go through. Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.llm import common

BITS, LEVELS = 12, 3


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """36 bits of an MD5 over id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", common.id_text(doc_id), F.coalesce(text, F.lit("")))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, copies, budget: one row per source.

    With sources in order of cap over weight, those at their cap come first; the level at which the
    rest share what is left follows from running sums, so no loop is needed.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    level = (total * share - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(by)).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    free = F.min_by("level", F.when(~F.col("full"), F.col("place"))).over(W.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("w"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("target", target).withColumn("copies", copies).select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def _digit(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with each source's threshold: hashes below it are in."""
    edge = targets.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        here = sized.select("source", "size", F.shiftright("h", BITS * (LEVELS - level)).alias("prefix"), _digit(level).alias("digit"))
        sums = here.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.prefix") == F.col("e.prefix"))).groupBy("s.source", "e.prefix", "e.budget", "digit").agg(F.sum("size").alias("size"))
        through = F.sum("size").over(W.partitionBy("source").orderBy("digit"))
        crossing = sums.withColumn("through", through).filter((F.col("through") > F.col("budget")) & (F.col("through") - F.col("size") <= F.col("budget")))
        edge = common.materialize(crossing.select("source", (F.col("budget") - (F.col("through") - F.col("size"))).alias("budget"), (F.col("prefix") * (1 << BITS) + F.col("digit")).alias("prefix"), "size"), f"mix{level}", rows=1)
        if level < LEVELS - 1:
            edge = edge.drop("size")
    nearest = F.col("e.prefix") + F.when(F.col("e.size") - F.col("e.budget") < F.col("e.budget"), 1).otherwise(0)
    return common.materialize(targets.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select("t.source", "t.source_size", "t.target", "t.copies", F.coalesce(nearest, F.lit(0)).cast("long").alias("threshold")), "mix", rows=1)


def plan_mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of every row, and the sources' targets and thresholds; both stored."""
    sized = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), hash_of().alias("h")), "sized")
    targets = common.materialize(source_targets(sized, weights, share, most), "targets", rows=1)
    return sized, thresholds(sized, targets)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source and h) and how often the mix takes each."""
    own = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("copies").alias("_whole"), "threshold")
    return rows.join(own, rows.source.eqNullSafe(own._source)).withColumn("copies", F.col("_whole") + (F.col("h") < F.col("threshold")).cast("long")).drop("_source", "_whole", "threshold")


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with the columns it came with."""
    _, plan = plan_mix(docs, weights, share, most)
    rows = common.wrapped(docs, "doc_id", "source", "text").withColumn("h", hash_of()).drop("doc_id", "text")
    taken = with_copies(rows, plan).filter("copies > 0")
    return common.unwrapped(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    sized, plan = plan_mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return with_copies(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def targets_sql(documents: str = "documents") -> str:
    """CTEs ``sized`` and ``taken`` over a relation of documents: the mix with a running sum in place of histograms."""
    return f"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS h FROM {documents}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM weighed),
marked AS (SELECT *, level * w >= cap AS full_ FROM levels),
targets AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (SELECT min_by(level, place) FROM marked WHERE NOT full_) END AS target FROM marked),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ranked AS (SELECT s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
  CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS BIGINT) AS through,
  CAST(sum(s.size) OVER (PARTITION BY s.source, s.h) AS BIGINT) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
taken AS (SELECT *, whole + CASE WHEN through <= budget AND budget > 0 OR through > budget AND through - own <= budget AND own - (budget - (through - own)) < budget - (through - own)
  THEN 1 ELSE 0 END AS copies FROM ranked)"""


SQL = "WITH " + targets_sql() + "\nSELECT CAST(doc_id AS BIGINT) AS doc_id, size, source_size, target, copies * size AS taken, source FROM taken"
