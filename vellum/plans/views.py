"""What the corpus queries stand on: pages, mentions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL, filled by a decorator."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a gold page, and what a scanner of four habits makes of it; ``_raw`` before lower case.

    Metrics cost the square of a line's length. Only a table of fewer splits than there are cores is dealt out before.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    lines = docs.select("doc_id", F.col("source").alias("system"), (1600 + F.col("doc_id") % 200).cast("int").alias("year"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    habit = F.col("doc_id") % 4
    seen = lambda c: F.when(habit == 0, F.replace(c, F.lit("s"), F.lit("f"))).when(habit == 1, F.replace(c, F.lit("th"), F.lit("t"))).when(habit == 2, F.replace(c, F.lit("en"), F.lit("een"))).otherwise(F.col(c))
    ref = lines.filter(F.col("line").rlike(r"(?U)\S")).withColumn("ref", X.normalize(F.col("line"))).withColumn("ref_raw", X.squeeze(F.col("line"))).drop("line")
    return ref.withColumn("line_no", F.col("line_no").cast("long")).withColumn("hyp", seen("ref")).withColumn("hyp_raw", seen("ref_raw"))


PAGES = r"""lines AS (SELECT doc_id, source AS system, CAST(1600 + doc_id % 200 AS INTEGER) AS year, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS line
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))),
pages AS (SELECT doc_id, line_no, system, year, ref, CASE doc_id % 4 WHEN 0 THEN replace(ref, 's', 'f') WHEN 1 THEN replace(ref, 'th', 't') WHEN 2 THEN replace(ref, 'en', 'een') ELSE ref END AS hyp
  FROM (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS ref FROM lines) WHERE ref <> '')"""

NAME = "[A-Z][a-z]+"


def mention_type(name: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("TOPONYM", "COMMODITY", "PERSON", "ORGANIZATION"))), (F.ascii(name) % 4 + 1).cast("int"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of whole texts as entities: doc_id, ord, text, type, start, end."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("m"), F.transform(F.slice(F.split("text", NAME, -1), 1, 1 << 30), F.length).alias("g"))).alias("ord", "z")).filter("z.m is not null")
    each = each.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("z.m").alias("text"), F.col("z.g").alias("gap"))  # the text between names isn't dealt out, its length is
    end = F.sum(F.length("text") + F.col("gap")).over(W.partitionBy("doc_id").orderBy("ord"))
    return each.select("doc_id", "ord", "text", mention_type(F.col("text")).alias("type"), (end - F.length("text")).alias("start"), end.alias("end"))


MENTIONS = f"""found AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS ord, ms[i] AS text, gs[i] AS gap FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{NAME}') AS ms, string_split_regex(text, '{NAME}') AS gs FROM documents))),
mentions AS (SELECT doc_id, ord, text, ['TOPONYM', 'COMMODITY', 'PERSON', 'ORGANIZATION'][ascii(text) % 4 + 1] AS type, CAST("end" - len(text) AS BIGINT) AS start, "end" FROM
  (SELECT *, CAST(sum(len(gap) + len(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS "end" FROM found))"""

_NEXT = {"TOPONYM": "COMMODITY", "COMMODITY": "PERSON", "PERSON": "ORGANIZATION", "ORGANIZATION": "TOPONYM"}


def gold(m: DataFrame) -> DataFrame:
    """Mentions at even places, and all of every third document."""
    return m.filter((F.col("ord") % 2 == 0) | (F.col("doc_id") % 3 == 0)).withColumnRenamed("type", "label").withColumn("text", F.lower("text"))


def predicted(m: DataFrame) -> DataFrame:
    """Mentions but every third; every fifth under the next label."""
    flip = F.element_at(F.create_map(*(F.lit(x) for p in _NEXT.items() for x in p)), F.col("type"))
    return m.filter(F.col("ord") % 3 != 0).withColumn("label", F.when(F.col("ord") % 5 == 0, flip).otherwise(F.col("type"))).drop("type").withColumn("text", F.lower("text"))


_CASE = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NEXT.items()) + " END"
SIDES = (
    MENTIONS
    + f""",
gold AS (SELECT doc_id, ord, lower(text) AS text, type AS label, start, "end" FROM mentions WHERE ord % 2 = 0 OR doc_id % 3 = 0),
pred AS (SELECT doc_id, ord, lower(text) AS text, CASE WHEN ord % 5 = 0 THEN {_CASE} ELSE type END AS label, start, "end" FROM mentions WHERE ord % 3 <> 0)"""
)
