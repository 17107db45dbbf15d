"""Trade-ledger queries: goods from supplier nations to customer nations, per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import ledger as L
from vellum.operators import library
from vellum.operators.ledger import ledger, top_exports
from vellum.plans.views import Registry, table

query = Registry()

#: The ledger view as SQL, used by every query below.
LEDGER = """WITH ledger AS (
  SELECT p.p_name AS commodity, sn.n_name AS from_location, cn.n_name AS to_location,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, l.l_quantity AS quantity, l.l_extendedprice AS value,
         nullif(l.l_discount, 0) AS discount, nullif(l.l_tax, 0) AS tax
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey)
"""


@query(
    "ledger_top_exports",
    LEDGER
    + """, totals AS (
  SELECT from_location, CAST(floor(year / 5) * 5 AS INTEGER) AS bucket, commodity,
         round(sum(quantity), 2) AS total_quantity, CAST(count(*) AS BIGINT) AS n
  FROM ledger GROUP BY ALL)
SELECT from_location, bucket, commodity, total_quantity, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY from_location, bucket ORDER BY total_quantity DESC, commodity) AS rank FROM totals)
WHERE rank <= 3""",
)
def _top_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_exports(ledger(spark, sf_dir), k=3, years=5)


_FROM_YEAR = ", per AS (SELECT from_location, year, round(sum(quantity), 2) AS q FROM ledger GROUP BY ALL)"


@query("ledger_growth_between_years", LEDGER + _FROM_YEAR + " SELECT a.from_location, a.q AS first, b.q AS last, round(b.q / a.q - 1, 6) AS growth FROM per a JOIN per b ON a.from_location = b.from_location AND a.year = 1996 AND b.year = 2000")
def _(spark, d):
    return L.growth(ledger(spark, d), 1996, 2000)


@query("ledger_decade_increase", LEDGER + """, per AS (SELECT commodity, CAST(floor(year / 3) * 3 AS INTEGER) AS bucket, round(sum(quantity), 2) AS q FROM ledger GROUP BY ALL)
SELECT commodity, bucket, q, round(q - lag(q) OVER (PARTITION BY commodity ORDER BY bucket), 2) AS increase FROM per""")
def _(spark, d):
    return L.increase(ledger(spark, d), 3)


@query("ledger_overtake_year", LEDGER + _FROM_YEAR + " SELECT a.from_location AS leader, b.from_location AS follower, CAST(min(b.year) AS INTEGER) AS year FROM per a JOIN per b ON a.year = b.year AND a.from_location < b.from_location AND b.q > a.q GROUP BY ALL")
def _(spark, d):
    return L.overtakes(ledger(spark, d))


@query("ledger_group_totals", LEDGER + "SELECT from_location, year, round(sum(quantity), 2) AS total_quantity, round(sum(value), 2) AS total_value, CAST(count(DISTINCT commodity) AS BIGINT) AS commodities, string_agg(DISTINCT to_location, '; ' ORDER BY to_location) AS destinations FROM ledger GROUP BY from_location, year")
def _(spark, d):
    return L.group_totals(ledger(spark, d))


@query("ledger_profile", LEDGER + "SELECT min(year) AS first_year, max(year) AS last_year, CAST(count(DISTINCT commodity) AS BIGINT) AS commodities, CAST(count(DISTINCT from_location) AS BIGINT) AS origins, CAST(count(*) AS BIGINT) AS records FROM ledger")
def _(spark, d):
    return L.profile(ledger(spark, d))


@query("ledger_nonzero_filter", LEDGER + "SELECT from_location, commodity, CAST(count(*) AS BIGINT) AS n, CAST(count(discount) AS BIGINT) AS with_discount FROM ledger WHERE coalesce(discount, 0) > 0 OR coalesce(tax, 0) > 0 GROUP BY ALL")
def _(spark, d):
    rows = L.any_measure(ledger(spark, d), ["discount", "tax"])
    return rows.groupBy("from_location", "commodity").agg(F.count(F.lit(1)).alias("n"), F.count("discount").alias("with_discount"))


@query("ledger_documents", LEDGER + """SELECT from_location, year, string_agg(line, chr(10) ORDER BY commodity) AS body FROM (SELECT from_location, year, commodity, commodity || ': ' || CAST(CAST(trunc(round(sum(quantity), 2)) AS BIGINT) AS VARCHAR) || ' units' AS line FROM ledger GROUP BY from_location, year, commodity) GROUP BY from_location, year""")
def _(spark, d):
    return L.documents(ledger(spark, d))


@query("ledger_rollup", LEDGER + "SELECT from_location, year, round(sum(quantity), 2) AS q FROM ledger GROUP BY ROLLUP (from_location, year)")
def _(spark, d):
    """Extension: totals at every level in one pass."""
    return ledger(spark, d).rollup("from_location", "year").agg(F.round(F.sum("quantity"), 2).alias("q"))


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    """Extension: intersection and difference of key sets."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select("s_nationkey")).exceptAll(table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("attachments_pdf", "SELECT CAST(p_partkey AS BIGINT) AS item_id, p FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '.PDF' ELSE '.txt' END AS p, CASE WHEN p_size % 3 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS t FROM part) WHERE (t = 'application/pdf' OR lower(p) LIKE '%.pdf') AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 0)")
def _(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("item_id"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".PDF").otherwise(".txt")).alias("path"), F.when(F.col("p_size") % 3 == 0, "application/pdf").otherwise("text/plain").alias("content_type"))
    return library.attachments(items, items.filter("item_id % 10 = 0")).select("item_id", F.col("path").alias("p"))


@query("first_creator", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return library.first_by(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("collections_counts", "SELECT n_nationkey AS collection_id, n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS items FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY ALL")
def _(spark, d):
    members = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("collection_id"), F.col("c_custkey").alias("item_id"))
    return library.collection_counts(table(spark, d, "nation").select(F.col("n_nationkey").alias("collection_id"), "n_name"), members)


QUERIES, ORACLE = query.queries, query.oracle
