"""The trade ledger and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def zero_to_null(c: Column) -> Column:
    """A measure of zero means that none was recorded."""
    return F.nullif(c, F.lit(0.0))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shipment: commodity, from, to, year and measures."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    part = read("part").select("p_partkey", F.col("p_name").alias("commodity"))
    nation = read("nation").select("n_nationkey", "n_name")
    supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("from_location"))
    customer = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("to_location"))
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select("commodity", "from_location", "to_location", "year", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value"), zero_to_null(F.col("l_discount")).alias("discount"), zero_to_null(F.col("l_tax")).alias("tax"))
    )


def year_bucket(c: Column, years: int) -> Column:
    return (F.floor(c / years) * years).cast("int")


def top_exports(rows: DataFrame, k: int = 3, years: int = 25) -> DataFrame:
    """The k commodities of the largest quantity for each origin and bucket of years."""
    totals = rows.groupBy("from_location", year_bucket(F.col("year"), years).alias("bucket"), "commodity").agg(F.round(F.sum("quantity"), 2).alias("total_quantity"), F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("from_location", "bucket").orderBy(F.desc("total_quantity"), "commodity")
    return totals.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def any_measure(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Rows with a positive value in one of the measures."""
    hit = F.lit(False)
    for m in measures:
        hit = hit | (F.coalesce(m, F.lit(0.0)) > 0)
    return rows.filter(hit)


def with_defaults(rows: DataFrame, sheet: Column, to: str = "London") -> DataFrame:
    """Missing origins take the sheet's name, missing destinations the port of record."""
    filled = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), d)
    return rows.withColumn("from_location", filled(F.col("from_location"), sheet)).withColumn("to_location", filled(F.col("to_location"), F.lit(to)))


def _yearly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("from_location", "year").agg(F.round(F.sum("quantity"), 2).alias("q"))


def growth(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Each origin's quantity in two years and the growth between them."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("q")))
    per = _yearly(rows.filter(F.col("year").isin(start, end))).groupBy("from_location").agg(at(start).alias("first"), at(end).alias("last"))
    return per.filter("first is not null and last is not null").withColumn("growth", F.round(F.col("last") / F.col("first") - 1, 6))


def increase(rows: DataFrame, years: int) -> DataFrame:
    """Each commodity's quantity per bucket of years and its rise over the bucket before."""
    per = rows.groupBy("commodity", year_bucket(F.col("year"), years).alias("bucket")).agg(F.round(F.sum("quantity"), 2).alias("q"))
    return per.withColumn("increase", F.round(F.col("q") - F.lag("q").over(W.partitionBy("commodity").orderBy("bucket")), 2))


def overtakes(rows: DataFrame) -> DataFrame:
    """For two origins in name order, the first year in which the second shipped more."""
    per = _yearly(rows)
    a, b = per.alias("a"), per.alias("b")
    ahead = a.join(b, (F.col("a.year") == F.col("b.year")) & (F.col("a.from_location") < F.col("b.from_location")) & (F.col("b.q") > F.col("a.q")))
    return ahead.groupBy(F.col("a.from_location").alias("leader"), F.col("b.from_location").alias("follower")).agg(F.min("b.year").alias("year"))


def group_totals(rows: DataFrame) -> DataFrame:
    """Per origin and year: sums, distinct commodities, sorted distinct destinations."""
    return rows.groupBy("from_location", "year").agg(F.round(F.sum("quantity"), 2).alias("total_quantity"), F.round(F.sum("value"), 2).alias("total_value"), F.countDistinct("commodity").alias("commodities"), F.array_join(F.sort_array(F.collect_set("to_location")), "; ").alias("destinations"))


def profile(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("commodity").alias("commodities"), F.countDistinct("from_location").alias("origins"), F.count(F.lit(1)).alias("records"))


def documents(rows: DataFrame) -> DataFrame:
    """One text per origin and year: a line for each commodity, in order."""
    per = rows.groupBy("from_location", "year", "commodity").agg(F.round(F.sum("quantity"), 2).alias("q"))
    line = F.concat("commodity", F.lit(": "), F.col("q").cast("long").cast("string"), F.lit(" units"))
    return per.groupBy("from_location", "year").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("commodity", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))


_SOME = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
_WHOLE = lambda c: F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("string")


def quantities() -> Column:
    """What a ledger row (hh, ton, quarter, lb) shipped: hogsheads, tons, quarters and pounds, those there are, cut to whole numbers but for tons."""
    parts = [F.when(_SOME("hh"), F.concat(_WHOLE("hh"), F.lit(" hogsheads"))), F.when(_SOME("ton"), F.format_string("%.2f tons", F.bround(F.col("ton").cast("double"), 2))), F.when(_SOME("quarter"), F.concat(_WHOLE("quarter"), F.lit(" quarters"))), F.when(_SOME("lb"), F.concat(_WHOLE("lb"), F.lit(" lb")))]
    said = F.concat_ws(", ", *parts)
    return F.when(said == "", "quantity unspecified").otherwise(said)


def quantity_line() -> Column:
    """A row as a list item: commodity, quantities, total pounds and weight in tons where known."""
    pounds = F.when(_SOME("total_pounds"), F.concat(F.lit(" ("), _WHOLE("total_pounds"), F.lit(" total pounds)")))
    weight = F.when(_SOME("weight_tons"), F.format_string(" [%.3f weight tons]", F.bround(F.col("weight_tons").cast("double"), 3)))
    return F.concat(F.lit("- **"), "commodity", F.lit("**: "), quantities(), F.coalesce(pounds, F.lit("")), F.coalesce(weight, F.lit("")))


def export_sentence() -> Column:
    """One sentence by the first measure that says something: hogsheads, weight over 0.01 tons, pounds; null where none does."""
    measure = F.when(_SOME("hh"), F.concat(_WHOLE("hh"), F.lit(" hogsheads"))).when(F.col("weight_tons") > 0.01, F.format_string("%.2f weight tons", F.bround(F.col("weight_tons").cast("double"), 2))).when(F.col("total_pounds") > 0, F.concat(_WHOLE("total_pounds"), F.lit(" pounds")))
    return F.concat(F.lit("In "), F.col("year").cast("string"), F.lit(", "), "from_location", F.lit(" exported "), measure, F.lit(" of "), "commodity", F.lit(" to "), "to_location", F.lit("."))
