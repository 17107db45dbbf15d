"""Exact quantiles of groups of any size: ranks are found by refining histograms, so no task holds a group.

Equal values of a group are counted as one row. A wanted rank starts with its group's range; each round counts the values
of the range in ``bins`` of equal width, goes on with the bin that holds the rank, from its least to its greatest value,
and ends where at most ``few`` distinct values are left, which one window ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum import storage


def _counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """g (the group's columns), v, c: each value of a group once with its count, null values left out; stored."""
    known = rows.filter(F.col(value).isNotNull()).select(F.struct(*by).alias("g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    return storage.kept(known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "values")


def _at_ranks(once: DataFrame, ranks: DataFrame, bins: int, few: int) -> DataFrame:
    """g, k, v: the value at each rank (g, k from 0) of the sorted values of its group; stored."""
    whole = once.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("kinds"))
    open_ = storage.kept(ranks.select("g", "k").distinct().join(whole, "g").withColumn("before", F.lit(0).cast("long")), "open")
    closed = []
    while True:
        closed.append(open_.filter(F.col("kinds") <= few))
        more = open_.filter(F.col("kinds") > few)
        if not more.limit(1).count():
            break
        met = once.join(storage.sent_if_small(more.drop("kinds")), "g").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = met.groupBy("g", "k", "before", at.alias("bin")).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("kinds"))
        through = F.col("before") + F.sum("n").over(W.partitionBy("g", "k").orderBy("bin"))  # ``bins`` rows
        found = counts.withColumn("through", through).filter((F.col("through") > F.col("k")) & (F.col("through") - F.col("n") <= F.col("k")))
        open_ = storage.kept(found.select("g", "k", "lo", "hi", "kinds", (F.col("through") - F.col("n")).alias("before")), "open")
    small = closed[0].select("g", "k", "lo", "hi", "before")
    for c in closed[1:]:
        small = small.unionByName(c.select("g", "k", "lo", "hi", "before"))
    met = once.join(storage.sent_if_small(storage.kept(small, "closed")), "g").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    through = F.col("before") + F.sum("c").over(W.partitionBy("g", "k").orderBy("v"))  # ``few`` rows
    return storage.kept(met.withColumn("through", through).filter((F.col("through") > F.col("k")) & (F.col("through") - F.col("c") <= F.col("k"))).select("g", "k", "v"), "found")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple = (0.5,), bins: int = 1024, few: int = 4096) -> DataFrame:
    """by, share, quantile: interpolated between the two nearest ranks, as ``percentile`` does; null values are left out, and groups of nothing else have none."""
    once = _counted(rows, by, value)
    place = (F.col("n") - 1) * F.col("share")
    wanted = once.groupBy("g").agg(F.sum("c").alias("n")).withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("low", F.floor(place)).withColumn("part", place - F.col("low"))
    wanted = storage.kept(wanted.withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1)), "ranks")
    values = _at_ranks(once, wanted.select("g", F.explode(F.array("low", "high")).alias("k")), bins, few)
    at = lambda k, name: values.select("g", F.col("k").alias(k), F.col("v").alias(name))
    both = wanted.join(at("low", "a"), ["g", "low"]).join(at("high", "b"), ["g", "high"])
    mixed = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return both.select("g.*", "share", mixed.alias("quantile"))


def rank_picks(rows: DataFrame, by: list[str], value: str, picks: dict[str, Callable[[Column], Column]], bins: int = 1024, few: int = 4096) -> DataFrame:
    """by, n, and under each name the value at a rank from 0 that is a function of the group's count; nothing is interpolated."""
    once = _counted(rows, by, value)
    counts = once.groupBy("g").agg(F.sum("c").alias("n"))
    wanted = storage.kept(counts.select("g", "n", *(F.greatest(F.least(k(F.col("n")), F.col("n") - 1), F.lit(0)).cast("long").alias(name) for name, k in picks.items())), "ranks")
    values = _at_ranks(once, wanted.select("g", F.explode(F.array(*picks)).alias("k")), bins, few)
    out = wanted
    for name in picks:
        out = out.join(values.select("g", F.col("k").alias(name), F.col("v").alias(f"_{name}")), ["g", name])
    return out.select("g.*", "n", *(F.col(f"_{name}").alias(name) for name in picks))


def medians(rows: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """by, and the median of each measure under its name; groups without a value have null."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("_measure"), c.cast("double").alias("_value")) for n, c in measures.items()))).alias("_m")
    found = exact_quantiles(rows.select(*by, each).select(*by, "_m.*"), [*by, "_measure"], "_value")
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_measure") == n, F.col("quantile"))).alias(n) for n in measures))


def latencies(rows: DataFrame, by: list[str], seconds: str, chars: str) -> DataFrame:
    """by, n, mean, median, p95, chars_per_s: the elements n // 2 and int(0.95 n) of the sorted times, not interpolated; characters over seconds."""
    picked = rank_picks(rows, by, seconds, {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)})
    rate = rows.groupBy(*by).agg(F.avg(seconds).alias("mean"), (F.sum(chars) / F.sum(seconds)).alias("chars_per_s"))
    keys = F.lit(True)
    for c in by:
        keys = keys & picked[c].eqNullSafe(rate[c])
    return picked.join(rate, keys).select(*(picked[c] for c in by), "n", "mean", "median", "p95", "chars_per_s")
