"""Scores of predicted entities against gold ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.functions import udfs


def prf(df: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    df = df.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return df.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def matched(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key of either side, with in_gold and in_pred."""
    g, p = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True)), pred.select(*keys).distinct().withColumn("in_pred", F.lit(True))
    return g.join(p, keys, "full").fillna(False, ["in_gold", "in_pred"])


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*by).agg(n(F.col("in_gold") & F.col("in_pred")).alias("tp"), n(~F.col("in_gold")).alias("fp"), n(~F.col("in_pred")).alias("fn"))


def set_scores(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Scores over sets of keys, per group of ``by`` (which may be keys or empty)."""
    return prf(counts(matched(gold, pred, keys), by))


def hit_spans(spans: DataFrame, others: DataFrame) -> DataFrame:
    """spans (doc_id, label, start, end) with ``hit``: whether one of ``others`` in the same document under the same label overlaps.

    A sweep: of those that start before a span's end, the one that reaches furthest must end behind its start. One sort
    of each document and label, however many spans overlap.
    """
    sides = spans.select("doc_id", "label", F.col("end").alias("_at"), F.lit(0).alias("_side"), F.col("start").alias("start"), F.col("end").alias("end"), F.lit(None).cast("long").alias("_reach"))
    rows = sides.unionByName(others.select("doc_id", "label", F.col("start").alias("_at"), F.lit(1).alias("_side"), "start", "end", F.col("end").cast("long").alias("_reach")))
    before = W.partitionBy("doc_id", "label").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = (F.max("_reach").over(before) > F.col("start")) & F.col("doc_id").isNotNull() & F.col("label").isNotNull()
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).filter("_side = 0").select("doc_id", "label", "start", "end", "hit")


def span_scores(gold: DataFrame, pred: DataFrame, overlap: bool) -> DataFrame:
    """Legacy span scores per label: gold spans hit are true positives, predicted spans without a hit false ones; many to many."""
    n = lambda c: F.count(F.when(c, 1))
    if overlap:
        marked = [hit_spans(a, b) for a, b in ((gold, pred), (pred, gold))]
    else:
        keys = ["doc_id", "label", "start", "end"]
        marked = [a.select(*keys).join(b.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left").fillna(False, ["hit"]) for a, b in ((gold, pred), (pred, gold))]
    of_gold = marked[0].groupBy("label").agg(n(F.col("hit")).alias("tp"), n(~F.col("hit")).alias("fn"))
    of_pred = marked[1].groupBy("label").agg(n(~F.col("hit")).alias("fp"))
    return prf(of_gold.join(of_pred, "label", "full").fillna(0, ["tp", "fp", "fn"]))


def alignment(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id and the five-pass alignment's pairs, one per row."""
    side = lambda df, n: df.select("doc_id", F.struct("text", "label").alias("e")).distinct().groupBy("doc_id").agg(F.collect_list("e").alias(n))
    return side(gold, "g").join(side(pred, "p"), "doc_id", "full").select("doc_id", F.explode(udfs.align("g", "p")).alias("x")).select("doc_id", "x.*")


def confusion(pairs: DataFrame) -> DataFrame:
    """gold label, predicted label, n; ``O`` for nothing."""
    return pairs.groupBy(F.coalesce("gold_label", F.lit("O")).alias("gold"), F.coalesce("pred_label", F.lit("O")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def slot_errors(pairs: DataFrame) -> DataFrame:
    """Substitutions, deletions, insertions and their rate over gold slots."""
    n = lambda c: F.count(F.when(F.col("category") == c, 1))
    out = pairs.agg(n("substitution").alias("substitutions"), n("missing").alias("deletions"), n("spurious").alias("insertions"), F.count("gold_label").alias("slots"))
    out = out.withColumn("correct", F.col("slots") - F.col("substitutions") - F.col("deletions"))
    return out.withColumn("ser", F.when(F.col("slots") > 0, F.round((F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.col("slots"), 6)).otherwise(0.0))


def diversity(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per label: distinct forms on each side, shared ones, coverage of gold, forms predicted once."""
    forms = lambda df, n: df.groupBy("label", "text").agg(F.count(F.lit(1)).alias(n))
    both = forms(gold, "g").join(forms(pred, "p"), ["label", "text"], "full")
    out = both.groupBy("label").agg(F.count("g").alias("gold_forms"), F.count("p").alias("pred_forms"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("p") == 1, 1)).alias("hapax"))
    return out.withColumn("coverage", F.when(F.col("gold_forms") > 0, F.round(F.col("shared") / F.col("gold_forms"), 6)).otherwise(0.0))


def top_forms(pred: DataFrame, k: int = 5) -> DataFrame:
    n = pred.groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "text"))).filter(F.col("rank") <= k)


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values, and element int(0.95 n): picked, not interpolated."""
    s, n = F.sort_array(values), F.size(values)
    return F.struct(F.element_at(s, (F.floor(n / 2) + 1).cast("int")).alias("median"), F.element_at(s, F.least(F.floor(n * 0.95) + 1, n).cast("int")).alias("p95"))
