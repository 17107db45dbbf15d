"""Quality rules with thresholds from the corpus itself.

Every document gets its counts and the rates made of them. For each language and source a mergeable
quantile sketch of each rate is kept over the documents that pass the base rules: a histogram of
``ceil(1000 * sqrt(rate))``, whose error is one bin, whose merge is a sum, and whose rows are dealt out by
group, rate and bin, so that no task merges a hot group alone. Languages and the corpus have the sums of
their groups' histograms. A group's fence for a rate is

    high + reach * max(high - median, unit)

``high`` is the quantile up to which ``TRUSTED`` takes a group to be sound in that rate, ``unit`` the group's
median of what one event adds to the rate (one symbol in the median document, say), which is what is left
of the spread where the rate is mostly nought. So a source of tables has a loose fence for symbols and one
of prose a tight one; nothing is a fixed cutoff. Small groups lean on their language's fence and small
languages on the corpus's, by the geometric mean of n parts of their own and ``LEAN`` of the other, without a
switch. The fences, one row per language and source, are joined back.

Defined results: a null text has no words and fails; null languages and sources are groups of their own;
ties in a rate share a bin, and a rate equal to its fence passes; repeated rows are judged alike; a text
may be of any length; an empty table gives no rows; extra columns are ignored (kept by ``keep_good``), and
columns of any name may stand beside ours. Built from DataFrame functions alone.

Repeated three-word windows are found per text without leaving the row: each window's hash is cut to make
room for its position, the longs are sorted, and equal neighbours are candidates; the words of candidates
are then compared, so a hash never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.llm import common

SYMBOLS = "[^#*$%&|<>]+"
#: rate -> what it counts, over what, the share of a group that is trusted in it, and how many spreads beyond that a document may lie.
TRUSTED = {
    "symbol_rate": ("n_symbols", "word_chars", 0.75, 16.0),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.98, 3.0),
    "repeat_rate": ("n_repeat_words", "n_words", 0.98, 6.0),
    "upper_rate": ("n_upper", "word_chars", 0.75, 16.0),
    "bang_rate": ("n_bangs", "n_words", 0.75, 16.0),
}
RATES = list(TRUSTED)
#: Rows of its language (and of the corpus) that a group's fence is mixed with.
LEAN = 20.0
#: Bins of a sketch over the square root of a rate.
BINS = 1000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURES = [*COUNTS, "n_lines", "n_upper", "n_bangs"]


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the counts and rates; later columns build on earlier ones, each computed once. ``wrapped`` rows keep columns of clashing names."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", F.array_remove(F.split("_text", common.SPACE), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_bits", F.greatest(F.lit(1), F.ceil(F.log2(F.col("n_words") + 2))).cast("int"))
    window = "shiftleft(shiftright(xxhash64(get(_hash, i), get(_hash, i + 1), get(_hash, i + 2)), _bits), _bits) | i"
    df = df.withColumn("_keys", F.expr(f"sort_array(if(n_words < 3, array(cast(null as long)), transform(sequence(0, cast(greatest(n_words, 3) as int) - 3), i -> {window})))"))
    alike = lambda j: f"shiftright(x, _bits) <=> shiftright(get(_keys, {j}), _bits)"
    place = "cast(x & (shiftleft(1L, _bits) - 1) as int)"
    maybe = f"transform(filter(_keys, (x, j) -> {alike('j - 1')} or {alike('j + 1')}), x -> {place})"
    # candidates with their words, in order: those like a neighbour are repeats
    df = df.withColumn("_maybe", F.expr(f"sort_array(transform({maybe}, p -> struct(get(_words, p) as a, get(_words, p + 1) as b, get(_words, p + 2) as c, p as p)))"))
    same = lambda j: f"(x.a <=> get(_maybe, {j}).a and x.b <=> get(_maybe, {j}).b and x.c <=> get(_maybe, {j}).c)"
    df = df.withColumn("_at", F.expr(f"sort_array(transform(filter(_maybe, (x, j) -> j > 0 and {same('j - 1')} or {same('j + 1')}), x -> x.p))"))
    df = df.withColumn("n_repeat_words", F.expr("if(n_words < 4, 0L, aggregate(transform(_at, (p, k) -> cast(least(3, coalesce(get(_at, k + 1) - p, 3)) as bigint)), 0L, (a, x) -> a + x))"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("n_lines", F.size("_lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    for name, others in (("n_symbols", SYMBOLS), ("n_upper", r"[^\p{Lu}]+"), ("n_bangs", "[^!]+")):
        df = df.withColumn(name, F.length(F.regexp_replace("_text", others, "")).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_text", "_words", "_hash", "_bits", "_keys", "_maybe", "_at", "_lines")


def rate(name: str) -> Column:
    count, over, _, _ = TRUSTED[name]
    return F.col(count) / F.greatest(F.col(over), F.lit(1))


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, what, bin, n: the histograms of every rate and unit over the documents that pass the base rules."""
    values = [F.struct(F.lit(r).alias("what"), rate(r).alias("x")) for r in RATES]
    values += [F.struct(F.lit(over).alias("what"), (1 / F.greatest(F.col(over), F.lit(1))).alias("x")) for over in sorted({t[1] for t in TRUSTED.values()})]
    each = stats.filter("not base_failed").select("lang", "source", F.inline(F.array(*values)))
    return each.groupBy("lang", "source", "what", F.ceil(BINS * F.sqrt("x")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(histograms: DataFrame, group: list[str]) -> DataFrame:
    """group, n and a fence per rate, from histograms."""
    merged = histograms.groupBy(*group, "what", "bin").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*group, "what")
    up = merged.withColumn("through", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own))
    value = F.pow(F.col("bin") / BINS, F.lit(2))
    cut = lambda q: F.min(F.when(F.col("through") >= q * F.col("total"), value))
    high = F.lit(0.5)
    for r, t in TRUSTED.items():
        high = F.when(F.col("what") == r, t[2]).otherwise(high)
    per = up.groupBy(*group, "what").agg(F.max("total").alias("n"), cut(0.5).alias("mid"), cut(high).alias("high"))
    found = {w: lambda c, w=w: F.max(F.when(F.col("what") == w, F.col(c))) for w in [*RATES, *(t[1] for t in TRUSTED.values())]}
    fence = lambda r, over, reach: found[r]("high") + reach * F.greatest(found[r]("high") - found[r]("mid"), found[over]("mid"))
    return per.groupBy(*group).agg(F.max("n").cast("double").alias("n"), *(fence(r, t[1], t[3]).alias(f"f_{r}") for r, t in TRUSTED.items()))


def fences(stats: DataFrame) -> DataFrame:
    """_lang, _source and a fence per rate: one row per group that any document passes the base rules in."""
    histograms = common.materialize(sketches(stats), "sketches", rows=400_000)
    own, by_lang, whole = (_quantiles(histograms, g).alias(a) for g, a in ((["lang", "source"], "o"), (["lang"], "l"), ([], "w")))
    part = lambda a: F.col(f"{a}.n") / (F.col(f"{a}.n") + LEAN)
    leant = lambda a, r, parent: F.pow(F.col(f"{a}.f_{r}"), part(a)) * F.pow(parent, 1 - part(a))
    # one row of the corpus against one a language, then one a language against one a group
    langs = by_lang.join(F.broadcast(whole), F.lit(True)).select("l.lang", *(leant("l", r, F.col(f"w.f_{r}")).alias(f"f_{r}") for r in RATES)).alias("p")
    joined = own.join(langs, F.col("o.lang").eqNullSafe(F.col("p.lang")))
    return common.materialize(joined.select(F.col("o.lang").alias("_lang"), F.col("o.source").alias("_source"), *(leant("o", r, F.col(f"p.f_{r}")).alias(f"f_{r}") for r in RATES)), "fences", rows=1)


def judge(stats: DataFrame) -> DataFrame:
    """stats with ``kept``. A group without a fence has no document that passes the base rules."""
    limits = fences(stats)
    within = ~F.col("base_failed")
    for r in RATES:
        within = within & F.coalesce(rate(r) <= F.col(f"f_{r}"), F.lit(False))
    joined = stats.join(limits, stats.lang.eqNullSafe(limits._lang) & stats.source.eqNullSafe(limits._source), "left")
    return joined.withColumn("kept", within).drop("_lang", "_source", *(f"f_{r}" for r in RATES))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    counted = with_counts(common.wrapped(docs, "lang", "source", "text")).drop("text")
    return common.unwrapped(judge(common.materialize(counted, "counted")).filter("kept"))


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: counts and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = common.materialize(with_counts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *_MEASURES, "base_failed"), "counts")
    return judge(stats).select("doc_id", *COUNTS, "base_failed", "kept")


def verdict_sql(documents: str = "documents") -> str:
    """CTE ``judged`` over a relation of documents; the repeats by grouping, the quantiles by sorting the binned rates."""
    units = sorted({t[1] for t in TRUSTED.values()})
    binned = lambda x: f"pow(ceil({BINS}::DOUBLE * sqrt({x})) / {BINS}::DOUBLE, 2)"
    rates = ", ".join(f"{count} / greatest({over}, 1) AS {r}" for r, (count, over, _, _) in TRUSTED.items())
    cells = ", ".join([*(f"{binned(r)} AS b_{r}" for r in RATES), *(f"{binned(f'1::DOUBLE / greatest({u}, 1)')} AS b_{u}" for u in units)])
    low = lambda x, q: f"quantile_disc({x}, {q})"
    fence = ", ".join(f"{low('b_' + r, q)} + {reach}::DOUBLE * greatest({low('b_' + r, q)} - {low('b_' + r, 0.5)}, {low('b_' + over, 0.5)}) AS f_{r}" for r, (_, over, q, reach) in TRUSTED.items())
    part = lambda a: f"(CAST({a}.n AS DOUBLE) / (CAST({a}.n AS DOUBLE) + {LEAN}::DOUBLE))"
    lean = lambda a, r, parent: f"pow({a}.f_{r}, {part(a)}) * pow({parent}, 1 - {part(a)}) AS f_{r}"
    within = " AND ".join(f"coalesce(c.{r} <= o.f_{r}, false)" for r in RATES)
    return f"""
split_ AS (SELECT *, row_number() OVER () AS uid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM {documents}),
windows AS (SELECT uid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split_)),
found AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT uid, CAST(count(DISTINCT at_) AS BIGINT) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS at_ FROM found) GROUP BY uid),
counted AS (SELECT s.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM split_ s LEFT JOIN repeats r ON s.uid = r.uid),
rated AS (SELECT *, {rates}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
binned_ AS (SELECT lang, source, {cells} FROM rated WHERE NOT base_failed),
own_ AS (SELECT lang, source, count(*) AS n, {fence} FROM binned_ GROUP BY lang, source),
lang_ AS (SELECT lang, count(*) AS n, {fence} FROM binned_ GROUP BY lang),
all_ AS (SELECT {fence} FROM binned_),
parent_ AS (SELECT l.lang, {", ".join(lean("l", r, f"w.f_{r}") for r in RATES)} FROM lang_ l CROSS JOIN all_ w),
limit_ AS (SELECT o.lang, o.source, {", ".join(lean("o", r, f"p.f_{r}") for r in RATES)} FROM own_ o JOIN parent_ p ON o.lang IS NOT DISTINCT FROM p.lang),
judged AS (SELECT c.*, NOT c.base_failed AND {within} AS kept FROM rated c LEFT JOIN limit_ o ON c.lang IS NOT DISTINCT FROM o.lang AND c.source IS NOT DISTINCT FROM o.source)"""


SQL = "WITH " + verdict_sql() + "\nSELECT CAST(doc_id AS BIGINT) AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
