"""How far the sources of each language diverge in their words, exactly, by inclusion-exclusion over supports.

A group is a language and source; its counts over a language's V kept terms are smoothed into whole numbers
p = 1 + floor(10^9 (count + 1) / (N + V)), and two groups are held against each other by the sum over all V terms of
f(p, q) = floor((p - q)^2 / q). Summed term by term that costs V per pair. A group's support (terms it holds) is
sparse, and outside of it p is one number, z. So, for groups A and B:

    sum over A's support of f(p, z_B) + sum over B's support of f(z_A, q)      one-sided prices
    + sum over the shared support of f(p, q) - f(p, z_B) - f(z_A, q) + f(z_A, z_B)   corrections of overlaps
    + (V - |support A| - |support B|) f(z_A, z_B)                              terms of neither

One-sided prices depend on a count alone: a histogram of each group's counts (how many terms occur so often) prices
them against every other group. Only overlaps need the terms: postings (language, term, group, p) meet on the term,
and sums per pair of groups are made in each task before anything is shuffled.

1. Words are counted in Arrow batches: each task sums counts and document frequencies per group and term, in a
   dictionary of at most ``HELD`` entries, so a hot source or word is one row per task and not one per document.
2. Spark adds the partial counts, and again by language and term for document frequencies and the language's counts;
   terms in fewer than ``LEAST`` of the language's documents go.
3. The three sums above, added up per pair; ranks per group. Of terms only ``TOP`` a group are asked for: Spark keeps
   that many per task before it ranks them.

Joins on terms are sort-merge joins, whose hot partitions Spark splits. All arithmetic is on whole numbers; products
that could pass 2^63 are decimals.

Defined results: null text, language or source is the empty string; documents without terms still make their group; a
language without kept terms gives 0 for all its pairs and no terms; a language of one source has no pairs; repeated
rows each count; ties go by the item's UTF-8 bytes; a text may be of any length and is counted in pieces; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.llm import common, tokens

SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Entries of all dictionaries of a task, and bytes of a text that are split at a time.
HELD, PIECE = 400_000, 4 << 20
#: Bytes to what terms are made of: letters in lower case, all that isn't ASCII; the rest parts terms.
FOLD = bytes(b if b >= 128 or chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def pieces(raw: bytes, most: int = PIECE):
    """A folded text in runs of whole terms."""
    at = 0
    while at < len(raw):
        end = at + most
        if end < len(raw):
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[at:end]
        at = end


def count_batches(batches):
    """(lang, source, term, n, df): partial counts of terms and of documents that hold them."""
    from collections import Counter

    import pyarrow as pa

    held: dict = {}

    def out():
        for (lang, source), (n, df) in held.items():
            for at, terms in enumerate(_some(n)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )
        held.clear()

    for whole in batches:
        for b in tokens.slices(whole, 256):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own: set = set()
                for piece in pieces((text or b"").translate(FOLD)):
                    words = piece.split()
                    n.update(words)
                    own.update(words)
                df.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
    yield from out()
    common.give_back()


def _some(found, most: int = 50_000):
    terms = list(found)
    for at in range(0, len(terms), most):
        yield terms[at : at + most]


def smoothed(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total)."""
    return F.lit(1) + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): p and q are at most 10^9 + 1, so the square is below 2^63."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups (lang, source), kept terms (lang, term, n_lang), postings (lang, source, term, n, n_lang); all stored."""
    common.small_batches(docs.sparkSession)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    parts = named.mapInArrow(count_batches, "lang string, source string, term string, n long, df long")
    each = common.materialize(parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = each.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang")).filter(F.col("df") >= least).select("lang", "term", "n_lang")
    postings = common.materialize(each.select("lang", "term", "source", "n").join(kept.hint("merge"), ["lang", "term"]), "postings")
    return common.materialize(named.select("lang", "source").distinct(), "groups"), postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")), postings


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    groups, kept, postings = counted(docs, least)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_all"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("support"))
    known = groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["v", "n_all", "n_group", "support"])
    total = F.col("n_group") + F.col("v")
    known = common.materialize(known.withColumn("total", total).withColumn("z", F.when(total > 0, smoothed(F.lit(0), total))), "known")
    live = common.sent_if_small(known.filter("v > 0").select("lang", "source", "total", "z", (F.col("v") + F.col("n_all")).alias("total_lang"), "v", "support"))
    priced = postings.join(live.select("lang", "source", "total", "z", "total_lang"), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "z", "n", smoothed(F.col("n"), F.col("total")).alias("p"), smoothed(F.col("n_lang"), F.col("total_lang")).alias("q"))
    priced = common.materialize(priced, "priced")

    other = live.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"), F.col("v").alias("vo"), F.col("support").alias("so"))
    pair = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), value.alias("value"))
    # one-sided prices: terms by count, against every other group of the language
    histogram = priced.groupBy("lang", "source", "z", "p").agg(F.count(F.lit(1)).alias("k"))
    met = histogram.join(other, "lang").filter("source <> other")
    one = met.groupBy("lang", "source", "other").agg(F.sum(F.col("k") * gap(F.col("p"), F.col("zo"))).alias("ahead"), F.sum(F.col("k") * gap(F.col("zo"), F.col("p"))).alias("back"))
    one = one.select("lang", F.explode(F.array(pair("source", "other", F.col("ahead")), pair("other", "source", F.col("back")))).alias("c"))
    # overlaps: postings of a term, each two groups once
    x, y = priced.select("lang", "term", "source", "p", "z"), priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("po"), F.col("z").alias("zo"))
    both = x.hint("merge").join(y, ["lang", "term"]).filter("source < other")
    p, z, po, zo = (F.col(c) for c in ("p", "z", "po", "zo"))
    fix = both.groupBy("lang", "source", "other").agg(
        F.sum(gap(p, po) - gap(p, zo) - gap(z, po) + gap(z, zo)).alias("ahead"), F.sum(gap(po, p) - gap(po, z) - gap(zo, p) + gap(zo, z)).alias("back")
    )
    fix = fix.select("lang", F.explode(F.array(pair("source", "other", F.col("ahead")), pair("other", "source", F.col("back")))).alias("c"))
    # terms of neither; this also makes every pair there is
    twos = live.select("lang", "source", "z", "v", "support").join(other, "lang").filter("source <> other")
    none = twos.select("lang", pair("source", "other", (F.col("v") - F.col("support") - F.col("so")) * gap(F.col("z"), F.col("zo"))).alias("c"))
    bare = common.sent_if_small(known.filter("v = 0").select("lang", "source"))
    zero = known.filter("v = 0").select("lang", "source").join(bare.withColumnRenamed("source", "other"), "lang").filter("source <> other").select("lang", pair("source", "other", F.lit(0).cast("long")).alias("c"))
    pairs = one.unionByName(fix).unionByName(none).unionByName(zero).groupBy("lang", F.col("c.source").alias("source"), F.col("c.item").alias("item")).agg(F.sum("c.value").alias("value"))

    terms = priced.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the divergence of every two sources of a language, and the terms that set a source apart from its language."""
    return divergences(common.table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: The same, term by term over all groups and terms.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row_, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
size_of_lang AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0)::HUGEINT AS n, k.n::HUGEINT AS n_lang, s.v, s.n AS all_lang FROM groups g JOIN kept k ON g.lang = k.lang JOIN size_of_lang s ON s.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
priced AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p, 1 + (1000000000 * (n_lang + 1)) // (all_lang + v)::HUGEINT AS q FROM full_),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank_ AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank_ FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank_ <= 200"""
