"""Text functions and transcription quality over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions import udfs, vocab
from vellum.operators import ocr
from vellum.plans.views import PAGES, Registry, pages, table

query = Registry()
_STOP = "[" + ", ".join(f"'{w}'" for w in vocab.STOP_WORDS) + "]"


@query("text_normalize", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS standardized FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("normalized"), X.squeeze(F.col("text")).alias("standardized"))


@query("ner_normalize", "SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(trim(lower(n)), '^the ', ''), '-', ' '), '\\s+', ' ', 'g')) AS normalized FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'The ' ELSE '' END || replace(p_name, ' ', '-') AS n FROM part)")
def _(spark, d):
    n = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, d, "part").select("p_partkey", X.ner_normalize(n).alias("normalized"))


@query("sanitize_id", "SELECT page_id, substr(regexp_replace(lower(trim(url)), '[^a-z0-9_\\-]', '_', 'g'), 1, 120) AS id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitize_id(F.col("url")).alias("id"))


_NAMES = "SELECT o_orderkey, 'Author - ' || CAST(1390 + o_orderkey % 700 AS VARCHAR) || ' - Title of 17' AS n FROM orders"


@query("year_extract", f"SELECT o_orderkey, CAST(nullif(regexp_extract(n, '- (\\d{{4}}) -', 1), '') AS INTEGER) AS by_filename, CAST(nullif(regexp_extract(n, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') AS INTEGER) AS by_title, CAST(nullif(regexp_extract(n, '\\b(1[4-9]\\d\\d|20[0-2]\\d)\\b', 1), '') AS INTEGER) AS dated FROM ({_NAMES})")
def _(spark, d):
    n = F.concat(F.lit("Author - "), (1390 + F.col("o_orderkey") % 700).cast("string"), F.lit(" - Title of 17"))
    return table(spark, d, "orders").select("o_orderkey", X.year(n, "filename").alias("by_filename"), X.year(n, "title").alias("by_title"), X.year(n, "dated").alias("dated"))


@query("age_bucket", "SELECT doc_id, y, CAST(floor(y / 25) * 25 AS INTEGER) || '-' || CAST(floor(y / 25) * 25 + 24 AS INTEGER) AS age_group, CASE WHEN y BETWEEN 1400 AND 2100 THEN y || '-01-01' ELSE 'unknown' END AS observed FROM (SELECT doc_id, CAST(1300 + doc_id % 900 AS INTEGER) AS y FROM documents)")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", (1300 + F.col("doc_id") % 900).cast("int").alias("y"))
    return df.select("doc_id", "y", X.age_group(F.col("y")).alias("age_group"), X.iso_date(F.col("y")).alias("observed"))


@query("number_groups", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[$£€]?\\d+(?:[.,/\\-:]\\d+)*[%]?|[$£€]\\d+'), '~') AS numbers FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.number_groups(F.col("text")), "~").alias("numbers"))


@query("significant_tokens", f"WITH {PAGES} SELECT doc_id, line_no, CAST(len(list_filter(string_split(ref, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AND NOT list_contains({_STOP}, w))) AS BIGINT) AS n FROM pages")
def _(spark, d):
    return pages(spark, d).select("doc_id", "line_no", F.size(X.significant(X.words(F.col("ref")))).cast("long").alias("n"))


@query("capitalized_tokens", f"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({_STOP}, lower(w))), ' ') AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.capitalized(X.words(F.col("text"))), " ").alias("tokens"))


@query("front_matter_strip", "SELECT doc_id, text AS body FROM documents")
def _(spark, d):
    framed = F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.without_front_matter(framed).alias("body"))


@query("html_text_extract", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.markup_text(F.col("html")).alias("body"))


@query("json_recover", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as asked."))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(X.object_in(said), "$.k", "bigint").alias("k"))


@query("cer_distance", f"WITH {PAGES} SELECT doc_id, line_no, CAST(len(ref) AS BIGINT) AS ref_chars, CAST(levenshtein(ref, hyp) AS BIGINT) AS distance, round(levenshtein(ref, hyp) / len(ref), 6) AS cer FROM pages")
def _(spark, d):
    return ocr.with_distance(pages(spark, d)).select("doc_id", "line_no", "ref_chars", "distance", F.round("cer", 6).alias("cer"))


@query("page_metrics")
def _(spark, d):
    """Edits, word errors, BLEU and the three accuracies of every page."""
    return ocr.with_metrics(pages(spark, d)).select("doc_id", "line_no", "char", "word", "bleu", "significant", "capitalized", "numbers", "cer", "wer")


@query("error_taxonomy")
def _(spark, d):
    return pages(spark, d).filter("ref <> hyp").select("system", udfs.error_taxonomy("ref", "hyp").alias("e")).select("system", "e.*").groupBy("system").agg(*(F.sum(c).alias(c) for c in udfs.kernels.TAXONOMY))


@query("halluc_type", f"WITH {PAGES} SELECT doc_id, line_no, CAST(len(h) AS BIGINT) AS types, CAST(len(list_filter(h, lambda w: NOT list_contains(r, w))) AS BIGINT) AS made_up, round(len(list_filter(h, lambda w: NOT list_contains(r, w))) / len(h), 6) AS rate FROM (SELECT *, list_distinct(string_split(ref, ' ')) AS r, list_distinct(string_split(hyp, ' ')) AS h FROM pages)")
def _(spark, d):
    return ocr.hallucinated_types(pages(spark, d)).select("doc_id", "line_no", "types", "made_up", F.round("rate", 6).alias("rate"))


@query(
    "halluc_token",
    rf"""WITH {PAGES}, lex AS (SELECT DISTINCT lower(unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))) AS word FROM benchmark),
ws AS (SELECT doc_id, line_no, ref, unnest(string_split(hyp, ' ')) AS w FROM pages),
marked AS (SELECT doc_id, line_no, w, NOT list_contains(string_split(ref, ' '), w) AND regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') <> ''
  AND (lower(w) IN (SELECT word FROM lex) OR lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) IN (SELECT word FROM lex)) AS made FROM ws)
SELECT doc_id, line_no, CAST(count(*) AS BIGINT) AS n_words, CAST(count(*) FILTER (made) AS BIGINT) AS made_up, CAST(count(DISTINCT w) FILTER (made) AS BIGINT) AS made_up_types, round(count(*) FILTER (made) / count(*), 6) AS rate FROM marked GROUP BY doc_id, line_no""",
)
def _(spark, d):
    lexicon = table(spark, d, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word"))
    return ocr.hallucinated_tokens(pages(spark, d), lexicon, ["doc_id", "line_no"]).withColumn("rate", F.round("rate", 6))


_DIST = PAGES + ", scored AS (SELECT *, CAST(len(ref) AS BIGINT) AS ref_chars, CAST(levenshtein(ref, hyp) AS BIGINT) AS distance, levenshtein(ref, hyp) / len(ref) AS cer FROM pages)"
_STATS = "CAST(count(*) AS BIGINT) AS n, round(avg(cer), 6) AS mean_cer, round(quantile_cont(cer, 0.5), 6) AS median_cer, round(stddev_pop(cer), 6) AS std_cer, round(min(cer), 6) AS min_cer, round(max(cer), 6) AS max_cer"


@query("ocr_summary", f"WITH {_DIST} SELECT system, {_STATS}, CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(ref_chars) AS BIGINT) AS total_ref_chars FROM scored GROUP BY system")
def _(spark, d):
    return ocr.summary(ocr.with_distance(pages(spark, d)), ["system"], ["cer"], ["distance", "ref_chars"])


@query("ocr_age_groups", f"WITH {_DIST} SELECT system, CAST(floor(year / 25) * 25 AS INTEGER) || '-' || CAST(floor(year / 25) * 25 + 24 AS INTEGER) AS age_group, {_STATS} FROM scored GROUP BY ALL")
def _(spark, d):
    df = ocr.with_distance(pages(spark, d)).withColumn("age_group", X.age_group(F.col("year"))).filter("age_group is not null")
    return ocr.summary(df, ["system", "age_group"], ["cer"])


@query("ocr_best_worst", f"WITH {_DIST} SELECT system, doc_id, line_no, round(cer, 6) AS cer, best, worst FROM (SELECT *, CAST(row_number() OVER (PARTITION BY system ORDER BY round(cer, 6), doc_id, line_no) AS INTEGER) AS best, CAST(row_number() OVER (PARTITION BY system ORDER BY round(cer, 6) DESC, doc_id, line_no) AS INTEGER) AS worst FROM scored) WHERE best <= 3 OR worst <= 3")
def _(spark, d):
    df = ocr.with_distance(pages(spark, d)).select("system", "doc_id", "line_no", F.round("cer", 6).alias("cer"))
    return ocr.extremes(df, "system", "cer", ["doc_id", "line_no"], 3).select("system", "doc_id", "line_no", "cer", "best", "worst")


@query("ocr_word_budget", r"""SELECT source, doc_id, words, words_before FROM (SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
  FROM (SELECT source, doc_id, CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS BIGINT) AS words FROM documents)) WHERE words_before < 5000""")
def _(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"))
    return ocr.word_budget(docs, ["source"], ["doc_id"], "words", 5000)


@query("system_rank", f"WITH {_DIST} SELECT system, round(avg(cer), 6) AS mean_cer, CAST(rank() OVER (ORDER BY round(avg(cer), 6)) AS INTEGER) AS rank FROM scored GROUP BY system")
def _(spark, d):
    from pyspark.sql.window import Window as W

    mean = ocr.with_distance(pages(spark, d)).groupBy("system").agg(F.round(F.avg("cer"), 6).alias("mean_cer"))
    return mean.withColumn("rank", F.rank().over(W.orderBy("mean_cer")))


@query("table_summary", f"WITH {_DIST}, t AS (SELECT system, cer, len(list_filter(list_distinct(string_split(hyp, ' ')), lambda w: NOT list_contains(string_split(ref, ' '), w))) / len(list_distinct(string_split(hyp, ' '))) AS made FROM scored) SELECT system, CAST(count(*) AS BIGINT) AS n, round(avg(cer), 6) AS mean_cer, round(avg(greatest(0, 1 - cer)), 6) AS char_accuracy, round(avg(made), 6) AS hallucination FROM t GROUP BY system")
def _(spark, d):
    df = ocr.hallucinated_types(ocr.with_distance(pages(spark, d)))
    return df.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.avg(F.greatest(F.lit(0.0), 1 - F.col("cer"))), 6).alias("char_accuracy"), F.round(F.avg("rate"), 6).alias("hallucination"))


_BASE = "CASE WHEN name LIKE '%\\_page\\_001.md' ESCAPE '\\' THEN replace(name, '_page_001.md', '') WHEN name LIKE '%.md' THEN replace(name, '.md', '') ELSE name END"
_MADE = """names AS (SELECT lower(replace(c_name, '#', '')) || CASE WHEN c_custkey % 3 = 0 THEN '_page_001.md' WHEN c_custkey % 3 = 1 THEN 'x.md' ELSE '.md' END AS name FROM customer),
golds AS (SELECT lower(replace(s_name, '#', '')) || '.xml' AS gold_name FROM supplier UNION ALL SELECT lower(replace(c_name, '#', '')) || '.xml' FROM customer WHERE c_custkey % 5 = 0)"""


@query(
    "filename_match",
    f"""WITH {_MADE}, n AS (SELECT name, {_BASE} AS base FROM names), g AS (SELECT gold_name, replace(gold_name, '.xml', '') AS gb FROM golds),
scored AS (SELECT name, gold_name, CASE WHEN base || '.xml' = gold_name THEN 2.0 WHEN starts_with(base, gb) OR starts_with(gb, base) THEN least(len(base), len(gb)) / greatest(len(base), len(gb))
  ELSE len(list_filter(range(1, least(len(base), len(gb)) + 1), lambda i: lower(left(base, i)) = lower(left(gb, i)))) / least(len(base), len(gb)) END AS s FROM n, g),
best AS (SELECT name, gold_name, s, row_number() OVER (PARTITION BY name ORDER BY s DESC, gold_name) AS r FROM scored)
SELECT name, CASE WHEN s >= 0.6 THEN gold_name END AS gold_name, CASE WHEN s >= 2 THEN 1.0 WHEN s >= 0.6 THEN round(s, 6) ELSE 0.0 END AS score FROM best WHERE r = 1""",
)
def _(spark, d):
    low = lambda c: F.lower(F.replace(c, F.lit("#"), F.lit("")))
    c = table(spark, d, "customer")
    end = F.when(F.col("c_custkey") % 3 == 0, "_page_001.md").when(F.col("c_custkey") % 3 == 1, "x.md").otherwise(".md")
    names = c.select(F.concat(low("c_name"), end).alias("name"))
    gold = table(spark, d, "supplier").select(F.concat(low("s_name"), F.lit(".xml")).alias("gold_name")).union(c.filter("c_custkey % 5 = 0").select(F.concat(low("c_name"), F.lit(".xml"))))
    return ocr.match_names(names, gold).withColumn("score", F.round("score", 6))


QUERIES, ORACLE = query.queries, query.oracle
