"""Entity extraction and its evaluation over mentions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.functions import text as X
from vellum.functions import udfs, vocab
from vellum.operators import ner, ner_eval
from vellum.plans.views import MENTIONS, SIDES, Registry, gold, mentions, predicted, table

query = Registry()


@query("mentions", f"WITH {MENTIONS} SELECT doc_id, ord, text, type, start, \"end\" FROM mentions")
def _(spark, d):
    return mentions(spark, d)


@query("halluc_filter", f"WITH {MENTIONS} SELECT m.doc_id, m.ord, m.text FROM mentions m JOIN documents x ON m.doc_id = x.doc_id WHERE m.ord % 7 <> 0 OR contains(lower(x.text), lower(m.text || 'x'))")
def _(spark, d):
    m = mentions(spark, d).withColumn("said", F.when(F.col("ord") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.upper("text")))
    kept = ner.grounded(m.withColumnRenamed("text", "as_found").withColumnRenamed("said", "text"), table(spark, d, "documents"))
    return kept.select("doc_id", "ord", F.col("as_found").alias("text"))


#: A text inside a dropped one is inside the one that dropped it, so "inside any earlier text" says it without a fold.
_CASCADE = f"""WITH {MENTIONS}, r AS (SELECT *, list_position({vocab.CASCADE!r}, type) AS rank, replace(replace(lower(trim(text)), '-', ' '), '  ', ' ') AS norm FROM mentions),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, ord) AS k FROM r WHERE rank > 0),
kept AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n e WHERE e.doc_id = n.doc_id AND e.k < n.k AND contains(e.norm, n.norm)))
SELECT doc_id, CAST(count(*) AS BIGINT) AS kept, string_agg(type || ':' || text, ',' ORDER BY k) AS entities FROM kept GROUP BY doc_id"""


@query("cascade_merge", _CASCADE)
def _(spark, d):
    """Texts claimed by type priority within each document."""
    return ner.cascade(mentions(spark, d)).select("doc_id", F.size("entities").cast("long").alias("kept"), F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["text"])), ",").alias("entities"))


@query("entity_dedupe", f"WITH {MENTIONS} SELECT doc_id, ord, text, type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY ord) AS n FROM mentions) WHERE n = 1")
def _(spark, d):
    return ner.first_by_text(mentions(spark, d)).select("doc_id", "ord", "text", "type")


@query("entity_counts", f"WITH {MENTIONS} SELECT type, CAST(count(*) AS BIGINT) AS entities, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM mentions GROUP BY type")
def _(spark, d):
    return ner.type_counts(mentions(spark, d))


@query("per_type_examples", f"WITH {MENTIONS}, k AS (SELECT unnest(['TOPONYM', 'PERSON', 'ORGANIZATION', 'COMMODITY']) AS type) SELECT x.doc_id, k.type, coalesce(string_agg(m.text, ',' ORDER BY m.ord), '') AS texts FROM documents x CROSS JOIN k LEFT JOIN mentions m ON m.doc_id = x.doc_id AND m.type = k.type GROUP BY x.doc_id, k.type")
def _(spark, d):
    return ner.examples(table(spark, d, "documents"), mentions(spark, d)).select("doc_id", "type", F.array_join("texts", ",").alias("texts"))


_SPELL = " ".join(f"WHEN lower(n) = '{k}' THEN '{v}'" for k, v in vocab.TOPONYM_SPELLINGS.items())


@query("spelling_normalize", f"SELECT n_nationkey, n AS written, CASE n_nationkey % 2 WHEN 0 THEN CASE {_SPELL} ELSE n END ELSE 'Captain ' || n_name END AS spelled FROM (SELECT *, CASE n_nationkey % 6 WHEN 0 THEN 'Barbadoes' WHEN 2 THEN 'st. Kitts' WHEN 4 THEN n_name ELSE 'Capt. ' || n_name END AS n FROM nation)")
def _(spark, d):
    k = F.col("n_nationkey")
    n = F.when(k % 6 == 0, "Barbadoes").when(k % 6 == 2, "st. Kitts").when(k % 6 == 4, F.col("n_name")).otherwise(F.concat(F.lit("Capt. "), F.col("n_name")))
    df = table(spark, d, "nation").select("n_nationkey", n.alias("written"))
    return df.withColumn("spelled", X.spelling(F.col("written"), F.when(k % 2 == 0, "TOPONYM").otherwise("PERSON")))


@query("entity_link", f"WITH {MENTIONS}, cache AS (SELECT DISTINCT lower(text) AS norm, type, 'Q' || ascii(text) AS authority FROM mentions WHERE ord % 2 = 0) SELECT m.doc_id, m.ord, c.authority, c.authority IS NOT NULL AS linked FROM mentions m LEFT JOIN cache c ON lower(m.text) = c.norm AND m.type = c.type")
def _(spark, d):
    m = mentions(spark, d)
    cache = m.filter("ord % 2 = 0").select(F.lower("text").alias("norm"), "type", F.concat(F.lit("Q"), F.ascii("text").cast("string")).alias("authority")).distinct()
    return ner.link(m, cache).select("doc_id", "ord", "authority", "linked")


#: CRC-32 by its rule: for each byte, eight times shifted right and, where a one fell out, combined with the reversed polynomial.
_CRC = """(SELECT xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT))"""


@query("hash_split", f"SELECT doc_id, CASE WHEN h < 90 THEN 'train' WHEN h < 95 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, {_CRC} % 100 AS h FROM (SELECT doc_id, doc_id || ':42' AS k FROM documents))")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ner.split_of(F.col("doc_id")).alias("split"))


def sides(spark, d):
    m = mentions(spark, d)
    return gold(m), predicted(m)


_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


def _set_sql(keys: str, by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""WITH {SIDES}, b AS (SELECT * FROM (SELECT DISTINCT {keys}, true AS in_gold FROM gold) FULL JOIN (SELECT DISTINCT {keys}, true AS in_pred FROM pred) USING ({keys})),
c AS (SELECT {lead}CAST(count(*) FILTER (in_gold AND in_pred) AS BIGINT) AS tp, CAST(count(*) FILTER (in_gold IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (in_pred IS NULL) AS BIGINT) AS fn FROM b {group})
SELECT *, {_PRF} FROM c"""


@query("unique_f1", _set_sql("doc_id, text, label", ""))
def _(spark, d):
    return ner_eval.set_scores(*sides(spark, d), ["doc_id", "text", "label"], [])


@query("unique_f1_by_label", _set_sql("text, label", "label"))
def _(spark, d):
    """Labels are scored over the whole corpus's sets, unlike the overall score."""
    return ner_eval.set_scores(*sides(spark, d), ["text", "label"], ["label"])


@query("strict_span_f1", _set_sql('doc_id, start, "end", label', "label"))
def _(spark, d):
    return ner_eval.set_scores(*sides(spark, d), ["doc_id", "start", "end", "label"], ["label"])


@query("per_doc_scores", _set_sql("doc_id, text, label", "doc_id"))
def _(spark, d):
    return ner_eval.set_scores(*sides(spark, d), ["doc_id", "text", "label"], ["doc_id"])


@query("worst_docs", _set_sql("doc_id, text, label", "doc_id") + " ORDER BY f1, doc_id LIMIT 10")
def _(spark, d):
    return ner_eval.set_scores(*sides(spark, d), ["doc_id", "text", "label"], ["doc_id"]).orderBy("f1", "doc_id").limit(10)


def _span_sql(near: str) -> str:
    return f"""WITH {SIDES}, g AS (SELECT label, count(*) FILTER (h) AS tp, count(*) FILTER (NOT h) AS fn FROM (SELECT *, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.label = g.label AND {near}) AS h FROM gold g) GROUP BY label),
p AS (SELECT label, count(*) FILTER (NOT h) AS fp FROM (SELECT *, EXISTS (SELECT 1 FROM gold g WHERE p.doc_id = g.doc_id AND p.label = g.label AND {near}) AS h FROM pred p) GROUP BY label),
c AS (SELECT label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fn, 0) AS BIGINT) AS fn, CAST(coalesce(fp, 0) AS BIGINT) AS fp FROM g FULL JOIN p USING (label)) SELECT *, {_PRF} FROM c"""


@query("span_exact", _span_sql('p.start = g.start AND p."end" = g."end"'))
def _(spark, d):
    return ner_eval.span_scores(*sides(spark, d), overlap=False)


@query("span_overlap", _span_sql('g.start < p."end" AND p.start < g."end"'))
def _(spark, d):
    return ner_eval.span_scores(*sides(spark, d), overlap=True)


def _pass(k: int, fits: str, kind: str) -> str:
    """One greedy pass: each gold row in order takes the first predicted row that fits; both leave."""
    state = "{'rest': []::STRUCT(t VARCHAR, l VARCHAR)[], 'r': p%d.r, 'out': p%d.out}" % (k - 1, k - 1)
    step = f"""lambda s, a: CASE WHEN len(list_filter(s.r, lambda b: {fits})) = 0 THEN {{'rest': list_append(s.rest, a), 'r': s.r, 'out': s.out}}
      ELSE {{'rest': s.rest, 'r': list_filter(s.r, lambda b: b <> list_filter(s.r, lambda b: {fits})[1]), 'out': list_append(s.out, {{'c': '{kind}', 'g': a, 'p': list_filter(s.r, lambda b: {fits})[1]}})}} END"""
    return f"p{k} AS (SELECT doc_id, s.rest AS l, s.r AS r, s.out AS out FROM (SELECT p{k - 1}.doc_id, list_reduce(p{k - 1}.l, {step}, {state}) AS s FROM p{k - 1}))"


_ROW = "STRUCT(t VARCHAR, l VARCHAR)"
_INSIDE = "(contains(a.t, b.t) OR contains(b.t, a.t))"
_ALIGNED = f"""WITH {SIDES}, g AS (SELECT doc_id, list_sort(list(DISTINCT {{'t': text, 'l': label}})) AS g FROM gold GROUP BY doc_id), p AS (SELECT doc_id, list_sort(list(DISTINCT {{'t': text, 'l': label}})) AS p FROM pred GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(g, []::{_ROW}[]) AS g, coalesce(p, []::{_ROW}[]) AS p FROM g FULL JOIN p USING (doc_id)),
p0 AS (SELECT doc_id, list_filter(g, lambda a: NOT list_contains(p, a)) AS l, list_filter(p, lambda a: NOT list_contains(g, a)) AS r,
  list_transform(list_filter(g, lambda a: list_contains(p, a)), lambda a: {{'c': 'strict', 'g': a, 'p': a}}) AS out FROM b),
{_pass(1, f"a.l = b.l AND {_INSIDE}", "partial")}, {_pass(2, "a.l <> b.l AND a.t = b.t", "substitution")}, {_pass(3, f"a.l <> b.l AND {_INSIDE}", "substitution")},
aligned AS (SELECT doc_id, x.c AS category, x.g.t AS gold_text, x.g.l AS gold_label, x.p.t AS pred_text, x.p.l AS pred_label FROM (SELECT doc_id, unnest(out) AS x FROM p3)
  UNION ALL SELECT doc_id, 'missing', x.t, x.l, NULL, NULL FROM (SELECT doc_id, unnest(l) AS x FROM p3) UNION ALL SELECT doc_id, 'spurious', NULL, NULL, x.t, x.l FROM (SELECT doc_id, unnest(r) AS x FROM p3))"""


@query("align_five_pass", _ALIGNED + " SELECT * FROM aligned")
def _(spark, d):
    return ner_eval.alignment(*sides(spark, d))


@query("confusion_matrix", _ALIGNED + " SELECT coalesce(gold_label, 'O') AS gold, coalesce(pred_label, 'O') AS pred, CAST(count(*) AS BIGINT) AS n FROM aligned GROUP BY ALL")
def _(spark, d):
    return ner_eval.confusion(ner_eval.alignment(*sides(spark, d)))


_SLOTS = _ALIGNED + """, c AS (SELECT CAST(count(*) FILTER (category = 'substitution') AS BIGINT) AS substitutions, CAST(count(*) FILTER (category = 'missing') AS BIGINT) AS deletions, CAST(count(*) FILTER (category = 'spurious') AS BIGINT) AS insertions, CAST(count(gold_label) AS BIGINT) AS slots FROM aligned)
SELECT *, slots - substitutions - deletions AS correct, round((substitutions + deletions + insertions) / slots, 6) AS ser FROM c"""


@query("slot_error_rate", _SLOTS)
def _(spark, d):
    return ner_eval.slot_errors(ner_eval.alignment(*sides(spark, d)))


_PARTIAL = f"""WITH {SIDES}, g AS (SELECT DISTINCT doc_id, label, text FROM gold), p AS (SELECT DISTINCT doc_id, label, text FROM pred),
extra AS (SELECT * FROM p ANTI JOIN g USING (doc_id, label, text)), missed AS (SELECT * FROM g ANTI JOIN p USING (doc_id, label, text)),
hit AS (SELECT e.doc_id, e.label, e.text, min(m.text) AS m FROM extra e JOIN missed m ON e.doc_id = m.doc_id AND e.label = m.label AND (contains(m.text, e.text) OR contains(e.text, m.text)) GROUP BY ALL),
tally AS (SELECT label, count(*) AS hits, count(DISTINCT (doc_id, m)) AS used FROM hit GROUP BY label),
n AS (SELECT label, (SELECT count(*) FROM g SEMI JOIN p USING (doc_id, label, text) WHERE g.label = l.label) AS both_, (SELECT count(*) FROM extra e WHERE e.label = l.label) AS ex, (SELECT count(*) FROM missed m WHERE m.label = l.label) AS mi
  FROM (SELECT label FROM g UNION SELECT label FROM p) l),
c AS (SELECT n.label, CAST(both_ + coalesce(hits, 0) AS BIGINT) AS tp, CAST(ex - coalesce(hits, 0) AS BIGINT) AS fp, CAST(mi - coalesce(used, 0) AS BIGINT) AS fn FROM n LEFT JOIN tally USING (label)) SELECT *, {_PRF} FROM c"""


@query("partial_f1", _PARTIAL)
def _(spark, d):
    g, p = sides(spark, d)
    texts = lambda df, n: df.groupBy("doc_id", "label").agg(F.collect_set("text").alias(n))
    each = texts(g, "g").join(texts(p, "p"), ["doc_id", "label"], "full").select("label", udfs.partial_counts("g", "p").alias("c"))
    return ner_eval.prf(each.groupBy("label").agg(*(F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn"))))


@query("diversity", f"""WITH {SIDES}, b AS (SELECT * FROM (SELECT label, text, count(*) AS g FROM gold GROUP BY ALL) FULL JOIN (SELECT label, text, count(*) AS p FROM pred GROUP BY ALL) USING (label, text))
SELECT label, CAST(count(g) AS BIGINT) AS gold_forms, CAST(count(p) AS BIGINT) AS pred_forms, CAST(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS BIGINT) AS shared, CAST(count(*) FILTER (p = 1) AS BIGINT) AS hapax,
  CASE WHEN count(g) > 0 THEN round(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) / count(g), 6) ELSE 0 END AS coverage FROM b GROUP BY label""")
def _(spark, d):
    return ner_eval.diversity(*sides(spark, d))


@query("top_forms", f"WITH {SIDES} SELECT label, text, n, rank FROM (SELECT label, text, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, text) AS INTEGER) AS rank FROM pred GROUP BY label, text) WHERE rank <= 5")
def _(spark, d):
    return ner_eval.top_forms(sides(spark, d)[1])


@query("model_diff_top10", f"""WITH {SIDES}, a AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id)
SELECT doc_id, CAST(a.n AS BIGINT) AS first, CAST(b.n AS BIGINT) AS second, CAST(a.n - b.n AS BIGINT) AS diff FROM a JOIN b USING (doc_id) ORDER BY abs(a.n - b.n) DESC, doc_id LIMIT 10""")
def _(spark, d):
    g, p = sides(spark, d)
    n = lambda df, c: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    return n(g, "first").join(n(p, "second"), "doc_id").withColumn("diff", F.col("first") - F.col("second")).orderBy(F.desc(F.abs("diff")), "doc_id").limit(10)


@query("latency_profile", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS median, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT) + 1, count(*))], 6) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    """Element n // 2 and element int(0.95 n) of each type's sorted values, by rank, so that no group is gathered."""
    ranked = table(spark, d, "events").select("event_type", "value", F.row_number().over(W.partitionBy("event_type").orderBy("value")).alias("r"), F.count(F.lit(1)).over(W.partitionBy("event_type")).alias("n"))
    at = lambda k: F.round(F.max(F.when(F.col("r") == k, F.col("value"))), 6)
    return ranked.groupBy("event_type", "n").agg(at(F.floor(F.col("n") / 2) + 1).alias("median"), at(F.least(F.floor(F.col("n") * 0.95) + 1, F.col("n"))).alias("p95"))


@query("relation_parse", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN NULL WHEN event_id % 4 = 2 THEN 'GROWN_IN' ELSE 'HAS_OWNER' END AS relation, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN event_id % 4 IN (0, 1) THEN NULL WHEN event_id % 4 = 2 THEN 'domain' ELSE 'cidoc_standard' END AS tier, CASE WHEN event_id % 4 = 3 THEN 'P52' END AS property FROM events")
def _(spark, d):
    k = F.col("event_id")
    said = F.when(k % 4 == 0, "n/a").when(k % 4 == 1, "").when(k % 4 == 2, " grown_in").otherwise("HAS_OWNER")
    rel = X.relation_of(said)
    return table(spark, d, "events").select("event_id", rel.alias("relation"), X.confidence(F.when(k % 3 == 0, "High").otherwise("sure")).alias("confidence"), F.when(rel.isNotNull(), X.relation_tier(rel)).alias("tier"), X.relation_property(rel).alias("property"))


@query("chat_extract", "SELECT conv_id, u AS body, CAST(a AS BIGINT) AS n_assistant FROM (SELECT conv_id, trim(max_by(text, turn) FILTER (role = 'user')) AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)")
def _(spark, d):
    messages = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.concat(F.lit("Find names. TEXT: "), "text").alias("content")))).alias("m"))
    text, _ = ner.chat_example(F.col("m"))
    return messages.select("conv_id", text.alias("body"), F.size(F.filter("m", lambda m: m["role"] == "assistant")).cast("long").alias("n_assistant"))


QUERIES, ORACLE = query.queries, query.oracle
