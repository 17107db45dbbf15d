"""Secret scans: patterns in every text, then ownership of each candidate over the corpus.

Three base kinds are found by pattern. A wider pattern (a run of 20 or more key characters with both a
letter and a digit) gives further candidates, which prose, identifiers and examples also match; what
tells them apart is who holds them. Candidate hashes are counted by distinct owner (source) and by distinct
repository (source and language, unless other columns are named): a value that ``shared_owners`` or more
owners or ``shared_repositories`` or more repositories hold is a widely copied example, any other is
owner-specific and looks live. Base spans are always reported, each with a second span over its value, of
kind ``live`` or ``example``; wider candidates that overlap no base span are reported, as kind ``owned``,
only when owner-specific.

Text between matches and matches alternate, so ``split`` and ``regexp_extract_all`` with the same pattern give
the lengths whose running sums are the positions. Those sums, the overlaps and the merging of spans are
windows over the rows of a text's matches, so a text costs its length and its matches times their logarithm,
and only matches are shuffled, never texts. Every task reduces a value's rows to distinct holders before
they are shuffled; only the shared values, broadcast when a count finds them few, are joined back.

Defined results: a null text is empty; a text may be of any length; null owners are one owner; of spans with
one start the kind listed first stands first; repeated rows each have their own spans and are one holder; an
empty table gives no rows; extra columns are ignored (kept by ``redact``, also where they bear names of ours).
Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.llm import common

#: Fixed patterns of the base kinds, in the order of ties. Runs of the last two are matched whole, so their least length can stand in the pattern.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
WIDER = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = [*PATTERNS, "owned", "live", "example"]
#: Code points of a block of a text that is cut apart.
BLOCK = 4096
_HITS = "array<struct<ord:int,i:int,d:int,l:int,n:int,h:bigint>>"


def hits_of(text: str, kind: str, pattern: str) -> Column:
    """Array of a pattern's matches in a column: kind, place, distance from the last match's start, length, and length and hash of the value, which ends the match."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = f"regexp_extract_all({text}, {p}, {1 if kind == 'assign' else 0})"
    # a one-element transform names the arrays, so that each is computed once
    named = f"array(struct(split({text}, {p}, -1) as g, regexp_extract_all({text}, {p}, 0) as f, {value} as v))"
    hit = f"struct({KINDS.index(kind)} as ord, i as i, length(get(a.g, i)) + if(i > 0, length(get(a.f, i - 1)), 0) as d, length(x) as l, length(get(a.v, i)) as n, xxhash64(get(a.v, i)) as h)"
    return F.expr(f"if({text} rlike {p}, transform({named}, a -> transform(a.f, (x, i) -> {hit}))[0], cast(array() as {_HITS}))")


def with_hits(docs: DataFrame) -> DataFrame:
    """docs with ``hits``: all matches of all patterns."""
    text = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    return text.withColumn("hits", F.concat(*(hits_of("_t", k, p) for k, p in {**PATTERNS, "owned": WIDER}.items()))).drop("_t")


def candidates(found: DataFrame, owner: str = "source", repository: tuple = ("source", "lang")) -> DataFrame:
    """uid, owner, repository, ord, s, e, n, h: base spans, and the wider ones that overlap none of them."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    holder = (name(owner).alias("owner"), F.concat_ws("/", *(name(c) for c in repository)).alias("repository"))
    each = found.filter(F.size("hits") > 0).select("uid", *holder, F.inline("hits"))
    start = F.sum("d").over(W.partitionBy("uid", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("s", start).withColumn("e", F.col("s") + F.col("l")).filter(f"ord <> {KINDS.index('assign')} or n >= 6")
    before, base = (W.unboundedPreceding, -1), F.col("ord") < len(PATTERNS)
    left = F.max(F.when(base, F.col("e"))).over(W.partitionBy("uid").orderBy("s", "ord").rowsBetween(*before))
    right = F.min(F.when(base, F.col("s"))).over(W.partitionBy("uid").orderBy(F.desc("s"), F.desc("ord")).rowsBetween(*before))
    met = F.coalesce(F.col("left") > F.col("s"), F.lit(False)) | F.coalesce(F.col("right") < F.col("e"), F.lit(False))
    return each.withColumn("left", left).withColumn("right", right).filter(base | ~met).select("uid", "owner", "repository", "ord", "s", "e", "n", "h")


def owners(held: DataFrame) -> DataFrame:
    """h, n_owners, n_repositories of every candidate hash."""
    once = held.select("h", "owner", "repository").distinct()
    return once.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("r")).groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"))


def reported(found: DataFrame, shared_owners: int = 3, shared_repositories: int = 6, **how) -> DataFrame:
    """uid, s, ord, e: every span to report, the verdict's among them."""
    each = candidates(found, **how)
    copied = owners(each).filter((F.col("n_owners") >= shared_owners) | (F.col("n_repositories") >= shared_repositories))
    copied = common.sent_if_small(common.materialize(copied.select("h", F.lit(False).alias("live")), "copied"))  # grows with the corpus: as many files as its size makes
    judged = each.join(copied, "h", "left").withColumn("live", F.coalesce("live", F.lit(True)))
    verdict = f"struct(e - n as s, if(live, {KINDS.index('live')}, {KINDS.index('example')}) as ord, e as e)"
    own = "struct(s as s, ord as ord, e as e)"
    return judged.select("uid", F.explode(F.expr(f"if(ord < {len(PATTERNS)}, array({own}, {verdict}), if(live, array({own}), array()))")).alias("x")).select("uid", "x.*")


def merged(spans: DataFrame) -> DataFrame:
    """uid and ``cut``: its spans in order, overlapping ones as one."""
    order = W.partitionBy("uid").orderBy("s", "e", "ord")
    open_ = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    each = spans.withColumn("new", F.when(open_ > F.col("s"), 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return each.groupBy("uid", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cut"))


def _listed(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({kinds}[x.ord], ':', x.s, ':', x.e)), ',')"


def _scanned(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs (with text unless told not to) with uid and hits, stored."""
    seen = with_hits(docs).withColumn("uid", F.monotonically_increasing_id())
    return common.materialize(seen if text else seen.drop("text"), "secrets")


def find_secrets(docs: DataFrame, text: bool = True, **how) -> DataFrame:
    """docs (with text unless told not to) with uid and ``spans`` (start, kind's place, end), empty where there are none."""
    found = _scanned(docs, text)
    none = F.expr("cast(array() as array<struct<s:int,ord:int,e:int>>)")
    listed = reported(found, **how).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "ord", "e"))).alias("spans"))
    some = found.filter(F.size("hits") > 0).join(listed, "uid", "left").withColumn("spans", F.coalesce("spans", none))
    return some.unionByName(found.filter(F.size("hits") == 0).withColumn("spans", none)).drop("hits")


def redact(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with every reported span replaced by a mark (overlapping spans by one), ``n_chars`` brought up to date.

    A text is cut into blocks of ``BLOCK`` code points, and what stays is taken from the blocks it lies in.
    """
    found = _scanned(common.wrapped(docs, "source", "lang", "text"))
    some = found.filter(F.size("hits") > 0).join(merged(reported(found, **how)), "uid", "left")
    some = some.withColumn("blocks", F.expr(f"if(cut is null, null, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0))")).withColumn("size", F.length("text"))
    parts = "concat(transform(cut, (x, i) -> struct(if(i > 0, get(cut, i - 1).e, 0) as a, x.s as b)), array(struct(element_at(cut, -1).e as a, size as b)))"
    first, last = f"cast(p.a div {BLOCK} as int)", f"cast((p.b - 1) div {BLOCK} as int)"
    within = f"substring(get(blocks, {first}), p.a % {BLOCK} + 1, p.b - p.a)"
    across = f"concat(substring(get(blocks, {first}), p.a % {BLOCK} + 1), array_join(slice(blocks, {first} + 2, {last} - {first} - 1), ''), substring(get(blocks, {last}), 1, (p.b - 1) % {BLOCK} + 1))"
    kept = f"transform({parts}, p -> case when p.a >= p.b then '' when {first} = {last} then {within} else {across} end)"
    some = some.withColumn("clean", F.expr(f"if(cut is null, text, array_join({kept}, '{mark}'))"))
    some = some.withColumn("_row", F.col("_row").withField("text", F.col("clean")))
    if "n_chars" in docs.columns:
        own = F.col("_row.n_chars")
        some = some.withColumn("_row", F.col("_row").withField("n_chars", F.when(F.col("cut").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(own)))
    return common.unwrapped(some.select("_row").unionAll(found.filter(F.size("hits") == 0).select("_row")))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: spans of every document."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    rows = find_secrets(docs, text=False)
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.ord = {KINDS.index(k)})) as bigint)").alias(f"n_{k}")
    base = _listed(f"filter(spans, x -> x.ord < {len(PATTERNS)})")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
