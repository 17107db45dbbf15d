"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import vocab

_U = "(?U)"


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _U + r"\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case and squeezed: how pages are compared."""
    return squeeze(F.lower(c))


def words(c: Column) -> Column:
    """White-space tokens; an empty text has none."""
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.split(squeeze(c), " "))


def ner_normalize(c: Column) -> Column:
    """Lower case, without a leading article, hyphens as spaces, squeezed."""
    return squeeze(F.replace(F.regexp_replace(F.trim(F.lower(c)), "^the ", ""), F.lit("-"), F.lit(" ")))


def _map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def spelling(text: Column, kind: Column) -> Column:
    """An entity's text in the spelling that is looked up."""
    bare = F.trim(text)
    low = F.lower(bare)
    person = None
    for prefix, title in vocab.PERSON_TITLES:
        full = F.concat(F.lit(title + " "), F.trim(F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))))
        person = F.when(low.startswith(prefix), full) if person is None else person.when(low.startswith(prefix), full)
    return (
        F.when(kind == "TOPONYM", F.coalesce(F.element_at(_map(vocab.TOPONYM_SPELLINGS), low), bare))
        .when(kind == "COMMODITY", F.coalesce(F.element_at(_map(vocab.COMMODITY_SPELLINGS), low), bare))
        .when(kind == "PERSON", person.otherwise(bare))
        .otherwise(bare)
    )


def sanitize_id(c: Column, most: int = 120) -> Column:
    """Trimmed, lower case, anything but letters, digits, ``_`` and ``-`` replaced, cut."""
    return F.substring(F.regexp_replace(F.lower(F.trim(c)), _U + r"[^\w\-]", "_"), 1, most)


ID_PREFIX = {"PERSON": "person__", "TOPONYM": "location__", "ORGANIZATION": "org__", "COMMODITY": "commodity__"}
NODE_LABEL = {"PERSON": "Person", "TOPONYM": "Location", "ORGANIZATION": "Organization", "COMMODITY": "Commodity"}


def entity_id(text: Column, kind: Column) -> Column:
    return F.concat(F.coalesce(F.element_at(_map(ID_PREFIX), kind), F.lit("entity__")), sanitize_id(text))


def node_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(_map(NODE_LABEL), kind), F.lit("Entity"))


#: Year patterns by use: between dashes in file names, in titles, in texts with dates.
YEARS = {"filename": r"- (\d{4}) -", "title": r"\b(1[5-9]\d{2}|20\d{2})\b", "dated": r"\b(1[4-9]\d\d|20[0-2]\d)\b", "any": r"\b(\d{4})\b"}


def year(c: Column, use: str) -> Column:
    """The first year, or null."""
    return F.nullif(F.regexp_extract(c, YEARS[use], 1), F.lit("")).cast("int")


def year_range(c: Column) -> Column:
    """(start, end) of ``1696-1697`` at the front; else the first and last four-digit runs."""
    found = F.regexp_extract_all(c, F.lit(r"\d{4}"), F.lit(0))
    pair = c.rlike(r"^\d{4}-\d{4}")
    start = F.when(pair, F.substring(c, 1, 4)).when(F.size(found) > 0, found[0])
    end = F.when(pair, F.substring(c, 6, 4)).when(F.size(found) > 0, F.element_at(found, -1))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def age_group(c: Column, years: int = 25) -> Column:
    """``1675-1699`` for 1675 to 1699; null for null."""
    low = (F.floor(c / years) * years).cast("int")
    return F.when(c.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + years - 1).cast("string")))


def iso_date(c: Column) -> Column:
    """The first day of a year from 1400 to 2100, else ``unknown``."""
    return F.when(c.between(1400, 2100), F.concat(F.lpad(c.cast("string"), 4, "0"), F.lit("-01-01"))).otherwise("unknown")


def significant(tokens: Column) -> Column:
    """Tokens with a letter or digit that aren't function words."""
    stop = F.array(*(F.lit(w) for w in vocab.STOP_WORDS))
    return F.filter(tokens, lambda w: w.rlike(r"[\p{L}\p{N}]") & ~F.array_contains(stop, w))


def capitalized(tokens: Column) -> Column:
    """Tokens that begin with a capital and aren't function words."""
    stop = F.array(*(F.lit(w) for w in vocab.STOP_WORDS))
    return F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(stop, F.lower(w)))


def number_groups(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(vocab.NUMBER_GROUP), F.lit(0))


def without_front_matter(c: Column) -> Column:
    """Without a leading block between ``---`` lines."""
    return F.regexp_replace(c, r"\A---\n(?s:.*?\n)??---(?:\n|\z)", "")


def markup_text(c: Column, strip: bool = True) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags out, common entities decoded, squeezed."""
    x = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return squeeze(x) if strip else x


def hyphen_free(c: Column) -> Column:
    """Hyphens as spaces, one pass over double spaces."""
    return F.replace(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("  "), F.lit(" "))


def occurs_in(entity: Column, source: Column) -> Column:
    """Whether an entity's text stands in its source, in any case, hyphens as written or as spaces."""
    e, s = F.lower(F.trim(entity)), F.lower(source)
    return (F.length(e) > 0) & (F.contains(s, e) | F.contains(hyphen_free(s), hyphen_free(e)))


def object_in(c: Column) -> Column:
    """The first JSON object in a text, or null; never raises."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def relation_of(c: Column) -> Column:
    """A relation's label, null where the answer was none."""
    label = F.upper(F.trim(c))
    return F.when(~label.isin("NONE", "", "NULL", "N/A"), label)


def confidence(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("low")


def relation_tier(c: Column) -> Column:
    domain = [r for rs in vocab.DOMAIN_RELATIONS.values() for r in rs]
    return F.when(c.isin(*vocab.STANDARD_RELATIONS), "cidoc_standard").when(c.isin(*domain), "domain").otherwise("unclassified")


def relation_property(c: Column) -> Column:
    return F.element_at(_map(vocab.STANDARD_RELATIONS), c)


def relation_uri(c: Column) -> Column:
    return F.element_at(_map(vocab.STANDARD_URIS), c)


def relation_domain(c: Column) -> Column:
    return F.element_at(_map({r: d for d, rs in vocab.DOMAIN_RELATIONS.items() for r in rs}), c)


def crm_class(kind: Column) -> Column:
    return F.coalesce(F.element_at(_map(vocab.CRM_CLASSES), kind), F.lit(vocab.CRM_DEFAULT))


def authority(c: Column) -> Column:
    """(id, label) from an answer in prose: the first Q number and the capitalised phrase behind it."""
    return F.struct(F.nullif(F.regexp_extract(c, r"\b(Q\d+)\b", 1), F.lit("")).alias("id"), F.nullif(F.regexp_extract(c, r"\bQ\d+\W+([A-Z]\w+(?: [A-Z]\w+)*)", 1), F.lit("")).alias("label"))


def clean_filename(author: Column, when: Column, title: Column, most: int = 120) -> Column:
    part = lambda c: F.trim(F.substring(F.regexp_replace(F.coalesce(c, F.lit("Unknown")), r'[<>:"/\\|?*\x00-\x1f]', ""), 1, most))
    return F.concat(part(author), F.lit(" - "), part(when), F.lit(" - "), part(title), F.lit(".pdf"))


def quantity_phrase(tons: Column, pounds: Column) -> Column:
    """What was shipped in words; absent measures are left out, whole numbers cut towards zero."""
    return F.concat_ws(" and ", F.when(tons > 0, F.concat(F.format_number(tons.cast("long"), 0), F.lit(" tons"))), F.when(pounds > 0, F.concat(F.format_number(pounds.cast("long"), 0), F.lit(" pounds"))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
