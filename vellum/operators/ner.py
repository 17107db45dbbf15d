"""Entity extraction around an external model: filters, merging, deduplication, training examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.functions import text as X
from vellum.functions import vocab


def extract(docs: DataFrame, model: Callable[[str], list[dict]]) -> DataFrame:
    """Run a model (text to entities with text and type) over documents: doc_id, ord, text, type. The model is loaded by the caller and called once a text."""

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = [(d, i, e["text"], e["type"]) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, e in enumerate(model(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "text", "type"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ord long, text string, type string")


def grounded(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities whose text stands in their document. A document meets its entities as one row, so its text is shuffled, lowered and freed of hyphens once."""
    own = [c for c in entities.columns if c != "doc_id"]
    each = entities.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_es"))
    low = F.lower("_source")
    hit = lambda t, s: (F.length(t) > 0) & (F.contains(s["low"], t) | F.contains(s["free"], X.hyphen_free(t)))
    found = F.transform(F.array(F.struct(low.alias("low"), X.hyphen_free(low).alias("free"))), lambda s: F.filter("_es", lambda e: hit(F.lower(F.trim(e["text"])), s)))
    return each.join(docs.select("doc_id", F.col("text").alias("_source")), "doc_id").select("doc_id", F.inline(F.get(found, F.lit(0))))


def cascade(entities: DataFrame) -> DataFrame:
    """doc_id, entities: types claim texts in priority order; a text equal to or inside a claimed one is dropped. One ordered fold per document."""
    rank = F.array_position(F.array(*(F.lit(t) for t in vocab.CASCADE)), F.col("type"))
    rows = entities.filter(rank > 0).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "ord", "text", "type"))).alias("es"))
    norm = "replace(replace(lower(trim(e.text)), '-', ' '), '  ', ' ')"
    fold = f"""aggregate(es, struct(cast(array() as array<string>) as claimed, cast(array() as array<struct<text:string,type:string>>) as kept),
      (a, e) -> if(exists(a.claimed, c -> contains(c, {norm})), a, struct(concat(a.claimed, array({norm})) as claimed, concat(a.kept, array(struct(e.text as text, e.type as type))) as kept)), a -> a.kept)"""
    return rows.select("doc_id", F.expr(fold).alias("entities"))


def first_by_text(entities: DataFrame) -> DataFrame:
    """The first entity of each text, in any case, of a document."""
    w = W.partitionBy("doc_id", F.lower(F.trim("text"))).orderBy("ord")
    return entities.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("doc_id").alias("documents"))


def examples(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """One training example per document and type, also where the type has no entities."""
    kinds = F.explode(F.array(*(F.lit(t) for t in vocab.ENTITY_TYPES))).alias("type")
    found = entities.groupBy("doc_id", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda e: e["text"]).alias("texts"))
    return docs.select("doc_id", kinds).join(found, ["doc_id", "type"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def chat_example(messages) -> tuple:
    """(text, entities) of a chat: what stands behind the last ``TEXT:`` of the user, and the assistant's JSON."""
    say = lambda role: F.filter(messages, lambda m: m["role"] == role)
    text = F.trim(F.element_at(F.split(F.element_at(say("user"), -1)["content"], "TEXT:"), -1))
    return text, F.from_json(F.element_at(say("assistant"), -1)["content"], "array<struct<text:string,type:string>>")


#: What a positive says around a name, by type.
SAID = {"PERSON": "{} set out for the coast that season.", "ORGANIZATION": "A dividend was declared by {} in that year.", "COMMODITY": "The ship brought home a cargo of {}.", "TOPONYM": "They sailed at last to {}."}


def hard_examples(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, type, kind, text, texts: examples made by rule from whole documents and their entities (doc_id, ord, text, type).

    A negative of a type is a document that holds names, but none of that type: its answer is empty, though there is
    plenty to mistake. A positive is a sentence said of a document's name, one for each distinct name and type: its answer
    is the name.
    """
    held = entities.select("doc_id", "type").distinct()
    kinds = F.explode(F.array(*(F.lit(t) for t in SAID))).alias("type")
    bare = held.select("doc_id").distinct().select("doc_id", kinds).join(held, ["doc_id", "type"], "left_anti")
    negatives = bare.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "type", F.lit("negative").alias("kind"), "text", F.array().cast("array<string>").alias("texts"))
    template = F.element_at(F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair)), F.col("type"))
    names = entities.filter(F.col("type").isin(*SAID)).select("doc_id", "type", F.trim("text").alias("name")).distinct()
    positives = names.select("doc_id", "type", F.lit("positive").alias("kind"), F.replace(template, F.lit("{}"), F.col("name")).alias("text"), F.array("name").alias("texts"))
    return negatives.unionByName(positives)


def split_of(key, seed: int = 42):
    """train, valid or test by hash: 90, 5 and 5 in a hundred, the same on every run."""
    bucket = F.pmod(F.crc32(F.concat(key.cast("string"), F.lit(f":{seed}"))), F.lit(100))
    return F.when(bucket < 90, "train").when(bucket < 95, "valid").otherwise("test")


def link(entities: DataFrame, cache: DataFrame, resolver: Callable | None = None) -> DataFrame:
    """Entities with the authority that the cache holds for their normalised text and type; each unknown one goes to ``resolver`` once."""
    want = entities.withColumn("norm", F.lower(X.spelling(F.col("text"), F.col("type"))))
    known = cache.select("norm", "type", "authority")
    if resolver is not None:
        missing = want.select("norm", "type").distinct().join(known, ["norm", "type"], "left_anti")

        def run(batches):
            for b in batches:
                yield b.assign(authority=[resolver(n, t) for n, t in zip(b["norm"], b["type"], strict=True)])

        known = known.unionByName(missing.mapInPandas(run, "norm string, type string, authority string"))
    return want.join(known, ["norm", "type"], "left").withColumn("linked", F.col("authority").isNotNull()).withColumn("crm_class", X.crm_class(F.col("type")))


def link_and_remember(entities: DataFrame, path: str, resolver: Callable) -> DataFrame:
    """``link`` with a cache that is kept at ``path``: what the resolver says of names not yet there, nothing included, is added before anything is linked, so no later run asks again."""
    from vellum import storage
    from vellum.sources import writers

    spark = entities.sparkSession
    schema = "norm string, type string, authority string"
    known = spark.read.schema(schema).parquet(path) if writers.there(spark, path) else storage.empty(spark, schema)
    names = entities.select("text", "type").distinct()
    fresh = link(names, known, resolver).select("norm", "type", "authority").distinct().join(known.select("norm", "type"), ["norm", "type"], "left_anti")
    storage.kept(fresh, "answers").write.mode("append").parquet(path)
    return link(entities, spark.read.schema(schema).parquet(path))


def masked_labels(ids, n_prompt, ignored: int = -100):
    """Labels of a training example: the prompt's are ignored, the answer's are its ids."""
    return F.transform(ids, lambda x, i: F.when(i < n_prompt, F.lit(ignored)).otherwise(x).cast("int"))


def padded(values, width, fill: int):
    """An array filled up to a width, and cut to it."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill).cast("int"), F.greatest(width - F.size(values), F.lit(0)))), F.lit(1), width)


def training_batches(examples: DataFrame, size: int, pad: int = 0, most: int = 2048) -> DataFrame:
    """batch, id, input_ids, labels, attention: examples (id, ids, n_prompt) in the order of their ids by ``size``, each batch as wide as its longest, ``most`` at most.

    The place of an example is counted by hash bucket first, so that no task numbers all of them.
    """
    cut = examples.select("id", F.slice("ids", 1, most).alias("ids"), "n_prompt").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(1024)))
    counts = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("id")) - 1 + F.col("before")
    placed = cut.join(F.broadcast(counts.select("bucket", "before")), "bucket").withColumn("batch", F.floor(place / size))  # 1,024 rows
    wide = placed.withColumn("width", F.max(F.size("ids")).over(W.partitionBy("batch")))
    fill = lambda values, x: padded(values, F.col("width"), x)
    ones = F.transform("ids", lambda _: F.lit(1))
    return wide.select("batch", "id", fill(F.col("ids"), pad).alias("input_ids"), fill(masked_labels(F.col("ids"), F.col("n_prompt")), -100).alias("labels"), fill(ones, 0).alias("attention"))
