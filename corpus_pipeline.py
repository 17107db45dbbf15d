"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Defined results. Null texts have no words, so the quality rules reject them; the later stages take null, empty
and very long texts all the same (a null text is in a class of its own, holds no secret, has size 0 and packs
as an empty one). Null languages and sources are groups of their own. Repeated rows are judged alike, and one of
them stays; of a class the row of the least id stays, and ties go by the text. An empty table goes through every
stage as one. Extra columns go through unchanged, whatever their names, up to packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, mixing, near_dedup, packing, quality_rules, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, placed in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: Sampling sketches and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs, since = common.table(spark, sf_dir, "documents"), common.made()
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.drop(spark, since, docs)  # what the stage stored on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
