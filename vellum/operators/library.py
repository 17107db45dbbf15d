"""Bibliographic records: attachments, first creators, collections, clean names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attachments(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """PDF attachments (by type or by name) whose item isn't deleted."""
    pdf = (F.col("content_type") == "application/pdf") | F.lower(F.col("path")).endswith(".pdf")
    return items.filter(pdf).join(deleted.select("item_id"), "item_id", "left_anti")


def first_by(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of the first row of each key: a correlated LIMIT 1 without the correlation."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Each collection with its number of distinct items, 0 included."""
    n = members.groupBy("collection_id").agg(F.countDistinct("item_id").alias("items"))
    return collections.join(n, "collection_id", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))


def to_copy(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files whose destination isn't there yet."""
    return wanted.join(present.select("name"), "name", "left_anti")


def with_metadata(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Documents with title, author and year, which default to the id and to empty texts, and the archive that the id's beginning tells."""
    known = metadata.select("doc_id", F.col("title").alias("_t"), F.col("author").alias("_a"), F.col("year").cast("string").alias("_y"))
    found = docs.join(known, "doc_id", "left")
    defaults = {"title": F.coalesce("_t", "doc_id"), "author": F.coalesce("_a", F.lit("")), "year": F.coalesce("_y", F.lit(""))}
    return found.withColumns(defaults).withColumn("source", F.when(F.startswith("doc_id", F.lit("archive_org")), "archive_org").otherwise("EEBO")).drop("_t", "_a", "_y")
