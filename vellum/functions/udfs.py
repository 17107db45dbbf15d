"""The kernels as Arrow-batched functions; ``register`` puts them into SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import kernels


def _struct(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])  # types as objects: text would need a session at import


_COUNTS = _struct(T.LongType(), "distance", "insertions", "deletions", "substitutions")
_SPANS = T.ArrayType(_struct(T.IntegerType(), "s", "e"))


@F.pandas_udf(_COUNTS)
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Character edits."""
    return pd.DataFrame([kernels.edit_counts(a, b) for a, b in zip(ref, hyp, strict=True)], columns=["distance", "insertions", "deletions", "substitutions"])


@F.pandas_udf(T.LongType())
def plain_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """The edit distance where one reading shows it, else null."""
    found = [None if a is None or b is None else kernels.plain_edits(a, b) for a, b in zip(ref, hyp, strict=True)]
    return pd.Series([f[0] if f else None for f in found], dtype="Int64")


@F.pandas_udf(_COUNTS)
def token_edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edits of token arrays."""
    return pd.DataFrame([kernels.edit_counts(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], columns=["distance", "insertions", "deletions", "substitutions"])


@F.pandas_udf(T.StructType([T.StructField("accuracy", T.DoubleType()), *_struct(T.LongType(), "total", "errors").fields]))
def token_accuracy(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.accuracy(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], columns=["accuracy", "total", "errors"])


@F.pandas_udf(T.DoubleType())
def bleu(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([kernels.bleu(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)])


def page_measures(parts: tuple, lexicon=None):
    """Measures of a page, ``part_kind`` of the parts of ``kernels.PAGE``, in one reading of its texts before and after lower case; ``lexicon``: a broadcast set of words in lower case."""
    names = [f"{p}_{k}" for p in parts for k in kernels.PAGE[p]]
    kind = T.StructType([T.StructField(n, T.DoubleType() if n.endswith(("_score", "_accuracy")) else T.LongType()) for n in names])

    @F.pandas_udf(kind)
    def measures(ref: pd.Series, hyp: pd.Series, ref_raw: pd.Series, hyp_raw: pd.Series) -> pd.DataFrame:
        measured, none = kernels.page_measures(parts, lexicon.value if lexicon else frozenset()), (None,) * len(names)
        return pd.DataFrame([none if a is None or b is None else measured(a, b, c, d) for a, b, c, d in zip(ref, hyp, ref_raw, hyp_raw, strict=True)], columns=names)

    return measures


@F.pandas_udf(_struct(T.LongType(), *kernels.TAXONOMY))
def error_taxonomy(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.error_taxonomy(a, b) for a, b in zip(ref, hyp, strict=True)], columns=kernels.TAXONOMY)


@F.pandas_udf(_struct(T.LongType(), *kernels.ARTIFACTS))
def artifact_taxonomy(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.artifact_taxonomy(a, b) for a, b in zip(ref, hyp, strict=True)], columns=kernels.ARTIFACTS)


@F.pandas_udf(T.StringType())
def entity_text(text: pd.Series) -> pd.Series:
    return text.map(kernels.entity_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def three_places(number: pd.Series) -> pd.Series:
    """Rounded from the exact binary number; Java's formats round its shortest digits."""
    return number.map("{:.3f}".format, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_chunks(text: pd.Series) -> pd.Series:
    return text.map(kernels.sentence_chunks, na_action="ignore")


@F.pandas_udf(T.ArrayType(_struct(T.StringType(), "category", "gold_text", "gold_label", "pred_text", "pred_label")))
def align(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """Alignment of two arrays of (text, label)."""
    names = ["category", "gold_text", "gold_label", "pred_text", "pred_label"]
    sets = lambda rows: {(r["text"], r["label"]) for r in rows} if rows is not None else set()
    return pd.Series([[dict(zip(names, x, strict=True)) for x in kernels.align(sets(g), sets(p))] for g, p in zip(gold, pred, strict=True)])


@F.pandas_udf(_struct(T.LongType(), "tp", "fp", "fn"))
def partial_counts(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.partial_counts(set(g) if g is not None else set(), set(p) if p is not None else set()) for g, p in zip(gold, pred, strict=True)], columns=["tp", "fp", "fn"])


@F.pandas_udf(T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("repairs", T.LongType())]))
def rejoined(lines: pd.Series, known: pd.Series) -> pd.DataFrame:
    """Arrays of lines with words rejoined over line ends, and the number of repairs."""
    return pd.DataFrame([kernels.rejoin(list(a), set(b)) for a, b in zip(lines, known, strict=True)], columns=["lines", "repairs"])


@F.pandas_udf(_SPANS)
def occurrences(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[{"s": a, "e": b} for a, b in kernels.occurrences(t or "", n or "")] for t, n in zip(text, name, strict=True)])


@F.pandas_udf(_SPANS)
def first_unused(text: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([[{"s": a, "e": b} for a, b in kernels.first_unused(t or "", list(n))] for t, n in zip(text, names, strict=True)])


@F.udtf(returnType=T.StructType([T.StructField("chunk_idx", T.IntegerType()), T.StructField("chunk", T.StringType())]))
class SentenceChunks:
    """``SELECT doc_id, c.* FROM documents, LATERAL sentence_chunk_rows(text) c``"""

    def eval(self, text: str):
        yield from enumerate(kernels.sentence_chunks(text or ""))


ALL = [edit_counts, token_edit_counts, token_accuracy, bleu, error_taxonomy, artifact_taxonomy, entity_text, sentence_chunks, align, partial_counts, occurrences, first_unused]


def register(spark: SparkSession) -> None:
    for f in ALL:
        spark.udf.register(f.__name__, f)
    spark.udtf.register("sentence_chunk_rows", SentenceChunks)
