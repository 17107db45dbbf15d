"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (shares of character classes, repetition, lengths) are put through log
and logit transforms. Counts, sums and outer products per class, added up over all labelled rows, give
the class means and covariances; each covariance is shrunk towards the pooled one and its diagonal.
The model keeps the inverse of each Cholesky factor, so a score is two triangular products: the
difference of the Gaussian log densities (Mahalanobis terms and log determinants) plus log priors,
through a logistic.

Defined results: a null text is empty and gets a score like any other; a text of any length is read whole; equal
texts, and so ties, have equal scores; a document whose id has no
usable label teaches nothing; null labels are left out; repeated rows each count; with a class absent
every score is the share of the other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

FEATURES = ["words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "stops", "other_ascii", "lines", "distinct", "adjacent", "line_repeats"]


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of one text in UTF-8."""
    from math import log
    from operator import eq

    words = raw.split()
    n, chars = len(words), len(raw)
    kept = raw.translate(None, b" \t\n\r\x0b\x0c")
    body = len(kept)
    share = lambda kinds: log((body - len(kept.translate(None, kinds)) + 0.5) / (body + 50))
    logit = lambda k, m: log((k + 0.5) / (m - k + 0.5))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        log(n + 1), log(body + 1) - log(n + 1), share(b"#$%&*<>^~@"), share(b"!?"), share(b"|"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"),
        share(b".,;:"), share(b"\"'()[]{}_/\\=+-"), log((raw.count(b"\n") + 1) / (chars + 50)), logit(len(set(words)), n), logit(sum(map(eq, words, words[1:])), max(n - 1, 0)), logit(len(lines) - len(set(lines)), len(lines)),
    ]


def feature_batches(batches):
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for b in tokens.slices(whole):
            x = np.array([statistics(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(feature_batches, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant."""

    classes: dict

    @classmethod
    def fit(cls, sums: dict, shrink: float = 0.1, to_diagonal: float = 0.05, ridge: float = 1e-3) -> "Discriminant":
        """sums: label -> (count, sum of x, sum of outer products)."""
        import numpy as np

        total = sum(n for n, _, _ in sums.values())
        scatter = {k: o - np.outer(s, s) / n for k, (n, s, o) in sums.items()}
        pooled = sum(scatter.values()) / max(total, 1) if sums else None
        out = {}
        for k, (n, s, _) in sums.items():
            cov = (1 - shrink) * scatter[k] / n + shrink * pooled
            cov = (1 - to_diagonal) * cov + (to_diagonal + ridge) * np.diag(np.diag(cov)) + ridge * np.eye(len(s))
            factor = np.linalg.cholesky(cov)
            out[k] = (np.log(n / total), s / n, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
        return cls(out)

    def log_density(self, k: int, x):
        prior, mean, inverse, determinant = self.classes[k]
        z = (x - mean) @ inverse.T
        return prior - 0.5 * ((z * z).sum(1) + determinant)

    def score(self, x):
        """Odds of label 1, as a probability."""
        import numpy as np

        if len(self.classes) < 2:
            return np.full(len(x), 1.0 if 1 in self.classes else 0.0 if 0 in self.classes else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.log_density(1, x) - self.log_density(0, x), -30, 30)))


def moments(batches):
    import numpy as np
    import pyarrow as pa

    d, sums = len(FEATURES), {}
    for b in batches:
        x, y = np.asarray(b.column(1).values.to_numpy()).reshape(-1, d), b.column(0).to_numpy()
        for k in np.unique(y):
            at = x[y == k]
            n, s, o = sums.get(int(k), (0, np.zeros(d), np.zeros((d, d))))
            sums[int(k)] = (n + len(at), s + at.sum(0), o + at.T @ at)
    rows = [(k, [float(n), *s, *o.ravel()]) for k, (n, s, o) in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "m"])


def fit(labelled: DataFrame) -> Discriminant:
    """From (label, x) rows: each task sends one row of sums per class, and so many numbers only reach the driver after being added."""
    import numpy as np

    d = len(FEATURES)
    parts = labelled.select(F.col("label").cast("int"), "x").mapInArrow(moments, "label int, m array<double>")
    summed = parts.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    sums: dict = {}
    for r in summed.collect():  # classes x (1 + d + d*d) numbers
        sums.setdefault(r["label"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return Discriminant.fit({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in sorted(sums.items())})


def score_batches(model: Discriminant):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column(2).values.to_numpy()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, label) of the held-out fold are never read."""
    fold = F.crc32(common.id_text()) % folds
    common.small_batches(docs.sparkSession)
    x = common.materialize(features(docs), "quality")
    known = labels.filter(F.col("label").isin(0, 1) & (fold != held)).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    model = fit(x.join(known, "doc_id").select("label", "x"))
    scored = x.select("doc_id", (fold == held).alias("held_out"), "x").mapInArrow(score_batches(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: quality of every document."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(common.table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
