"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] x[i] + sum over pairs of c[i] c[j] <v[i], v[j]> / sqrt(n)), over the distinct hashed
terms of the whole text (Unicode lower case, punctuation stripped; each word, and the first four letters of a longer
one), n of which the fit knows. x[i] is the term's count in the text times its inverse document frequency, of a text's
terms together of length 1, so that long and short texts are told by their share of insults; a term of few training
documents counts less, by df / (df + ``doubt``), but no term of two or more is left out. Pairs are what a linear model
misses: a word that is harmless alone and an insult next to a group's name. c[i] is 1 or 0, for a term in the text or
not, less the share of the training documents that hold the term: without that, the terms of every text drown the
others, and in long texts no pair is learnt. The pair sum is taken as half of (sum c v)^2 - sum (c v)^2, what absent
terms add to it is known beforehand, so a document costs its terms times the rank.

The model is fit on at most ``max_rows`` labelled documents, the lowest by a hash of the id; that documented bound
also bounds what the driver holds. AdaGrad with weight decay, fixed seed. How many updates it takes, and how fast the
pairs learn, is what does best on every fifth of those documents, kept out of a first fit; the held-out fold is never
looked at. Scoring reads every text whole.

Defined results: a null text is empty and scores by the bias and what absent terms add; a text may be of any length;
null labels are left out; repeated rows each count; ties in the hash that picks rows go by id and label; without
labelled rows every score is 0.5; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

BITS, BATCH = 18, 128
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>_-"


class Terms(dict):
    """Word to the places of its hashed terms: the word and, of a longer one, its first four letters; emptied when full."""

    def __init__(self, limit: int = 250_000):
        from array import array

        self.limit, self.terms = limit, array("i")

    def __missing__(self, word: bytes) -> int:
        import zlib

        bare = word.decode("utf-8", "replace").lower().strip(_EDGE)
        at = self[word] = len(self.terms) // 2
        self.terms.append(zlib.crc32(bare.encode()) & ((1 << BITS) - 1))
        self.terms.append(zlib.crc32(b"^" + bare[:4].encode()) & ((1 << BITS) - 1) if len(bare) > 4 else -1)
        return at

    def of(self, raw: bytes):
        """Distinct terms of a text in UTF-8, sorted, and how often each stands in it."""
        from collections import Counter

        import numpy as np

        if len(self) > self.limit:
            self.clear()
            del self.terms[:]
        words = Counter(raw.split())
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        terms = np.frombuffer(self.terms, np.int32).reshape(-1, 2)[places].ravel()
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), 2)
        found, which = np.unique(terms[terms >= 0], return_inverse=True)
        return found, np.bincount(which, times[terms >= 0], len(found)).astype(np.int32)


@dataclass
class Machine:
    """bias, and per hashed term: weight ``w``, pair vector ``v``, share ``p`` of the training documents that hold it, and ``scale`` of its count."""

    bias: float
    w: Any
    v: Any
    p: Any
    scale: Any

    def __post_init__(self):
        squares = (self.v**2).sum(1)
        self.centre, self.rest, self.own = self.p @ self.v, (self.p**2 * squares).sum(), (1 - 2 * self.p) * squares

    def raw(self, flat, starts, counts=None):
        """Scores before the logistic; documents are runs of ``flat``, and of ``counts`` (each term once, unless given), from ``starts``."""
        import numpy as np

        if not len(starts):
            return np.zeros(0)
        n = np.diff([*starts, len(flat)])
        doc = np.repeat(np.arange(len(starts)), n)
        x = self.scale[flat] * (1 if counts is None else counts)
        norm = np.sqrt(np.maximum(np.bincount(doc, x * x, len(starts)), 1e-12))
        total = np.bincount(doc, self.w[flat] * x, len(starts)) / norm
        share = 0.5 / np.sqrt(np.maximum(np.bincount(doc, self.p[flat] > 0, len(starts)), 1))
        total -= share * (np.bincount(doc, self.own[flat], len(starts)) + self.rest)
        for k in range(self.v.shape[1]):
            total += share * (np.bincount(doc, self.v[flat, k], len(starts)) - self.centre[k]) ** 2
        return total + self.bias

    @classmethod
    def fit(cls, documents: list, labels, counts: list | None = None, epochs: int | None = None, updates: int = 500, every: int = 25, pair_rates: tuple = (0.4, 0.05), **how) -> "Machine":
        """Trained for ``epochs``, or else for as many updates, and at the pair rate, after which every fifth document, left out of a first fit, has the least loss."""
        import numpy as np

        counts = [np.ones(len(d)) for d in documents] if counts is None else counts
        y = np.asarray(labels, float)
        if not len(documents) or not 0 < y.sum() < len(y):
            size = 1 << BITS
            return cls(0.0 if not len(y) else 30.0 if y.all() else -30.0, np.zeros(size), np.zeros((size, 1)), np.zeros(size), np.zeros(size))
        size = lambda most: most * -(-len(y) // how.get("batch", BATCH))
        if epochs is not None:
            return cls._last(documents, counts, y, size(epochs), pair_rate=pair_rates[0], **how)
        out = np.arange(len(y)) % 5 == 4
        best, steps, chosen = np.inf, updates // 4, pair_rates[0]  # where there are too few rows to tell
        if 0 < y[out].sum() < out.sum() and 0 < y[~out].sum() < (~out).sum():
            pick = lambda some, keep: [s for s, k in zip(some, keep, strict=True) if k]
            held, held_counts = pick(documents, out), np.concatenate(pick(counts, out))
            flat, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
            for pair_rate in pair_rates:
                for step, model in cls._steps(pick(documents, ~out), pick(counts, ~out), y[~out], updates, every, pair_rate=pair_rate, **how):
                    z = model.raw(flat, starts, held_counts)
                    loss = (np.logaddexp(0, z) - y[out] * z).mean()
                    if loss < best:
                        best, steps, chosen = loss, step, pair_rate
        return cls._last(documents, counts, y, steps, pair_rate=chosen, **how)

    @classmethod
    def _last(cls, documents, counts, y, updates: int, **how) -> "Machine":
        *_, (_, model) = cls._steps(documents, counts, y, updates, 0, **how)
        return model

    @classmethod
    def _steps(cls, documents, counts, y, updates: int, every: int, rank: int = 4, rate: float = 4.0, pair_rate: float = 0.4, bias_rate: float = 0.4, decay: float = 1e-5, pair_decay: float = 1e-5, doubt: float = 8.0, batch: int = BATCH):
        """(step, model) after each ``every`` updates (0: none) and after the last."""
        import numpy as np

        rng, size = np.random.default_rng(7), 1 << BITS
        df = np.bincount(np.concatenate(documents), minlength=size)
        live = df >= 2  # a term of one document says nothing of another
        place, m, seen = np.cumsum(live) - 1, int(live.sum()), df[live]
        scale = np.log(len(documents) / np.maximum(seen, 1)) * seen / (seen + doubt)
        known = [live[d] for d in documents]
        values = [c[k] * scale[place[d[k]]] for d, c, k in zip(documents, counts, known, strict=True)]
        values = [x / np.sqrt(max((x * x).sum(), 1e-12)) for x in values]
        documents = [place[d[k]] for d, k in zip(documents, known, strict=True)]
        bias = float(np.log(y.mean() / (1 - y.mean())))
        wl, vl, pl = np.zeros(m), rng.normal(0, 0.02, (m, rank)), seen / len(documents)
        gw, gv, gb = np.full(m, 1e-4), np.full((m, rank), 1e-2), 1e-2

        def model():
            w, v, p, s = np.zeros(size), np.zeros((size, rank)), np.zeros(size), np.zeros(size)
            w[live], v[live], p[live], s[live] = wl, vl, pl, scale
            return cls(bias, w, v, p, s)

        order: list = []
        for step in range(1, updates + 1):
            if not order:
                mixed = rng.permutation(len(documents))
                order = [mixed[at : at + batch] for at in range(0, len(mixed), batch)][::-1]
            some = order.pop()
            own = [documents[i] for i in some]
            n = np.array([len(d) for d in own])
            flat, x, doc = np.concatenate(own), np.concatenate([values[i] for i in some]), np.repeat(np.arange(len(own)), n)
            sums = np.stack([np.bincount(doc, vl[flat, k], len(own)) for k in range(rank)], 1) - pl @ vl
            squares = (vl**2).sum(1)
            alone = np.bincount(doc, ((1 - 2 * pl) * squares)[flat], len(own)) + (pl**2 * squares).sum()
            share = 1 / np.sqrt(np.maximum(n, 1))
            z = bias + np.bincount(doc, wl[flat] * x, len(own)) + 0.5 * share * ((sums**2).sum(1) - alone)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(own)
            dw = np.bincount(flat, e[doc] * x, m)
            dw += decay * wl * (dw != 0)
            gw += dw * dw
            wl -= rate * dw / np.sqrt(gw)
            es = e * share
            dv = np.stack([np.bincount(flat, (es * sums[:, k])[doc], m) for k in range(rank)], 1) - pl[:, None] * (es @ sums)
            dv += (pair_decay - (1 - 2 * pl) * np.bincount(flat, es[doc], m) - pl**2 * es.sum())[:, None] * vl
            gv += dv * dv
            vl -= pair_rate * dv / np.sqrt(gv)
            gb += e.sum() ** 2
            bias -= bias_rate * e.sum() / np.sqrt(gb)
            if every and step % every == 0:
                yield step, model()
        yield updates, model()


def _runs(found: list):
    """Offsets and flat columns of many (terms, counts)."""
    import numpy as np

    none = np.zeros(0, np.int32)
    return np.cumsum([0, *(len(t) for t, _ in found)]), np.concatenate([*(t for t, _ in found), none]), np.concatenate([*(c for _, c in found), none])


def term_batches(batches):
    import numpy as np
    import pyarrow as pa

    seen = Terms()
    for b in batches:
        ends, terms, counts = _runs([seen.of(t or b"") for t in b.column(0).cast(pa.binary()).to_pylist()])
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(c)) for c in (terms, counts)]
        yield pa.RecordBatch.from_arrays([*lists, b.column(1)], names=["terms", "counts", "label"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 15_000, **how) -> Machine:
    """labels: (doc_id, label). At most ``max_rows`` of them are joined to their texts and brought here as hashed terms."""
    rows = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # at most max_rows ids
    got = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(term_batches, "terms array<int>, counts array<int>, label int").toArrow()
    import numpy as np

    terms, y = got.column("terms").combine_chunks(), got.column("label").to_numpy()
    counts = got.column("counts").combine_chunks().values.to_numpy()
    at, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
    found = [(flat[a:b], counts[a:b], label) for a, b, label in zip(at, at[1:], y, strict=False)]
    found.sort(key=lambda d: (len(d[0]), d[0].tobytes(), d[1].tobytes(), d[2]))  # the same order on every run
    return Machine.fit([d[0] for d in found], [d[2] for d in found], [d[1] for d in found], **how)


def score_batches(sent):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, seen = sent.value, Terms()
        for whole in batches:
            for b in tokens.slices(whole, 256):
                ends, terms, counts = _runs([seen.of(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()])
                z = model.raw(terms, ends[:-1], counts)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, label) of the held-out fold are never read."""
    fold = F.crc32(common.id_text()) % folds
    known = labels.filter(F.col("label").isin(0, 1) & (fold != held)).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, known, **how))  # 2^18 terms x (4 + rank) numbers
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held).alias("held_out"), "text").mapInArrow(score_batches(sent), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: toxicity of every document."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return classify(common.table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
