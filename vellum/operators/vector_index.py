"""Nearest vectors by inverted lists: a trained coarse quantiser, 8-bit residual codes, exact ranks.

``train`` fits centroids and the range of residuals on a bounded sample; ``build`` writes every vector under its list, one
folder per list, codes in files of their own so that a search reads a byte a dimension and full vectors only of what it
ranks again. ``search`` reads the ``probes`` lists nearest to each query, keeps ``again`` candidates by code in every batch,
and ranks those by exact cosine. With ``exact`` no neighbour is missed: a list whose bound (its centroid's angle to the
query less its own radius) is below a query's k-th score can hold none, all others are read in full.

What is broadcast: centroids (``lists`` of them, a parameter) and blocks of queries of at most ``block_bytes``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum import storage


@dataclass
class Quantiser:
    """centroids (lists x dimensions, unit length), and per dimension the least residual and the step of its codes."""

    centroids: Any
    low: Any
    step: Any

    def nearest(self, x):
        return (x @ self.centroids.T).argmax(1)

    def codes(self, x, at):
        import numpy as np

        return np.clip(np.round((x - self.centroids[at] - self.low) / self.step), 0, 255).astype(np.uint8)

    def restored(self, codes, at):
        return self.centroids[at] + self.low + codes * self.step


def unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(vectors: DataFrame, lists: int, sample: int = 65_536, rounds: int = 12) -> Quantiser:
    """Spherical k-means on at most ``sample`` vectors, the lowest by a hash of their ids; that bound is what the driver holds."""
    import numpy as np

    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(got):
        return Quantiser(np.zeros((1, 1)), np.zeros(1), np.ones(1))
    x = unit(got.values.to_numpy(zero_copy_only=False).astype(float).reshape(len(got), -1))
    lists = min(lists, len(x))
    c = x[np.random.default_rng(11).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = np.bincount(at, minlength=lists) > 0
        c[full] = unit(total[full])
    rest = x - c[(x @ c.T).argmax(1)]
    low, high = rest.min(0) - 0.05, rest.max(0) + 0.05
    return Quantiser(c, low, np.maximum(high - low, 1e-9) / 255)


def build(vectors: DataFrame, quantiser: Quantiser, path: str) -> None:
    """Codes, full vectors and each list's size and radius (least cosine to its centroid); vectors: vec_id, embedding. A large list is in several files."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        import numpy as np

        q = sent.value
        for b in batches:
            if not len(b):
                continue
            x = unit(np.array(b["embedding"].tolist(), float))
            at = q.nearest(x)
            b["list"], b["code"] = at.astype("int32"), [c.tobytes() for c in q.codes(x, at)]
            b["near"] = (x * q.centroids[at]).sum(1)
            yield b[["vec_id", "embedding", "list", "code", "near"]]

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(8))  # a list with a third of all vectors is eight tasks' work
    rows = storage.kept(vectors.select("vec_id", "embedding").mapInPandas(run, f"vec_id long, embedding {dict(vectors.dtypes)['embedding']}, list int, code binary, near double"), "coded")
    dealt = rows.repartition("list", spread)
    dealt.select("list", "vec_id", "code").write.partitionBy("list").parquet(f"{path}/codes")
    dealt.select("list", "vec_id", "embedding").write.partitionBy("list").parquet(f"{path}/vectors")
    rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("radius")).coalesce(1).write.parquet(f"{path}/lists")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, list, score) of each query; Spark keeps k a task before it ranks."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scored(rows: DataFrame, sent, exact: bool, keep: int) -> DataFrame:
    """(query_id, vec_id, list, score): each batch's ``keep`` best of each query whose lists these are. rows: vec_id, list and a code or an embedding."""

    def run(batches):
        import numpy as np
        import pandas as pd

        quantiser, ids, q, wanted = sent.value
        for b in batches:
            found = []
            for at, own in b.groupby("list"):
                asks = wanted.get(int(at))
                if asks is None:
                    continue
                x = unit(np.array(own["embedding"].tolist(), float)) if exact else quantiser.restored(np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1), int(at))
                s = q[asks] @ x.T
                if exact:
                    s = np.round(s, 6)
                best = np.argsort(-s, axis=1, kind="stable")[:, : keep if not exact else s.shape[1]]
                if exact:  # ties at the edge stay: ranks are given later, by id
                    edge = np.sort(s, axis=1)[:, ::-1][:, min(keep, s.shape[1]) - 1][:, None]
                    i, j = np.nonzero(s >= edge)
                else:
                    i, j = np.repeat(np.arange(len(asks)), best.shape[1]), best.ravel()
                found.append(pd.DataFrame({"query_id": ids[asks][i], "vec_id": own["vec_id"].to_numpy()[j], "list": np.int32(at), "score": s[i, j]}))
            if found:
                yield pd.concat(found)

    return rows.mapInPandas(run, "query_id long, vec_id long, list int, score double")


def search(spark: SparkSession, path: str, quantiser: Quantiser, queries: DataFrame, k: int = 5, probes: int = 8, again: int = 50, exact: bool = False, block_bytes: int = 64 << 20) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine (rounded to six places; ties by id). queries: query_id, embedding, a set that the caller states."""
    import numpy as np

    radius = {r["list"]: (r["n"], r["radius"]) for r in spark.read.parquet(f"{path}/lists").collect()} if storage_there(spark, f"{path}/lists") else {}  # ``lists`` rows at most
    size = queries.agg(F.sum(F.size("embedding") * 8).alias("b")).first()["b"] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    out = None
    for i in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        got = some.select("query_id", "embedding").toArrow()  # one block of the stated queries
        if not got.num_rows or not radius:
            continue
        ids, vectors = got.column("query_id").to_numpy(), got.column("embedding").combine_chunks()
        q = unit(vectors.values.to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1))
        near = q @ quantiser.centroids.T
        near[:, [c for c in range(near.shape[1]) if c not in radius]] = -np.inf
        chosen = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        hits = _probed(spark, path, quantiser, ids, q, chosen, near, k, again)
        if exact:
            hits = _completed(spark, path, quantiser, ids, q, near, radius, storage.kept(hits, "probed"), k)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else storage.empty(spark, "query_id long, vec_id long, score double, rank int")


def storage_there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _wanted(chosen, near) -> dict:
    """list to the places of the queries that want it."""
    import numpy as np

    of: dict = {}
    for place, lists in enumerate(chosen):
        for at in lists:
            if np.isfinite(near[place, at]):
                of.setdefault(int(at), []).append(place)
    return {at: np.array(v) for at, v in of.items()}


def _probed(spark, path, quantiser, ids, q, chosen, near, k: int, again: int) -> DataFrame:
    wanted = _wanted(chosen, near)
    sent = spark.sparkContext.broadcast((quantiser, ids, q, wanted))
    codes = spark.read.parquet(f"{path}/codes").filter(F.col("list").isin(list(wanted)))  # whole folders are left out
    likely = storage.kept(_best(_scored(codes.select("vec_id", "list", "code"), sent, False, again), again).select("query_id", "vec_id", "list"), "likely")
    full = spark.read.parquet(f"{path}/vectors").filter(F.col("list").isin(list(wanted))).join(storage.sent_if_small(likely), ["list", "vec_id"])
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q, strict=True)], "query_id long, qv array<double>")
    dot = F.aggregate(F.zip_with(F.transform("embedding", lambda x: x.cast("double")), "qv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scored = full.join(F.broadcast(asked), "query_id").select("query_id", "vec_id", "list", F.round(dot / F.greatest(size, F.lit(1e-12)), 6).alias("score"))
    return _best(scored, k).select("query_id", "vec_id", "score", "rank")


def _completed(spark, path, quantiser, ids, q, near, radius: dict, hits: DataFrame, k: int) -> DataFrame:
    """All lists that could hold a better neighbour than the k-th known, read in full."""
    import numpy as np

    known = {r["query_id"]: r["score"] for r in hits.filter(F.col("rank") == k).collect()}  # one row a query of the block
    least = np.array([known.get(int(i), -2.0) for i in ids])
    angle = np.arccos(np.clip(near, -1, 1))
    reach = np.full(near.shape[1], -1.0)
    for at, (_, r) in radius.items():
        reach[at] = np.arccos(np.clip(r, -1, 1))
    bound = np.where(reach < 0, -np.inf, np.cos(np.maximum(angle - reach, 0)))
    open_ = [np.flatnonzero(b >= s - 1e-6) for b, s in zip(bound, least, strict=True)]
    wanted = _wanted(open_, np.zeros_like(near))
    sent = spark.sparkContext.broadcast((quantiser, ids, q, wanted))
    rows = spark.read.parquet(f"{path}/vectors").filter(F.col("list").isin(list(wanted))).select("vec_id", "list", "embedding")
    return _best(_scored(rows, sent, True, k), k).select("query_id", "vec_id", "score", "rank")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query_id, vec_id) that were found."""
    n = truth.count()
    return found.select("query_id", "vec_id").join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / n if n else 1.0
