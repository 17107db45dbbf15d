"""Chunks, vector search and its mixture with the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vellum.functions import text as X
from vellum.functions import udfs


def fixed_chunks(c: Column, size: int, overlap: int, strip: bool = True) -> Column:
    """Array of windows of ``size`` characters every ``size - overlap``; empty ones dropped. The last may be all overlap."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.trim(F.substring(c, i + 1, F.lit(size))) if strip else F.substring(c, i + 1, F.lit(size)))
    return F.filter(cut, lambda x: x != "")


def chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    """chunk_id, doc_id, chunk_idx, text."""
    rows = docs.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "text"))
    return rows.select(F.format_string("%s__chunk%04d", F.col("doc_id").cast("string"), "chunk_idx").alias("chunk_id"), "doc_id", "chunk_idx", "text")


def sentence_chunks(docs: DataFrame) -> DataFrame:
    return chunk_rows(docs, udfs.sentence_chunks(F.col("text")))


#: Vectors and queries that are scored at a time.
ROWS, PART = 2048, 1024


def _nearest(sent, k: int):
    """(vec_id, embedding) to each task's k best (query_id, vec_id, score) of every query of a block, ties at the edge by id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, q = sent.value
        size = np.sqrt((q * q).sum(1))
        score, found = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)

        def best(score, found):
            if score.shape[1] <= k:
                return score, found
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            more = (score >= edge).sum(1)
            some = np.argpartition(-score, k - 1, axis=1)[:, :k]
            for i in np.flatnonzero(more > k):  # ties at the edge: the least ids
                at = np.flatnonzero(score[i] >= edge[i])
                some[i] = at[np.lexsort((found[i, at], -score[i, at]))[:k]]
            return np.take_along_axis(score, some, 1), np.take_along_axis(found, some, 1)

        for whole in batches:
            whole = whole.filter(pa.compute.is_valid(whole.column(1))) if whole.column(1).null_count else whole
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                norm, own, rows = (x * x).sum(1), b.column(0).to_numpy(), []
                for i in range(0, len(ids), PART):
                    part = slice(i, i + PART)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = np.round(q[part] @ x.T / np.sqrt((size[part] * size[part])[:, None] * norm), 6) + 0.0
                    new = best(np.where(np.isnan(s), -np.inf, s), np.broadcast_to(own, s.shape))
                    rows.append(best(np.hstack([score[part], new[0]]), np.hstack([found[part], new[1]])))
                score, found = (np.vstack([r[c] for r in rows]) for c in (0, 1))
        n = score.shape[1]
        ok = np.isfinite(score).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[ok]), pa.array(found.ravel()[ok]), pa.array(score.ravel()[ok])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = 64 << 20) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest by cosine.

    The query set is stated by the caller. It goes to every task in blocks of at most ``block_bytes`` of
    vectors, as a count finds them; a task scores them by matrix products and hands on its own k best per query.
    """
    import numpy as np

    spark, q = queries.sparkSession, queries.filter("embedding is not null").select("query_id", "embedding")
    size = q.agg((F.sum(F.size("embedding")) * 8).alias("b")).first()["b"] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1  # half full, so that hashing can't overfill them by much
    own, out, rows = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), None, vectors.select("vec_id", "embedding")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a small file is every core's work
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    for i in range(blocks):
        got = (q if blocks == 1 else q.filter(own == i)).toArrow()  # one block of the stated queries
        if not got.num_rows:
            continue
        ids = got.column("query_id").to_numpy()
        x = got.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        near = rows.mapInArrow(_nearest(spark.sparkContext.broadcast((ids, x)), k), "query_id long, vec_id long, score double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k)


def hybrid(vector_rows: DataFrame, graph_rows: DataFrame) -> DataFrame:
    """Both kinds of evidence with their source."""
    return vector_rows.withColumn("source", F.lit("vector")).unionByName(graph_rows.withColumn("source", F.lit("graph")), allowMissingColumns=True)


def context_lines(rows: DataFrame) -> DataFrame:
    """``[i] (doc: d, relevance: r)`` in rank order; r is rounded from the number itself, ties to even, as C and SQL do, not from its shortest digits."""
    return rows.withColumn("line", F.format_string("[%d] (doc: %s, relevance: %s)", "rank", F.col("doc_id").cast("string"), udfs.three_places(F.col("score").cast("double"))))


def diverse(rows: DataFrame, k: int) -> DataFrame:
    """Of each query's candidates (query_id, vec_id, embedding, score), k that are relevant and unlike each other."""

    def run(df):
        from vellum.functions import kernels

        df = df.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        chosen = kernels.diverse(df["embedding"].tolist(), df["score"].to_numpy(), k)
        out = df.iloc[chosen][["query_id", "vec_id"]].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    return rows.select("query_id", "vec_id", "embedding", "score").groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, pick int")


def win_rates(scores: DataFrame) -> DataFrame:
    """system, wins, games, win_rate from (question, system, score): every two systems that answered a question play; ties count for neither."""
    a, b = scores.alias("a"), scores.alias("b")
    games = a.join(b, (F.col("a.question") == F.col("b.question")) & (F.col("a.system") != F.col("b.system")) & (F.col("a.score") != F.col("b.score")))
    out = games.groupBy(F.col("a.system").alias("system")).agg(F.count(F.when(F.col("a.score") > F.col("b.score"), 1)).alias("wins"), F.count(F.lit(1)).alias("games"))
    return out.withColumn("win_rate", F.round(F.col("wins") / F.col("games"), 6))


def reuse(surfaced: DataFrame, by: str) -> DataFrame:
    """Of what each system surfaced (doc_id, chunk_id): rows, distinct chunks and documents, reuse in per cent, chunks a document."""
    out = surfaced.groupBy(by).agg(F.count(F.lit(1)).alias("surfaced"), F.countDistinct("chunk_id").alias("unique_chunks"), F.countDistinct("doc_id").alias("unique_docs"))
    return out.withColumn("reuse_pct", F.round(100 * (F.col("surfaced") - F.col("unique_chunks")) / F.col("surfaced"), 4)).withColumn("chunks_per_doc", F.round(F.col("unique_chunks") / F.col("unique_docs"), 4))


def coverage(surfaced: DataFrame, corpus: DataFrame, by: str) -> DataFrame:
    """Documents (doc_id) of the corpus that each system surfaced, and their share of it in per cent."""
    known = corpus.select("doc_id").distinct()
    total = known.agg(F.count(F.lit(1)).alias("_all"))
    n = surfaced.select(by, "doc_id").distinct().join(known, "doc_id").groupBy(by).agg(F.count(F.lit(1)).alias("docs"))
    return n.join(F.broadcast(total)).withColumn("coverage_pct", F.round(100 * F.col("docs") / F.col("_all"), 2)).drop("_all")  # one row


def embed(chunks: DataFrame, model, batch: int = 64) -> DataFrame:
    """chunks with ``embedding``: an injected model (texts to vectors) called with so many texts at once, its vectors brought to length 1. Empty texts are left out."""

    def run(batches):
        import numpy as np

        for b in batches:
            for at in range(0, len(b), batch):
                some = b.iloc[at : at + batch].copy()
                x = np.asarray(model(some["text"].tolist()), float)
                some["embedding"] = list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
                yield some

    kinds = ", ".join(f"`{n}` {k}" for n, k in chunks.dtypes)
    return chunks.filter(F.trim("text") != "").mapInPandas(run, kinds + ", embedding array<double>")


def dispatched(mode: str, graph_rows: DataFrame, vector_rows: DataFrame) -> DataFrame:
    """Evidence for an answer: of the graph, of the vectors (of the graph where they give nothing for a query), or both, by ``id``."""
    if mode == "graph":
        return hybrid(vector_rows.limit(0), graph_rows)
    if mode == "vector":
        return hybrid(vector_rows, graph_rows.join(vector_rows.select("id"), "id", "left_anti"))
    if mode == "hybrid":
        return hybrid(vector_rows, graph_rows)
    raise ValueError(f"no mode {mode}")


def graph_context(mode: str, terms: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, source, type, target: what a question's terms (id, term) find in a graph.

    local: nodes whose name holds a term, and the edges at them; global: edges whose type holds a term, and
    with them their ends; hybrid: both, each row once. Terms of a question are few and sent to every task.
    """
    t = F.broadcast(terms.select("id", F.lower("term").alias("_term")))  # a question's words
    named = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("_term"))
    node = lambda df, at: df.select("id", F.lit("node").alias("kind"), F.col(at).alias("source"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("target"))
    edge = lambda df: df.select("id", F.lit("edge").alias("kind"), "source", "type", "target")
    parts = []
    if mode in ("local", "hybrid"):
        hits = nodes.select(F.col("id").alias("node"), "name").join(t, named("name")).select("id", "node").distinct()
        touched = [edges.join(hits, F.col(end) == F.col("node")).select("id", "source", "type", "target") for end in ("source", "target")]
        parts += [node(hits, "node"), edge(touched[0].unionByName(touched[1]))]
    if mode in ("global", "hybrid"):
        found = edges.join(t, named("type")).select("id", "source", "type", "target").distinct()
        parts += [edge(found), node(found, "source"), node(found, "target")]
    if not parts:
        raise ValueError(f"no mode {mode}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
