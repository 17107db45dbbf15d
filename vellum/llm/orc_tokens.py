"""Token ids in ORC: run-length-encoded stripes with row indexes and Bloom filters on the document id.

``write_tokens`` range-partitions documents by id (ties by a hash of the text), so file k holds only
ids below those of file k+1 and rows within a file ascend. Each row holds its id, the file's number,
the count of ids before it in the file, and the ids as an integer list, which ORC stores in
run-length-encoded stripes. ``read_tokens`` reads stripes in parallel and adds each file's base, the
sum of the earlier files' ids, taken from one column of the files themselves.

Defined results: a null text is empty; a document is its ids and the end id, so an empty one has one
id; a text of any length is one row, encoded whole; a null doc_id sorts first, and ties go by a hash of the
text; repeated rows are kept, next to each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

#: More files than this and the table of bases is joined without a broadcast.
MAX_BROADCAST_FILES = 100_000


def encode_partition(path: str | None, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, before = tokens.encoder(path, 800_000), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in tokens.slices(whole, 2048):
                starts, ids = enc.encode(b.column(1), end_id)
                n = np.diff(starts)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(before + starts[:-1]), pa.array(n.astype(np.int32)), tokens.id_lists(starts, ids)], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += len(ids)
            common.give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, files: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Encode and write; ``files`` is the number of ORC files (the session's shuffle partitions unless given)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(files or common.partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(encode_partition(tokenizer, end_id), "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "lz4")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: from the files alone. A filter on doc_id prunes stripes and row groups."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per file
    base, total = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        base.append((r["part"], total))
        total += r["n"]
    bases = spark.createDataFrame(base, "part int, base long")
    if len(base) <= MAX_BROADCAST_FILES:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(batches):
    """ids to their CRC-32 as little-endian unsigned 32-bit integers; the other columns go through."""
    import zlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids = b.column(b.num_columns - 1)
        at, flat = ids.offsets.to_numpy(), np.asarray(ids.values.to_numpy(), "<u4")
        crc = [zlib.crc32(flat[at[i] : at[i + 1]]) for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: write every document's ids, read the files back, and return a digest of each row."""
    path = common.fresh_path(spark, "orc")
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", F.col("n_tokens").cast("long"), "ids").mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
