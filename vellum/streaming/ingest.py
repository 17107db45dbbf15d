"""File arrivals as streams: each new file once, resume by checkpoint, windows with watermarks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder all executors share, under ``spark.checkpoint.dir``. Where that is unset, one of this machine, but only if all of Spark runs on it."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: no folder is known that all executors share")
    return "file://" + tempfile.mkdtemp(prefix=f"vellum-{name}-")


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 8, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as they come, a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table, and return the table. A later call on the same checkpoint takes only what is new."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out + "/rows")


def latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream over all that is there in update mode; the last state written for each key."""
    spark = stream.sparkSession
    out = scratch(spark, name)

    def batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out + "/rows")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out + "/rows")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in rest))


def process_once(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Each key once, whatever is replayed or arrives again, and whatever another checkpoint has put into the sink.

    Keys that were taken are keyed state of Spark's own, held by the checkpoint: a batch looks up its keys there and never
    reads what this checkpoint wrote. What others had written when the stream began is left out by a join on their keys
    alone. Each batch has a folder of its own in the sink, written anew if the batch is run again. The first row of a key in
    a batch by its columns is the one that stays; a task holds the rows that a batch deals to it.
    """
    import hashlib

    spark = stream.sparkSession
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    own = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def batch(df: DataFrame, epoch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={own}-{epoch}")

    fresh = stream.repartition(key).mapInArrow(_first_rows(key), stream.schema)
    if there:
        others = spark.read.parquet(out).filter(~F.startswith(F.col("batch").cast("string"), F.lit(f"{own}-")))
        others = others.select(F.col(key).cast(stream.schema[key].dataType).alias("_taken"))
        fresh = fresh.join(others, F.col(key).eqNullSafe(F.col("_taken")), "left_anti")
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        fresh.dropDuplicates([key]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)


def _first_rows(key: str):
    """Of the rows of a task, each key's first by its columns as texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        at = rows.schema.get_field_index(key)
        try:
            code = rows.column(at).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        except pa.ArrowNotImplementedError:  # keys of several parts
            codes: dict = {}
            code = np.array([codes.setdefault(repr(k), len(codes)) for k in rows.column(at).to_pylist()])
        many = np.flatnonzero(np.bincount(code)[code] > 1)
        if not len(many):
            yield from held
            return
        first: dict = {}
        for i, row in zip(many.tolist(), rows.take(pa.array(many)).to_pylist(), strict=True):
            said = [str(v) for v in row.values()]
            if code[i] not in first or said < first[code[i]][0]:
                first[code[i]] = said, i
        stays = np.ones(len(code), bool)
        stays[many] = False
        stays[[i for _, i in first.values()]] = True
        yield from rows.filter(pa.array(stays)).to_batches()

    return run


def watch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, done: Callable[[], bool], poll: float = 1.0) -> int:
    """Hand new files to ``work`` as they come, looking every ``poll`` seconds, until ``done()`` (a sentinel is there, say) and nothing is left. The number of rows taken.

    What came before the sentinel is always taken, since the queue is emptied once more after it was seen.
    """
    import time

    taken: dict[int, int] = {}  # by batch: one that is run again counts once

    def batch(df: DataFrame, epoch: int) -> None:
        work(df, epoch)
        taken[epoch] = df.count()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(poll * 1000))} milliseconds").start()
    try:
        while True:
            last = done()
            q.processAllAvailable()
            if last:
                break
            time.sleep(poll)
    finally:
        q.stop()
    return sum(taken.values())


def extracted(entities: Callable[[DataFrame], DataFrame], per_doc: str, aggregate: str, key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """Work of a batch: its entities as lines in a folder per document and, again, all together. A batch that is run again writes its own folder anew."""

    def work(df: DataFrame, epoch: int) -> None:
        found = entities(df)
        found.write.mode("overwrite").json(f"{aggregate}/epoch={epoch}")
        lines = df.sparkSession.read.schema(found.schema).json(f"{aggregate}/epoch={epoch}")
        lines.withColumn("_doc", F.col(key).cast("string")).repartition("_doc").write.mode("overwrite").partitionBy("_doc").json(f"{per_doc}/epoch={epoch}")

    return work


def tumbling(stream: DataFrame, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key; windows close once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), *by, "n", "v")


def sessions(stream: DataFrame, gap: str, *by: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def distinct_within(stream: DataFrame, *by: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(by))
