"""Stages that feed each other: each its own stream with its own checkpoint, handing over by folders and sentinels.

A stage's batch is written beside its output and moved there as one folder, so the next stage sees a batch whole or not at
all; a batch that is run again after a failure finds its folder and leaves it. A stage stops when the one before it has
left its sentinel and nothing is left to take, and then leaves its own, so stages stop in order. ``run`` may be called
again after a failure: finished stages aren't started, others go on from their checkpoints.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vellum.sources import writers


@dataclass
class Stage:
    """name; work, from a batch to the rows handed over (lazy; rows of a key that came together stay together); and their schema."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    schema: str


def _hand_over(spark: SparkSession, root: str, stage: Stage) -> Callable[[DataFrame, int], None]:
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(df: DataFrame, epoch: int) -> None:
        out = f"{root}/{stage.name}/rows/b{epoch:09d}"
        if store.exists(path(out)):
            return
        beside = f"{root}/{stage.name}/open/b{epoch:09d}"
        stage.work(df).write.mode("overwrite").parquet(beside)
        if not store.rename(path(beside), path(out)):
            raise OSError(f"{beside} can't be moved to {out}")

    return batch


def sentinel(root: str, stage: Stage) -> str:
    return f"{root}/{stage.name}.sentinel"


def rows(spark: SparkSession, root: str, stage: Stage) -> DataFrame:
    """All that a stage has handed over."""
    return spark.read.schema(stage.schema).parquet(f"{root}/{stage.name}/rows/*")


def run(source: DataFrame, stages: list[Stage], root: str, done: Callable[[], bool], poll: float = 1.0) -> list[str]:
    """Stages from a stream of arrivals on, until ``done()`` and all is taken; the names in the order in which they stopped."""
    spark = source.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    running, stopped = {}, [s.name for s in stages if writers.there(spark, sentinel(root, s))]
    try:
        stream = source
        for stage in stages:
            store.mkdirs(path(f"{root}/{stage.name}/rows"))
            if stage.name not in stopped:
                running[stage.name] = stream.writeStream.foreachBatch(_hand_over(spark, root, stage)).option("checkpointLocation", f"{root}/{stage.name}/checkpoint").trigger(processingTime=f"{max(1, int(poll * 1000))} milliseconds").start()
            stream = spark.readStream.schema(stage.schema).parquet(f"{root}/{stage.name}/rows/*")
        for i, stage in enumerate(stages):
            if stage.name not in running:
                continue
            before = done if not i else lambda i=i: writers.there(spark, sentinel(root, stages[i - 1]))
            while not before():
                for q in running.values():
                    if q.exception() is not None:
                        raise q.exception()
                time.sleep(poll)
            q = running[stage.name]
            q.processAllAvailable()  # raises what ended the stage, if anything did
            q.stop()
            del running[stage.name]
            writers.named(spark, sentinel(root, stage), "done\n")
            stopped.append(stage.name)
    finally:
        for q in running.values():
            q.stop()
    return stopped

