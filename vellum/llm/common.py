"""What the operators of this package share: tables, the shared folder, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own, but only if all of Spark runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: no folder is known that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> int:
    """How many tables this driver has stored so far."""
    return len(_made)


def drop(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables stored since a count of ``made``, but for the one that ``keep`` reads: for when all that was built on them is stored."""
    files = keep.inputFiles()
    rest = [p for p in _made[since:] if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]
    for path in _made[since:]:
        if path not in rest:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made[since:] = rest


def materialize(df: DataFrame, name: str, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage, survives lost executors and keeps row ids fixed.

    ``rows``: at least as many as a narrow table has; it is then dealt into files of about ``per_file`` rows. A
    table of keys in hundreds of tiny files costs more to write and read than the keys, and in some stores a
    process or a request for each.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.repartition(max(1, -(-rows // per_file)))
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one column ``_row``, beside the columns named: whatever else a table holds, no name of ours can clash with it."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(docs[c] for c in columns))


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hand Python at most so many bytes at once, so that long texts don't add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, f"{most}b")


def give_back() -> None:
    """Return memory that allocators hold but nothing uses to the system; a Python worker lives on between tasks, and with other code."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(column: str | Column = "doc_id") -> Column:
    """The id as text; a missing id is the empty text."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))


def sent_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of keys, marked for broadcast when a count finds at most so many rows; beyond that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
