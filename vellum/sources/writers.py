"""Where results go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """With a header, doubles in fixed decimals where asked."""
    df.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in (digits or {}).items()}).write.mode("overwrite").option("header", True).csv(path)


def with_all_columns(parts: list[DataFrame], first: list[str]) -> DataFrame:
    """Rows of sparse tables under the union of their columns: the leading ones, then the rest by name."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def graph(nodes: list[DataFrame], edges: list[DataFrame], path: str) -> None:
    csv(with_all_columns(nodes, ["id", "label", "name"]), f"{path}/nodes")
    csv(with_all_columns(edges, ["source", "target", "type"]), f"{path}/edges")


def routed(df: DataFrame, by: str, path: str) -> None:
    """JSON lines appended to a folder per value."""
    df.write.mode("append").partitionBy(by).json(path)


def group_texts(df: DataFrame, name: str, body: str, path: str) -> None:
    """One text file per row, written where executors can see the path: a folder per name, as Spark commits whole folders."""
    df.select(F.regexp_replace(name, r"[^\w\-]", "_").alias("name"), F.col(body).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A keyed table with new rows in place of old ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merged_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once by id, and the edges both of whose ends exist: what loading by key makes of them."""
    once = nodes.dropDuplicates(["id"])
    ids = once.select("id")
    return once, edges.join(ids, edges.source == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi")


def named(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One small file under a name of its own, in any store: reports, and the sentinel that says a job is done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def all_and_some(df: DataFrame, keep, csv_path: str, text_path: str, name: str, body: str) -> None:
    """Every row as CSV, and as text only the rows that ``keep`` holds for."""
    csv(df, csv_path)
    group_texts(df.filter(keep), name, body, text_path)


def copies(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """name, source, action of each file to copy: ``copy``; ``duplicate`` where an earlier one of the same run has the name; ``present`` where the destination has it. Nothing is copied: the plan is the dry run."""
    from pyspark.sql.window import Window as W

    n = F.row_number().over(W.partitionBy("name").orderBy("source"))
    known = present.select("name").distinct().withColumn("_there", F.lit(True))
    rows = wanted.withColumn("_n", n).join(known, "name", "left")
    return rows.select("name", "source", F.when(F.col("_there"), "present").when(F.col("_n") > 1, "duplicate").otherwise("copy").alias("action"))


def load_graph(nodes: DataFrame, edges: DataFrame, path: str, rows: int = 5000) -> None:
    """Nodes merged by id into what the path holds and edges whose ends exist appended, in files of at most ``rows`` rows, each of them one transaction for a loader."""
    spark = nodes.sparkSession
    if there(spark, f"{path}/nodes"):
        old = spark.read.parquet(f"{path}/nodes")
        nodes = nodes.join(old.select("id"), "id", "left_anti")
        known = old.select("id").unionByName(nodes.select("id"))
    else:
        known = nodes.select("id")
    fresh, ids = nodes.dropDuplicates(["id"]), known.distinct()
    kept = edges.join(ids, edges.source == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi")
    kept.write.mode("append").option("maxRecordsPerFile", rows).parquet(f"{path}/edges")
    fresh.write.mode("append").option("maxRecordsPerFile", rows).parquet(f"{path}/nodes")


def push(df: DataFrame, send, rows: int = 500, key: str | None = None) -> DataFrame:
    """Rows handed to an injected ``send`` (a list of dicts to the number taken) by the tasks that hold them, ``rows`` at a time: batches and rows sent, and rows taken, per partition.

    With a ``key``, ``send`` also gets a token of the batch. Rows are dealt and sorted by key, so a task that runs again
    makes the same batches with the same tokens, and a receiver that remembers tokens takes none twice.
    """

    def run(batches):
        import hashlib

        import pandas as pd

        sent = taken = calls = 0
        held: list = []

        def out(some: list) -> int:
            token = hashlib.sha256("\x1f".join(str(r[key]) for r in some).encode()).hexdigest() if key else ""
            return send(some, token) if key else send(some)

        for b in batches:
            held += b.to_dict("records")
            while len(held) >= rows:
                taken += out(held[:rows])
                sent, calls, held = sent + rows, calls + 1, held[rows:]
        if held:
            taken += out(held)
            sent, calls = sent + len(held), calls + 1
        yield pd.DataFrame({"calls": [calls], "sent": [sent], "taken": [taken]})

    dealt = df.repartition(key).sortWithinPartitions(key, F.to_json(F.struct(*df.columns))) if key else df
    return dealt.mapInPandas(run, "calls long, sent long, taken long")


def latex_table(spark: SparkSession, rows: DataFrame, path: str, caption: str, most: int = 1000) -> None:
    """A table of a report: at most ``most`` rows of a summary, in their order, as LaTeX."""
    got = rows.limit(most).collect()
    safe = lambda v: "--" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{table}", rf"\caption{{{safe(caption)}}}", r"\begin{tabular}{" + "l" * len(rows.columns) + "}", " & ".join(map(safe, rows.columns)) + r" \\ \hline"]
    lines += [" & ".join(map(safe, r)) + r" \\" for r in got] + [r"\end{tabular}", r"\end{table}"]
    named(spark, path, "\n".join(lines) + "\n")
