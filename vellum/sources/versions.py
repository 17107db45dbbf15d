"""Tables in keyed buckets under one manifest: a merge rewrites the buckets it touches, and all its tables appear together.

``path/data`` holds a folder per merge and table, dealt by a hash of the key; ``path/manifests`` holds one file per version,
which names the folder of every table's buckets. A merge writes its folders first and its manifest last, by creating a file
that mustn't exist: whoever fails before leaves the version before readable, and of two merges at once one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another merge was committed meanwhile."""


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    store, folder = _store(spark, f"{path}/manifests")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in store.listStatus(folder) if f.getPath().getName().endswith(".json")) if store.exists(folder) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, buckets, and tables: name to key, schema and the folder of each bucket."""
    known = versions(spark, path)
    at = known[-1] if version is None and known else version
    if at is None or at not in known:
        return {"version": -1, "buckets": BUCKETS, "tables": {}}
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifests/{at:09d}.json", wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    store, target = _store(spark, f"{path}/manifests/{content['version']:09d}.json")
    try:
        out = store.create(target, False)
    except Exception as e:
        raise Conflict(f"version {content['version']} is there already") from e
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()


def read(spark: SparkSession, path: str, name: str, version: int | None = None, keys: list | None = None) -> DataFrame | None:
    """A table as of a version (the last), or only the buckets that hold some keys; None where it isn't."""
    known = manifest(spark, path, version)
    table = known["tables"].get(name)
    if table is None:
        return None
    places = sorted(table["folders"])
    if keys is not None:
        kind = next(f["type"] for f in json.loads(table["schema"])["fields"] if f["name"] == table["key"])
        asked = spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(_bucket("k", known["buckets"]).alias("b")).distinct()
        places = sorted({str(r["b"]) for r in asked.collect()} & set(places))
    return _rows(spark, path, table, places)


def _rows(spark: SparkSession, path: str, table: dict, places: list[str]) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(table["schema"]))
    folders = [f"{path}/data/{table['folders'][b]}/_bucket={b}" for b in places]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def merge(spark: SparkSession, path: str, changes: dict[str, tuple[DataFrame, str]], replace: bool = True, buckets: int = BUCKETS) -> int:
    """Rows put into tables by key, all or none; the new version. changes: name to rows and their key.

    A row whose key is there replaces it, or is left out with ``replace=False``. Keys are unique among the rows (of more,
    one stays: the first by all columns as text). Columns must be those of the table.
    """
    known = manifest(spark, path)
    tables = {n: {**t, "folders": dict(t["folders"])} for n, t in known["tables"].items()}
    own, buckets = uuid.uuid4().hex, known["buckets"] if known["tables"] else buckets
    for name, (rows, key) in changes.items():
        order = F.to_json(F.struct(*rows.columns))
        rows = rows.withColumn("_bucket", _bucket(key, buckets)).groupBy("_bucket", key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_bucket", "_row.*")
        table = tables.get(name)
        if table is not None:
            touched = [str(r["_bucket"]) for r in rows.select("_bucket").distinct().collect()]  # ``buckets`` at most
            old = _rows(spark, path, table, [b for b in touched if b in table["folders"]]).withColumn("_bucket", _bucket(key, buckets)).select(rows.columns)
            rows = old.join(rows.select(key), key, "left_anti").unionByName(rows) if replace else old.unionByName(rows.join(old.select(key), key, "left_anti"))
        folder = f"{name}-{own}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
        store, target = _store(spark, f"{path}/data/{folder}")
        written = [f.getPath().getName().split("=")[1] for f in store.listStatus(target) if f.getPath().getName().startswith("_bucket=")]
        schema = rows.drop("_bucket").schema.json() if table is None else table["schema"]
        tables[name] = {"key": key, "schema": schema, "folders": (table or {"folders": {}})["folders"] | dict.fromkeys(written, folder)}
    version = known["version"] + 1
    _commit(spark, path, {"version": version, "buckets": buckets, "tables": tables})
    return version


def load_graph(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame) -> int:
    """Nodes merged by id, those there stay as they are, and edges (source, target, type) whose ends exist, in one version."""
    old = read(spark, path, "nodes")
    known = nodes.select("id") if old is None else nodes.select("id").unionByName(old.select("id"))
    ids = known.distinct()
    kept = edges.join(ids, edges.source == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi")
    keyed = kept.withColumn("edge", F.sha2(F.concat_ws("\x1f", "source", "type", "target"), 256))
    return merge(spark, path, {"nodes": (nodes, "id"), "edges": (keyed, "edge")}, replace=False)
