"""Data sources for ``spark.read.format``: SQLite tables by ranges of row ids and ledger workbooks by file, with filters pushed down.

Files are listed and opened through ``pyarrow.fs``, so any store it knows does (local, HDFS, S3, GCS), given a URI; a path
without a scheme is local. Turn on ``spark.sql.python.filterPushdown.enabled`` to have filters pushed.
"""

from __future__ import annotations

import contextlib
import fnmatch
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextlib.contextmanager
def _copy(uri: str) -> Iterator[sqlite3.Connection]:
    """A private copy of a database, which may be in use; gone when the task ends."""
    store, path = _store(uri)
    with tempfile.TemporaryDirectory() as d:
        own = os.path.join(d, "copy.sqlite")
        with store.open_input_stream(path) as source, open(own, "wb") as target:
            shutil.copyfileobj(source, target, 1 << 20)
        db = sqlite3.connect(own)
        try:
            yield db
        finally:
            db.close()


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteTable(DataSource):
    """``format("sqlite_table").option("table", name).option("rows", most of a task).load(uri)``: a task per range of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with _copy(self.options["path"]) as db:
            found = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        kind = lambda said: T.LongType() if "INT" in said.upper() else T.DoubleType() if any(k in said.upper() for k in ("REAL", "FLOA", "DOUB")) else T.StringType()
        return T.StructType([T.StructField(name, kind(said)) for _, name, said, *_ in found])

    def reader(self, schema: T.StructType) -> "SqliteReader":
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.most = options["path"], options["table"], int(options.get("rows", 50_000))
        self.names = [f.name for f in schema]
        self.where: list[str] = []
        self.given: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of one column with numbers or texts go to the database; all others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
            if len(column) == 1 and type(f) in _COMPARED and plain(f.value):
                self.where.append(f"{_quoted(column[0])} {_COMPARED[type(f)]} ?")
                self.given.append(f.value)
            elif len(column) == 1 and isinstance(f, In) and all(map(plain, f.value)):
                self.where.append(f"{_quoted(column[0])} in ({', '.join('?' * len(f.value))})")
                self.given += list(f.value)
            elif len(column) == 1 and isinstance(f, IsNotNull):
                self.where.append(f"{_quoted(column[0])} is not null")
            else:
                yield f

    def _rows(self, what: str, more: tuple = ()) -> tuple[str, list]:
        where = [*self.where, *more]
        return f"select {what} from {_quoted(self.table)}" + (f" where {' and '.join(where)}" if where else ""), self.given

    def partitions(self) -> list[Rows]:
        """Ranges of row ids from the first to the last that the filters leave."""
        with _copy(self.path) as db:
            low, high, n = db.execute(*self._rows("min(rowid), max(rowid), count(*)")).fetchone()
        if not n:
            return [Rows(0, -1)]
        parts = max(1, -(-n // self.most))
        step = -(-(high - low + 1) // parts)
        return [Rows(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if partition.high < partition.low:
            return
        sql, given = self._rows(", ".join(map(_quoted, self.names)), ("rowid between ? and ?",))
        with _copy(self.path) as db:
            yield from db.execute(sql, [*given, partition.low, partition.high])


class Workbooks(DataSource):
    """``format("ledger_workbooks").option("skip", sheet).load(folder or pattern)``: a task per workbook; a filter on ``file`` leaves the others unopened, one on ``sheet`` their rows unmade."""

    @classmethod
    def name(cls) -> str:
        return "ledger_workbooks"

    def schema(self) -> str:
        from vellum.sources import readers

        return readers.LEDGER

    def reader(self, schema: T.StructType) -> "WorkbooksReader":
        return WorkbooksReader(self.options)


class WorkbooksReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.skip = options["path"], options.get("skip", "Master Goods Sheet")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("file",), ("sheet",)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = some if known is None else known & some
            elif not (isinstance(f, IsNotNull) and f.attribute in (("file",), ("sheet",))):
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        folder, _, pattern = self.path.rpartition("/") if self.path.endswith(".xlsx") or "*" in self.path else (self.path, "", "*.xlsx")
        store, path = _store(folder)
        names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))
        return [InputPartition((folder, n)) for n in names if n in self.wanted.get("file", {n})]

    def read(self, partition) -> Iterator[tuple]:
        from vellum.sources import readers

        folder, name = partition.value
        store, path = _store(folder)
        with store.open_input_stream(f"{path}/{name}") as f:
            for row in readers.ledger_rows(f.readall(), name, self.skip):
                if row[1] in self.wanted.get("sheet", {row[1]}):
                    yield row


def sqlite_file(folder: str, table: str, columns: str):
    """For ``groupBy(part).applyInPandas``: a group's rows, without their first column, as ``part-<part>.sqlite`` in a folder all executors reach; (part, n)."""

    def run(group):
        import pandas as pd

        part, rows = int(group.iloc[0, 0]), group.iloc[:, 1:]
        with tempfile.TemporaryDirectory() as d:
            own = os.path.join(d, "own.sqlite")
            db = sqlite3.connect(own)
            db.execute(f"create table {_quoted(table)} ({columns})")
            db.executemany(f"insert into {_quoted(table)} values ({', '.join('?' * rows.shape[1])})", (tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows.itertuples(index=False, name=None)))
            db.commit()
            db.close()
            store, path = _store(folder)
            with open(own, "rb") as source, store.open_output_stream(f"{path}/part-{part}.sqlite") as target:
                shutil.copyfileobj(source, target, 1 << 20)
        return pd.DataFrame({"part": [part], "n": [len(rows)]})

    return run


def register(spark) -> None:
    for source in (SqliteTable, Workbooks):
        spark.dataSource.register(source)
