"""Documents, markup, annotations and ledgers as DataFrames. Everything is read by Spark, so any store it knows will do."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

from vellum.functions import text as X


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def decode(raw: bytes) -> str:
    """UTF-8, else Latin-1, which takes any byte."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def page_xml_text(xml: str, strip: bool = False) -> str:
    """The first Unicode element of every TextLine, joined by spaces, whatever the namespace."""
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    lines = []
    for line in (e for e in ET.fromstring(xml).iter() if local(e) == "TextLine"):
        found = next((e.text for e in line.iter() if local(e) == "Unicode" and e.text), None)
        if found:
            lines.append(found.strip() if strip else found)
    return " ".join(lines)


def hocr_text(xml: str) -> str:
    """Every span with text of its own, trimmed, joined by spaces."""
    return " ".join(e.text.strip() for e in ET.fromstring(xml).iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] == "span" and e.text and e.text.strip())


def xml_text(xml: str) -> str:
    """hOCR or PAGE by the root's name; what can't be parsed as it stands."""
    try:
        root = ET.fromstring(xml).tag.rsplit("}", 1)[-1].lower()
        return hocr_text(xml) if "html" in root else page_xml_text(xml)
    except ET.ParseError:
        return xml


def markdown_text(md: str, strip_headers: bool = False, front_matter: bool = False) -> str:
    """Lines joined by spaces, runs of spaces collapsed; headings and a leading block between ``---`` lines off if asked."""
    lines = md.split("\n")
    if front_matter and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        lines = lines[[x.strip() for x in lines].index("---", 1) + 1 :]
    if strip_headers:
        lines = [x for x in lines if not x.lstrip().startswith("#")]
    return re.sub(" +", " ", "\n".join(lines)).strip()


def one_line_text(md: str) -> str:
    """Text of a file whose heading was run into its first line: behind ``_page_N`` or a file name, before a layout block; of one line that begins with a heading and has neither, behind the heading's first two blanks."""
    body = md.split(" { ")[0]
    if body.startswith("#") and "\n" not in body and not re.search(r"_page_\d+\s+.|\.md\s+.", body):
        return re.sub(r"\A#[^#]*?\s{2,}", "", body).strip()
    body = body if body.startswith("#") and "\n" not in body else "\n".join(x for x in body.split("\n") if not x.startswith("#"))
    for pattern in (r"_page_\d+\s+(.+)", r"\.md\s+(.+)"):
        if found := re.search(pattern, body, re.S):
            return found[1].strip()
    return body.strip()


_PARSERS = {"xml": xml_text, "md": markdown_text, "txt": lambda s: s, "line": one_line_text}


def _parsed(kind: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [_PARSERS[kind](decode(raw)) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["source", "text"])

    return run


def documents(spark: SparkSession, path: str, kind: str = "txt", limit: int = 0, glob: str | None = None) -> DataFrame:
    """doc_id (the file's stem), text, source of every file of a folder. kind: txt, md, xml, or line for one-line pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select(F.col("path").alias("source"), "content")
    rows = files.mapInArrow(_parsed(kind), "source string, text string").filter(F.col("text").rlike(r"(?U)\S"))
    rows = rows.select(file_stem(F.col("source")).alias("doc_id"), "text", "source")
    return rows.orderBy("doc_id").limit(limit) if limit else rows


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, source of a folder of text, Markdown, XML and JSON lines."""
    parts = [documents(spark, path, kind, glob=f"*.{kind}") for kind in ("txt", "md", "xml")]
    lines = json_lines(spark, f"{path}/*.jsonl")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(lines)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of JSON lines; without an id, the file's stem and the line's place; lines that don't parse are dropped.

    A line's place is its place in its split and the lines of the file's splits before, counted by split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(counts.select("path", "block", "first", before.alias("before")), ["path", "block"]).withColumn("i", F.col("at") - F.col("first") + F.col("before"))
    rows = placed.withColumn("v", F.from_json("value", "doc_id string, id string, text string")).filter(F.try_parse_json("value").isNotNull() & F.col("v.text").isNotNull())
    return rows.select(F.coalesce("v.doc_id", "v.id", F.format_string("%s_%d", file_stem(F.col("path")), "i")).alias("doc_id"), F.col("v.text").alias("text"), F.col("path").alias("source"))


def entity_lines(spark: SparkSession, per_doc: str, aggregate: str) -> DataFrame:
    """doc_id, text, type of entities in JSON lines, a file per document; where there is no such folder, of one file that names the documents. Lines that don't parse are dropped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(per_doc)
    split = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    lines = spark.read.text(per_doc if split else aggregate).select("value", F.col("_metadata.file_path").alias("path"))
    e = lines.filter(F.try_parse_json("value").isNotNull()).withColumn("e", F.from_json("value", "doc_id string, text string, type string"))
    doc_id = file_stem(F.col("path")) if split else F.nullif("e.doc_id", F.lit(""))
    return e.select(doc_id.alias("doc_id"), "e.text", "e.type").filter("doc_id is not null")


_ENTITY = "struct<text:string,type:string,label:string,start:int,end:int>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ord, text, label, start, end of JSON documents with entities, one or an array per file; ``.xml`` comes off ids."""
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    doc = f"struct<doc_id:string,text:string,entities:array<{_ENTITY}>>"
    one = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{doc}>")).otherwise(F.array(F.from_json("value", doc)))
    docs = files.select("path", F.explode(one).alias("d")).filter("d is not null")
    doc_id = F.replace(F.coalesce("d.doc_id", file_stem(F.col("path"))), F.lit(".xml"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.posexplode("d.entities").alias("ord", "e")).select("doc_id", "ord", F.col("e.text").alias("text"), F.coalesce("e.label", "e.type").alias("label"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ord, text, label of files that hold an array of predictions; of a document's several entries the last wins, and its id stays as it is."""
    docs = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<doc_id:string,entities:array<{_ENTITY}>>>")).alias("place", "d"))
    last = last_by_id(docs.select("place", "d.doc_id", "d.entities"), "place")
    return last.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", "ord", F.col("e.text").alias("text"), F.coalesce("e.label", "e.type").alias("label"))


def last_by_id(rows: DataFrame, order: str) -> DataFrame:
    """Of predictions for one document the last wins."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def chats(spark: SparkSession, path: str) -> DataFrame:
    """text and entities of chat examples in JSON lines."""
    from vellum.operators import ner

    rows = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    text, entities = ner.chat_example(F.col("messages"))
    return rows.select(text.alias("text"), entities.alias("entities"))


def metadata(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """doc_id, title, author, year of JSON records whose fields vary in name and may be lists."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), file_stem(F.col("_metadata.file_path")).alias("doc_id")).filter("v is not null")
    one = lambda *names: F.coalesce(*(F.try_variant_get("v", f"$.{n}{i}", "string") for n in names for i in ("[0]", "")))
    return raw.select("doc_id", F.substring(F.coalesce(one("title", "Title"), F.col("doc_id")), 1, most).alias("title"), F.substring(one("creator", "author", "Author"), 1, most).alias("author"), X.year(F.coalesce(one("date", "year", "Year"), F.lit("")), "title").alias("year"))


def filename_record(stem: Column) -> Column:
    """(author, year, title) of ``Author - Year - Title``; two parts are author and title, one is the title."""
    p = F.split(stem, " - ", 3)
    n = F.size(p)
    return F.struct(F.when(n > 1, F.trim(p[0])).alias("author"), F.when(n == 3, F.trim(p[1])).alias("year"), F.trim(F.element_at(p, -1)).alias("title"))


def ledger_csv(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """Ledger rows of CSV with some measure written in them, be it 0."""
    rows = spark.read.option("header", True).csv(path)
    some = F.lit(False)
    for m in measures:
        some = some | (F.coalesce(F.trim(F.col(m)), F.lit("")) != "")
    return rows.filter(some).withColumns({m: F.expr(f"nullif(try_cast({m} as double), 0)") for m in measures})


LEDGER = "file string, sheet string, commodity string, from_location string, to_location string, year string, ton double, hh double, quarter double, lb double, total_pounds double, weight_tons double"


def ledger_workbooks(spark: SparkSession, path: str, skip: str = "Master Goods Sheet") -> DataFrame:
    """Rows of every ledger workbook under a path of any store; a workbook is read whole by one task, with no library."""

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in LEDGER.split(", ")]
        kinds = [pa.string()] * 6 + [pa.float64()] * 6
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(ledger_rows(raw, file, skip))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, LEDGER)


class LedgerWorkbooks(DataSource):
    """Ledgers in workbooks, ``spark.read.format("ledger_xlsx").option("skip", sheet).load(glob of local or mounted files)``; a task a file, no library needed."""

    @classmethod
    def name(cls) -> str:
        return "ledger_xlsx"

    def schema(self) -> str:
        return LEDGER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _WorkbookReader(self.options)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.skip = options["path"], options.get("skip", "Master Goods Sheet")

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path.removeprefix("file://")))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from ledger_rows(f.read(), partition.value.rsplit("/", 1)[-1], self.skip)


def _number(s):
    try:
        return float(s) or None
    except (TypeError, ValueError):
        return None


def sheets(raw: bytes):
    """(name, rows of strings) of every sheet of a workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(raw)) as z:
        shared = ["".join(t.text or "" for t in si.iter("{%s}t" % ns["m"])) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
            out = []
            for row in ET.fromstring(z.read("xl/" + targets[s.get(rel)].removeprefix("/xl/"))).iter("{%s}row" % ns["m"]):
                cells: dict = {}
                for c in row:
                    column = 0
                    for ch in re.match("[A-Z]+", c.get("r"))[0]:
                        column = column * 26 + ord(ch) - 64
                    v = c.find("m:v", ns)
                    inline = c.find("m:is/m:t", ns)
                    text = inline.text if inline is not None else v.text if v is not None else None
                    cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            yield s.get("name"), out


def ledger_rows(raw: bytes, file: str, skip: str):
    """Rows by fixed columns: commodity, from, to, year, then six measures; defaults from the sheet's and the file's names."""
    years = re.findall(r"\d{4}", file)
    for sheet, rows in sheets(raw):
        if sheet == skip:
            continue
        for r in rows[1:]:
            r = [*r, *[None] * 10][:10]
            if not (r[0] or "").strip():
                continue
            yield (file, sheet, r[0].strip(), (r[1] or "").strip() or sheet, (r[2] or "").strip() or "London", (r[3] or "").strip() or (years[0] if years else None), *map(_number, r[4:10]))


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, rows: int = 10_000) -> DataFrame:
    """Rows of a query on a private copy of a bibliographic database, which may be in use. The task that holds the file runs the query and hands rows on as they come."""

    def run(batches):
        import os
        import sqlite3
        import tempfile

        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                with tempfile.TemporaryDirectory() as d:  # the task's own, gone before it ends
                    with open(os.path.join(d, "copy.sqlite"), "wb") as f:
                        f.write(raw)
                    db = sqlite3.connect(f.name)
                    found = db.execute(query)
                    names = [c[0] for c in found.description]
                    while some := found.fetchmany(rows):
                        yield pd.DataFrame(some, columns=names)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def recognised(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a recogniser's JSON lines: the page's source file, made a key, names the document."""
    rows = spark.read.schema("text string, metadata struct<`Source-File`: string>").json(path)
    return rows.select(F.regexp_replace(file_stem(F.col("metadata.`Source-File`")), r"[^\w\-.]", "_").alias("doc_id"), "text").filter(F.col("text").rlike(r"(?U)\S"))


def config(text: str, **overrides) -> dict:
    """``key: value`` lines (JSON where a value is), comments off; named values win."""
    out: dict = {}
    for line in text.split("\n"):
        key, colon, value = line.split("#")[0].partition(":")
        if colon and key.strip():
            try:
                out[key.strip()] = json.loads(value.strip() or "null")
            except ValueError:
                out[key.strip()] = value.strip().strip("'\"")
    return out | {k: v for k, v in overrides.items() if v is not None}


def latest_file(spark: SparkSession, path: str) -> str:
    """The file under a path that was changed last (of several, the last by name); its content isn't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path"))["path"]).first()[0]


def latest_run(runs: DataFrame, column: str = "run") -> DataFrame:
    """The rows of the last run by name: one partition is read."""
    last = runs.agg(F.max(column)).first()[0]
    return runs.filter(F.col(column) == last)
