"""Sources and sinks: each query writes files to the shared folder, reads them back and is held against SQL over the tables they were made of."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vellum import storage
from vellum.functions import text as X
from vellum.plans.views import Registry, table
from vellum.sources import readers, writers
from vellum.streaming import ingest

query = Registry()


def _nations(spark, d) -> list:
    """The 25 rows of the table of nations."""
    return sorted(tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())


def _folder(spark, d, name: str, content) -> str:
    """A folder with a file for each nation, as ``content(key, name, region)`` names and fills it."""
    folder = ingest.scratch(spark, name)
    for row in _nations(spark, d):
        file, body = content(*row)
        writers.named(spark, f"{folder}/{file}", body)
    return folder


_PAGE = '<PcGts xmlns="http://schema/2013"><Page><TextLine><TextEquiv><Unicode>{}</Unicode></TextEquiv></TextLine><TextLine><Unicode>region {}</Unicode></TextLine></Page></PcGts>'
_HOCR = '<html xmlns="http://www.w3.org/1999/xhtml"><body><span>{}</span><p><span> region {} </span></p></body></html>'


@query("read_xml", "SELECT 'page_' || n_nationkey AS doc_id, CASE n_nationkey % 3 WHEN 2 THEN '<PcGts>' || n_name ELSE n_name || ' region ' || n_regionkey END AS text FROM nation")
def _(spark, d):
    """PAGE, hOCR and what can't be parsed, told by their roots."""
    made = lambda k, n, r: (f"page_{k}.xml", (_PAGE.format(n, r), _HOCR.format(n, r), f"<PcGts>{n}")[k % 3])
    return readers.documents(spark, _folder(spark, d, "xml", made), "xml").select("doc_id", "text")


@query("read_markdown", "SELECT 'page_' || n_nationkey AS doc_id, '# ' || n_name || chr(10) || 'region ' || n_regionkey AS text FROM nation")
def _(spark, d):
    return readers.documents(spark, _folder(spark, d, "md", lambda k, n, r: (f"page_{k}.md", f"# {n}\nregion    {r}\n")), "md").select("doc_id", "text")


@query("read_one_line", "SELECT 'f' || n_nationkey AS doc_id, 'body of ' || n_name AS text FROM nation")
def _(spark, d):
    """Pages whose heading was run into their first line."""
    made = lambda k, n, r: (f"f{k}.md", (f'x_page_1 body of {n} {{ "x": 1', f"x.md  body of {n}", f"# {r}\nbody of {n}")[k % 3])
    return readers.documents(spark, _folder(spark, d, "line", made), "line").select("doc_id", "text")


@query("read_corpus", "SELECT CASE n_nationkey % 4 WHEN 3 THEN 'f' || n_nationkey || '_1' ELSE 'f' || n_nationkey END AS doc_id, n_name AS text FROM nation UNION ALL SELECT 'own' || n_nationkey, 'first' FROM nation WHERE n_nationkey % 4 = 3")
def _(spark, d):
    """Text, Markdown, XML and JSON lines in one folder; empty files are left out."""
    lines = lambda k, n: json.dumps({"doc_id": f"own{k}", "text": "first"}) + "\n" + json.dumps({"text": n}) + "\nnot json\n"
    made = lambda k, n, r: (f"f{k}.{('txt', 'md', 'xml', 'jsonl')[k % 4]}", (n, n, f"<PcGts><TextLine><Unicode>{n}</Unicode></TextLine></PcGts>", lines(k, n))[k % 4])
    folder = _folder(spark, d, "corpus", made)
    writers.named(spark, f"{folder}/empty.txt", "  \n")
    return readers.corpus(spark, folder).select("doc_id", "text")


@query("read_latin1", "SELECT 'f' || n_nationkey AS doc_id, 'é ' || n_name AS text FROM nation")
def _(spark, d):
    """UTF-8 and, where that fails, Latin-1."""
    return readers.documents(spark, _folder(spark, d, "latin", lambda k, n, r: (f"f{k}.txt", f"é {n}".encode("utf-8" if k % 2 else "latin-1")))).select("doc_id", "text")


@query("read_first_documents", "SELECT * FROM (SELECT 'f' || n_nationkey AS doc_id, n_name AS text FROM nation) ORDER BY doc_id LIMIT 7")
def _(spark, d):
    """The first few documents of a folder, by name."""
    return readers.documents(spark, _folder(spark, d, "limit", lambda k, n, r: (f"f{k}.txt", n)), limit=7).select("doc_id", "text")


@query("read_gold_json", "SELECT 'd' || n_nationkey AS doc_id, CAST(i AS INTEGER) AS ord, CASE i WHEN 0 THEN n_name ELSE 'r' || n_regionkey END AS text, CASE i WHEN 0 THEN 'TOPONYM' ELSE 'PERSON' END AS label FROM nation, (SELECT unnest([0, 1]) AS i)")
def _(spark, d):
    """Annotated documents, one or an array to a file; the label under either name."""

    def made(k, n, r):
        doc = {"doc_id": f"d{k}.xml", "text": "t", "entities": [{"text": n, "label": "TOPONYM"}, {"text": f"r{r}", "type": "PERSON"}]}
        return f"x{k}.json", json.dumps([doc] if k % 2 else doc)

    return readers.annotations(spark, _folder(spark, d, "gold", made)).select("doc_id", "ord", "text", "label")


@query("read_predictions", "SELECT 'd' || n_regionkey AS doc_id, 0 AS ord, arg_max(n_name, n_nationkey) AS text, 'TOPONYM' AS label FROM nation GROUP BY n_regionkey")
def _(spark, d):
    """One array of predictions, in which a document's last entry wins."""
    folder = ingest.scratch(spark, "predictions")
    rows = [{"doc_id": f"d{r}", "entities": [{"text": n, "type": "TOPONYM"}]} for _, n, r in _nations(spark, d)]
    writers.named(spark, f"{folder}/all.json", json.dumps(rows))
    return readers.predictions(spark, folder).select("doc_id", "ord", "text", "label")


@query("read_entity_lines", "SELECT 'files' AS via, 'd' || n_nationkey AS doc_id, n_name AS text, 'TOPONYM' AS type FROM nation UNION ALL SELECT 'aggregate', 'd' || n_nationkey, n_name, 'TOPONYM' FROM nation WHERE n_nationkey <> 3")
def _(spark, d):
    """A file of lines to a document, and without those one file that names the documents; bad lines are skipped."""
    line = lambda k, n, own: json.dumps(({"doc_id": own} if own is not None else {}) | {"text": n, "type": "TOPONYM"}) + "\n{broken\n"
    folder = _folder(spark, d, "entities", lambda k, n, r: (f"per_doc/d{k}.jsonl", line(k, n, None)))
    writers.named(spark, f"{folder}/entities.jsonl", "".join(line(k, n, f"d{k}" if k != 3 else "") for k, n, _ in _nations(spark, d)))
    found = lambda per, via: readers.entity_lines(spark, per, f"{folder}/entities.jsonl").withColumn("via", F.lit(via))
    return found(f"{folder}/per_doc", "files").unionByName(found(f"{folder}/none", "aggregate")).select("via", "doc_id", "text", "type")


@query("read_metadata", "SELECT 'm' || n_nationkey AS doc_id, CASE n_nationkey % 3 WHEN 2 THEN 'm' || n_nationkey ELSE n_name END AS title, CASE n_nationkey % 2 WHEN 0 THEN 'Author ' || n_regionkey END AS author, CAST(1700 + n_nationkey AS INTEGER) AS year FROM nation")
def _(spark, d):
    """Records whose fields vary in name and may be lists."""

    def made(k, n, r):
        record = ({"title": n}, {"Title": [n, "other"]}, {})[k % 3] | ({"Author": [f"Author {r}"]} if k % 2 == 0 else {})
        return f"m{k}.json", json.dumps(record | ({"date": f"printed {1700 + k}"} if k % 2 else {"year": [str(1700 + k)]}))

    return readers.metadata(spark, _folder(spark, d, "metadata", made))


@query("read_filename_records", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 < 2 THEN 'Author ' || n_regionkey END AS author, CASE WHEN n_nationkey % 3 = 0 THEN CAST(1700 + n_nationkey AS VARCHAR) END AS year, CASE n_nationkey % 3 WHEN 0 THEN n_name || ' - part' ELSE n_name END AS title FROM nation")
def _(spark, d):
    """Author, year and title from the names of files."""
    made = lambda k, n, r: ((f"Author {r} - {1700 + k} - {n} - part", f"Author {r} - {n}", n)[k % 3] + f"#{k}.txt", "x")
    files = readers.documents(spark, _folder(spark, d, "names", made))
    at = F.split("doc_id", "#")
    return files.select(at[1].cast("int").alias("id"), readers.filename_record(at[0]).alias("r")).select("id", "r.author", "r.year", "r.title")


def _workbook(rows: list[list]) -> bytes:
    """A workbook of the rows, and of the sheet that is skipped."""
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r) if v != "") + "</row>" for i, r in enumerate([["Commodity"], *rows]))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Jamaica" r:id="r1"/><sheet name="Master Goods Sheet" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@query("read_ledger_xlsx", "SELECT n_name AS commodity, CASE n_nationkey % 2 WHEN 0 THEN 'Jamaica' ELSE 'Nevis' END AS from_location, CASE n_nationkey % 2 WHEN 0 THEN 'London' ELSE 'Bristol' END AS to_location, CASE n_nationkey % 2 WHEN 0 THEN '1696' ELSE '1701' END AS year, CAST(nullif(n_regionkey, 0) AS DOUBLE) AS ton, CAST(n_nationkey + 0.5 AS DOUBLE) AS total_pounds FROM nation")
def _(spark, d):
    """Workbooks by columns, with defaults from the sheet's and the file's names; blank commodities are left out."""
    folder = ingest.scratch(spark, "xlsx")
    row = lambda k, n, r: [n, *(("", "", "") if k % 2 == 0 else ("Nevis", "Bristol", "1701")), r, "", "", "", k + 0.5]
    rows = [row(*x) for x in _nations(spark, d)]
    writers.named(spark, f"{folder}/L 1696-1697.xlsx", _workbook([*rows, ["", "x"]]))
    return readers.ledger_workbooks(spark, folder).select("commodity", "from_location", "to_location", "year", "ton", "total_pounds")


@query("read_ledger_csv", "SELECT s_name AS good, CASE WHEN s_suppkey % 3 = 2 THEN CAST(s_suppkey AS DOUBLE) END AS ton, NULL::DOUBLE AS lb FROM supplier WHERE s_suppkey % 3 <> 1")
def _(spark, d):
    """Rows with some measure written in them, be it 0, which then counts as none."""
    out = ingest.scratch(spark, "ledger-csv")
    k = F.col("s_suppkey")
    ton = F.when(k % 3 == 0, "0.0").when(k % 3 == 1, "").otherwise(k.cast("string"))
    writers.csv(table(spark, d, "supplier").select(F.col("s_name").alias("good"), ton.alias("ton"), F.lit("").alias("lb")), out)
    return readers.ledger_csv(spark, out, ["ton", "lb"])


@query("read_sqlite", "SELECT s_suppkey AS id, s_name AS title FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, d):
    """A query on a copy of a database file."""
    import os
    import sqlite3
    import tempfile

    with tempfile.TemporaryDirectory() as local:  # the file is made here and then put where all can read it
        path = os.path.join(local, "b.sqlite")
        db = sqlite3.connect(path)
        db.execute("create table items (id integer, title text)")
        db.executemany("insert into items values (?, ?)", [tuple(r) for r in table(spark, d, "supplier").select("s_suppkey", "s_name").collect()])
        db.commit()
        db.close()
        with open(path, "rb") as f:
            raw = f.read()
    out = ingest.scratch(spark, "sqlite") + "/b.sqlite"
    writers.named(spark, out, raw)
    return readers.sqlite_table(spark, out, "select id, title from items where id % 2 = 0", "id long, title string")


@query("read_recognised", "SELECT 'Customer_' || c_custkey AS doc_id, c_name AS text FROM customer WHERE c_custkey % 10 <> 0")
def _(spark, d):
    """A recogniser's lines, named by the page they were made of; empty ones are left out."""
    out = ingest.scratch(spark, "recognised")
    k = F.col("c_custkey")
    said = F.struct(F.concat(F.lit("/scans/Customer "), k.cast("string"), F.lit(".pdf")).alias("Source-File"))
    table(spark, d, "customer").select(F.when(k % 10 == 0, " ").otherwise(F.col("c_name")).alias("text"), said.alias("metadata")).write.json(out)
    return readers.recognised(spark, out)


@query("read_latest_run", "SELECT event_id FROM events WHERE event_id % 3 = 2")
def _(spark, d):
    out = ingest.scratch(spark, "runs")
    table(spark, d, "events").select("event_id", F.format_string("2026010%d", (F.col("event_id") % 3).cast("int")).alias("run")).write.partitionBy("run").parquet(out)
    return readers.latest_run(spark.read.parquet(out).withColumn("run", F.col("run").cast("string"))).select("event_id")


@query("read_config", "SELECT c_custkey AS id, k AS key, CASE k WHEN 'name' THEN replace(c_name, '#', '-') WHEN 'segment' THEN 'override' ELSE '[' || c_nationkey || ', ' || c_custkey || ']' END AS value FROM customer, (VALUES ('name'), ('segment'), ('keys')) AS t(k)")
def _(spark, d):
    """Keys and values of a settings text of each customer, of which named ones win."""
    k = F.concat_ws(", ", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("# a note\nname: '"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("'  # who\nsegment: "), "c_mktsegment", F.lit("\nkeys: ["), k, F.lit("]\n")).alias("text"))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, key, v if isinstance(v, str) else json.dumps(v)) for i, t in zip(b["id"], b["text"], strict=True) for key, v in readers.config(t, segment="override", missing=None).items()]
            yield pd.DataFrame(rows, columns=["id", "key", "value"])

    return texts.mapInPandas(run, "id long, key string, value string")


@query("write_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, printf('%.2f', p_retailprice) AS p_retailprice, printf('%.6f', p_size / 7) AS share FROM part")
def _(spark, d):
    """CSV with a header and fixed decimals, as text."""
    out = ingest.scratch(spark, "csv")
    writers.csv(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") / 7).alias("share")), out, {"p_retailprice": 2, "share": 6})
    return spark.read.option("header", True).csv(out)


@query("write_json_lines", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def _(spark, d):
    out = ingest.scratch(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(out)
    return spark.read.schema("event_id long, event_type string, value double").json(out).withColumn("value", F.round("value", 6))


@query("write_all_and_some", "SELECT 'all' AS kind, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'some', count(*) FROM supplier WHERE s_acctbal > 0")
def _(spark, d):
    """All rows as CSV, and as texts only those that hold something."""
    out = ingest.scratch(spark, "both")
    rows = table(spark, d, "supplier").withColumn("body", F.concat("s_name", F.lit(": "), F.col("s_acctbal").cast("string"))).withColumn("group", F.lit("ledger"))
    writers.all_and_some(rows, F.col("s_acctbal") > 0, f"{out}/csv", f"{out}/texts", "group", "body")
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(spark.read.option("header", True).csv(f"{out}/csv"), "all").unionByName(n(spark.read.text(f"{out}/texts"), "some"))


@query("write_group_texts", "SELECT regexp_replace(p_brand, '[^a-zA-Z0-9_\\-]', '_', 'g') AS name, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS body FROM part GROUP BY p_brand")
def _(spark, d):
    """A text for each group."""
    out = ingest.scratch(spark, "texts")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "\n")
    writers.group_texts(table(spark, d, "part").groupBy("p_brand").agg(body.alias("body")), "p_brand", "body", out)
    return spark.read.text(out, wholetext=True).select(F.col("name").cast("string").alias("name"), F.col("value").alias("body"))


@query("write_routed", "SELECT CASE WHEN event_id % 4 = 2 THEN 'domain' WHEN event_id % 4 = 3 THEN 'cidoc_standard' ELSE 'unclassified' END AS tier, CAST(2 * count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    """Lines appended, twice, to a folder for each kind."""
    out, k = ingest.scratch(spark, "routed"), F.col("event_id") % 4
    relation = F.when(k == 2, "GROWN_IN").when(k == 3, "HAS_OWNER").otherwise("KNOWN_TO")
    rows = table(spark, d, "events").select("event_id", X.relation_tier(relation).alias("tier"))
    for _ in range(2):
        writers.routed(rows, "tier", out)
    return spark.read.json(out).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("write_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS body FROM customer")
def _(spark, d):
    """New rows in the place of old ones of the same key."""
    old, new = ingest.scratch(spark, "old"), ingest.scratch(spark, "new")
    c = table(spark, d, "customer")
    c.filter("c_custkey % 5 <> 0 or c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body")).write.parquet(old)
    writers.upsert(spark.read.parquet(old), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("body")), "id").write.parquet(new)
    return spark.read.parquet(new)


@query("load_graph", "SELECT 'nodes' AS part, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'edges', 2 * count(*) FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, d):
    """Loaded twice: nodes once by id, edges whose ends exist each time, in files of bounded size."""
    out = ingest.scratch(spark, "graph")
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_name")
    k = F.col("s_nationkey").cast("string")
    edges = table(spark, d, "supplier").select(F.concat(F.lit("n"), k).alias("source"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), k)).otherwise("nowhere").alias("target"))
    for _ in range(2):
        writers.load_graph(nodes, edges, out, rows=20)
    n = lambda part: spark.read.parquet(f"{out}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n("nodes").unionByName(n("edges"))


@query("push_rows", "SELECT CAST(count(*) AS BIGINT) AS sent, CAST(count(*) FILTER (s_suppkey % 7 <> 0) AS BIGINT) AS taken FROM supplier")
def _(spark, d):
    """Rows handed to a service by the tasks that hold them."""
    got = writers.push(table(spark, d, "supplier").select("s_suppkey"), lambda rows: sum(r["s_suppkey"] % 7 != 0 for r in rows), rows=10)
    return got.agg(F.sum("sent").alias("sent"), F.sum("taken").alias("taken"))


@query("write_report", "SELECT CAST(count(*) + 6 AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS rows FROM region")
def _(spark, d):
    """A table of a report under a name of its own."""
    out = ingest.scratch(spark, "report") + "/regions.tex"
    writers.latex_table(spark, table(spark, d, "region").orderBy("r_regionkey"), out, "Regions & names")
    return spark.read.text(out).agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("value").rlike(r"^\d"), 1)).alias("rows"))


@query("copy_plan", "SELECT name, source, CASE WHEN k % 4 = 0 THEN 'present' WHEN row_number() OVER (PARTITION BY name ORDER BY source) > 1 THEN 'duplicate' ELSE 'copy' END AS action FROM (SELECT floor(s_suppkey / 2) AS k, 'f' || CAST(floor(s_suppkey / 2) AS BIGINT) || '.pdf' AS name, s_name AS source FROM supplier)")
def _(spark, d):
    """What a copy would do with each file."""
    k = F.floor(F.col("s_suppkey") / 2)
    wanted = table(spark, d, "supplier").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("name"), F.col("s_name").alias("source"), k.alias("k"))
    return writers.copies(wanted.drop("k"), wanted.filter("k % 4 = 0").select("name"))


@query("read_sqlite_ranges", "SELECT o_orderkey AS id, o_orderpriority AS title, o_totalprice AS price FROM orders WHERE o_orderkey >= 100 AND o_orderpriority <> '5-LOW'")
def _(spark, d):
    """Orders from four databases, each written by a task: a range of row ids is a task's, and the least id goes to the database."""
    from vellum.sources import datasources

    folder = ingest.scratch(spark, "sqlite-ranges")
    writers.named(spark, f"{folder}/about", "four parts\n")  # makes the folder
    keyed = table(spark, d, "orders").select(F.pmod(F.col("o_orderkey"), F.lit(4)).cast("int").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    written = keyed.groupBy("part").applyInPandas(datasources.sqlite_file(folder, "items", "id integer primary key, title text, price real"), "part int, n long")
    written.write.parquet(f"{folder}-written")
    datasources.register(spark)
    key, before = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set(key, "true")
    try:
        names = [r["part"] for r in spark.read.parquet(f"{folder}-written").collect()]  # four at most
        parts = [spark.read.format("sqlite_table").option("table", "items").option("rows", 2000).load(f"{folder}/part-{k}.sqlite") for k in sorted(names)]
        rows = storage.empty(spark, "id long, title string, price double")
        for p in parts:
            rows = rows.unionByName(p.filter("id >= 100 and title <> '5-LOW'"))
        return storage.kept(rows, "sqlite-rows")
    finally:
        spark.conf.set(key, before)


QUERIES, ORACLE = query.queries, query.oracle
