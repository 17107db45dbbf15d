import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from vellum.sources import readers, writers
from vellum.streaming import ingest

PAGE = '<PcGts xmlns="http://x/2013"><Page><TextLine><TextEquiv><Unicode> one </Unicode></TextEquiv></TextLine><TextLine><Unicode>two</Unicode></TextLine></Page></PcGts>'


def test_markup():
    assert readers.page_xml_text(PAGE) == " one  two" and readers.page_xml_text(PAGE, strip=True) == "one two"
    assert readers.xml_text('<html xmlns="http://w/xhtml"><span>a</span><span> b </span></html>') == "a b"
    assert readers.xml_text("<broken") == "<broken"
    assert readers.markdown_text("---\nt: 1\n---\n# H\na   b", strip_headers=True, front_matter=True) == "a b"
    assert readers.one_line_text("name_page_3 the body { \"x\": 1") == "the body"


def test_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "c.txt").write_text("  ")
    rows = readers.documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [("a", "x"), ("b", "café")]
    assert readers.documents(spark, str(tmp_path), limit=1).count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"doc_id": "x", "text": "a"}\nbad\n{"text": "b"}\n')
    assert {(r["doc_id"], r["text"]) for r in readers.json_lines(spark, str(tmp_path)).collect()} == {("x", "a"), ("f_2", "b")}


def test_annotations(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"doc_id": "d.xml", "text": "t", "entities": [{"text": "A", "type": "PERSON"}]}))
    (tmp_path / "two.json").write_text(json.dumps([{"text": "t", "entities": [{"text": "B", "label": "TOPONYM", "start": 1, "end": 2}]}]))
    got = {(r["doc_id"], r["text"], r["label"], r["start"]) for r in readers.annotations(spark, str(tmp_path)).collect()}
    assert got == {("d", "A", "PERSON", None), ("two", "B", "TOPONYM", 1)}


def test_metadata_and_names(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Title": ["T" * 300], "creator": "C", "date": "printed 1701"}))
    r = readers.metadata(spark, str(tmp_path)).first()
    assert (len(r["title"]), r["author"], r["year"]) == (200, "C", 1701)
    df = spark.createDataFrame([("A - 1700 - T - x",), ("A - T",), ("T",)], "s string").select(readers.filename_record(F.col("s")).alias("r")).collect()
    assert [tuple(x["r"]) for x in df] == [("A", "1700", "T - x"), ("A", None, "T"), (None, None, "T")]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    rows = [["Commodity", "From"], ["Sugar", "", "", "", 2, 0, 1], ["", "x"], ["Rum", "Nevis", "Bristol", "1700", 0, 0, 0, 0, 5, 6]]
    sheet = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r) if v != "") + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Jamaica" r:id="r1"/><sheet name="Master Goods Sheet" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "L 1696-1697.xlsx")
    spark.dataSource.register(readers.LedgerWorkbooks)
    rows = spark.read.format("ledger_xlsx").load(str(tmp_path / "*.xlsx")).orderBy("commodity").collect()
    assert [(r["commodity"], r["from_location"], r["to_location"], r["year"], r["ton"], r["quarter"], r["total_pounds"]) for r in rows] == [("Rum", "Nevis", "Bristol", "1700", None, None, 5.0), ("Sugar", "Jamaica", "London", "1696", 2.0, 1.0, None)]


def test_csv_ledger_and_sqlite(spark, tmp_path):
    (tmp_path / "l.csv").write_text("c,ton,lb\nsugar,0.0,\nrum,,\nhops,3,x\n")
    got = {r["c"]: r["ton"] for r in readers.ledger_csv(spark, str(tmp_path / "l.csv"), ["ton", "lb"]).collect()}
    assert got == {"sugar": None, "hops": 3.0}
    with sqlite3.connect(tmp_path / "b.sqlite") as db:
        db.execute("create table items (id int, t text)")
        db.execute("insert into items values (1, 'x')")
    assert readers.sqlite_table(spark, str(tmp_path / "b.sqlite"), "select id, t from items", "id long, t string").first()["t"] == "x"


def test_config():
    assert readers.config("a: 1\nb: 'x'  # note\n# c: 2\nd: [1, 2]", a=5, b=None) == {"a": 5, "b": "x", "d": [1, 2]}


def test_writers(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, z string"), spark.createDataFrame([(2, 3.14159)], "id int, m double")
    both = writers.with_all_columns([a, b], ["id"])
    assert both.columns == ["id", "m", "z"] and both.count() == 2
    writers.csv(b, str(tmp_path / "c"), {"m": 2})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["m"] == "3.14"
    assert writers.upsert(a, spark.createDataFrame([(1, "y")], "id int, z string"), "id").first()["z"] == "y"
    n, e = writers.merged_graph(spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "c")], "source string, target string"))
    assert n.count() == 2 and e.count() == 1


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string"
    for k in range(3):
        spark.createDataFrame([(k, "t"), (0, "t")], schema).coalesce(1).write.mode("append").parquet(src)
        ingest.process_once(ingest.arrivals(spark, src, schema), "doc_id", lambda df: df, out, str(tmp_path / "cp"))
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]


def test_watch_takes_all_that_came_before_the_sentinel(spark, tmp_path):
    src, schema, seen = str(tmp_path / "in"), "doc_id long", []
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(src)
    looks = iter([False, True])

    def done():
        last = next(looks)
        if last:  # more files, then the sentinel
            spark.range(3, 5).withColumnRenamed("id", "doc_id").write.mode("append").parquet(src)
        return last

    work = lambda df, epoch: seen.extend(r["doc_id"] for r in df.collect())
    assert ingest.watch(ingest.arrivals(spark, src, schema), work, str(tmp_path / "cp"), done, poll=0.1) == 5
    assert sorted(seen) == list(range(5))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("".join(json.dumps({"text": f"{i:05d}" + "x" * 40}) + "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.json_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["doc_id"]: int(r["text"][:5]) for r in got} == {f"f_{i}": i for i in range(5000)}
