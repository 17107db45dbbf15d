"""Indexes, temporal merges, chained streams, versions, exact ranks and sweeps, each against brute force or a failure."""

import collections
import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import graph, ner_eval, ocr, quantiles, temporal, text_index, vector_index
from vellum.sources import versions, writers
from vellum.streaming import chain, ingest


def test_similar_names_lose_none(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 14))) for _ in range(60)]
    names = sorted({*base, *(b + r.choice("xyz") for b in base), *(b[1:] for b in base), "aa" * 9, "aaa", "", "é"})
    grams = lambda s: collections.Counter(m[i : i + 3] for m in [f"^{s}$"] for i in range(max(len(m) - 2, 1)))
    g = {n: grams(n) for n in names}
    sq = {n: sum(c * c for c in g[n].values()) for n in names}
    dot = lambda a, b: sum(c * g[b][k] for k, c in g[a].items())
    want = {(a, b) for a in names for b in names if a < b and dot(a, b) ** 2 * 100 >= 64 * sq[a] * sq[b]}
    got = temporal.similar(spark.createDataFrame([("k", n) for n in names] + [("other", names[3])], "kind string, name string"), (8, 10)).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(want) > 40 and len(got) == len(want)


def test_best_partners_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(temporal, "BLOCK", 5)
    r = random.Random(4)
    stems = ["".join(r.choice("abcde") for _ in range(r.randint(6, 12))) for _ in range(12)]
    names = {s + "".join(r.choice("abcde") for _ in range(r.randint(0, 3))): r.randint(1, 4) for s in stems for _ in range(9)} | {"": 1, "É" * 3000: 2, "é" * 3001 + "a": 1, "\U0001f600 x": 1}
    grams = lambda s: collections.Counter(m[i : i + 3] for m in [f"^{s.lower()}$"] for i in range(max(len(m) - 2, 1)))
    g = {n: grams(n) for n in names}
    sq = {n: sum(c * c for c in g[n].values()) for n in names}
    dot = lambda a, b: sum(c * g[b][k] for k, c in g[a].items())
    want = {}
    for a, n in names.items():
        near = [(-dot(a, b) ** 2 / sq[b], -m, b) for b, m in names.items() if dot(a, b) ** 2 * 100 >= 49 * sq[a] * sq[b] and (-m, b) < (-n, a)]
        want[a] = min(near)[2] if near else a

    def root(a):
        return a if want[a] == a else root(want[a])

    rows = [("k", a, n) for a, n in names.items()] + [("k", None, 3), (None, "x", 1)]
    df = spark.createDataFrame(rows, "kind string, name string, n long")
    got = {x["name"]: x["root"] for x in temporal.merged(df, (7, 10)).filter("kind is not null and name is not null").collect()}
    assert got == {a: root(a) for a in names} and len(set(got.values())) < len(names) / 2 and got["é" * 3001 + "a"] == "É" * 3000
    pairs = [(x["a"], x["b"]) for x in temporal.similar(df.select("kind", "name"), (7, 10)).collect()]
    assert sorted(pairs) == sorted((a, b) for a in names for b in names if a < b and dot(a, b) ** 2 * 100 >= 49 * sq[a] * sq[b])
    assert temporal.merged(df.limit(0), (7, 10)).count() == 0


def test_long_lists_are_split_without_loss_and_not_compared_as_a_whole(spark, monkeypatch):
    r = random.Random(8)
    syllables = ["en", "er", "ti", "on", "th", "le", "ea", "nd", "enen", "a"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    names = sorted({f"{word()} qz{word()}" for _ in range(1400)} | {"qz" + x * k for x in ("en", "aa", "thle") for k in range(1, 9)} | {"e qz", "qz e"})
    row, gram, count, _ = temporal.trigrams(names)
    code = np.unique(gram, return_inverse=True)[1]
    m = np.zeros((len(names), code.max() + 1), np.int64)
    m[row, code] = count
    dot, norm = m @ m.T, (m * m).sum(1)
    a, b = np.nonzero(np.triu(dot**2 * 100 >= norm[:, None] * norm * 49, 1))
    want = {(names[i], names[j]) for i, j in zip(a, b, strict=True)}
    df = spark.createDataFrame([("k", x) for x in names], "kind string, name string")
    for long, block in ((200, 3), (1 << 17, 20)):  # split by Spark, again and again; in arrays
        monkeypatch.setattr(temporal, "LONG", long)
        monkeypatch.setattr(temporal, "BLOCK", block)
        assert {(x["a"], x["b"]) for x in temporal.similar(df, (7, 10)).collect()} == want and len(want) > 500
    n, every = len(names), np.arange(len(names))
    lists = temporal._split(every * 0, every, every * 0, every * 0, every >= 0, np.bincount(row), code, count.astype(np.int64), norm, (m > 1).any(1), 7, 10, 20)
    met, compared = set(), 0
    for own, strong, sizes in lists:
        for x, s in zip(np.split(own, np.cumsum(sizes)[:-1]), np.split(strong, np.cumsum(sizes)[:-1]), strict=True):
            some = x[s]
            compared += len(some) * len(x)
            met |= {(min(i, j), max(i, j)) for i in some.tolist() for j in x.tolist() if i != j}
    assert met >= set(zip(a.tolist(), b.tolist(), strict=True)) and len(met) < n * (n - 1) / 2 / 3


def test_planted_duplicates_merge_and_intervals_join(spark):
    day = lambda n: datetime.date(1700, 1, 1) + datetime.timedelta(n)
    rows = [("Wellington", "P", "trades with", "Liverpool", "T", day(0), day(4)), ("Wellingtons", "P", "trade with", "Liverpool", "T", day(5), day(9)), ("Wellington", "P", "trades with", "Liverpool", "T", day(20), None), ("Wellington", "P", "trades with", "Liverpool", "T", day(30), day(31)), ("Oslo", "P", "trades with", "Wellington", "P", day(11), day(12)), ("Wellington", "T", "trades with", "Wellingtons", "T", day(1), day(1)), ("Wellington", "P", "trades with", "Liverpool", "T", day(15), day(13))]
    facts = spark.createDataFrame(rows, "subject string, subject_kind string, relation string, object string, object_kind string, valid_from date, valid_to date")
    nodes, edges = temporal.build(facts)
    roots = {(r["kind"], r["name"]): r["root"] for r in nodes.collect()}
    assert roots["P", "Wellingtons"] == "Wellington" and roots["P", "Oslo"] == "Oslo" and roots["T", "Liverpool"] == "Liverpool"
    got = sorted((r["source"], r["relation"], r["valid_from"], r["valid_to"], r["n_facts"]) for r in edges.filter("target = 't__Liverpool'").collect())
    assert got == [("p__Wellington", "trades with", day(0), day(9), 2), ("p__Wellington", "trades with", day(15), day(13), 1), ("p__Wellington", "trades with", day(20), None, 2)]
    assert [r["source"] for r in temporal.as_of(edges, "1700-01-12").collect()] == ["p__Oslo"]


def test_intervals_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), datetime.date(1700, 1, 1) + datetime.timedelta(s), datetime.date(1700, 1, 1) + datetime.timedelta(s + r.randint(0, 6))) for s in (r.randint(0, 200) for _ in range(60))]
    got = sorted(tuple(x) for x in temporal.coalesced(spark.createDataFrame(rows, "k string, valid_from date, valid_to date"), ["k"]).collect())
    want = []
    for k in "ab":
        held = {d for key, s, e in rows if key == k for d in range(s.toordinal(), e.toordinal() + 1)}
        starts = sorted(d for d in held if d - 1 not in held)
        for s in starts:
            e = s
            while e + 1 in held:
                e += 1
            want.append((k, datetime.date.fromordinal(s), datetime.date.fromordinal(e), sum(key == k and s <= a.toordinal() <= e for key, a, _ in rows)))
    assert got == sorted(want)


def test_clustered_vectors_are_found_in_few_lists(spark, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24))
    x = np.concatenate([c + 0.15 * r.normal(size=(50, 24)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[7].tolist()), (5001, (2 * x[7]).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    path, quantiser = str(tmp_path / "index"), vector_index.train(vectors, 32)
    vector_index.build(vectors, quantiser, path)
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    ids = [i for i, _ in rows]
    truth = {(q, ids[j], i + 1) for q in range(7, 2000, 100) for i, j in enumerate(sorted(range(len(ids)), key=lambda j: (-round(float(unit[j] @ unit[q]), 6), ids[j]))[:5])}
    exact = vector_index.search(spark, path, quantiser, asked, 5, probes=1, exact=True, block_bytes=800)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in exact.collect()} == truth
    near = vector_index.search(spark, path, quantiser, asked, 5, probes=4)
    assert vector_index.recall(near, spark.createDataFrame(list(truth), "query_id long, vec_id long, rank int")) >= 0.95
    assert near.filter("query_id = 7 and vec_id in (7, 5000, 5001)").count() == 3


def test_vectors_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    quantiser = vector_index.train(none, 4)
    vector_index.build(none, quantiser, str(tmp_path / "index"))
    assert vector_index.search(spark, str(tmp_path / "index"), quantiser, none.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_postings_give_what_a_scan_gives_and_read_only_their_folders(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices("red green blue Grün 42".split(), k=3)), None if i % 3 else "label red", " ".join(r.choices("red green blue sea sky".split(), k=r.randint(0, 30)))) for i in range(80)]
    nodes, path = spark.createDataFrame(rows, "id long, name string, wd_label string, description string"), str(tmp_path / "postings")
    text_index.build(nodes, path)
    for phrase in ("red green", "RED, red", "grün", "sea sky sea", "absent red"):
        ws = phrase.lower().replace(",", "").split()
        want = {(i, f): n for i, *texts in rows for f, t in zip(text_index.COLUMNS, texts, strict=True) for own in [(t or "").lower().split()] if (n := sum(own[k : k + len(ws)] == ws for k in range(len(own))))}
        assert {(x["id"], x["field"]): x["n"] for x in text_index.phrase(spark, path, phrase).collect()} == want
    asked = spark.createDataFrame([(1, "Sea sea sky"), (2, "nothing here")], "query_id long, text string")
    found = text_index.search(spark, path, asked, k=100)
    assert {x["id"] for x in found.collect()} == {i for i, *texts in rows if any({"sea", "sky"} & set((t or "").lower().split()) for t in texts)}
    wide = text_index.search(spark, path, asked, k=100, fewest=0)  # by join
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, found.collect()))
    plan = text_index._postings(spark, path, ["sea"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "word" in plan.split("PushedFilters")[1]


def _stages(fail):
    def links(df):
        if fail and fail.pop():
            raise ValueError("killed")
        return df.select("doc_id", F.upper("word").alias("word"))

    return [
        chain.Stage("words", lambda df: df.select("doc_id", F.explode(F.split("text", " ")).alias("word")), "doc_id long, word string"),
        chain.Stage("links", links, "doc_id long, word string"),
        chain.Stage("relations", lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id long, n long"),
    ]


def test_stages_stop_in_order_and_a_killed_one_resumes(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), str(tmp_path / "stages"), "doc_id long, text string"
    for k in range(3):
        spark.createDataFrame([(k, "a b c")], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="killed"):
        chain.run(ingest.arrivals(spark, src, schema, 1), _stages([True]), root, lambda: True, poll=0.1)
    assert not writers.there(spark, f"{root}/links.sentinel") and not writers.there(spark, f"{root}/relations.sentinel")
    spark.createDataFrame([(3, "d")], schema).coalesce(1).write.mode("append").parquet(src + "2")  # a later arrival isn't in this source
    assert chain.run(ingest.arrivals(spark, src, schema, 1), _stages([]), root, lambda: True, poll=0.1) == ["words", "links", "relations"]
    found = chain.rows(spark, root, _stages([])[1]).collect()
    assert sorted((r["doc_id"], r["word"]) for r in found) == [(k, w) for k in range(3) for w in "ABC"]
    assert sorted(map(tuple, chain.rows(spark, root, _stages([])[2]).collect())) == [(k, 3) for k in range(3)]
    assert chain.run(ingest.arrivals(spark, src, schema, 1), _stages([True]), root, lambda: True, poll=0.1) == ["words", "links", "relations"]  # all done: nothing runs


def test_state_holds_what_another_checkpoint_took(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id long, text string"
    for k, cp in enumerate("aab"):
        spark.createDataFrame([(k, "new"), (0, "again"), (None, "x")], schema).coalesce(1).write.mode("append").parquet(src)
        ingest.process_once(ingest.arrivals(spark, src, schema, 1), "doc_id", lambda df: df, out, str(tmp_path / cp))
    rows = spark.read.parquet(out).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows) == [-1, 0, 1, 2]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_watch_counts_more_batches_than_are_remembered(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(0, 110, 1, 110).withColumnRenamed("id", "doc_id").write.parquet(src)
    seen = []
    assert ingest.watch(ingest.arrivals(spark, src, "doc_id long", 1), lambda df, epoch: seen.append(epoch), str(tmp_path / "cp"), lambda: True, poll=0.01) == 110
    assert len(set(seen)) > 100


def test_exact_quantiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    groups = {"flat": r.random(3000), "skewed": np.exp(8 * r.normal(size=2001)), "ties": r.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 5e-324])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("flat", None), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    for bins, few in ((64, 3), (1024, 4096)):
        got = {(x["g"], x["share"]): x["quantile"] for x in quantiles.exact_quantiles(df, ["g"], "v", shares, bins, few).collect()}
        want = {(x["g"], s): x["q"][i] for x in df.groupBy("g").agg(F.percentile("v", list(shares)).alias("q")).collect() if x["q"] for i, s in enumerate(shares)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
        picks = {x["g"]: (x["n"], x["median"], x["p95"]) for x in quantiles.rank_picks(df, ["g"], "v", {"median": lambda n: F.floor(n / 2), "p95": lambda n: F.floor(n * 0.95)}, bins, few).collect()}
        assert {g: (len(x), sorted(x)[len(x) // 2], sorted(x)[int(len(x) * 0.95)]) for g, x in groups.items()} == {g: v for g, v in picks.items() if g}


def test_summaries_are_the_same_by_refined_medians(spark):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.random(), float(r.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "system string, cer double, wer double")
    one, two = (sorted(map(str, ocr.summary(df, ["system"], ["cer", "wer"], ["wer"], at_once=n).collect())) for n in (10**6, 0))
    assert one == two and len(one) == 3


def test_sweep_equals_pairs(spark):
    r = random.Random(7)
    span = lambda i, far: (r.choice([1, 2, None]), r.choice(["x", "y", None]), s := r.randint(0, 300), s + r.choice([0, 1, 5, far]))
    gold, pred = [span(i, 200) for i in range(150)], [span(i, 9) for i in range(40)]
    schema = "doc_id long, label string, start long, end long"
    got = collections.Counter((x["doc_id"], x["label"], x["start"], x["end"], x["hit"]) for x in ner_eval.hit_spans(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).collect())
    assert got == collections.Counter((*g, any(None not in g[:2] and g[:2] == p[:2] and p[2] < g[3] and g[2] < p[3] for p in pred)) for g in gold)


def test_sweep_of_a_hundred_thousand_overlapping_spans(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("label"), F.lit(0).cast("long").alias("start"), (F.col("id") + 1).alias("end"))
    assert ner_eval.span_scores(spans, spans, overlap=True).first()["tp"] == 100_000


def test_versions_appear_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "graph")
    n = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    e = lambda *pairs: spark.createDataFrame(list(pairs), "source long, target long, type string")
    assert versions.read(spark, path, "nodes") is None
    assert versions.load_graph(spark, path, n(1, 2, 2), e((1, 2, "T"), (1, 3, "T"))) == 0
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            versions.load_graph(spark, path, n(3), e((1, 3, "T")))
    assert versions.read(spark, path, "nodes").count() == 2 and versions.read(spark, path, "edges").count() == 1
    before = versions.manifest(spark, path)["tables"]["nodes"]["folders"]
    assert versions.load_graph(spark, path, n(3), e((1, 3, "T"), (1, 2, "T"))) == 1
    after = versions.manifest(spark, path)["tables"]["nodes"]["folders"]
    assert sum(before.get(b) != f for b, f in after.items()) == 1  # one bucket was touched
    assert sorted(r["id"] for r in versions.read(spark, path, "nodes").collect()) == [1, 2, 3] and versions.read(spark, path, "edges").count() == 2
    assert versions.read(spark, path, "nodes", version=0).count() == 2
    assert versions.read(spark, path, "nodes", keys=[3]).filter("id = 3").count() == 1
    versions.merge(spark, path, {"nodes": (spark.createDataFrame([(1, "renamed")], "id long, name string"), "id")})
    assert {r["id"]: r["name"] for r in versions.read(spark, path, "nodes").collect()} == {1: "renamed", 2: "n2", 3: "n3"}
    stale = versions.manifest(spark, path)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, stale)


def test_hops_have_one_plan_each(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 100), (100, 0)], "source long, target long")
    got = graph.within_hops(edges, spark.createDataFrame([(0,)], "id long"), 40)
    assert {r["id"]: r["hop"] for r in got.collect()} == {0: 0, 100: 1} | {i: i for i in range(1, 13)}
    assert len(got._jdf.queryExecution().executedPlan().toString().splitlines()) < 8


def _database(path, n):
    import sqlite3

    db = sqlite3.connect(path)
    db.execute("create table items (id integer primary key, title text, price real)")
    db.executemany("insert into items values (?, ?, ?)", [(10 * i, None if i % 5 == 0 else f"t{i % 3}", i / 2) for i in range(n)])
    db.execute("create table bare (id integer)")
    db.commit()
    db.close()


def test_filters_leave_row_ranges_unread(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNull

    from vellum.sources import datasources

    path = str(tmp_path / "b.sqlite")
    _database(path, 1000)
    source = datasources.SqliteTable({"path": path, "table": "items", "rows": "100"})
    reader = source.reader(source.schema())
    assert len(reader.partitions()) == 10
    assert [type(f) for f in reader.pushFilters([GreaterThanOrEqual(("id",), 9500), IsNull(("title",)), EqualTo(("title",), "t1")])] == [IsNull]
    (only,) = reader.partitions()
    assert only.low >= 9500 and {r[1] for r in reader.read(only)} == {"t1"}
    datasources.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("sqlite_table").option("table", "items").option("rows", 100).load(path)
        assert df.count() == 1000 and df.rdd.getNumPartitions() == 10
        few = df.filter("id >= 9500 and title = 't1' and price * 2 > 955")
        assert few.rdd.getNumPartitions() == 1
        assert sorted(r["id"] for r in few.collect()) == [10 * i for i in range(956, 1000) if i % 3 == 1 and i % 5]
        assert df.filter("title is null").count() == 200 and df.filter("id in (10, 20, 11)").count() == 2
        assert spark.read.format("sqlite_table").option("table", "bare").load(path).count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_headings_without_a_file_name_come_off(spark):
    from vellum.sources import readers

    assert readers.one_line_text("# A heading  the body, whole") == "the body, whole"
    assert readers.one_line_text("# x_page_2 the body") == "the body"
    assert readers.one_line_text("# only a heading") == "# only a heading"
    assert readers.one_line_text("# h\nbody") == "body"


def test_uris_turn_with_their_relation(spark):
    rel = spark.createDataFrame([("A", "PERSON", "B", "PERSON", "b", "has_owner", "u1", "u2"), ("A", "PERSON", "B", "PERSON", "a", "has_owner", "u1", "u2")], "entity_a string, type_a string, entity_b string, type_b string, subject string, relation string, uri_a string, uri_b string")
    nodes = spark.createDataFrame([("person__a",), ("person__b",)], "id string")
    assert sorted((r["source"], r["source_uri"], r["target"], r["target_uri"]) for r in graph.typed_edges(rel, nodes).collect()) == [("person__a", "u1", "person__b", "u2"), ("person__b", "u2", "person__a", "u1")]


def test_a_task_that_runs_again_sends_the_same_tokens(spark, tmp_path):
    folder = tmp_path / "sent"
    folder.mkdir()

    def send(records, token):
        (folder / token).write_text(",".join(str(r["id"]) for r in records))  # a token known already is written over: nothing is taken twice
        return len(records)

    df = spark.range(1000).repartition(3).withColumn("x", F.rand())
    for _ in range(2):
        got = writers.push(df, send, 64, key="id").agg(F.sum("sent"), F.sum("taken")).first()
        assert tuple(got) == (1000, 1000)
    assert sorted(int(i) for p in folder.iterdir() for i in p.read_text().split(",")) == list(range(1000))


def test_cooccurrence_in_many_cells(spark):
    r = random.Random(5)
    names = [a + b for a in "AbcÉ" for b in "wxyz"]
    rows = [(d, o, r.choice(names), r.choice(["PERSON", "TOPONYM", "COMMODITY"])) for d in range(40) for o in r.sample(range(500), r.randint(1, 14))]
    m = spark.createDataFrame(rows, "doc_id long, ord long, text string, type string")
    by: dict = {}
    for x in sorted((x.doc_id, x.ord, x.id, x.type) for x in graph.with_ids(m).collect()):
        by.setdefault(x[0], []).append(x[1:])
    want: dict = {}
    for d, xs in by.items():
        for k, (_, a, s) in enumerate(xs):
            for _, b, t in xs[k + 1 :]:
                w = want.setdefault((min(a, b), max(a, b)), [0, f"{s}-{t}", []])
                w[0] += 1
                if d not in w[2] and len(w[2]) < 5:
                    w[2].append(d)
    want = {k: (w, t, "|".join(map(str, ds))) for k, (w, t, ds) in want.items()}
    for small in ({"cell": 300, "at_once": 40}, {"cell": 2000, "at_once": 5}, {}):
        got = graph.cooccurrence(m, **small).collect()
        assert {(x["source"], x["target"]): (x["weight"], x["types"], x["docs"]) for x in got} == want and len(got) == len(want)
    docs = {(x["source"], x["target"]): x["weight"] for x in graph.cooccurrence(m, distinct_docs=True, most=3, cell=300).collect()}
    assert docs == {k: sum(k[0] != k[1] and {k[0], k[1]} <= (i := {x[1] for x in xs}) or k[0] == k[1] and [x[1] for x in xs].count(k[0]) > 1 for xs in by.values()) for k in want}
    assert graph.cooccurrence(m.limit(0)).count() == 0


def test_pairs_of_names_are_not_shuffled(spark):
    m = spark.range(300).selectExpr("id div 100 as doc_id", "id as ord", "concat('N', id % 100) as text", "'PERSON' as type")
    df = graph.cooccurrence(m)
    assert df.count() == 4950
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_nearest_by_parts_with_ties_at_the_edge(spark, monkeypatch):
    from vellum.operators import retrieval

    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "PART", 3)
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (120, 3)).astype(float)
    x[~x.any(1)] = 1
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    q = v.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    score = np.round(x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))), 6)
    want = [(i, int(j), n + 1) for i in range(0, 120, 10) for n, j in enumerate(np.lexsort((np.arange(120), -score[i]))[:5])]
    for bytes_ in (64 << 20, 100):
        df = retrieval.top_k(v, q, 5, block_bytes=bytes_)
        assert sorted((g["query_id"], g["vec_id"], g["rank"]) for g in df.collect()) == sorted(want, key=lambda t: (t[0], t[1]))
    assert "NestedLoop" not in retrieval.top_k(v, q)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.top_k(v, q.limit(0)).count() == 0


def test_names_match_as_if_all_pairs_were_scored(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aAbBcé") for _ in range(r.randint(1, 7)))
    names = spark.createDataFrame([(w + r.choice([".md", "_page_001.md", "x.md"]),) for w in {word() for _ in range(150)}], "name string")
    gold = spark.createDataFrame([(w + ".xml",) for w in {word() for _ in range(60)}], "gold_name string")
    n, g = names.select("name", ocr.base_name(F.col("name")).alias("base")), gold.withColumn("gb", F.replace("gold_name", F.lit(".xml"), F.lit("")))
    score = F.when(F.concat("base", F.lit(".xml")) == F.col("gold_name"), 2.0).otherwise(ocr.name_score(F.col("base"), F.col("gb")))
    want = {}
    for x in n.crossJoin(g).select("name", "gold_name", score.alias("s")).collect():
        want[x["name"]] = min(want.get(x["name"], (0, "")), (-x["s"], x["gold_name"]))
    want = {k: (x[1], min(1.0, -x[0])) if -x[0] >= 0.6 else (None, 0.0) for k, x in want.items()}
    found = ocr.match_names(names, gold)
    assert {x["name"]: (x["gold_name"], x["score"]) for x in found.collect()} == want and sum(w[1] > 0 for w in want.values()) > 20
    alike = spark.range(400).select(F.format_string("customer%06d.md", "id").alias("name"))
    golds = spark.range(400, 800).select(F.format_string("customer%06d.xml", "id").alias("gold_name"))
    assert {x["gold_name"] for x in ocr.match_names(alike, golds).filter("name = 'customer000007.md'").collect()} == {"customer000400.xml"}


def test_extremes_are_ranked_without_sorting_a_system(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.randint(0, 9) / 4, i, i % 3) for i in range(300)] + [("c", 1.0, 7, 7)]
    df = spark.createDataFrame(rows, "system string, cer double, doc_id long, line_no long")
    want = {}
    for s in "abc":
        own = [x for x in rows if x[0] == s]
        for name, key in (("best", lambda x: (x[1], x[2], x[3])), ("worst", lambda x: (-x[1], x[2], x[3]))):
            for n, x in enumerate(sorted(own, key=key)):
                want.setdefault(x, {})[name] = n + 1
    want = {(*x, w["best"], w["worst"]) for x, w in want.items() if min(w.values()) <= 3}
    out = ocr.extremes(df, "system", "cer", ["doc_id", "line_no"], 3)
    got = [tuple(x) for x in out.select("system", "cer", "doc_id", "line_no", "best", "worst").collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_best_texts_of_blocks_without_a_row_a_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "QUERIES", 3)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(i, r.choice(vocabulary), None, " ".join(r.choices(vocabulary, k=r.randint(0, 12)))) for i in range(200)] + [(900 + i, "w0", None, "w1 w2") for i in range(40)]
    nodes = spark.createDataFrame(rows, "id long, name string, wd_label string, description string").repartition(5)
    text_index.build(nodes, str(tmp_path / "i"))
    words = {(f, i): (t or "").split() for i, *texts in rows for f, t in zip(text_index.COLUMNS, texts, strict=True)}
    mean = {f: sum(len(w) for (g, _), w in words.items() if g == f) / len(rows) for f in text_index.COLUMNS}
    df = {(f, w): sum(g == f and w in own for (g, _), own in words.items()) for f in text_index.COLUMNS for w in vocabulary}
    asked = [(i, " ".join(r.choices(vocabulary, k=3))) for i in range(12)] + [(50, "w1 W0"), (51, "w0, w1"), (52, "")]
    want = set()
    for q, text in asked:
        scores = {}
        for w in set(text.lower().replace(",", "").split()):
            for (f, i), own in words.items():
                if tf := own.count(w):
                    n, m = len(rows), df[f, w]
                    scores[i] = scores.get(i, 0) + np.log1p((n - m + 0.5) / (m + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean[f]))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:4]
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    found = text_index.search(spark, str(tmp_path / "i"), spark.createDataFrame(asked, "query_id long, text string"), k=4)
    assert {(x["query_id"], x["id"], round(x["score"], 6), x["rank"]) for x in found.collect()} == want
    assert "askers" in found._jdf.queryExecution().executedPlan().toString()  # queries come to a block's postings as lists


def test_entities_are_merged_without_relations_and_facts_without_a_shuffle(spark, tmp_path, monkeypatch):
    from vellum.plans import indexes

    texts = [(7, "Anna sold red cloth Bert and Cara"), (8, "Dora"), (9, None), (10, "no name"), (11, "Éa Ünn Oda gives Pia"), (12, "Xa of the Ya")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = indexes.facts(spark, str(tmp_path))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["subject"], r["relation"], r["object"], str(r["valid_from"]), r["valid_to"] is None) for r in rows.collect()}
    assert got == {("Annas", "sold red", "Berts", "1700-01-08", False), ("Berts", "and", "Caras", "1700-01-08", False), ("Oda", "gives", "Pia", "1700-01-12", True), ("Xa", "of the", "Ya", "1700-01-13", False)}
    asked, merged = [], temporal.merged
    monkeypatch.setattr(temporal, "merged", lambda names, least: asked.append(least) or merged(names, least))
    assert {r["name"] for r in indexes.QUERIES["temporal_entities"](spark, str(tmp_path)).collect()} == {"Annas", "Berts", "Caras", "Oda", "Pia", "Xa", "Ya"}
    assert asked == [temporal.ENTITIES]


def test_openings_match_as_if_all_pairs_were_looked_at(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 8)))
    file_names = [w + r.choice([".md", "_page_001.md", ".mdb.md", "", "a"]) for w in (word() for _ in range(80))] + [None]
    golds = [word() for _ in range(150)] + ["ab" * 5, None]
    base = lambda n: n.replace("_page_001.md", "").replace(".md", "")
    for names in (file_names, [n for n in file_names if n and len(n) > 7]):
        holds = lambda g, n: g.startswith(base(n)) or base(n).startswith(g) or g[:4] in n or n[:4] in g
        want = {g: min((n for n in names if n is not None and g is not None and holds(g, n)), default=None) for g in golds}
        found = ocr.match_by_opening(spark.createDataFrame([(g,) for g in golds], "gold_name string"), spark.createDataFrame([(n,) for n in names], "file_name string"), length=4)
        assert {x["gold_name"]: x["file_name"] for x in found.collect()} == want
    assert "Contains" not in found._jdf.queryExecution().executedPlan().toString()  # names that begin alike aren't paired


def test_regions_are_rejoined_in_batches(spark):
    from vellum.functions import kernels

    r = random.Random(4)
    line = lambda: " ".join(r.choice(["im-", "porter", "consi", "der", "it", "Of,", "sur", "prise"]) for _ in range(r.randint(0, 3)))
    rows = [(d, i, line()) for d in range(300) for i in range(r.randint(1, 6))]
    words = ["importer", "Consider", "surprise", "of", "porter"]
    out = ocr.rejoin_lines(spark.createDataFrame(r.sample(rows, len(rows)), "region long, line_no int, line string"), spark.createDataFrame([(w,) for w in words], "word string"))
    want = set()
    for d in range(300):
        fixed, n = kernels.rejoin([x[2] for x in rows if x[0] == d], {"", *(w.lower() for w in words)})
        want |= {(d, i, text, n) for i, text in enumerate(fixed)}
    assert {tuple(x) for x in out.collect()} == want and any(x[3] for x in want) and out.columns == ["region", "line_no", "line", "repairs"]
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no batch of its own for each region


def test_pages_are_scored_without_a_row_for_a_word(spark):
    rows = [(i, f"s{i % 3}", 1700 + i % 3, t, t.replace("a", "o"), t, t) for i, t in enumerate(["a cat sat 12", "land 4 ahoy", "", "no cat", " the\tmat "] * 4)]
    pairs = spark.createDataFrame(rows, "doc_id long, system string, year int, ref string, hyp string, ref_raw string, hyp_raw string")
    lexicon = spark.createDataFrame([("Cot",), ("ohoy",), (None,), ("lond",)], "word string")
    few, many = (ocr.scored_pages(pairs, lexicon, ["doc_id"], most=m) for m in (3, 2))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(str, few.select(sorted(few.columns)).collect())) == sorted(map(str, many.select(sorted(few.columns)).collect()))
    assert few.agg(F.sum("hallucinated_words")).first()[0] == 12 + 4  # cot twice, ohoy, lond
    plain, refined = (sorted(map(str, ocr.full_summary(few, ["system"], at_once=n).collect())) for n in (1000, 1))
    assert plain == refined
    plain, refined = (sorted(map(str, ocr.age_summary(few, at_once=n).collect())) for n in (1000, 1))
    assert plain == refined


def test_totals_take_no_median(spark, monkeypatch):
    monkeypatch.setattr(ocr.storage, "kept", None)
    monkeypatch.setattr(ocr.quantiles, "medians", None)
    pairs = spark.createDataFrame([("s", "cat 5", "cot 5"), ("s", "mat", "mat")], "system string, ref string, hyp string")
    only = ["n", "total_words", "total_numbers_total", "mean_char_accuracy", "char_substitutions_pct"]
    got = ocr.full_summary(ocr.with_metrics(pairs, parts=("char", "numbers")), ["system"], at_once=1, only=only).collect()
    assert [tuple(r) for r in got] == [("s", 2, 3, 1, 0.9, 100.0)]


def test_cells_of_names_are_read_and_not_shuffled(spark):
    m = spark.range(3000).selectExpr("id div 100 as doc_id", "id as ord", "concat('N', id % 100) as text", "'PERSON' as type")
    df = graph.cooccurrence(m, cell=5_000)  # of 151,500 pairs
    assert df.rdd.getNumPartitions() == 2 + 8 * 9 // 2  # a task for each cell of eight buckets
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 4950 and df.agg(F.sum("weight")).first()[0] == 30 * 4950


def test_top_pairs_are_those_of_all_pairs(spark):
    r = random.Random(8)
    rows = [(d, o, f"N{int(r.random() ** 3 * 40)}", "PERSON") for d in range(60) for o in range(r.randint(1, 12))]
    rows += [(d, 90 + o, "Self", "ORGANIZATION") for d in (3, 4) for o in range(9)] + [(None, 1, "Lost", "PERSON"), (70, 1, " ", "PERSON")]
    m = spark.createDataFrame(rows, "doc_id long, ord long, text string, type string")
    for k in (1, 10, 5000):
        want = [tuple(x) for x in graph.top(graph.cooccurrence(m), "weight", k, "source", "target").select("source", "target", "weight").collect()]
        for few, seen in ((1024, 64), (1024, 3), (2, 8)):
            assert [tuple(x) for x in graph.top_pairs(m, k, few, seen).collect()] == want
    assert graph.top_pairs(m.limit(0), 3).count() == 0


def test_a_key_is_taken_once_by_its_first_row(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id long, text string"
    rows = [(k, f"{k % 7}{x}") for k in range(4000) for x in ("b", "a")[: 1 + (k % 5 == 0)]]
    spark.createDataFrame([*rows, (None, "z"), (None, "y")], schema).coalesce(1).write.parquet(src)
    began = time.time()
    ingest.process_once(ingest.arrivals(spark, src, schema, 1), "doc_id", lambda df: df, out, str(tmp_path / "a"))
    spark.createDataFrame([(5, "0"), (-5, "new")], schema).coalesce(1).write.mode("append").parquet(src)
    for cp in "ab":
        ingest.process_once(ingest.arrivals(spark, src, schema, 1), "doc_id", lambda df: df, out, str(tmp_path / cp))
    got = spark.read.parquet(out)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(k, f"{k % 7}{'a' if k % 5 == 0 else 'b'}") for k in range(4000)} | {(None, "y"), (-5, "new")}
    assert got.count() == 4002
    assert time.time() - began < 40  # a key at a time took minutes
