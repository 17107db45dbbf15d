import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import graph, ledger, ner, ner_eval, ocr, retrieval


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, f, want",
    [
        ("  The  Big\xa0Page ", X.normalize, "the big page"),
        ("The East-India  Company", X.ner_normalize, "east india company"),
        (" St. Kitts ", X.sanitize_id, "st__kitts"),
        ("Ælf é", X.sanitize_id, "ælf_é"),
        ("x 1499 y", lambda c: X.year(c, "title"), None),
        ("x 1499 y", lambda c: X.year(c, "dated"), 1499),
        ("Barbadoes", lambda c: X.spelling(c, F.lit("TOPONYM")), "Barbados"),
        ("Capt. Cole", lambda c: X.spelling(c, F.lit("PERSON")), "Captain Cole"),
        ("n/a", X.relation_of, None),
        ("", lambda c: F.size(X.words(c)), 0),
        ("see Q42 (Douglas Adams)", lambda c: X.authority(c)["id"], "Q42"),
        ("$1,234.56 and 45.6%", lambda c: F.array_join(X.number_groups(c), "|"), "$1,234.56|45.6%"),
        ("---\na: b\n---\nbody", X.without_front_matter, "body"),
        ("abcdefghij", lambda c: F.array_join(retrieval.fixed_chunks(c, 4, 1), ","), "abcd,defg,ghij,j"),
        ("1696-1697 ledger", lambda c: X.year_range(c)["end"], 1697),
    ],
)
def test_scalars(spark, value, f, want):
    assert one(spark, value, f) == want


def test_age_group(spark):
    assert [one(spark, y, X.age_group, "int") for y in (1675, 1700, None)] == ["1675-1699", "1700-1724", None]


def test_names(spark):
    names = spark.createDataFrame([("abc_page_001.md",), ("abcd",), ("abcdX",), ("zzz",)], "name string")
    got = {r["name"]: (r["gold_name"], round(r["score"], 3)) for r in ocr.match_names(names, spark.createDataFrame([("abc.xml",), ("abcdefghij.xml",), ("abcdY.xml",)], "gold_name string")).collect()}
    assert got == {"abc_page_001.md": ("abc.xml", 1.0), "abcd": ("abcdY.xml", 0.8), "abcdX": ("abcdY.xml", 0.8), "zzz": (None, 0.0)}


def test_word_budget(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate((3000, 1500, 1000, 500))], "s string, i int, n long")
    assert ocr.word_budget(df, ["s"], ["i"], "n", 5000).agg(F.sum("n")).first()[0] == 5500


def test_summary(spark):
    r = ocr.summary(spark.createDataFrame([("a", 0.0), ("a", 1.0)], "s string, cer double"), ["s"], ["cer"]).first()
    assert (r["median_cer"], r["std_cer"]) == (0.5, 0.5)


def test_cascade(spark):
    rows = [("d", 0, "New-England", "TOPONYM"), ("d", 1, "New England Smith", "PERSON"), ("d", 2, "England", "ORGANIZATION"), ("d", 3, "england", "COMMODITY")]
    got = ner.cascade(spark.createDataFrame(rows, "doc_id string, ord int, text string, type string")).first()["entities"]
    assert [e["text"] for e in got] == ["New-England", "New England Smith"]


def test_grounded(spark):
    e = spark.createDataFrame([("d", "new england"), ("d", "boston"), ("d", "")], "doc_id string, text string")
    assert [r["text"] for r in ner.grounded(e, spark.createDataFrame([("d", "In New-England they")], "doc_id string, text string")).collect()] == ["new england"]


def test_grounded_reads_a_document_once(spark):
    e = spark.createDataFrame([("d", 1, "new england"), ("d", 2, None), ("d", 3, " Old  "), ("d", 4, "a b"), ("x", 5, "old"), (None, 6, "old"), ("d", 1, "new england")], "doc_id string, ord int, text string")
    docs = spark.createDataFrame([("d", "New-England, OLD a-b"), ("x", None)], "doc_id string, text string")
    out = ner.grounded(e, docs)
    assert sorted(map(tuple, out.collect())) == [("d", 1, "new england")] * 2 + [("d", 3, " Old  "), ("d", 4, "a b")] and out.columns == e.columns
    assert "collect_list" in out._jdf.queryExecution().executedPlan().toString()


def test_extract_and_link(spark):
    docs = spark.createDataFrame([("d", "a b")], "doc_id string, text string")
    found = ner.extract(docs, lambda t: [{"text": w, "type": "TOPONYM"} for w in t.split()])
    cache = spark.createDataFrame([("a", "TOPONYM", "Q1")], "norm string, type string, authority string")
    got = {r["text"]: r["authority"] for r in ner.link(found, cache, lambda n, t: "Q2").collect()}
    assert got == {"a": "Q1", "b": "Q2"}


def test_spans(spark):
    s = "doc_id string, start int, end int, label string"
    r = ner_eval.span_scores(spark.createDataFrame([("d", 0, 10, "T")], s), spark.createDataFrame([("d", 0, 4, "T"), ("d", 5, 9, "T")], s), overlap=True).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 0)


def test_alignment_scores(spark):
    s = "doc_id string, text string, label string"
    gold = spark.createDataFrame([("d", "jamaica", "T"), ("d", "sugar", "C")], s)
    pred = spark.createDataFrame([("d", "jamaica", "T"), ("d", "sugar", "T"), ("d", "rum", "C")], s)
    r = ner_eval.slot_errors(ner_eval.alignment(gold, pred)).first()
    assert (r["substitutions"], r["insertions"], r["ser"]) == (1, 1, 1.0)
    f = ner_eval.set_scores(gold, pred, ["doc_id", "text", "label"], []).first()
    assert (f["precision"], f["recall"], f["f1"]) == (0.333333, 0.5, 0.4)


def test_picked_quantiles(spark):
    assert one(spark, [1.0, 2.0, 3.0, 4.0], lambda c: ner_eval.upper_median(c)["median"], "array<double>") == 3.0
    assert one(spark, [float(i) for i in range(20)], lambda c: ner_eval.upper_median(c)["p95"], "array<double>") == 19.0


def test_cooccurrence_counts_mentions(spark):
    m = spark.createDataFrame([("d", 0, "Sugar", "COMMODITY"), ("d", 1, "sugar", "COMMODITY"), ("d", 2, "Jamaica", "TOPONYM")], "doc_id string, ord int, text string, type string")
    got = {(r["source"], r["target"]): (r["weight"], r["docs"]) for r in graph.cooccurrence(m).collect()}
    assert got == {("commodity__sugar", "commodity__sugar"): (1, "d"), ("commodity__sugar", "location__jamaica"): (2, "d")}


def test_close_pairs(spark):
    text = "Sugar from Jamaica and rum"
    m = spark.createDataFrame([(1, "Sugar", "C", 0, 5), (1, "Jamaica", "T", 11, 18)], "doc_id long, text string, type string, start int, end int")
    pairs = graph.close_pairs(m)
    assert pairs.first()["distance"] == 6 and graph.close_pairs(m, window=6).count() == 0
    assert graph.evidence(pairs, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["evidence"] == text


def test_close_pairs_over_two_stretches(spark):
    rows = [(1, "Zoe", "P", 496, 499), (1, "Adam", "P", 998, 1003), (2, "Zoe" * 700, "P", 10, 2110), (2, "Adam", "P", 2600, 2604), (3, "Zoe", "P", 499, 502), (3, "Adam", "P", 1002, 1006)]
    m = spark.createDataFrame(rows, "doc_id long, text string, type string, start int, end int")
    assert sorted((r["doc_id"], r["distance"]) for r in graph.close_pairs(m).collect()) == [(1, 499), (2, 490)]


def test_relevance_is_rounded_as_in_sql(spark):
    scores = [0.1235, 0.0625, 0.1875, 0.0005, 0.9995, -0.0625, -0.0001, 1.0, 0.6, 0.8145, 0.2675]
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(scores)], "rank int, doc_id long, score double")
    got = [r["line"] for r in retrieval.context_lines(rows).orderBy("rank").collect()]
    assert got == [f"[{i}] (doc: {i}, relevance: {x:.3f})" for i, x in enumerate(scores)]


def test_any_measure(spark):
    rows = spark.createDataFrame([(1, None, 5.0), (2, 1.0, None)], "i int, ton double, quarter double")
    assert [r["i"] for r in ledger.any_measure(rows, ["ton"]).collect()] == [2]


def test_reuse_and_wins(spark):
    rows = [("s", i, i % 22) for i in range(31)] + [("s", i, 0) for i in range(14)]
    r = retrieval.reuse(spark.createDataFrame(rows, "system string, chunk_id int, doc_id int"), "system").first()
    assert r["reuse_pct"] == 31.1111
    w = retrieval.win_rates(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 1)], "question int, system string, score int")).collect()
    assert {x["system"]: (x["wins"], x["games"]) for x in w} == {"a": (1, 1), "b": (0, 1)}


def test_chat_example(spark):
    m = [("user", "x TEXT: hello"), ("assistant", json.dumps([{"text": "h", "type": "PERSON"}]))]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    text, entities = ner.chat_example(F.col("m"))
    r = df.select(text.alias("t"), entities.alias("e")).first()
    assert r["t"] == "hello" and r["e"][0]["text"] == "h"


def test_functions_in_sql(spark):
    from vellum.functions import udfs

    udfs.register(spark)
    assert spark.sql("SELECT edit_counts('kitten', 'sitting').distance AS d").first()["d"] == 3
    long = "word " * 800
    assert spark.sql(f"SELECT c.chunk_idx FROM (SELECT '{long}' AS t), LATERAL sentence_chunk_rows(t) c").count() == 3
    assert spark.sql("SELECT entity_text('The Rum.') AS t").first()["t"] == "the rum"


def test_capitals_are_those_of_the_raw_text(spark):
    from vellum.operators import ocr

    rows = [("the king of spain", "the king of spain", "The King of Spain", "The king of Spain"), ("a b", "a b", "a b", "a b"), ("london town", "londen town", "London Town", "LONDON Town")]
    df = spark.createDataFrame(rows, "ref string, hyp string, ref_raw string, hyp_raw string")
    got = [tuple(r["capitalized"]) for r in ocr.with_metrics(df).collect()]
    assert got == [(0.5, 2, 1), (1.0, 0, 0), (1.0, 2, 0)]
    assert ocr.with_metrics(df.drop("ref_raw", "hyp_raw")).first()["capitalized"]["total"] == 0


def test_names_match_by_containment(spark):
    from vellum.operators import ocr

    long = "x" * 60
    gold = spark.createDataFrame([("Letters of a Planter",), (long + "gold",), ("Sugar",), ("None of these",), ("ab",)], "gold_name string")
    files = spark.createDataFrame([("The Letters of a Planter, 1701.md",), (long + "file_page_001.md",), ("Sug_page_001.md",), ("zz ab zz.md",)], "file_name string")
    got = {r["gold_name"]: r["file_name"] for r in ocr.match_by_opening(gold, files).collect()}
    assert got == {"Letters of a Planter": "The Letters of a Planter, 1701.md", long + "gold": long + "file_page_001.md", "Sugar": "Sug_page_001.md", "None of these": None, "ab": "zz ab zz.md"}


def test_cooccurrence_counts_pairs_of_mentions(spark):
    from vellum.operators import graph

    kinds = "doc_id long, ord long, text string, type string"
    rows = [(d, i, t, "PERSON") for d in range(8) for i, t in enumerate(["A", "B", "A", "B", "B"])]
    got = {(r["source"], r["target"]): (r["weight"], r["types"], r["docs"]) for r in graph.cooccurrence(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(f"person__{a}", f"person__{b}"): (8 * n, "PERSON-PERSON", "0|1|2|3|4") for a, b, n in (("a", "b", 6), ("a", "a", 1), ("b", "b", 3))}


def test_rejoin_lines_with_a_lexicon_table(spark):
    from vellum.operators import ocr

    rows = [(1, 0, "of Im-"), (1, 1, "porter of consi"), (1, 2, "der it"), (2, 0, "Im-"), (2, 1, "possible"), (3, 0, "alone")]
    lines = spark.createDataFrame(rows, "region long, line_no int, line string")
    lexicon = spark.createDataFrame([("importer",), ("Consider",)], "word string")
    got = {(r["region"], r["line_no"]): r["line"] for r in ocr.rejoin_lines(lines, lexicon).collect()}
    assert got == {(1, 0): "of Importer", (1, 1): "of consider", (1, 2): "it", (2, 0): "Im-", (2, 1): "possible", (3, 0): "alone"}
    assert {r["line"] for r in ocr.rejoin_lines(lines.filter("region = 2"), None).collect()} == {"Impossible", ""}


def test_rounds_with_an_authority():
    from vellum.operators import agents

    said = []

    def chat(talk):
        said.append(len(talk))
        if len(talk) == 2:
            return {"tool_calls": [{"function": {"name": "search_items", "arguments": '{"query": "x"}'}}, {"function": {"name": "other", "arguments": {}}}]}
        if len(talk) == 5:
            assert [m["content"] for m in talk[-2:]] == ['["Q1"]', "ERROR: no tool other"]
            return {"content": "the first one, I think"}
        assert talk[-1]["role"] == "user"
        return {"tool_calls": [{"function": {"name": "submit_result", "arguments": {"qid": "Q1", "label": "L", "confidence": 0.8}}}]}

    tools = {"search_items": lambda query: ["Q1"]}
    assert agents.resolve("x", "PERSON", chat, tools) == {"authority": "Q1", "label": "L", "confidence": 0.8, "linked": True} and said == [2, 5, 7]
    none = {"authority": None, "label": None, "confidence": 0.0, "linked": False}
    assert agents.resolve("x", "PERSON", lambda talk: None, tools) == none
    calls = []
    assert agents.resolve("x", "PERSON", lambda talk: calls.append(1) or {"content": "hm"}, tools) == none and len(calls) == 4
    submit = lambda given: lambda talk: {"tool_calls": [{"function": {"name": "submit_result", "arguments": given}}]}
    for given in ({"qid": "", "confidence": 0}, {"qid": "Q5", "label": "L", "confidence": 0}, {"qid": "Q5"}, "no json", {"qid": "Q5", "confidence": "high"}, [1]):
        assert agents.resolve("x", "PERSON", submit(given), tools) == none
    assert agents.resolve("x", "PERSON", submit({"qid": " Q5 ", "label": "L", "confidence": 3}), tools) == {"authority": "Q5", "label": "L", "confidence": 1.0, "linked": True}


def test_replies_in_prose_are_read_before_the_reminder():
    from vellum.operators import agents

    ask = lambda content: agents.resolve("x", "PERSON", lambda talk: {"content": content}, {})
    assert ask('{"qid": "Q7", "label": "Seven", "confidence": 0.4}') == {"authority": "Q7", "label": "Seven", "confidence": 0.4, "linked": True}
    assert ask('{"qid": "", "confidence": 0.9}') == agents.NONE
    assert ask("The best match is Q145 (United Kingdom).") == {"authority": "Q145", "label": "United Kingdom", "confidence": 0.7, "linked": True}
    assert ask("It must be Q9, surely") == {"authority": "Q9", "label": None, "confidence": 0.7, "linked": True}
    assert ask("SEQ12 says nothing") == agents.NONE and ask(None) == agents.NONE


def test_link_remembers_what_was_not_found(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def resolver(norm, kind):
        import os

        os.makedirs(asked, exist_ok=True)
        path = os.path.join(asked, norm)
        with open(path, "a") as f:
            f.write("x")
        return None if norm == "nowhere" else f"Q{len(norm)}"

    rows = spark.createDataFrame([("Nowhere", "TOPONYM"), ("Paris", "TOPONYM"), ("paris", "TOPONYM")], "text string, type string")
    for _ in range(3):
        got = ner.link_and_remember(rows, str(tmp_path / "cache"), resolver)
        assert sorted((r["text"], r["authority"], r["linked"]) for r in got.collect()) == [("Nowhere", None, False), ("Paris", "Q5", True), ("paris", "Q5", True)]
    assert {p.name: p.read_text() for p in (tmp_path / "asked").iterdir()} == {"nowhere": "x", "paris": "x"}


def test_whole_summaries_against_the_kernels(spark):
    import numpy as np

    from vellum.functions import kernels
    from vellum.operators import ocr

    rows = [("s", 1700 + 30 * i, a, b, a.title(), b.title(), i) for i, (a, b) in enumerate([("the king of 3 isles", "the kinge of 3 ifles"), ("a b c", "a x b c"), ("one two", "one"), ("12 ships", "12 fhips sailed")])]
    pairs = spark.createDataFrame(rows, "system string, year int, ref string, hyp string, ref_raw string, hyp_raw string, doc_id long")
    lexicon = spark.createDataFrame([("sailed",), ("x",)], "word string")
    scored = ocr.scored_pages(pairs, lexicon, ["doc_id"])
    got = ocr.full_summary(scored, ["system"]).first()
    cer = [kernels.edit_counts(r[2], r[3])[0] / len(r[2]) for r in rows]
    word = [kernels.edit_counts(r[2].split(), r[3].split()) for r in rows]
    wer = [w[0] / len(r[2].split()) for w, r in zip(word, rows, strict=True)]
    bleu = [kernels.bleu(r[2].split(), r[3].split()) for r in rows]
    made = [kernels.hallucinations(r[2].split(), r[3].split(), {"sailed", "x"}) for r in rows]
    for name, x in (("cer", cer), ("wer", wer), ("bleu", bleu), ("hallucination", [m[0] for m in made])):
        for stat, f in (("mean", np.mean), ("median", np.median), ("std", np.std), ("min", np.min), ("max", np.max)):
            assert abs(got[f"{stat}_{name}"] - f(x)) < 1e-5
    assert got["total_word_insertions"] == sum(w[1] for w in word) and got["total_words"] == 12 and got["total_hallucinated_words"] == sum(m[1] for m in made)
    assert abs(got["word_deletions_pct"] - 100 * sum(w[2] for w in word) / sum(w[0] for w in word)) < 1e-5 and abs(got["mean_word_accuracy"] - (1 - np.mean(wer))) < 1e-5
    ages = {r["age_group"]: r for r in ocr.age_summary(scored).collect()}
    assert set(ages) == {"1700-1724", "1725-1749", "1750-1774", "1775-1799"} and abs(ages["1725-1749"]["mean_wer"] - wer[1]) < 1e-5


def test_training_batches_are_padded_and_masked(spark):
    from vellum.operators import ner

    rows = [(i, list(range(1, 2 + i)), i % 3) for i in range(9)]
    got = ner.training_batches(spark.createDataFrame(rows, "id long, ids array<int>, n_prompt int"), 4, most=6).collect()
    assert sorted(r["id"] for r in got) == list(range(9)) and {r["batch"] for r in got} == {0, 1, 2}
    for r in got:
        ids = list(range(1, 2 + r["id"]))[:6]
        width = max(len(x["ids"]) for x in [{"ids": [a for a, m in zip(o["input_ids"], o["attention"], strict=True) if m]} for o in got if o["batch"] == r["batch"]])
        assert r["input_ids"] == ids + [0] * (width - len(ids)) and sum(r["attention"]) == len(ids)
        assert r["labels"] == [-100 if i < r["id"] % 3 else x for i, x in enumerate(ids)] + [-100] * (width - len(ids))
