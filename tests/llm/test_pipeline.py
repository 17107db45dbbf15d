import duckdb
import pytest

import corpus_pipeline
from vellum.llm import chat, common, mixing, quality_rules, secrets, tokens

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = common.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = common.materialize(out, "test")
    assert docs.count() > 0.5 * n
    assert out.count() > 0


@pytest.mark.parametrize("name", ["quality_rules", "mixing", "chat"])
def test_sql(spark, name):
    module = {"quality_rules": quality_rules, "mixing": mixing, "chat": chat}[name]
    query = {"quality_rules": "rule_verdicts", "mixing": "mixed_sizes", "chat": "chat_digests"}[name]
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = getattr(module, query)(spark, SF)
    want = {tuple(r) for r in db.execute(f"select {', '.join(mine.columns)} from ({module.SQL})").fetchall()}
    assert {tuple(r) for r in mine.collect()} == want


def brute_classes(texts: dict) -> dict:
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().split()] for i in range(max(1, len(w) - 4))} if t.split() else {("", t)}
    sets = {i: cut(t) for i, t in texts.items()}
    head = {i: i for i in texts}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_redact(docs: dict) -> dict:
    """docs: text, source and language by id."""
    import re

    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    wide = re.compile(secrets.WIDER, re.A)
    base = {i: [m.span() for m in assign.finditer(t) if len(m[1]) >= 6] + [m.span() for p in (r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}") for m in re.finditer(p, t)] for i, (t, *_) in docs.items()}
    more = {i: [m for m in wide.finditer(t) if not any(a < m.end() and m.start() < b for a, b in base[i])] for i, (t, *_) in docs.items()}
    held: dict = {}
    for i, ms in more.items():
        for m in ms:
            held.setdefault(m[0], set()).add(docs[i][1:])
    out = {}
    live = {v: len({source for source, _ in by}) < 3 and len(by) < 6 for v, by in held.items()}
    for i, (t, *_) in docs.items():
        spans = sorted(base[i] + [m.span() for m in more[i] if live[m[0]]])
        merged: list = []
        for a, b in spans:
            if merged and merged[-1][1] > a:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        out[i] = t
    return out


def test_pipeline_against_brute_force(spark):
    import pandas as pd

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0]: r[1:] for r in db.execute(f"WITH {quality_rules.verdict_sql()} SELECT doc_id, text, source, lang FROM judged WHERE kept").fetchall()}
    classes = brute_classes({i: t for i, (t, *_) in kept.items()})
    kept = {i: v for i, v in kept.items() if classes[i] == i}
    clean = brute_redact(kept)
    db.register("frame", pd.DataFrame({"doc_id": list(kept), "text": [clean[i] for i in kept], "source": [kept[i][1] for i in kept]}))
    copies = dict(db.execute(f"WITH {mixing.targets_sql('frame')} SELECT doc_id, copies FROM taken WHERE copies > 0").fetchall())
    lib = tokens.load()
    want = {i: n * (len(lib.encode(clean[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()}
    got: dict = {}
    fill: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    assert got == want
    for v in fill.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns that bear names of ours, through the whole pipeline; and an empty table."""
    import random

    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one = text(80)
    rows = [(1, one, "en", "s"), (1, one, "en", "s"), (2, one, "de", None), (3, text(60_000), None, "s"), (None, text(70), "en", "s"), (4, None, "en", "s"), (5, "", None, None), (None, None, None, None), (6, text(60) + " token=abcdef1234", "en", "t")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, _row string, hits string, h string, copies string, uid string, kept string, _t string"
    full = [(*x, None if x[1] is None else len(x[1]), *"abcdefgh") for x in rows]
    for name, data in (("odd", full), ("none", [])):
        spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = common.table(spark, f"{tmp_path}/{name}", "documents")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            docs = common.materialize(out, "odd")
            if name == "odd" and stage in ("quality rules", "near-duplicates"):
                ids = sorted((x["doc_id"] for x in docs.collect()), key=str)
                assert ids == ([1, 1, 2, 3, 6, None] if stage == "quality rules" else [1, 3, 6, None])
            if name == "odd" and stage == "secrets":
                assert {x["text"][-9:] for x in docs.collect() if x["doc_id"] == 6} == {" [SECRET]"}
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "odd") and (not got or {x["doc_id"] for x in got} >= {3})
