"""Search, fusion, gate and index files on small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import gate as E
from tessella.operators import retrieval as R
from tessella.sources import artifacts as A
from tessella.sources import sinks


def legs(spark, rows):
    return spark.createDataFrame([(1, leg, i, r, float(s)) for leg, i, r, s in rows], "query_id int, leg string, id string, rank int, score double")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("d", "a", 1, 0), ("d", "b", 2, 0)], [("a", 1 / 61), ("b", 1 / 62)]),
        ([("d", "a", 1, 0), ("s", "a", 1, 0)], [("a", 2 / 61)]),
        ([("d", "a", 1, 0), ("d", "b", 2, 0), ("s", "c", 1, 0)], [("a", 1 / 61), ("c", 1 / 61), ("b", 1 / 62)]),
        ([("d", "y", 1, 0), ("d", "x", 2, 0), ("s", "z", 1, 0), ("s", "x", 2, 0)], [("x", 2 / 62), ("y", 1 / 61), ("z", 1 / 61)]),
        ([("d", "b", 1, 0), ("d", "a", 2, 0), ("s", "a", 1, 0), ("s", "b", 2, 0)], [("a", 1 / 61 + 1 / 62), ("b", 1 / 61 + 1 / 62)]),
    ],
)
def test_rrf(spark, rows, want):
    got = [(r["id"], r["score"]) for r in R.rrf(legs(spark, rows)).orderBy("rank").collect()]
    assert got == [(i, pytest.approx(s)) for i, s in want]


@pytest.mark.parametrize(
    ("rows", "weights", "want"),
    [
        ([("d", "a", 1, 0.9), ("d", "b", 2, 0.5)], {"d": 0.5}, {"a": 0.5, "b": 0.0}),
        ([("d", "a", 1, 1), ("d", "b", 2, 0.5), ("s", "b", 1, 10), ("s", "a", 2, 0)], {"d": 0.9, "s": 0.1}, {"a": 0.9, "b": 0.1}),
        ([("d", "a", 1, 3), ("d", "b", 2, 3)], {"d": 1}, {"a": 1.0, "b": 1.0}),
        ([("d", "a", 1, 2)], {"d": 0.5, "s": 0.5}, {"a": 0.5}),
    ],
)
def test_weighted(spark, rows, weights, want):
    got = {r["id"]: r["score"] for r in R.weighted_fusion(legs(spark, rows), weights).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_knn(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "id string, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [5.0, 0.0]), (3, [0.0, 0.0])], "query_id int, q array<double>")
    got = [(r["query_id"], r["id"], round(r["score"], 5)) for r in R.knn(q, v, 99).orderBy("query_id", "rank").collect()]
    assert got == [(i, x, s) for i in (1, 2) for x, s in (("a", 1.0), ("c", 0.70711), ("b", 0.0))]
    assert R.knn(q, v, 0).count() == 0 and R.knn(q, v, 2, max_bytes=1).count() == 4
    for bad in ([("a", [1.0]), ("a", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [0.0])]):
        with pytest.raises(Exception, match="repeats|dimension|zero"):
            R.checked_vectors(spark.createDataFrame(bad, "id string, v array<double>")).collect()


def test_bm25_by_hand(spark):
    docs = {"d1": "apple banana apple", "d2": "banana cherry", "d3": "cherry cherry date banana"}
    recs = R.records(spark.createDataFrame(list(docs.items()), "id string, text string"), 1)
    q = spark.createDataFrame([(1, ["apple", "banana"]), (2, ["zzz"]), (3, [])], "query_id int, tokens array<string>")
    got = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(q, recs, 10).collect()}
    n, avg = 3, 3.0
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in {"apple": 1, "banana": 3, "cherry": 2, "date": 1}.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / 4 for t, v in raw.items()}

    def part(t, tf, dl):
        return idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))

    want = {"d1": part("apple", 2, 3) + part("banana", 1, 3), "d2": part("banana", 1, 2), "d3": part("banana", 1, 4)}
    assert got == {(1, d): pytest.approx(s) for d, s in want.items() if s > 0}


def test_tokens_of_both_scripts(spark):
    df = spark.createDataFrame([("ATP细胞 is 25µM",), (None,), ("膜",)], "t string").select(X.tokens(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == [["atp", "细胞", "is", "25", "m"], [], ["膜"]]


def test_retrieve_modes(spark):
    recs = R.records(spark.createDataFrame([("a", "cells have membranes today"), ("b", "plants have walls today")], "id string, text string"))
    vec = R.hash_embeddings(recs.select("id", "text")).select("id", "v")
    q = R.hash_embeddings(spark.createDataFrame([(1, "membranes walls membranes"), (2, "  ")], "query_id int, text string"), name="q")
    both = R.retrieve(q, recs, vec).collect()
    assert {r["query_id"] for r in both} == {1} and all(r["sources"] == sorted(r["sources"]) for r in both)
    assert R.retrieve(q, recs, vec, "dense").where("sparse_score is not null").count() == 0
    with pytest.raises(ValueError):
        R.retrieve(q, recs, vec, "other")
    twice = vec.union(vec).groupBy("id").agg(F.count_distinct("v").alias("n")).collect()
    assert {r["n"] for r in twice} == {1}


def hits(spark, rows):
    return spark.createDataFrame([(1, i + 1, t.split(), float(s)) for i, (t, s) in enumerate(rows)], "query_id int, rank int, tokens array<string>, sparse_score double")


@pytest.mark.parametrize(
    ("query", "rows", "config", "score"),
    [
        ("alpha beta", [("x", 12), ("y", 6), ("z", 3)], {}, 0.25),
        ("alpha beta", [("alpha beta", 13), ("alpha", 8), ("beta", 5)], {}, 1.0),
        ("alpha beta", [], {}, 0.0),
        ("alpha beta", [("zzz", 12)], {"window": 1, "pool": 1}, 0.15 + 0.1 / 3),
        ("alpha beta gamma delta", [("alpha", 12), ("beta", 12), ("gamma", 12), ("delta", 12)], {}, 0.75 * (0.5 + 0.125) + 0.25),
    ],
)
def test_gate(spark, query, rows, config, score):
    q = spark.createDataFrame([(1, query.split())], "query_id int, tokens array<string>")
    r = E.evaluate(q, hits(spark, rows), E.EvidenceConfig(**config)).first()
    assert r["coverage_score"] == pytest.approx(score, abs=1e-4) and r["sufficient"] == (score >= 0.8)
    if not rows:
        assert r["missing"] == query.split()


def test_gate_without_terms_and_bad_settings(spark):
    q = spark.createDataFrame([(1, ["的", "a"])], "query_id int, tokens array<string>")
    r = E.evaluate(q, hits(spark, [("的", 9)])).first()
    assert not r["sufficient"] and r["message"]
    for bad in ({"term_weight": 0.9}, {"pool": 2}):
        with pytest.raises(ValueError):
            E.EvidenceConfig(**bad)
    syn = E.evaluate(spark.createDataFrame([(1, ["氧气"])], "query_id int, tokens array<string>"), hits(spark, [("o2 levels", 12), ("x", 3), ("y", 3)])).first()
    assert syn["missing"] == [] and syn["sufficient"]
    with pytest.raises(Exception, match="insufficient evidence"):
        E.require(E.gate(E.evaluate(q, hits(spark, [])))).collect()


def test_second_level_and_its_answers(spark):
    first = spark.createDataFrame([(1, False, ["x"]), (2, True, []), (3, False, ["y"])], "query_id int, sufficient boolean, missing array<string>")
    second = spark.createDataFrame([(1, True, []), (2, False, ["z"])], "query_id int, sufficient boolean, missing array<string>")
    got = {r["query_id"]: (r["sufficient"], r["level"]) for r in E.gate(first, second).collect()}
    assert got == {1: (True, "heuristic+llm"), 2: (True, "heuristic"), 3: (False, "heuristic")}
    answers = spark.createDataFrame([('```json\n{"sufficient": true, "coverage_score": 7, "missing": []}\n```',), ("no",)], "a string")
    assert [r["v"] and r["v"]["coverage_score"] for r in answers.select(E.parse_verdict(F.col("a")).alias("v")).collect()] == [1.0, None]


def test_supplement_leaves_covered_out(spark):
    h = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    links = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "id string, paragraph_id string")
    covered = spark.createDataFrame([(1, "p2")], "query_id int, paragraph_id string")
    assert [r["id"] for r in R.supplement(h, links, covered).collect()] == ["b"]


def test_index_is_built_once(spark, tmp_path):
    recs = R.records(spark.createDataFrame([("a", "cells have membranes"), ("b", "short")], "id string, text string"))
    vec = R.hash_embeddings(recs.select("id", "text"), dim=8).select("id", "v")
    root, kind = f"file://{tmp_path}/i", {"embedder": "hash", "dim": 8}
    assert sinks.write_index(recs, vec, root, R.RetrievalConfig().config_hash(), kind) == "built"
    assert sinks.write_index(recs, vec, root, R.RetrievalConfig().config_hash(), kind) == "skipped"
    assert sinks.write_index(recs, vec, root, R.RetrievalConfig(rrf_k=9).config_hash(), kind) == "built"
    manifest, r, v = sinks.open_index(spark, root, 8)
    assert manifest["num_chunks"] == 1 and r.count() == v.count() == 1
    with pytest.raises(ValueError):
        sinks.open_index(spark, root, 16)
    with pytest.raises(ValueError):
        sinks.write_index(recs.where("false"), vec, root, "x", kind)


def test_artifact_files(spark, tmp_path):
    import json

    d = tmp_path / "doc1"
    d.mkdir()
    (d / "chunks.jsonl").write_text('{"chunk_id": "c1", "text": "a", "paragraph_ids": ["p"]}\n\n{"chunk_id": "c2", "text": "b"}\n')
    got = A.read_chunks(spark, f"file://{tmp_path}/*/chunks.jsonl").orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["chunk_id"]) for r in got] == [("doc1", 0, "c1"), ("doc1", 2, "c2")]
    (d / "evidence.jsonl").write_text('{"evidence_id": "e", "text": "old"}\nbroken\n{"evidence_id": "e", "text": "new"}\n')
    rows = A.read_json_lines(spark, f"file://{tmp_path}/*/evidence.jsonl", "evidence_id string, text string", strict=False)
    assert [r["text"] for r in rows.orderBy("ord").collect()] == ["old", "new"]
    tree = {"node_id": "r", "node_type": "document", "title": "doc1", "children": [{"node_id": "c", "node_type": "chapter", "title": "One", "level": 1, "children": [{"node_id": "p", "node_type": "paragraph", "text": "hi", "level": 2, "provenance": {"page_no": 3}}]}]}
    (d / "document.json").write_text(json.dumps(tree))
    flat = A.tree_paths(A.read_trees(spark, f"file://{tmp_path}/*/document.json"))
    assert {r["node_id"]: r["path"] for r in flat.collect()} == {"r": [], "c": ["One"], "p": ["One"]}
    assert A.read_if_there(spark, f"file://{tmp_path}/nothing", A.read_chunks) is None
    assert A.Settings.from_env({"TESSELLA_RRF_K": "7"}).rrf_k == 7
    with pytest.raises(ValueError):
        A.upload_id("x.txt")


def test_streamed_documents_become_postings(spark, tmp_path):
    from tessella.streaming import ingest

    spark.createDataFrame([(1, "a b a", "en", "s", 5), (2, "b", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/in")
    q = ingest.write_postings(ingest.document_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = {(r["id"], r["term"]): r["tf"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1}


def test_knn_over_blocks_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 6))
    x[40:60] = x[3]  # many equal vectors: ties go by id
    rows = [(f"v{i:02d}", [float(y) for y in v]) for i, v in enumerate(x)] + [("zero", [0.0] * 6), ("null", None)]
    v = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows) if i % 10 == 3] + [(900, [0.0] * 6), (901, None)], "query_id int, q array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(3, 80, 10):
        order = sorted(range(80), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), rows[j][0]))[:7]
        want += [(i, rows[j][0], n + 1) for n, j in enumerate(order)]
    got = R.knn(q, v, 7, max_bytes=200)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
    plan = R.knn(q, v, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("MapInArrow") == 1
    assert R.knn(q, v.where("false"), 7).count() == 0 and R.knn(q.where("false"), v, 7).count() == 0
    with pytest.raises(Exception, match="dimension"):
        R.knn(q, spark.createDataFrame([("a", [1.0])], "id string, v array<double>"), 1).collect()
