"""Stage tables by runs, look-up of single documents, and documents that can't be read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella import __main__ as jobs
from tessella.sources import artifacts as A
from tessella.sources import sinks
from tests.test_jobs import raw


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if not f.startswith(".")}


def test_runs_replace_documents_and_leave_files_alone(spark, tmp_path, monkeypatch):
    root, kinds = f"file://{tmp_path}", "doc_id string, n int, set_id string"
    make = lambda *r: spark.createDataFrame(list(r), kinds)
    sinks.write_stage(make(*((f"d{i}", i, f"s{i}") for i in range(40)), ("d1", 100, "s")), root, "t")
    before = stamps(tmp_path / "t")
    sinks.write_stage(make(("d1", 5, "x"), ("new", 1, "y")), root, "t", ids=spark.createDataFrame([("d2",), ("d1",)], "doc_id string"))
    assert {f: t for f, t in stamps(tmp_path / "t").items() if f in before} == before
    want = sorted([(f"d{i}", i, f"s{i}") for i in range(40) if i not in (1, 2)] + [("d1", 5, "x"), ("new", 1, "y")])
    assert rows(sinks.read_stage(spark, root, "t")) == want
    assert rows(sinks.read_stage(spark, root, "t", "d1")) == [("d1", 5, "x")] and rows(sinks.read_stage(spark, root, "t", "d2")) == []
    # a run that only takes away, and one that brings all together
    sinks.write_stage(make(("z", 0, "z")).where("false"), root, "t", ids=spark.createDataFrame([("new",)], "doc_id string"))
    monkeypatch.setattr(sinks, "MOST_RUNS", 3)
    sinks.write_stage(make(("d3", 33, "x")), root, "t")
    want = sorted([(i, n, s) if i != "d3" else (i, 33, "x") for i, n, s in want if i != "new"])
    assert rows(sinks.read_stage(spark, root, "t")) == want and len(sinks.inverted.commits(spark, f"{root}/t")) == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_stage(spark, root, "nothing")


def test_one_document_is_read_from_one_folder(spark, tmp_path, capsys):
    root = f"file://{tmp_path}"
    sinks.write_stage(spark.createDataFrame([(f"d{i}", f"s{i}") for i in range(200)], "doc_id string, set_id string"), root, "t", buckets=32)
    one = sinks.read_stage(spark, root, "t", "d7").where(F.col("set_id") == "s7")
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1


def test_json_stages(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.write_json(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int"), root, "j")
    sinks.write_json(spark.createDataFrame([("a", 3)], "doc_id string, n int"), root, "j")
    assert rows(sinks.read_stage(spark, root, "j")) == [("a", 3), ("b", 2)]


def paper(folder, doc, text=None, toc="[]", lines=None):
    d = folder / "raw" / doc
    d.mkdir(parents=True, exist_ok=True)
    own = lines if lines is not None else json.dumps([raw(0, 1, 0, "Results", 100.0, 16.0), raw(1, 1, 1, text if text is not None else "Treatment A increased expression of gene X in all of the cells!", 140.0, 10.0)])
    (d / "lines.json").write_text(own)
    (d / "toc.json").write_text(toc)


def test_bad_documents_go_to_quarantine_and_come_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    for i in range(5):
        paper(tmp_path, f"good{i}")
    paper(tmp_path, "broken", lines='[{"index": 0, "page_no": ')
    paper(tmp_path, "scanned", lines=json.dumps([raw(0, 1, 0, "  ", 100.0, 10.0)]))
    paper(tmp_path, "nothing", lines="[]")
    paper(tmp_path, "unplaced", lines=json.dumps([{"text": "no place"}]))
    paper(tmp_path, "contents", toc='{"level": ')
    stats = jobs.ingest(spark, root)
    assert sorted(r["doc_id"] for r in stats.collect()) == [f"good{i}" for i in range(5)]
    want = [("broken", "lines", "malformed JSON"), ("contents", "toc", "malformed JSON"), ("nothing", "lines", "no lines"), ("scanned", "lines", A.SCANNED), ("unplaced", "lines", "a line without index or page")]
    assert rows(jobs.stage(spark, root, "quarantine")) == want

    paper(tmp_path, "broken")
    paper(tmp_path, "good0", lines="no JSON at all")
    jobs.ingest(spark, root)
    assert [r[0] for r in rows(jobs.stage(spark, root, "quarantine"))] == ["contents", "good0", "nothing", "scanned", "unplaced"]
    assert {r["doc_id"] for r in jobs.stage(spark, root, "chunks").collect()} == {"broken", *(f"good{i}" for i in range(5))}  # good0 keeps what it had


def test_bad_lines_and_trees_lose_their_document_alone(spark, tmp_path):
    good, tree = '{"chunk_id": "c1", "text": "a"}', {"node_id": "r", "node_type": "document", "title": "t", "children": []}
    for doc, chunks, one in (("a", good, json.dumps(tree)), ("b", f"{good}\n\nbroken\n{good}", "{"), ("c", f"{good}\n{good}", json.dumps({**tree, "children": [{"title": "no id"}]})), ("d", "", json.dumps([1]))):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "chunks.jsonl").write_text(chunks)
        (tmp_path / doc / "document.json").write_text(one)
    found, bad = A.json_lines_and_bad(spark, f"file://{tmp_path}/*/chunks.jsonl", A.CHUNK, "chunk_index", "chunks")
    assert sorted((r["doc_id"], r["chunk_index"]) for r in found.collect()) == [("a", 0), ("c", 0), ("c", 1)] and rows(bad) == [("b", "chunks", "malformed JSON in line 3")]
    found, bad = A.trees_and_bad(spark, f"file://{tmp_path}/*/document.json")
    assert [(r["doc_id"], r["node_id"]) for r in found.collect()] == [("a", "r")] and [r[:2] for r in rows(bad)] == [("b", "tree"), ("c", "tree"), ("d", "tree")]
    assert all(r[2].startswith("no tree: ") for r in rows(bad))


def test_review_reads_a_document(spark, tmp_path, capsys):
    root = f"file://{tmp_path}"
    drafts = spark.createDataFrame([("a", "Figure 1", "s1", 0, "x", "y", True, "template", ["e1"]), ("b", "Figure 2", "s2", 0, "x", "y", True, "template", ["e1"])], "doc_id string, figure_id string, set_id string, nn int, statement string, statement_zh string, is_correct boolean, method string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("a", "e1", "whole text", "direct", "t", "results", 1, "p")], "doc_id string, evidence_id string, text string, role string, evidence_type string, section_type string, page_no int, paragraph_id string")
    sinks.write_stage(drafts, root, "drafts_zh")
    sinks.write_stage(evidence, root, "evidence_rows")
    assert jobs.main(["review", "--root", root, "--doc", "a", "--set", "s1"]) == 0 and '"text":"whole text"' in capsys.readouterr().out
    assert jobs.main(["review", "--root", root, "--doc", "b"]) == 0 and '"set_ids":["s2"]' in capsys.readouterr().out


def test_figure_summaries(spark):
    from tessella.operators import review as V

    one = {"figure_id": "Figure 2", "kind": "figure", "status": "PARTIAL", "confidence": 0.5, "title": "T", "caption": "C", "research_question": "", "groups": {"experimental": ["A"], "control": []}, "conclusions": [], "panels": [{"panel_id": "2a", "status": "SUFFICIENT", "title": "", "evidence": []}]}
    doc = {"doc_id": "d", "figures": [one, {**one, "figure_id": "Figure 3", "panels": None}]}
    got = V.figure_summaries(spark.createDataFrame([("d", json.dumps(doc)), ("e", '{"figures": []}')], "doc_id string, json string")).orderBy("n").collect()
    assert [(r["doc_id"], r["figure_id"], r["confidence"], r["caption"]) for r in got] == [("d", "Figure 2", 0.5, "C"), ("d", "Figure 3", 0.5, "C")]
    assert json.loads(got[0]["experiment"]["groups"]) == one["groups"] and list(got[0]["experiment"]) == ["groups"]
    assert [tuple(p) for p in got[0]["panels"]] == [("2a", "SUFFICIENT", "")] and got[1]["panels"] == []
