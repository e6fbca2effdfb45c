"""The jobs from raw lines to statements over one folder."""

import json

from tessella import __main__ as jobs


def raw(i, page, block, text, y, size):
    return {"index": i, "page_no": page, "block_no": block, "text": text, "bbox": [72.0, y, 400.0, y + size], "spans": [], "size": size, "font": "F", "bold": False, "page_width": 595.0, "page_height": 842.0}


def test_jobs(spark, tmp_path, capsys):
    d = tmp_path / "raw" / "paper"
    d.mkdir(parents=True)
    texts = [("Materials and Methods", 16.0), ("Cells were divided into control and treatment groups!", 10.0), ("Results", 16.0), ("Treatment A significantly increased expression of gene X compared with control (Figure 2)!", 10.0), ("Figure 2. Relative expression of gene X in control and treatment groups!", 10.0), ("Treatment B decreased expression of gene X by 30% (Figure 3)!", 10.0)]
    (d / "lines.json").write_text(json.dumps([raw(i, 1, i, t, 100.0 + 40 * i, s) for i, (t, s) in enumerate(texts)]))
    (d / "toc.json").write_text(json.dumps([{"level": 1, "title": "Results", "page_no": 1}]))
    root = f"file://{tmp_path}"
    stats = jobs.ingest(spark, root).collect()
    assert [(r["doc_id"], r["n_chunks"]) for r in stats] == [("paper", 2)]
    assert jobs.build_index(spark, root) == "built" and jobs.build_index(spark, root) == "skipped"
    hits = jobs.search(spark, root, "expression of gene X").collect()
    assert hits[0]["rank"] == 1 and "gene X" in hits[0]["text"]
    assert jobs.gate(spark, root, "quantum tunnelling").first()["missing"] == ["quantum", "tunnelling"]
    assert jobs.main(["gate", "--root", root, "--query", "quantum tunnelling"]) == 2
    zh = jobs.questions(spark, root).collect()
    assert any(r["is_correct"] and "significantly increases" in r["statement"] for r in zh) and all(r["statement_zh"] for r in zh)
    told = json.loads(jobs.stage(spark, root, "figures").first()["json"])
    assert [f["figure_id"] for f in told["figures"]] == ["Figure 2", "Figure 3"] and told["summary"]["figures"]["total"] == 2
