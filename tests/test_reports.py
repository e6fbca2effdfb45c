"""The report of a small paper, word by word."""

import json

import pytest

from tessella.operators import figures as G
from tessella.operators import semantics as S
from tessella.session import Tables
from tessella.sources import reports, sinks
from tests.test_papers import PAPER, SCHEMA, paper

HEAD = """# d — Figure Semantic Reconstruction

**Introduction** Gene X is a key regulator of cellular metabolism.

**5 figures** · SUFFICIENT 3 · PARTIAL 1 · INSUFFICIENT 1
**0 panels** · SUFFICIENT 0 · PARTIAL 0 · INSUFFICIENT 0

## Figure 2 — SUFFICIENT (confidence 1.00, deterministic)
**Caption:** Figure 2. Relative expression of gene X in control and treatment groups.
**Q:** Does Treatment A affect gene X expression?
**Groups:** Treatment A, treatment vs control
**DV:** gene X expression

- **OBS** Treatment A significantly increased expression of gene X compared with control (Figure 2). — direction=increase, significant, causal [ev_f02_002]
- **INT** Our findings for Figure 2 suggest that Treatment A promotes gene X expression in cultured cells. [ev_f02_005]
- **CON** Treatment A increases gene X expression. [ev_f02_002] ← int_001
**Text block:** 2 paragraphs (2 anchored, 0 continuation)
**Evidence:** 5 units (direct_observation 2, experimental_design 2, author_interpretation 1)

## Figure 3 — INSUFFICIENT (confidence 0.00, deterministic)
**Missing:** figure caption; independent variable / intervention; dependent variable / measured endpoint; experimental vs control group comparison; direction of change; statistical significance
**Text block:** 1 paragraphs (1 anchored, 0 continuation)
**Evidence:** 1 units (direct_observation 1)

## Figure 4 — PARTIAL (confidence 0.35, deterministic)
**Caption:** Figure 4. Experimental setup of the assay for gene Y expression.
**DV:** gene Y expression

**Missing:** independent variable / intervention; experimental vs control group comparison; direction of change; statistical significance
**Text block:** 2 paragraphs (2 anchored, 0 continuation)
**Evidence:** 3 units (direct_observation 2, experimental_design 1)

## Figure 5 — SUFFICIENT (confidence 0.75, deterministic)
**Caption:** Figure 5. Association between Treatment C exposure and gene Z expression in patient samples.
**Q:** Does Treatment C affect gene Z expression?
**Groups:** Treatment C vs ?
**DV:** gene Z expression

- **OBS** As shown in Figure 5, Treatment C was associated with increased expression of gene Z. — direction=increase, association [ev_f05_002]
- **CON** Treatment C is associated with increased gene Z expression. [ev_f05_002]
**Text block:** 2 paragraphs (2 anchored, 0 continuation)
**Evidence:** 3 units (direct_observation 2, experimental_design 1)

## Table 1 — SUFFICIENT (confidence 1.00, deterministic)
**Caption:** Table 1. Relative body weight of mice in control and treatment groups.
**Q:** Does Treatment B affect body weight?
**Groups:** Treatment B, Treatment A, treatment vs control
**DV:** body weight, mice weight

- **OBS** Treatment B significantly decreased body weight of mice compared with control (Table 1). — direction=decrease, significant, causal [ev_t01_002]
- **CON** Treatment B decreases body weight. [ev_t01_002]
**Text block:** 2 paragraphs (2 anchored, 0 continuation)
**Evidence:** 4 units (direct_observation 2, experimental_design 2)
"""


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, a, b, t.replace("Figure 5, Treatment", "Figure 5b and Figure 2, Treatment")) for i, a, b, t in PAPER]
    df = Tables(spark).put(spark.createDataFrame(paper(spark, PAPER) + paper(spark, rows, "m"), SCHEMA), "paragraphs")
    sem = S.reconstruct(df, put=Tables(spark).put)
    hashes = spark.createDataFrame([("m", "00ff")], "doc_id string, input_hash string")
    rows = {k: v.collect() for k, v in reports.report(sem, G.background(df), df, hashes).items()}
    return {doc: {k: [r for r in v if r["doc_id"] == doc] for k, v in rows.items()} for doc in "dm"}


def test_markdown(told):
    assert told["d"]["report"][0]["markdown"] == HEAD
    lines = told["m"]["report"][0]["markdown"].split("\n")
    assert "**Text block:** 2 paragraphs (2 anchored, 0 continuation, shared with Figure 2)" in lines
    assert [x for x in lines if x.startswith("**Panels:** 5b ")]


def test_figure_blocks(told):
    doc = json.loads(told["m"]["figures"][0]["json"])
    assert list(doc) == ["doc_id", "background", "summary", "figures"] and doc["background"]["abstract"] == {} and doc["background"]["introduction"]["paragraph_ids"] == ["p-intro-1"]
    assert doc["summary"]["figures"] == {"total": 5, "SUFFICIENT": 3, "PARTIAL": 1, "INSUFFICIENT": 1} and doc["summary"]["panels"]["total"] == 1
    by = {f["figure_id"]: f for f in doc["figures"]}
    assert list(by) == ["Figure 2", "Figure 3", "Figure 4", "Figure 5", "Table 1"] and by["Table 1"]["kind"] == "table"
    two = by["Figure 2"]
    assert list(two)[:8] == ["figure_id", "kind", "status", "confidence", "method", "title", "caption", "research_question"] and "missing_information" not in two and "panels" not in two
    assert two["observations"][0]["p_value"] is None and two["conclusions"][0] == {"statement": "Treatment A increases gene X expression.", "relationship": "causal", "evidence": ["ev_f02_002"], "interpretations": ["int_001"]}
    assert by["Figure 5"]["text_block"] == {"anchors": ["p-results-6", "p-cap-fig5"], "continuations": [], "shared_with": ["Figure 2"], "paragraph_count": 2}
    assert by["Figure 5"]["panels"][0] == {"panel_id": "5b", "status": "PARTIAL", "confidence": by["Figure 5"]["panels"][0]["confidence"], "title": "", "missing_information": by["Figure 5"]["panels"][0]["missing_information"], "experiment_id": "exp_f05b", "evidence": ["ev_f05b_001"]}
    assert by["Figure 3"]["evidence_by_type"] == {"direct_observation": 1} and len(by["Figure 3"]["missing_information"]) == 6


def test_manifest_and_stores(told):
    m = json.loads(told["m"]["manifest"][0]["json"])
    assert m["num_figures"] == 5 and m["status_counts"] == {"SUFFICIENT": 3, "PARTIAL": 1, "INSUFFICIENT": 1} and m["input_document_sha256"] == "00ff" and set(m["files"]) == {"figures", "evidence", "experiments", "report"}
    index = m["reading_index"]
    assert index["section_paragraph_counts"] == {"introduction": 1, "methods": 1, "results": 9, "discussion": 1} and list(index["section_paragraph_counts"]) == ["introduction", "methods", "results", "discussion"]
    assert [f["figure_id"] for f in index["figure_inventory"]] == ["Figure 2", "Figure 3", "Figure 4", "Figure 5", "Table 1"] and index["figure_inventory"][1] == {"figure_id": "Figure 3", "kind": "figure", "status": "INSUFFICIENT", "caption": ""}
    assert index["partition"] == {"method": "L1-deterministic", "flow_paragraphs": 9, "assigned": 9, "anchors": 9, "continuations": 0, "unassigned": 0, "coverage": 1.0}
    ids = [json.loads(r["json"])["evidence_id"] for r in told["m"]["evidence"]]
    assert len(ids) == len(set(ids)) and "ev_f05b_001" in ids
    assert [json.loads(r["json"])["experiment_id"] for r in sorted(told["m"]["experiments"], key=lambda r: r["n"])] == ["exp_f02", "exp_f03", "exp_f04", "exp_f05", "exp_f05b", "exp_t01"]


def test_a_document_takes_the_place_of_its_own_rows_alone(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.write_stage(spark.createDataFrame([(f"d{i}", i) for i in range(40)], "doc_id string, n int"), root, "t", buckets=4)
    sinks.write_stage(spark.createDataFrame([("d3", 99), ("new", 1)], "doc_id string, n int"), root, "t", buckets=4)
    got = sorted((r["doc_id"], r["n"]) for r in sinks.read_stage(spark, root, "t").collect())
    assert got == sorted([(f"d{i}", 99 if i == 3 else i) for i in range(40)] + [("new", 1)])
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= 4
