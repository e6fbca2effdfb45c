"""From paragraphs to Chinese statements, on a small paper with known results."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import blueprints as B
from tessella.operators import drafts as D
from tessella.operators import figures as G
from tessella.operators import semantics as S
from tessella.operators import translate as T
from tessella.session import Tables

SCHEMA = "doc_id string, ord int, paragraph_id string, section_title string, section_type string, text string, page_no int"
PAPER = [
    ("p-intro-1", "Introduction", "introduction", "Gene X is a key regulator of cellular metabolism."),
    ("p-methods-1", "Materials and Methods", "methods", "Cells were divided into control and treatment groups. Cells in the treatment group received Treatment A for 24 hours."),
    ("p-results-1", "Results", "results", "Treatment A significantly increased expression of gene X compared with control (Figure 2)."),
    ("p-cap-fig2", "Results", "results", "Figure 2. Relative expression of gene X in control and treatment groups."),
    ("p-results-3", "Results", "results", "The samples were analyzed as described previously. Figure 3 shows the experimental results."),
    ("p-results-4", "Results", "results", "Figure 4 shows the apparatus used in the assay."),
    ("p-cap-fig4", "Results", "results", "Figure 4. Experimental setup of the assay for gene Y expression."),
    ("p-results-6", "Results", "results", "As shown in Figure 5, Treatment C was associated with increased expression of gene Z."),
    ("p-cap-fig5", "Results", "results", "Figure 5. Association between Treatment C exposure and gene Z expression in patient samples."),
    ("p-results-8", "Results", "results", "Treatment B significantly decreased body weight of mice compared with control (Table 1)."),
    ("p-cap-tab1", "Results", "results", "Table 1. Relative body weight of mice in control and treatment groups."),
    ("p-disc-1", "Discussion", "discussion", "Our findings for Figure 2 suggest that Treatment A promotes gene X expression in cultured cells."),
]
NUMBERS = [
    ("p-d1", "Results", "results", "Treatment D reduced migration distance by 30% (p < 0.01) (Figure 6)."),
    ("p-cap6", "Results", "results", "Figure 6. Migration distance in control and treatment groups."),
    ("p-d2", "Results", "results", "Treatment E reduced migration distance by 50% (Figure 7)."),
    ("p-cap7", "Results", "results", "Figure 7. Migration distance in control and treatment groups."),
]


def paper(spark, rows, doc="d"):
    return [(doc, i, p, title, kind, text, 1 + i // 4) for i, (p, title, kind, text) in enumerate(rows)]


@pytest.fixture(scope="module")
def sem(spark):
    df = spark.createDataFrame(paper(spark, PAPER) + paper(spark, PAPER[:-1] + NUMBERS + PAPER[-1:], "e"), SCHEMA)
    return S.reconstruct(df, put=Tables(spark).put)


@pytest.fixture(scope="module")
def bps(spark, sem):
    return Tables(spark).put(B.blueprints(sem), "blueprints")


@pytest.fixture(scope="module")
def sets(spark, sem, bps):
    put = Tables(spark).put
    return put(D.draft_sets(bps, sem, put=put), "drafts")


def test_verdicts(sem):
    rows = sem["verdicts"].join(sem["units"], ["doc_id", "unit"]).where("doc_id = 'd' and panel = ''").collect()
    assert {r["figure_id"]: r["status"] for r in rows} == {"Figure 2": "SUFFICIENT", "Figure 3": "INSUFFICIENT", "Figure 4": "PARTIAL", "Figure 5": "SUFFICIENT", "Table 1": "SUFFICIENT"}


def test_figure_2(sem):
    x = sem["experiments"].where("doc_id = 'd' and unit = 'f02'").first()
    assert x["intervention"] == "Treatment A" and "control" in x["control_groups"] and x["dependent_variables"][0] == "gene X expression"
    o = sem["observations"].where("doc_id = 'd' and unit = 'f02' and direction <> 'unspecified'").orderBy("i").first()
    assert (o["direction"], o["significance"], o["relationship"], o["p_value"]) == ("increase", "significant", "causal", None)
    assert [r["statement"] for r in sem["conclusions"].where("doc_id = 'd' and unit = 'f02'").collect()] == ["Treatment A increases gene X expression."]
    assert sem["experiments"].where("doc_id = 'd' and unit = 't01'").first()["dependent_variables"][0] == "body weight"
    assert sem["observations"].where("doc_id = 'd' and unit = 'f03'").count() == 0
    assert sem["conclusions"].where("doc_id = 'd' and unit = 'f05'").first()["statement"] == "Treatment C is associated with increased gene Z expression."


def test_evidence_is_numbered_and_bound(sem, bps):
    rows = sem["evidence"].where("doc_id = 'd' and unit = 'f02'").orderBy("n").collect()
    assert [r["evidence_id"] for r in rows] == [f"ev_f02_{i:03d}" for i in range(1, len(rows) + 1)]
    assert [r["role"] for r in rows][:1] == ["caption"] and rows[-1]["role"] == "interpretation"
    ids = {(r["doc_id"], r["evidence_id"]) for r in sem["evidence"].collect()}
    assert all((r["doc_id"], e) in ids for r in bps.collect() for e in r["evidence_ids"])


def test_no_data_statement_without_numbers(bps):
    assert bps.where("doc_id = 'd' and question_type = 'DATA_STATEMENT'").count() == 0
    got = {r["data_value"] for r in bps.where("doc_id = 'e' and unit = 'f06' and question_type = 'DATA_STATEMENT'").collect()}
    assert got == {"30%", "p < 0.01"}


def test_sets_have_one_truth(sets):
    rows = sets.collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["set_id"]), []).append(r)
    assert by
    for g in by.values():
        assert sum(r["is_correct"] for r in g) == 1 and len(g) >= 2 and len({r["statement"] for r in g}) == len(g) and all(r["evidence_ids"] for r in g)
    up = [r for r in rows if r["perturbation"] == "CAUSALITY_UPGRADE"]
    assert up and {r["unit"] for r in up} == {"f05"}
    swaps = [r["statement"] for r in rows if r["perturbation"] == "NUMERIC_MUTATION" and r["doc_id"] == "e"]
    assert any("50%" in s for s in swaps) and any("30%" in s for s in swaps)


def test_statements_in_chinese(sets):
    rows = T.translate_drafts(sets).collect()
    assert rows and all(r["statement_zh"] and r["method"] in ("template", "term_fallback") for r in rows)


SENTENCES = [
    ("Levels decreased then increased over time.", "decrease", "unspecified"),
    ("No significant difference was found.", "no_change", "not_significant"),
    ("Growth increased in a dose-dependent manner.", "increase", "unspecified"),
    ("The inhibitor was added.", "unspecified", "unspecified"),
    ("X was significantly lower.", "decrease", "significant"),
]


def test_sentence_classes(spark):
    df = spark.createDataFrame([(s,) for s, *_ in SENTENCES], "s string").select("s", S.direction(F.col("s")).alias("d"), S.significance(F.col("s")).alias("g"), S.relationship(F.col("s")).alias("r"))
    got = {r["s"]: r for r in df.collect()}
    for s, d, g in SENTENCES:
        assert (got[s]["d"], got[s]["g"]) == (d, g)
    assert got["Growth increased in a dose-dependent manner."]["r"] == "dose_response"


def test_mentions(spark):
    texts = ["Figure 1 shows data. (Fig. 2B) figure 3a and Table 4 were omitted.", "Figures 2 and 3 were combined. Figure 5-6 show dose response.", "Configuration 7 was figuratively large.", "See Extended Data Fig. 2b and Supplementary Table 1."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.explode(G.mention_array(F.col("t"))).alias("m")).select("i", "m.*")
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["i"], r["at"])):
        got.setdefault(r["i"], []).append((r["kind"], r["number"], r["panel"], r["prefix"]))
    assert got == {0: [("figure", 1, "", ""), ("figure", 2, "B", ""), ("figure", 3, "A", ""), ("table", 4, "", "")], 1: [("figure", n, "", "") for n in (2, 3, 5, 6)], 3: [("figure", 2, "B", "Extended Data"), ("table", 1, "", "Supplementary")]}


def test_partition(spark):
    rows = [("r0", "Results", "results", "Nothing is cited here."), ("r1", "Results", "results", "Figure 2 shows A."), ("r2", "Results", "results", "It goes on."), ("r3", "Results", "results", "And on."), ("r4", "Results", "results", "Figure 3 and Figure 2 differ."), ("r5", "Results", "results", "More."), ("m1", "Methods", "methods", "Figure 2 was drawn."), ("d1", "Discussion", "discussion", "Figure 3 again.")]
    df = spark.createDataFrame(paper(spark, rows), SCHEMA)
    flow = {r["paragraph_id"]: (r["owner"], r["assignment"], r["shared"]) for r in G.partition(df, G.registry(df)["figures"]).collect()}
    assert flow == {"r0": (None, None, []), "r1": ("Figure 2", "anchor", []), "r2": ("Figure 2", "continuation", []), "r3": ("Figure 2", "continuation", []), "r4": ("Figure 3", "anchor", ["Figure 2"]), "r5": ("Figure 3", "continuation", [])}


def test_panels(spark):
    caps = ["Fig. 2 | CCR7 upregulation follows. a, GFP intensity of cells. b, Expression of CCR7. c, Migration speed.", "Cells a, b, c and d were pooled (Fig. 1)."]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(caps)), "i int, c string").orderBy("i").select(G.caption_panels(F.col("c")).alias("p")).collect()]
    assert got[0] == {"a": "a, GFP intensity of cells.", "b": "b, Expression of CCR7.", "c": "c, Migration speed."} and got[1] == {}


def test_panel_references_are_no_values(spark):
    cases = [("1g", "as before (Fig. 1g)", True), ("2b", "see Fig. 2b, there", True), ("1 g", "1 g of it", False), ("6h", "6h incubation", False), ("3a", "in 3a, then", True)]
    df = spark.createDataFrame(cases, "v string, s string, e boolean")
    assert df.where(B.is_panel_reference(F.col("v"), F.col("s")) != F.col("e")).count() == 0


TRANSLATIONS = [
    ("cPLA2 inhibitor increases GFP expression.", "cPLA2 抑制剂可提高 GFP 表达。", "template", False),
    ("Treatment A does not significantly increase gene X expression.", "处理 A 不会显著提高 gene X 表达。", "template", False),
    ("The reported value is 30%.", "论文报告的数值为 30%。", "template", False),
    ("According to Figure 2, the reported percentage is 30%.", "根据Figure 2，论文报告的百分比为 30%。", "template", False),
    ("According to Figure 1, DCs spent 30% of their time displaying diameters.", "根据Figure 1，论文原文报告：DCs spent 30% of their time displaying diameters。", "template", True),
]


def test_translations(spark):
    df = spark.createDataFrame(TRANSLATIONS, "statement string, zh string, m string, data boolean")
    for r in T.translations(df, "statement", F.col("data")).collect():
        assert (r["statement_zh"], r["method"]) == (r["zh"], r["m"])
    df = spark.createDataFrame([("GFP rose 3-fold in Figure 2 and increased.", "图2 中 GFP 增加 3 倍"), ("GFP increased.", "GFP 降低"), ("CCR7 fell.", "它下降")], "e string, z string")
    assert [r["x"] for r in df.select(T.rejection(F.col("e"), F.col("z")).alias("x")).collect()] == [None, "increase", "name"]


def test_normalizer_patches(spark):
    rows = [("A raised B by 30%.", "increase", ["e1"], ["e1"], "A increased B by 30%."), ("A raised B by 40%.", "increase", ["e1"], ["e1"], "A increased B by 30%."), ("A.", "decrease", ["e1"], ["e1"], "A increased B."), ("A.", "unspecified", ["e9"], ["e1"], "A."), ("A.", "unspecified", [], ["e1"], "A.")]
    df = spark.createDataFrame(rows, "statement string, direction string, cites array<string>, known_ids array<string>, evidence_text string")
    assert [r["rejected"] for r in S.patch_rejected(df).collect()] == [None, "number not in evidence", "direction not in evidence", "unknown evidence cited", "no evidence cited"]
