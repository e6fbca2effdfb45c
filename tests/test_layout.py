"""Cleaning, headings, tree, paragraphs and chunks on a small textbook."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import layout as L


def line(idx, page, block, text, x0, y0, size, bold=False):
    return ("d", idx, page, block, text, float(x0), float(y0), x0 + 300.0, float(y0 + size), float(size), "F", bold, 595.0, 842.0)


@pytest.fixture(scope="module")
def book(spark):
    rows, y = [], 0
    page = {
        1: [("第1章 走近细胞", 18, 72), ("第1节 细胞是基本单位", 14, 72), ("细胞是生物体结构和功能的基本单位，所有生物都由它组成", 10.5, 92), ("生命活动离不开细胞。", 10.5, 72)],
        2: [("第2节 细胞的多样性", 14, 72), ("不同的细胞形态各异功能也不同。", 10.5, 92), ("2.1 小节标题", 12, 72), ("这里有一些正文内容可以阅读。", 10.5, 92)],
        3: [("第2章 组成细胞的分子", 18, 72), ("组成细胞的元素有很多种类型。", 10.5, 92)],
    }
    i = 0
    for p, items in page.items():
        rows.append(line(i, p, 0, "生物必修一", 72, 40, 9))
        i += 1
        for b, (text, size, x0) in enumerate(items, 1):
            y = 80 + 40 * b
            rows.append(line(i, p, b, text, x0, y, size))
            i += 1
        rows.append(line(i, p, 99, str(p), 290, 815, 9))
        i += 1
    lines = spark.createDataFrame(rows, L.LINES)
    toc = spark.createDataFrame([("d", 0, 1, "第1章 走近细胞……1", 1), ("d", 1, 2, "第1节 细胞是基本单位", 1), ("d", 2, 2, "第2节 细胞的多样性 .... 2", 2), ("d", 3, 1, "第2章 组成细胞的分子", 3)], L.TOC)
    return lines, toc


def test_headers_and_page_numbers_go(book):
    lines, _ = book
    texts = [r["text"] for r in L.clean_lines(lines).collect()]
    assert "生物必修一" not in texts and not {"1", "2", "3"} & set(texts) and len(texts) == 10
    r = L.clean_report(lines).first()
    assert (r["n_raw"], r["n_clean"], r["n_repeated"]) == (16, 10, 6)


def test_headings_and_tree(book):
    lines, toc = book
    t = L.ingest(lines, toc)
    heads = {r["text"]: (r["rule"], r["level"]) for r in t["headings"].collect()}
    assert heads["第1章 走近细胞"] == ("toc", 1) and heads["第2节 细胞的多样性"] == ("toc", 2) and heads["2.1 小节标题"][0] == "font"
    kinds = {r["node_type"]: r["n"] for r in L.tree_counts(t["nodes"]).groupBy("node_type").agg(F.sum("n").alias("n")).collect()}
    assert kinds == {"chapter": 2, "section": 3, "paragraph": 4}
    nodes = {r["node_id"]: r for r in t["nodes"].collect()}
    root = X.short_hash(F.lit("d|"))
    for r in nodes.values():
        assert r["parent_id"] in nodes or r["parent_id"] == lines.select(root).first()[0]
    paras = t["paragraphs"].orderBy("ord").collect()
    assert paras[0]["text"] == "细胞是生物体结构和功能的基本单位，所有生物都由它组成生命活动离不开细胞。"
    assert paras[2]["breadcrumb"] == ["d", "第1章 走近细胞", "第2节 细胞的多样性", "2.1 小节标题"]
    assert t["chunks"].count() == 4


def test_without_contents_fonts_decide(spark, book):
    lines, _ = book
    heads = L.detect_headings(L.clean_lines(lines), spark.createDataFrame([], L.TOC)).collect()
    assert {r["rule"] for r in heads} == {"font"} and len(heads) == 5


def test_levels_are_compacted(spark):
    got = spark.sql("SELECT array(1, 3, 5, 2, 4) AS a UNION ALL SELECT array(3, 5)").select(L.compact(F.col("a")).alias("c")).collect()
    assert sorted(r["c"] for r in got) == [[1, 2, 3, 2, 3], [3, 4]]


def test_sections_without_chapters_get_them(spark):
    rows = [("d", i, t) for i, t in enumerate(["第1节 甲", "第2节 乙", "第1节 丙"])] + [("e", 0, "第一节 甲"), ("e", 1, "3.1 A"), ("e", 2, "3.2 B")]
    got = {(r["doc_id"], r["first_ord"]): (r["title"], r["n_children"]) for r in L.synthetic_chapters(spark.createDataFrame(rows, "doc_id string, ord int, title string")).collect()}
    assert got == {("d", 0): ("第1章", 2), ("d", 2): ("第1章", 1), ("e", 1): ("第3章", 2)}


def test_a_document_without_headings_gets_a_chapter(spark):
    lines = spark.createDataFrame([line(0, 1, 1, "第一句话在这里，没有标题也要能读出来。", 72, 100, 10), line(1, 1, 2, "另一段。", 90, 140, 10)], L.LINES)
    heads = spark.createDataFrame([], "doc_id string, idx int, text string, level int, rule string, confidence double")
    rows = L.nodes(lines, heads).orderBy("ord").collect()
    assert [(r["node_type"], r["title"]) for r in rows] == [("chapter", "正文"), ("paragraph", None), ("paragraph", None)]
    assert rows[1]["parent_id"] == rows[0]["node_id"]


NUMBERING = [("第十二章 遗传", 1), ("Chapter 5 The Cell", 1), ("第1节 走近", 2), ("1.1 节", 2), ("1.1.1 小节", 3), ("一、概述", 3), ("（二）过程", 3), ("3、要点", 3), ("plain text", None)]


def test_numbering(spark):
    df = spark.createDataFrame([(t, v) for t, v in NUMBERING], "t string, v int")
    assert df.where(~L.numbering_level(F.col("t")).eqNullSafe(F.col("v"))).count() == 0
    titles = spark.createDataFrame([("第1章 走近细胞……12", "第1章 走近细胞"), ("Methods 12", "Methods")], "t string, e string")
    assert titles.where(L.clean_toc_title(F.col("t")) != F.col("e")).count() == 0


def test_lines_join_by_script(spark):
    df = spark.createDataFrame([(["细胞是", "基本单位。"], "细胞是基本单位。"), (["Cells are", "basic units."], "Cells are basic units.")], "p array<string>, e string")
    assert df.where(X.join_lines(F.col("p")) != F.col("e")).count() == 0


def test_chunks_keep_sections_apart(spark):
    def tree(rows):
        return spark.createDataFrame([("d", i, "paragraph", k, h, [h], t, p) for i, (k, h, t, p) in enumerate(rows)], "doc_id string, ord int, node_type string, node_id string, parent_id string, path array<string>, text string, pages array<int>")

    two = L.chunks(tree([("a", "s", "x" * 300, [4]), ("b", "s", "y" * 400, [5])])).orderBy("seq").collect()
    assert [c["paragraph_ids"] for c in two] == [["a"], ["b"]]
    one = L.chunks(tree([("a", "s", "x" * 300, [4]), ("b", "s", "y" * 250, [5])])).collect()
    assert [(c["paragraph_ids"], c["pages"]) for c in one] == [(["a", "b"], [4, 5])]
    apart = L.chunks(tree([("a", "s", "x" * 30, [1]), ("b", "t", "y" * 30, [1])])).collect()
    assert len(apart) == 2


def test_long_paragraphs_are_cut_with_overlap(spark):
    text = "".join(f"这是第{i}个句子它有一些字。" for i in range(79))
    got = spark.range(1).select(X.pack_sentences(F.lit(text), 100, 150, 1).alias("p"), X.cjk_sentences(F.lit("细胞是基本单位。病毒没有细胞结构！它们都必须依赖活细胞；才能增殖。")).alias("s")).first()
    plain = spark.range(1).select(X.pack_sentences(F.lit(text), 100, 150, 0).alias("p")).first()["p"]
    assert len(got["s"]) == 4 and all(len(p) <= 150 for p in got["p"]) and len(plain) == len(got["p"])
    for before, piece in zip(plain, got["p"][1:], strict=False):
        assert piece.startswith(before.rsplit("。", 2)[-2] + "。")
    assert spark.range(1).select(X.pack_sentences(F.lit("a" * 320), 100, 150, 1).alias("p")).first()["p"] == ["a" * 150, "a" * 150, "a" * 20]


def test_toc_takes_one_line_for_an_entry(spark):
    rows = [("d", 0, 1, "Introduction"), ("d", 1, 2, "Introduction to cells"), ("d", 2, 2, "Introductoin"), ("d", 3, 5, "Introduction")]
    lines = spark.createDataFrame(rows, "doc_id string, idx int, page_no int, text string")
    toc = spark.createDataFrame([("d", 0, 1, "Introduction", 2), ("d", 1, 2, "Introduction to cells", 2)], L.TOC)
    got = {r["title"]: (r["idx"], r["score"]) for r in L.match_toc(lines, toc).collect()}
    assert got == {"Introduction": (0, 3.0), "Introduction to cells": (1, 3.5)}


def test_contents_entries_pair_texts_not_rows(spark):
    """Repeated lines and entries: the first line of a text on a page and the first entry of a text count, as when rows are paired one by one."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["cell wall", "cell walls", "cellwall", "the cell", "old plate", "cold plate", "cold plates", "gear"]
    lines = [("d", i, rng.randint(1, 4), rng.choice(names)) for i in range(80)]
    toc = [("d", i, 1 + i % 3, rng.choice(names) + rng.choice(["", "s"]), rng.randint(1, 4)) for i in range(40)]
    got = L.match_toc(spark.createDataFrame(lines, "doc_id string, idx int, page_no int, text string"), spark.createDataFrame(toc, L.TOC))
    best = {}
    for _, ord_, level, title, page in toc:
        t, found = title.replace(" ", ""), []
        for _, idx, at, text in lines:
            lt = text.replace(" ", "")
            ratio = SequenceMatcher(None, lt, t).ratio()
            score = 3.0 if lt == t else 2.0 if lt in t or t in lt else 1 + ratio / 10 if ratio >= 0.8 else None
            if score is not None and abs(at - page) <= 1:
                found.append((-score - 0.5 * (at == page), idx))
        if found:
            score, idx = min(found)
            best[idx] = min(best.get(idx, (9, 0, 0, "")), (score, ord_, level, title))
    assert {r["idx"]: (round(-r["score"], 9), r["level"], r["title"]) for r in got.collect()} == {i: (round(b[0], 9), b[2], b[3]) for i, b in best.items()}
    # the work follows the texts of a page: of 3,000 equal lines and entries one pair is made
    many = L.match_toc(spark.range(3000).selectExpr("'d' AS doc_id", "cast(id AS int) AS idx", "1 AS page_no", "'one text' AS text"), spark.range(3000).selectExpr("'d' AS doc_id", "cast(id AS int) AS ord", "1 AS level", "'one text' AS title", "1 AS page_no"))
    assert [tuple(r) for r in many.collect()] == [("d", 0, 1, "one text", 3.5)]
    assert joined_rows(spark, many) < 10


def joined_rows(spark, df) -> int:
    """The most rows that a join of df's plan gave when it ran."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if "Join" in name:
            found.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return max(found)
