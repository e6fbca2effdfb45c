"""Lines of pages: cleaning, heading detection, the section tree and its paragraphs.

Every operator is keyed by doc_id; what one document needs together (a fold over its headings) is bounded by that document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

#: Lines: doc_id, idx, page_no, block_no, text, x0, y0, x1, y1, size, font, bold, page_width, page_height.
LINES = "doc_id string, idx int, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, bold boolean, page_width double, page_height double"
TOC = "doc_id string, ord int, level int, title string, page_no int"


@dataclass(frozen=True)
class ParserConfig:
    max_levels: int = 4
    band_ratio: float = 0.09
    repeat_ratio: float = 0.3
    heading_max_chars: int = 60
    min_confidence: float = 0.0
    indent_min: float = 10.0
    chunk_target: int = 600
    chunk_max: int = 1200
    overlap: int = 1


# --- cleaning ---------------------------------------------------------------------------------------------------------


def digit_mask(text: Column) -> Column:
    return X.strip(F.regexp_replace(text, "[0-9０-９]", "N"))


def fold_blanks(text: Column) -> Column:
    """Runs of blanks as one space, trimmed, then soft hyphens out."""
    return F.replace(X.strip(F.regexp_replace(text, "[ \\t\u00a0\u3000]+", " ")), F.lit("\u00ad"), F.lit(""))


def is_page_number(text: Column) -> Column:
    return (F.length(text) <= 10) & text.rlike(P.PAGE_NUMBER)


def band(ratio: float) -> Column:
    """top, bottom or null by a line's place on its page."""
    return F.when(F.col("y0") < ratio * F.col("page_height"), "top").when(F.col("y1") > (1 - ratio) * F.col("page_height"), "bottom")


def repeated_bands(lines: DataFrame, config: ParserConfig = ParserConfig()) -> DataFrame:
    """doc_id, band, mask of headers and footers: masked texts on at least max(2, repeat_ratio of the pages) pages."""
    marked = lines.withColumn("band", band(config.band_ratio)).withColumn("mask", digit_mask(F.col("text")))
    pages = lines.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    groups = marked.where("band is not null and mask <> ''").groupBy("doc_id", "band", "mask").agg(F.count_distinct("page_no").alias("on"), F.sort_array(F.collect_set("page_no")).alias("on_pages"), F.count(F.lit(1)).alias("dropped"))
    return groups.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.ceil(config.repeat_ratio * F.col("pages")))).drop("pages", "on")


def clean_lines(lines: DataFrame, config: ParserConfig = ParserConfig()) -> DataFrame:
    """Lines without repeated headers and footers, blank lines and page numbers, their texts folded."""
    marked = lines.withColumn("band", band(config.band_ratio)).withColumn("mask", digit_mask(F.col("text")))
    kept = marked.join(repeated_bands(lines, config).select("doc_id", "band", "mask"), ["doc_id", "band", "mask"], "left_anti").drop("band", "mask")
    folded = kept.withColumn("text", fold_blanks(F.col("text"))).where("text <> ''")
    return folded.where(~is_page_number(F.col("text")))


def clean_report(lines: DataFrame, config: ParserConfig = ParserConfig()) -> DataFrame:
    """doc_id, n_raw, n_clean, n_repeated: what cleaning did."""
    raw = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raw"))
    clean = clean_lines(lines, config).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clean"))
    rep = repeated_bands(lines, config).groupBy("doc_id").agg(F.sum("dropped").alias("n_repeated"))
    return raw.join(clean, "doc_id", "left").join(rep, "doc_id", "left").na.fill(0, ["n_clean", "n_repeated"])


# --- headings ---------------------------------------------------------------------------------------------------------


def numbering_level(text: Column, dotted_number: str = P.DOTTED) -> Column:
    """The level that a leading number implies: chapters 1, sections 2, a.b.c by its dots, lists 3; else null. dotted_number: what counts as a.b.c."""
    t = X.strip(text)
    dotted = F.regexp_extract(t, dotted_number, 1)
    return X.ordered_case(
        [
            (t.rlike(P.CHAPTER) | t.rlike(P.ENGLISH_CHAPTER), F.lit(1)),
            (t.rlike(P.SECTION), F.lit(2)),
            (dotted != "", 1 + F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit("")))),
            (t.rlike(P.SUB_CN) | t.rlike(P.PAREN_CN) | t.rlike(P.ARABIC_LIST), F.lit(3)),
        ],
        F.lit(None).cast("int"),
    ).cast("int")


def clean_toc_title(title: Column) -> Column:
    t = F.regexp_replace(X.strip(title), P.TOC_TAIL, "")
    return X.strip(F.when(t.rlike(P.CHAPTER) | t.rlike(P.SECTION), t).otherwise(F.regexp_replace(t, P.TRAILING_DIGITS, "")))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def font_profile(lines: DataFrame, max_levels: int = 4) -> DataFrame:
    """doc_id, size, body_size, level: sizes over the body size by more than 0.3, largest first. The body size has the most characters; of a tie the first seen."""
    n = F.length(X.strip(F.col("text")))
    weights = lines.where(n > 0).groupBy("doc_id", "size").agg(F.sum(n).alias("w"), F.min("idx").alias("first"))
    body = weights.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("body_size"))
    sized = weights.join(body, "doc_id").where(F.col("size") > F.col("body_size") + 0.3)
    return sized.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where(F.col("level") <= max_levels).select("doc_id", "size", "body_size", "level")


def similar(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """pairs with the ratio of matching blocks of two texts (Ratcliff and Obershelp): Arrow batches, as no built-in measures it. A task measures texts that meet again once, while its memory of them lasts."""
    from pyspark.sql import types as T

    import pyarrow as pa

    schema = T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())])
    i, j = pairs.columns.index(a), pairs.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher
        from functools import lru_cache

        ratio = lru_cache(1 << 15)(lambda s, t: SequenceMatcher(None, s, t).ratio())
        for x in batches:
            out = [ratio(s, t) for s, t in zip(x.column(i).to_pylist(), x.column(j).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.float64())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def match_toc(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, idx, level, title, score: at most one line for a contents entry and one entry for a line.

    Lines within a page of the entry compete: 3 for equal texts without white space, 2 if one holds the other, else 1 and a tenth of the ratio if
    that is 0.8 or more; the entry's own page adds 0.5. An entry takes its best line (the first of a tie), a line its best entry (the first of a tie).
    The range join runs as three equi-joins on the page, so that no document is paired with itself as a whole. Of a page's lines of one text the first alone can be
    taken, and entries of one text and page take the same line, which leaves the first of them; so texts are paired, not rows."""
    entries = toc.withColumn("target", squeezed(clean_toc_title(F.col("title")))).where("target <> ''")
    entries = entries.groupBy("doc_id", "target", F.col("page_no").alias("to_page")).agg(F.min(F.struct("ord", "level", "title")).alias("e"))
    entries = entries.withColumn("page_no", F.explode(F.array(*(F.col("to_page") + d for d in (-1, 0, 1)))))
    rows = lines.select("doc_id", "idx", "page_no", squeezed(F.col("text")).alias("lt")).where("lt <> ''").groupBy("doc_id", "page_no", "lt").agg(F.min("idx").alias("idx"))
    sure = F.when(F.col("lt") == F.col("target"), 3.0).when(F.contains("lt", "target") | F.contains("target", "lt"), 2.0)
    n, m = F.length("lt"), F.length("target")
    # the ratio is at most twice the shorter length over both, so that other pairs can't reach 0.8
    pairs = rows.join(entries, ["doc_id", "page_no"]).withColumn("score", sure).where(F.col("score").isNotNull() | (2.0 * F.least(n, m) >= 0.8 * (n + m) - 1e-9))
    close = similar(pairs.where("score is null").drop("score"), "lt", "target").where("ratio >= 0.8").withColumn("score", 1.0 + F.col("ratio") * 0.1).drop("ratio")
    scored = pairs.where("score is not null").unionByName(close).withColumn("score", F.col("score") + F.when(F.col("page_no") == F.col("to_page"), 0.5).otherwise(0.0))
    best = scored.groupBy("doc_id", "target", "to_page").agg(F.min(F.struct(-F.col("score"), "idx", "e")).alias("b")).select("doc_id", "b.idx", (-F.col("b.col1")).alias("score"), "b.e")
    one = best.groupBy("doc_id", "idx").agg(F.min(F.struct(-F.col("score"), F.col("e.ord"), "e", "score")).alias("b"))
    return one.select("doc_id", "idx", "b.e.level", "b.e.title", "b.score")


def gaps(lines: DataFrame) -> DataFrame:
    """Lines with gap_before and gap_after on their page by y0, page_first, and the document's median gap (0 without any)."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("y0", "idx")
    out = lines.withColumns({"gap_before": F.col("y0") - F.lag("y0").over(w), "gap_after": F.lead("y0").over(w) - F.col("y0"), "page_first": F.row_number().over(w) == 1})
    return out.withColumn("median_gap", F.coalesce(F.median("gap_after").over(Window.partitionBy("doc_id")), F.lit(0.0)))


def is_spatial(text: Column) -> Column:
    """Whether a short line stands apart; over the columns of gaps()."""
    after, before, mid = F.coalesce("gap_after", F.lit(0.0)), F.coalesce("gap_before", F.lit(0.0)), F.col("median_gap")
    return (F.length(text) < 40) & (mid > 0) & (after >= 1.5 * mid) & (F.col("page_first") | (before >= 1.2 * mid))


def detect_headings(lines: DataFrame, toc: DataFrame, config: ParserConfig = ParserConfig()) -> DataFrame:
    """doc_id, idx, text, level, rule, confidence, n_hits of lines that a rule takes for headings.

    Rules in order: contents entry, larger or bold font, numbering, space around. All but the first need 1 to heading_max_chars characters and no sentence's end.
    The first rule decides; each further one adds 0.08 to its confidence, to 0.95 at most."""
    hit = "struct<rule:string,level:int,confidence:double>"
    found = match_toc(lines, toc).select("doc_id", "idx", F.col("level").alias("toc_level"))
    profile = font_profile(lines, config.max_levels)
    body = font_body(lines)
    rows = gaps(lines).join(found, ["doc_id", "idx"], "left").join(profile.select("doc_id", "size", F.col("level").alias("font_level")), ["doc_id", "size"], "left").join(body, "doc_id", "left")
    t = X.strip(F.col("text"))
    open_ = (F.length(t) > 0) & (F.length(t) <= config.heading_max_chars) & ~t.rlike(P.SENTENCE_END)

    def one(rule: str, cond: Column, level: Column, confidence: float) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), level.cast("int").alias("level"), F.lit(confidence).alias("confidence"))).cast(hit)

    bold = F.col("font_level").isNull() & F.col("bold") & (F.col("size") >= F.coalesce("body_size", F.lit(0.0)) - 0.2)
    number = numbering_level(t)
    hits = F.array_compact(
        F.array(
            one("toc", F.col("toc_level").isNotNull(), F.col("toc_level"), 0.9),
            one("font", open_ & F.col("font_level").isNotNull(), F.col("font_level"), 0.7),
            one("font", open_ & bold, F.lit(min(2, config.max_levels)), 0.55),
            one("numbering", open_ & number.isNotNull(), number, 0.6),
            one("spatial", open_ & is_spatial(t), F.lit(2), 0.4),
        )
    )
    rows = rows.withColumn("hits", hits).where(F.size("hits") > 0)
    first = F.element_at("hits", 1)
    sure = F.least(F.lit(0.95), first["confidence"] + 0.08 * (F.size("hits") - 1))
    return rows.where(sure >= config.min_confidence).select("doc_id", "idx", t.alias("text"), first["level"].alias("level"), first["rule"].alias("rule"), F.round(sure, 2).alias("confidence"), F.size("hits").alias("n_hits"))


def font_body(lines: DataFrame) -> DataFrame:
    n = F.length(X.strip(F.col("text")))
    weights = lines.where(n > 0).groupBy("doc_id", "size").agg(F.sum(n).alias("w"), F.min("idx").alias("first"))
    return weights.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("body_size"))


def compact(levels: Column) -> Column:
    """An array of levels as compacted() has them, within one row: it grows with the square of the array."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(F.array_append(acc, F.when(x > last + 1, last + 1).otherwise(x)))

    return F.aggregate(levels, F.array().cast("array<int>"), step)


def compacted(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """headings (doc, idx, level, ...) with levels in order of idx, none more than one below the compacted one before it; the first stays.

    A level less its place never rises above the one before it, so it is the least so far: a window, and no array of a document's headings."""
    w = Window.partitionBy(doc).orderBy("idx")
    rows = headings.withColumn("_n", F.row_number().over(w))
    return rows.withColumn("level", (F.min(F.col("level") - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).cast("int")).drop("_n")


# --- tree -------------------------------------------------------------------------------------------------------------

#: Fixed value: a stack of headings as an array of (level, title), pushed by each heading after those of its level or deeper went.
STACK = "array<struct<level:int,title:string>>"


def paths(headings: DataFrame) -> DataFrame:
    """doc_id, idx, text, level (compacted), rule, confidence, path: the titles from the top to each heading. A fold over the headings of a document."""
    items = compacted(headings).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "level", "text", "rule", "confidence"))).alias("h"))
    out = "array<struct<idx:int,level:int,text:string,rule:string,confidence:double,path:array<string>>>"

    def step(acc: Column, x: Column) -> Column:
        stack = F.array_append(F.filter(acc["stack"], lambda s: s["level"] < x["level"]), F.struct(x["level"].alias("level"), x["text"].alias("title")))
        row = F.struct(x["idx"], x["level"], x["text"], x["rule"], x["confidence"], F.transform(stack, lambda s: s["title"]).alias("path"))
        return F.struct(stack.cast(STACK).alias("stack"), F.concat(acc["out"], F.array(row).cast(out)).alias("out"))

    zero = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast(out).alias("out"))
    return items.select("doc_id", F.explode(F.aggregate("h", zero, step, lambda a: a["out"])).alias("x")).select("doc_id", "x.*")


def body_x0(lines: DataFrame) -> DataFrame:
    """doc_id, body_x0: the median left edge of lines of 15 characters or more."""
    return lines.where(F.length(X.strip(F.col("text"))) >= 15).groupBy("doc_id").agg(F.median("x0").alias("body_x0"))


def paragraphs(lines: DataFrame, headings: DataFrame, config: ParserConfig = ParserConfig(), placed: DataFrame | None = None) -> DataFrame:
    """doc_id, head_idx, path, para, start_idx, text, page_no, pages: lines joined to paragraphs under their last heading.

    A heading ends a paragraph; so does a line of another block whose predecessor ends a sentence or that is indented by more than indent_min. placed: paths(headings), where it is known already."""
    heads = (paths(headings) if placed is None else placed).select("doc_id", "idx", "path", F.lit(True).alias("is_head"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = lines.join(heads, ["doc_id", "idx"], "left").join(body_x0(lines), "doc_id", "left")
    rows = rows.withColumns({"head_idx": F.last(F.when(F.col("is_head"), F.col("idx")), ignorenulls=True).over(w), "path": F.last("path", ignorenulls=True).over(w)})
    rows = rows.withColumns({"p_head": F.lag("is_head").over(w), "p_page": F.lag("page_no").over(w), "p_block": F.lag("block_no").over(w), "p_text": F.lag(X.strip(F.col("text"))).over(w)})
    same = (F.col("page_no") == F.col("p_page")) & (F.col("block_no") == F.col("p_block"))
    ends = F.col("p_text").rlike(P.SENTENCE_END) | (F.col("x0") - F.coalesce("body_x0", F.lit(0.0)) > config.indent_min)
    new = F.col("p_text").isNull() | F.coalesce("p_head", F.lit(False)) | (~same & ends)
    body = rows.where("is_head is null").withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(w))
    joined = body.groupBy("doc_id", "island").agg(
        F.first("head_idx").alias("head_idx"),
        F.first("path").alias("path"),
        F.min("idx").alias("start_idx"),
        F.min_by("page_no", "idx").alias("page_no"),
        F.sort_array(F.collect_set("page_no")).alias("pages"),
        X.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])).alias("text"),
    )
    under = Window.partitionBy("doc_id", "head_idx").orderBy("start_idx")
    return joined.withColumn("para", (F.row_number().over(under) - 1).cast("int")).drop("island").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def node_id(doc_id: Column, path: Column) -> Column:
    return X.short_hash(F.concat_ws("|", doc_id, path))


def chapter_keys(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, ord, title) with the key and number that synthetic chapters group them by.

    "3.1" groups by 3; a run 第1节, 第2节, ... by its run, which a restart at 1 or a gap ends; others have no key. Digits alone count."""
    dotted, jie = F.regexp_extract("title", P.DOTTED_PREFIX, 1), F.regexp_extract("title", P.JIE_PREFIX, 1)
    n = F.when((dotted == "") & jie.rlike(r"(?U)^\d+$"), F.translate(jie, "０１２３４５６７８９", "0123456789").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = sections.withColumn("n", n).withColumn("prev", F.last("n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("n").isNotNull() & ((F.col("n") == 1) | F.col("prev").isNull() | (F.col("n") != F.col("prev") + 1))
    rows = rows.withColumn("run", F.sum(F.when(start, 1).otherwise(0)).over(w) - 1)
    key = F.when(dotted != "", F.concat(F.lit("n"), dotted)).when(F.col("n").isNotNull(), F.concat(F.lit("jie-"), F.col("run").cast("string")))
    number = F.when(dotted != "", dotted).when(F.col("n").isNotNull(), jie)
    return rows.withColumns({"key": key, "number": number}).drop("n", "prev", "run")


def synthetic_chapters(sections: DataFrame) -> DataFrame:
    """doc_id, first_ord, title, n_children, key, number: the chapters that neighbouring sections of one key are wrapped in."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = chapter_keys(sections)
    change = F.col("key").isNull() | ~F.col("key").eqNullSafe(F.lag("key").over(w))
    rows = rows.withColumn("island", F.sum(F.when(change, 1).otherwise(0)).over(w)).where("key is not null")
    out = rows.groupBy("doc_id", "island").agg(F.min("ord").alias("first_ord"), F.min_by("number", "ord").alias("number"), F.min_by("key", "ord").alias("key"), F.count(F.lit(1)).alias("n_children"))
    return out.select("doc_id", "first_ord", F.concat(F.lit("第"), F.col("number"), F.lit("章")).alias("title"), "n_children", "key", "number")


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def nodes(lines: DataFrame, headings: DataFrame, config: ParserConfig = ParserConfig(), put: Callable[[DataFrame, str], DataFrame] = as_is) -> DataFrame:
    """doc_id, ord, node_type, node_id, parent_id, title, level, text, path, pages, rule: the tree as rows in document order.

    Sections without any chapter get synthetic chapters, and a document without headings one fallback chapter. A child's parent_id is its parent's node_id. put: writes
    what is used more than once (session.Tables.put)."""
    heads = put(paths(headings), "paths")
    paras = paragraphs(lines, headings, config, heads)
    none, text = F.lit(None).cast("string"), F.col("text")
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    hrows = heads.select("doc_id", F.col("idx").alias("ord"), F.when(F.col("level") == 1, "chapter").otherwise("section").alias("node_type"), text.alias("title"), "level", none.alias("text"), "path", up.alias("parent_path"), F.array().cast("array<int>").alias("pages"), "rule", F.lit(-1).alias("para"))
    prows = paras.select("doc_id", F.col("start_idx").alias("ord"), F.lit("paragraph").alias("node_type"), none.alias("title"), (F.size("path") + 1).alias("level"), "text", "path", F.col("path").alias("parent_path"), "pages", none.alias("rule"), "para")
    rows = put(hrows.unionByName(prows), "tree_rows")
    kinds = rows.groupBy("doc_id").agg(F.bool_or(F.col("node_type") == "chapter").alias("has_chapter"), F.bool_or(F.col("node_type") == "section").alias("has_section"))
    rows = rows.join(kinds, "doc_id")
    # the fallback chapter stands above all paragraphs of a document without headings
    bare = ~F.col("has_chapter") & ~F.col("has_section")
    # synthetic chapters stand above the top sections of a document without chapters
    tops = rows.where("node_type = 'section' and not has_chapter and size(path) = 1").select("doc_id", "ord", "title")
    chapters = put(synthetic_chapters(tops), "synthetic")
    owner = chapter_keys(tops).where("key is not null").join(chapters.select("doc_id", F.col("first_ord").alias("of"), F.col("title").alias("chapter"), "n_children"), "doc_id").where("ord >= of")
    owner = owner.groupBy("doc_id", "ord").agg(F.max_by("chapter", "of").alias("chapter"))
    last = Window.partitionBy("doc_id").orderBy("ord")
    rows = rows.join(owner, ["doc_id", "ord"], "left").withColumn("top", F.last(F.when((F.col("node_type") == "section") & (F.size("path") == 1), F.struct(F.col("chapter").alias("c"))), ignorenulls=True).over(last))
    lead = F.when(bare, F.array(F.lit("正文"))).when(~F.col("has_chapter") & F.col("top.c").isNotNull() & (F.size("path") > 0), F.array(F.col("top.c"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("lead", lead)
    key = F.concat(F.array_join("path", "/"), F.when(F.col("para") >= 0, F.concat(F.lit("/para-"), F.col("para").cast("string"))).otherwise(""))
    rows = rows.withColumns({"node_id": node_id(F.col("doc_id"), key), "parent_path": F.concat("lead", "parent_path"), "path": F.concat("lead", "path"), "level": F.col("level") + F.when(bare, 1).otherwise(0)})
    # fixed values: what the ids of chapters that no line names are made of
    made = F.concat_ws("/", F.lit("synthetic"), "key", "number")
    extra = chapters.select("doc_id", F.col("first_ord").alias("ord"), "title", F.lit("synthetic").alias("rule"), made.alias("place")).unionByName(kinds.where("not has_chapter and not has_section").select("doc_id", F.lit(-1).alias("ord"), F.lit("正文").alias("title"), F.lit("fallback").alias("rule"), F.lit("fallback").alias("place")))
    extra = extra.select("doc_id", "ord", F.lit("chapter").alias("node_type"), node_id(F.col("doc_id"), F.col("place")).alias("node_id"), "title", F.lit(1).alias("level"), none.alias("text"), F.array("title").alias("path"), F.array().cast("array<string>").alias("parent_path"), F.array().cast("array<int>").alias("pages"), "rule", F.lit(-1).alias("para"))
    keep = ["doc_id", "ord", "node_type", "node_id", "title", "level", "text", "path", "parent_path", "pages", "rule", "para"]
    out = put(rows.select(*keep).unionByName(extra.select(*keep)), "placed_rows")
    parents = out.where("node_type <> 'paragraph'").groupBy("doc_id", F.col("path").alias("pp")).agg(F.min("node_id").alias("parent_id")).withColumnRenamed("doc_id", "pd")
    return out.join(parents, (F.col("doc_id") == F.col("pd")) & (F.col("parent_path") == F.col("pp")), "left").drop("pd", "pp", "parent_path", "para").withColumn("parent_id", F.coalesce("parent_id", node_id(F.col("doc_id"), F.lit(""))))


def tree_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("doc_id", "node_type", F.coalesce("rule", F.lit("")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def classify_section(title: Column) -> Column:
    """The section type of the first keyword that a title holds, else other."""
    t = F.lower(title)
    return X.ordered_case([(t.contains(k), F.lit(v)) for k, v in P.SECTION_KEYWORDS], F.lit("other"))


def flatten(tree: DataFrame) -> DataFrame:
    """doc_id, ord, paragraph_id, text, breadcrumb, section_type, section_title, page_no of the paragraphs, in order.

    The section type is that of the nearest heading above whose title has one."""
    known = F.filter("path", lambda t: classify_section(t) != "other")
    title = F.when(F.size(known) > 0, F.try_element_at(known, F.lit(-1))).otherwise("")
    rows = tree.where("node_type = 'paragraph'").where(X.strip(F.col("text")) != "")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.select("doc_id", order.cast("int").alias("ord"), F.col("node_id").alias("paragraph_id"), X.strip(F.col("text")).alias("text"), F.concat(F.array("doc_id"), "path").alias("breadcrumb"), F.when(title == "", "other").otherwise(classify_section(title)).alias("section_type"), title.alias("section_title"), F.coalesce(F.get("pages", F.lit(0)), F.lit(0)).alias("page_no"))


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunks(tree: DataFrame, config: ParserConfig = ParserConfig()) -> DataFrame:
    """doc_id, seq, chunk_id, text, breadcrumb, pages, char_count, paragraph_ids.

    Whole paragraphs of one heading are packed to about chunk_target characters, without anything between them; one over chunk_max is cut
    into pieces of sentences. The fold holds the paragraphs of one heading."""
    item = "struct<ord:int,id:string,text:string,pages:array<int>>"
    made = "array<struct<text:string,ids:array<string>,pages:array<int>>>"
    rows = tree.where("node_type = 'paragraph'").where(X.strip(F.col("text")) != "")
    heads = rows.groupBy("doc_id", "parent_id", "path").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("node_id").alias("id"), X.strip(F.col("text")).alias("text"), "pages").cast(item))).alias("items"))

    def out(acc: Column) -> Column:
        group = F.struct(X.strip(acc["cur"]).alias("text"), F.array_distinct(acc["ids"]).alias("ids"), F.sort_array(F.array_distinct(acc["pages"])).alias("pages"))
        return F.when(X.strip(acc["cur"]) != "", F.concat(acc["out"], F.array(group).cast(made))).otherwise(acc["out"])

    def state(cur, ids, pages, done) -> Column:
        return F.struct(cur.alias("cur"), ids.cast("array<string>").alias("ids"), pages.cast("array<int>").alias("pages"), done.alias("out"))

    empty = F.array()

    def step(acc: Column, x: Column) -> Column:
        cut = F.transform(X.pack_sentences(x["text"], config.chunk_target, config.chunk_max, config.overlap), lambda p: F.struct(p.alias("text"), F.array(x["id"]).alias("ids"), x["pages"].alias("pages")))
        long = state(F.lit(""), empty, empty, F.concat(out(acc), cut.cast(made)))
        full = state(x["text"], F.array(x["id"]), x["pages"], out(acc))
        more = state(F.concat(acc["cur"], x["text"]), F.array_append(acc["ids"], x["id"]), F.concat(acc["pages"], x["pages"]), acc["out"])
        return F.when(F.length(x["text"]) > config.chunk_max, long).when((acc["cur"] != "") & (F.length(acc["cur"]) + F.length(x["text"]) > config.chunk_target), full).otherwise(more)

    zero = state(F.lit(""), empty, empty, F.array().cast(made))
    packed = heads.select("doc_id", "path", "first", F.posexplode(F.aggregate("items", zero, step, out)).alias("at", "c"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "at"))
    packed = packed.withColumn("seq", seq)
    chunk_id = X.short_hash(F.concat_ws("|", "doc_id", F.array_join("path", "/"), F.col("seq").cast("string")))
    return packed.select("doc_id", "seq", chunk_id.alias("chunk_id"), F.col("c.text").alias("text"), F.col("path").alias("breadcrumb"), F.col("c.pages").alias("pages"), F.length("c.text").alias("char_count"), F.col("c.ids").alias("paragraph_ids"))


def chunk_stats(chunk_rows: DataFrame, by: list[str], size: str = "char_count") -> DataFrame:
    """Count, least, largest and average size, rounded to one place; a group without rows is absent."""
    return chunk_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.round(F.avg(size), 1).alias("avg_chars"))


def ingest(lines: DataFrame, toc: DataFrame, config: ParserConfig = ParserConfig(), put: Callable[[DataFrame, str], DataFrame] = as_is) -> dict[str, DataFrame]:
    """All tables of a corpus of lines: clean, headings, nodes, paragraphs, chunks. Lazy, and each computed for itself; with put (session.Tables.put) each is computed once."""
    clean = put(clean_lines(lines, config), "clean")
    heads = put(detect_headings(clean, toc, config), "headings")
    tree = put(nodes(clean, heads, config, put), "nodes")
    return {"clean": clean, "headings": heads, "nodes": tree, "paragraphs": flatten(tree), "chunks": chunks(tree, config)}
