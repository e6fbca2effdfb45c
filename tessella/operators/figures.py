"""Figure and table references in paragraphs, and the partition of the narrative by figure.

Paragraphs: doc_id, ord, paragraph_id, text, section_type, section_title, page_no."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

CAPTION_MAX = 400


def namespace(prefix: Column) -> Column:
    p = F.regexp_replace(F.replace(F.lower(X.strip(F.coalesce(prefix, F.lit("")))), F.lit("."), F.lit("")), r"(?U)\s+", " ")
    return F.when(p.startswith("extended data"), "Extended Data").when(p.startswith("suppl"), "Supplementary").otherwise("")


def canonical(kind: Column, number: Column, prefix: Column) -> Column:
    return F.trim(F.concat(prefix, F.lit(" "), F.when(kind == "figure", "Figure").otherwise("Table"), F.lit(" "), number.cast("string")))


def figure_key(figure_id: Column, kind: Column, number: Column) -> Column:
    """f02, t01, edf01, sf02: a short key that is unique in its document."""
    low = F.lower(figure_id)
    space = F.when(low.startswith("extended data "), "ed").when(low.startswith("supplementary "), "s").otherwise("")
    return F.concat(space, F.when(kind == "figure", "f").otherwise("t"), F.format_string("%02d", number))


def namespace_rank(figure_id: Column) -> Column:
    return F.when(figure_id.startswith("Extended Data "), 1).when(figure_id.startswith("Supplementary "), 2).otherwise(0)


def mention_array(text: Column) -> Column:
    """All mentions in order: at, seq, kind, number, panel (upper case or empty), raw, prefix.

    Of a list ("Figures 2 and 3", "2-4") the second number is a mention too if it is larger by less than ten; numbers between are not."""
    item = "struct<at:int,seq:int,kind:string,number:int,panel:string,raw:string,prefix:string>"

    def of(kind: str, pattern: str, seq: int) -> Column:
        def each(m: Column) -> Column:
            number, extra = m["g2"].try_cast("int"), m["g4"].try_cast("int")
            # the form up to the panel, or to the number without one: it ends where the last of them does
            head = F.regexp_extract(m["m"], r"(?s)^(.*?" + r"\d+" + r")", 1)
            raw = F.when(m["g3"] != "", F.regexp_extract(m["m"], r"(?iUs)^(.*?\d+\s*[A-Za-z])(?![A-Za-z0-9])", 1)).otherwise(head)
            first = F.struct(m["at"].alias("at"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), number.alias("number"), F.upper(m["g3"]).alias("panel"), X.strip(raw).alias("raw"), namespace(m["g1"]).alias("prefix"))
            more = F.struct(m["stop"].alias("at"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), extra.alias("number"), F.lit("").alias("panel"), F.concat(F.lit(kind.title() + " "), m["g4"]).alias("raw"), namespace(m["g1"]).alias("prefix"))
            return F.when((m["g4"] != "") & (extra - number > 0) & (extra - number < 10), F.array(first.cast(item), more.cast(item))).otherwise(F.array(first.cast(item)))

        # without the label's first letters there is no match
        return F.when(text.rlike(P.I + kind[:3]), F.flatten(F.transform(X.match_spans(text, pattern, 4), each))).otherwise(F.array().cast(f"array<{item}>"))

    return F.filter(F.array_sort(F.concat(of("figure", P.FIGURE_MENTION, 0), of("table", P.TABLE_MENTION, 1))), lambda m: m["number"].isNotNull())


def label(text: Column, pattern: str) -> Column:
    """kind, number, panel, raw, prefix of the label that the pattern finds first; null without one."""
    hit = F.regexp_extract(text, pattern, 0)
    prefix, number, panel = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    head = X.strip(F.regexp_extract(hit, r"(?s)^(.*?)\d", 1))
    kind = F.when(head.rlike(P.TABLE_START), "table").otherwise("figure")
    raw = F.trim(F.concat(head, F.lit(" "), number, F.upper(panel)))
    return F.when(hit != "", F.struct(kind.alias("kind"), number.try_cast("int").alias("number"), F.upper(panel).alias("panel"), raw.alias("raw"), namespace(prefix).alias("prefix")))


def truncate_caption(text: Column, limit: int) -> Column:
    return X.char_budget(text, limit)


def captions(paragraphs: DataFrame, limit: int = CAPTION_MAX) -> DataFrame:
    """Paragraphs with cap (the label, null without a caption), caption_text, caption_at, and the parts to scan for mentions.

    A caption starts its paragraph, which is then short enough and not scanned, or follows its label with a pipe anywhere, cut to whole sentences."""
    start, inline = label(F.col("text"), P.CAPTION_START), F.when(F.contains("text", F.lit("|")), label(F.col("text"), P.INLINE_CAPTION))
    at = F.regexp_instr("text", F.lit(P.INLINE_CAPTION)) - 1
    rows = paragraphs.withColumns({"_start": F.when(F.length("text") <= limit, start), "_inline": inline, "_at": at})
    tail = F.substring(F.col("text"), F.col("_at") + 1, F.lit(2147483647))
    rows = rows.withColumn("_tail", F.when(F.length(tail) > limit, truncate_caption(tail, limit)).otherwise(tail))
    use = F.col("_start").isNull() & F.col("_inline").isNotNull()
    return rows.select(
        *paragraphs.columns,
        F.coalesce("_start", "_inline").alias("cap"),
        F.when(F.col("_start").isNotNull(), F.col("text")).when(use, F.col("_tail")).alias("caption_text"),
        F.when(F.col("_start").isNotNull(), 0).when(use, F.col("_at")).alias("caption_at"),
        F.when(F.col("_start").isNotNull(), F.array().cast("array<string>")).when(use, F.array(F.substring(F.col("text"), F.lit(1), F.col("_at")), F.col("_tail"))).otherwise(F.array("text")).alias("scan"),
    )


def mentions(caps: DataFrame) -> DataFrame:
    """doc_id, ord, paragraph_id, section_type, part, at, figure_id, kind, number, panel, raw, prefix, own (of the paragraph's own caption). caps: captions()."""
    own = canonical(F.col("cap.kind"), F.col("cap.number"), F.col("cap.prefix"))
    rows = caps.select("doc_id", "ord", "paragraph_id", "section_type", own.alias("own_id"), F.posexplode("scan").alias("part", "t"))
    rows = rows.select("*", F.explode(mention_array(F.col("t"))).alias("m"))
    fid = canonical(F.col("m.kind"), F.col("m.number"), F.col("m.prefix"))
    return rows.select("doc_id", "ord", "paragraph_id", "section_type", "part", F.col("m.at").alias("at"), F.col("m.seq").alias("seq"), fid.alias("figure_id"), "m.kind", "m.number", "m.panel", "m.raw", "m.prefix", F.coalesce(fid == F.col("own_id"), F.lit(False)).alias("own"))


def caption_panels(caption: Column) -> Column:
    """label -> text: a caption cut before "a, Left ..."; of a label's chunks the first counts. Empty without panels."""
    spans = X.match_spans(caption, P.PANEL_BOUNDARY, 1)
    ends = F.concat(F.slice(F.transform(spans, lambda s: s["at"]), 2, F.greatest(F.size(spans), F.lit(1))), F.array(F.length(caption)))
    parts = F.zip_with(spans, ends, lambda s, e: F.struct(F.lower(s["g1"]).alias("k"), X.strip(F.substring(caption, s["at"] + 1, e - s["at"])).alias("v")))
    seen = F.aggregate(
        F.filter(parts, lambda p: p["k"].isNotNull()),
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.array_append(acc, p)),
    )
    return F.map_from_entries(seen)


def registry(paragraphs: DataFrame, limit: int = CAPTION_MAX, put: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """figures: doc_id, figure_id, key, kind, number, n (place in the document), raw_forms, subfigures, caption_id, caption_text, caption_ord, panel_texts;
    mentions; panels: doc_id, figure_id, label, text (null where only cited). A later caption of a figure takes the place of an earlier one.
    put: writes captions and mentions, which are read several times, so that no pattern is matched again; without it all stay lazy."""
    caps = put(captions(paragraphs.drop("cited"), limit), "captions")
    found = put(mentions(caps), "mentions")
    owned = caps.where("cap is not null").withColumn("figure_id", canonical(F.col("cap.kind"), F.col("cap.number"), F.col("cap.prefix")))
    cap = owned.groupBy("doc_id", "figure_id").agg(F.max_by(F.struct("paragraph_id", "caption_text", "ord"), "ord").alias("c"))
    both = found.select("doc_id", "figure_id", "kind", "number").union(owned.select("doc_id", "figure_id", "cap.kind", "cap.number")).distinct()
    seen = found.where("not own")
    forms = owned.select("doc_id", "figure_id", "ord", F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(0).alias("seq"), "cap.raw", F.col("cap.panel").alias("sub")).unionByName(
        seen.select("doc_id", "figure_id", "ord", "part", "at", "seq", "raw", F.when(F.col("panel") != "", F.concat(F.col("number").cast("string"), "panel")).otherwise("").alias("sub"))
    )
    order = ["ord", "part", "at", "seq"]
    raws = X.ordered_distinct(forms, ["doc_id", "figure_id"], "raw", order, name="raw_forms")
    subs = X.ordered_distinct(forms.where("sub <> ''"), ["doc_id", "figure_id"], "sub", order, name="subfigures")
    none = F.array().cast("array<string>")
    figs = both.join(cap, ["doc_id", "figure_id"], "left").join(raws, ["doc_id", "figure_id"], "left").join(subs, ["doc_id", "figure_id"], "left")
    place = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "figure", 0).otherwise(1), namespace_rank(F.col("figure_id")), "number")
    figs = figs.select("doc_id", "figure_id", figure_key(F.col("figure_id"), F.col("kind"), F.col("number")).alias("key"), "kind", "number", F.row_number().over(place).alias("n"), F.coalesce("raw_forms", none).alias("raw_forms"), F.coalesce("subfigures", none).alias("subfigures"), F.col("c.paragraph_id").alias("caption_id"), F.col("c.caption_text").alias("caption_text"), F.col("c.ord").alias("caption_ord"))
    figs = figs.withColumn("panel_texts", F.when(F.col("caption_text").isNotNull(), caption_panels(F.col("caption_text"))))
    told = figs.select("doc_id", "figure_id", F.explode("panel_texts").alias("label", "text"))
    cited = seen.where("panel <> ''").select("doc_id", "figure_id", F.lower("panel").alias("label"), F.lit(None).cast("string").alias("text"))
    panels = told.union(cited).groupBy("doc_id", "figure_id", "label").agg(F.max("text").alias("text"))
    return {"figures": figs, "mentions": found, "panels": panels}


# --- partition --------------------------------------------------------------------------------------------------------


def cited(paragraphs: DataFrame) -> DataFrame:
    """doc_id, ord, cited: the distinct figures that whole paragraphs cite, in order; a registry knows all of them but labels of its own captions.

    Paragraphs that have the column already are returned as they are."""
    if "cited" in paragraphs.columns:
        return paragraphs
    ids = F.array_distinct(F.transform(mention_array(F.col("text")), lambda m: canonical(m["kind"], m["number"], m["prefix"])))
    return paragraphs.withColumn("cited", ids)


def partition(paragraphs: DataFrame, figures: DataFrame) -> DataFrame:
    """The flow with owner, assignment (anchor, continuation or null before the first anchor) and shared (the others that an anchor cites).

    The flow is the results sections, or without any the results and other paragraphs from the first to the last citing one. A citing paragraph belongs
    to the figure it cites first, others to the owner before them: a forward fill in document order."""
    known = figures.groupBy("doc_id").agg(F.collect_set("figure_id").alias("known"))
    rows = cited(paragraphs).join(known, "doc_id", "left").withColumn("cited", F.filter("cited", lambda f: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), f))).drop("known")
    doc = Window.partitionBy("doc_id")
    anchor = F.when(F.size("cited") > 0, F.col("ord"))
    rows = rows.withColumns({"has": F.max(F.when(F.col("section_type") == "results", 1).otherwise(0)).over(doc), "lo": F.min(anchor).over(doc), "hi": F.max(anchor).over(doc)})
    inside = F.when(F.col("has") == 1, F.col("section_type") == "results").otherwise(F.col("section_type").isin("results", "other") & F.col("ord").between(F.col("lo"), F.col("hi")))
    flow = rows.where(inside)
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.get("cited", F.lit(0)), ignorenulls=True).over(order)
    out = flow.withColumn("owner", owner)
    kind = F.when(F.size("cited") > 0, "anchor").when(F.col("owner").isNotNull(), "continuation")
    return out.withColumn("assignment", kind).withColumn("shared", F.slice("cited", 2, F.greatest(F.size("cited"), F.lit(1)))).drop("has", "lo", "hi")


def partition_coverage(flow: DataFrame) -> DataFrame:
    """doc_id, flow paragraphs, assigned ones and their share to 3 places."""
    return flow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_flow"), F.count_if(F.col("owner").isNotNull()).alias("n_assigned"), F.round(F.count_if(F.col("owner").isNotNull()) / F.count(F.lit(1)), 3).alias("coverage"))


# --- background -------------------------------------------------------------------------------------------------------


def is_caption_like(text: Column) -> Column:
    return text.rlike(P.CAPTION_START) | F.left(text, F.lit(120)).rlike(P.INLINE_CAPTION)


def looks_like_authors(text: Column) -> Column:
    """Whether four tenths of the words carry a letter before a digit or start with a digit."""
    words = F.split(X.strip(text), r"(?U)\s+")
    marked = F.filter(words, lambda w: w.rlike("[a-zA-Z][0-9]") | w.rlike(r"(?U)^\d"))
    return (X.strip(text) != "") & (F.size(marked) / F.size(words) >= 0.4)


def usable(text: Column, min_words: int = 10) -> Column:
    return (X.n_split(text) >= min_words) & ~is_caption_like(text) & ~looks_like_authors(text)


def background(paragraphs: DataFrame, words: int = 400, chars: int = 1500) -> DataFrame:
    """doc_id, part (abstract or introduction), text, source, paragraph_ids, pages: extracts in the authors' words.

    The abstract is its section, else the longest usable paragraph (the first of a tie) before the first main section and the first citing paragraph. The
    introduction is its section within `chars`, else the usable introduction and other paragraphs before the first citing paragraph, or without any
    the first methods or results paragraph, within `words`, without the abstract's own."""
    # usable() comes last in its conditions, so that its patterns meet few paragraphs
    rows, ok = cited(paragraphs), usable(F.col("text"))
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumns(
        {
            "cite": F.min(F.when(F.size("cited") > 0, F.col("ord"))).over(doc),
            "main": F.min(F.when(F.col("section_type").isin("introduction", "methods", "results", "discussion"), F.col("ord"))).over(doc),
            "body": F.min(F.when(F.col("section_type").isin("methods", "results"), F.col("ord"))).over(doc),
            "has_abstract": F.max(F.col("section_type") == "abstract").over(doc),
            "has_intro": F.max(F.col("section_type") == "introduction").over(doc),
        }
    )
    big = F.lit(2147483647)
    rows = rows.withColumn("leading", ~F.col("has_abstract") & (F.col("ord") < F.least(F.coalesce("main", big), F.coalesce("cite", big))) & ok)
    leading = F.col("leading")
    longest = F.max(F.when(leading, F.struct(X.n_split(F.col("text")).alias("w"), (-F.col("ord")).alias("o")))).over(doc)
    rows = rows.withColumn("pick", F.coalesce(-longest["o"] == F.col("ord"), F.lit(False)) & leading)
    rows = rows.withColumn("abstract", F.when(F.col("has_abstract"), F.col("section_type") == "abstract").otherwise(F.col("pick")))
    free = ~F.col("abstract") & F.col("section_type").isin("introduction", "other") & (F.col("ord") < F.coalesce("cite", "body", big)) & ok
    rows = rows.withColumn("intro", F.when(F.col("has_intro"), F.col("section_type") == "introduction").otherwise(free))
    part = F.explode(F.array_compact(F.array(F.when(F.col("abstract"), F.lit("abstract")), F.when(F.col("intro"), F.lit("introduction")))))
    each = rows.select("doc_id", "ord", "paragraph_id", "text", "page_no", "has_abstract", "has_intro", part.alias("part"))
    items = each.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "paragraph_id", "text"))).alias("p"), F.sort_array(F.collect_set(F.when(F.col("page_no") != 0, F.col("page_no")))).alias("pages"), F.first("has_abstract").alias("ha"), F.first("has_intro").alias("hi"))
    full = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    cut = F.when(F.col("part") == "abstract", F.when(F.col("ha") | (X.n_split(full) <= words), full).otherwise(X.word_budget(full, words)))
    cut = cut.otherwise(F.when(F.col("hi"), F.when(F.length(full) <= chars, full).otherwise(X.char_budget(full, chars))).otherwise(X.word_budget(full, words)))
    source = F.when(F.col("part") == "introduction", "").when(F.col("ha"), "abstract_heading").otherwise("leading_paragraphs")
    return items.select("doc_id", "part", cut.alias("text"), source.alias("source"), F.transform("p", lambda x: x["paragraph_id"]).alias("paragraph_ids"), "pages")


def title_from_caption(caption: Column, limit: int = 120) -> Column:
    bare = F.regexp_replace(caption, P.CAPTION_START, "")
    return F.left(X.strip(F.substring_index(bare, ". ", 1)), F.lit(limit))


def figure_queries(figures: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, figure_id, unit, text: what to search for a figure by, its id and the first content words of its caption."""
    terms = F.slice(X.content_words(F.coalesce("caption_text", F.lit(""))), 1, words)
    return figures.select("doc_id", "figure_id", F.col("key").alias("unit"), F.array_join(F.concat(F.array("figure_id"), terms), " ").alias("text"))


def reading_index(paragraphs: DataFrame) -> DataFrame:
    """doc_id, section_type, n paragraphs."""
    return paragraphs.groupBy("doc_id", "section_type").agg(F.count(F.lit(1)).alias("n"))
