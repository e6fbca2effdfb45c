"""A paper's report: the document of its figures as JSON, a Markdown companion, its evidence and experiments, and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import figures as G
from ..operators import semantics as S

UNIT = ["doc_id", "unit"]
#: Fixed value: the order of evidence types in a histogram.
TYPE_ORDER = ("direct_observation", "experimental_design", "statistical_result", "author_interpretation", "mixed")
METHOD = "deterministic"


def preview(text: Column, limit: int = 96) -> Column:
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t)


def members(*cols: Column) -> Column:
    """The members of a JSON object without its braces, nulls included."""
    j = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return F.substring(j, F.lit(2), F.length(j) - 2)


def member(name: str, json: Column) -> Column:
    """One member whose value is JSON already; null where that is."""
    return F.concat(F.lit(f'"{name}":'), json)


def an_object(*parts: Column) -> Column:
    """A JSON object of members; those that are null or empty are left out."""
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ","), F.lit("}"))


def counted(pairs: list[tuple[str, Column]], keep_zero: bool) -> Column:
    """Members of names and counts; counts of 0 go unless they are kept."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.lit(keep_zero) | (n > 0), F.concat(F.lit(f'"{k}":'), n.cast("string"))) for k, n in pairs))), ",")


def in_order(df: DataFrame, by: list[str], order: str, name: str, *cols: Column) -> DataFrame:
    """One row for each key with its rows as an array of structs in an order."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("_v")))).alias(name))
    return rows.withColumn(name, F.transform(name, lambda x: x["_v"]))


def text_blocks(flow: DataFrame) -> DataFrame:
    """doc_id, figure_id, anchors, continuations, shared_with: the paragraphs that belong to each figure, and the other figures that its anchors cite."""
    rows = flow.where("owner is not null").groupBy("doc_id", F.col("owner").alias("figure_id"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("ord", "paragraph_id", "assignment", "shared"))).alias("p"))

    def of(kind: str) -> Column:
        return F.transform(F.filter("p", lambda x: x["assignment"] == kind), lambda x: x["paragraph_id"])

    return rows.select("doc_id", "figure_id", of("anchor").alias("anchors"), of("continuation").alias("continuations"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["shared"]))).alias("shared_with"))


def histogram(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The keys with n_evidence and, for each type, its count."""
    return evidence.groupBy(*by).agg(F.count(F.lit(1)).alias("n_evidence"), *(F.count_if(F.col("evidence_type") == t).alias(f"n_{t}") for t in TYPE_ORDER))


def figure_rows(sem: dict[str, DataFrame]) -> DataFrame:
    """One row for each figure with all that a report says of it; sem: semantics.reconstruct()."""
    of_unit = sem["units"].join(sem["experiments"].drop("evidence_ids"), UNIT).join(sem["verdicts"], UNIT)
    evidence = in_order(sem["evidence"], UNIT, "n", "evidence", F.col("evidence_id").alias("id"))
    obs = in_order(sem["observations"], UNIT, "i", "obs", F.col("statement"), F.col("direction"), F.col("significance"), F.col("relationship"), F.col("p_value"), F.array("evidence_id").alias("evidence"))
    ints = in_order(sem["interpretations"], UNIT, "i", "ints", F.col("interpretation_id").alias("id"), F.col("statement"), F.col("direction"), F.col("relationship"), F.array("evidence_id").alias("evidence"))
    cons = in_order(sem["conclusions"], UNIT, "c", "cons", F.col("statement"), F.col("relationship"), F.array("evidence_id").alias("evidence"), F.col("interpretation_ids").alias("interpretations"))
    with_ids = of_unit.join(evidence, UNIT, "left").withColumn("evidence", F.coalesce(F.transform("evidence", lambda x: x["id"]), F.array().cast("array<string>")))
    panel = with_ids.where("panel <> ''").withColumn("panel_id", F.concat(F.col("number").cast("string"), "panel"))
    title = F.left(F.trim(F.substring_index(F.coalesce("caption", F.lit("")), ". ", 1)), F.lit(120))
    panels = in_order(panel, ["doc_id", "figure_id"], "panel", "panels", F.col("panel_id"), F.col("status"), F.col("confidence"), title.alias("title"), F.col("missing").alias("missing_information"), F.col("experiment_id"), F.col("evidence"))
    kinds = sem["figures"].select("doc_id", "figure_id", "kind")
    figs = with_ids.where("panel = ''").join(kinds, ["doc_id", "figure_id"]).join(panels, ["doc_id", "figure_id"], "left").join(text_blocks(sem["flow"]), ["doc_id", "figure_id"], "left")
    figs = figs.join(obs, UNIT, "left").join(ints, UNIT, "left").join(cons, UNIT, "left").join(histogram(sem["evidence"], UNIT), UNIT, "left")
    lists = {c: F.coalesce(c, F.expr(f"cast(array() as {t})")) for c, t in [(f.name, f.dataType.simpleString()) for f in figs.schema.fields if f.name in ("obs", "ints", "cons")]}
    figs = figs.withColumns({**lists, **{f"n_{t}": F.coalesce(f"n_{t}", F.lit(0)) for t in TYPE_ORDER}, "n_evidence": F.coalesce("n_evidence", F.lit(0)), "caption": F.coalesce("caption", F.lit(""))})
    return figs.withColumn("title", G.title_from_caption(F.col("caption")))


def types() -> list[tuple[str, Column]]:
    return [(t, F.col(f"n_{t}")) for t in TYPE_ORDER]


def figure_json() -> Column:
    """Over figure_rows(): a figure's block, evidence by id."""
    head = members(F.col("figure_id"), F.col("kind"), F.col("status"), F.col("confidence"), F.lit(METHOD).alias("method"), F.col("title"), F.col("caption"), F.col("research_question"))
    groups = members(F.struct(F.col("experimental_groups").alias("experimental"), F.col("control_groups").alias("control")).alias("groups"), F.struct(F.col("independent_variables").alias("independent"), F.col("dependent_variables").alias("dependent")).alias("variables"))
    told = members(F.col("obs").alias("observations"), F.col("ints").alias("interpretations"), F.col("cons").alias("conclusions"), F.col("statistical_results"))
    missing = F.when(F.size("missing") > 0, members(F.col("missing").alias("missing_information")))
    panels = F.when(F.size("panels") > 0, members(F.col("panels")))
    block = F.struct("anchors", "continuations", "shared_with", (F.size("anchors") + F.size("continuations")).alias("paragraph_count"))
    text = F.when(F.col("anchors").isNotNull(), members(block.alias("text_block")))
    return an_object(head, groups, told, missing, panels, text, members(F.col("evidence")), member("evidence_by_type", an_object(counted(types(), False))))


def summaries(sem: dict[str, DataFrame]) -> DataFrame:
    """doc_id with counts of figures and panels by status, and of different evidence by type."""
    units = sem["units"].join(sem["verdicts"], UNIT)
    parts = [("figures", F.col("panel") == ""), ("panels", F.col("panel") != "")]
    counts = units.groupBy("doc_id").agg(*(F.count_if(c).alias(k) for k, c in parts), *(F.count_if(c & (F.col("status") == s)).alias(f"{k}_{s}") for k, c in parts for s in S.STATUSES))
    return counts.join(histogram(S.evidence_store(sem["evidence"]), ["doc_id"]), "doc_id", "left").na.fill(0)


def backgrounds(background: DataFrame) -> DataFrame:
    """doc_id, abstract, introduction: structs, null where a paper has none."""
    one = F.struct("text", "source", "paragraph_ids", "pages")
    return background.groupBy("doc_id").agg(*(F.max(F.when(F.col("part") == p, one)).alias(p) for p in ("abstract", "introduction")))


def figure_documents(sem: dict[str, DataFrame], background: DataFrame) -> DataFrame:
    """doc_id, json: background, summary, then each figure's block in order. background: figures.background()."""
    told = figure_rows(sem).select("doc_id", F.col("fig_n"), figure_json().alias("j"))
    told = told.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fig_n", "j"))), lambda x: x["j"]), ",").alias("blocks"))
    rows = summaries(sem).join(told, "doc_id").join(backgrounds(background), "doc_id", "left")
    intro = F.col("introduction")
    back = an_object(
        member("abstract", F.coalesce(F.to_json("abstract"), F.lit("{}"))),
        member("introduction", F.coalesce(F.when(intro.isNotNull(), F.to_json(F.struct(intro["text"].alias("text"), intro["paragraph_ids"].alias("paragraph_ids"), intro["pages"].alias("pages")))), F.lit("{}"))),
    )

    def of(name: str) -> Column:
        return member(name, an_object(counted([("total", F.col(name)), *((s, F.col(f"{name}_{s}")) for s in S.STATUSES)], True)))

    units = member("evidence_units", an_object(counted([("total", F.col("n_evidence"))], True), counted(types(), False)))
    body = an_object(members(F.col("doc_id")), member("background", back), member("summary", an_object(of("figures"), of("panels"), units)), member("figures", F.concat(F.lit("["), "blocks", F.lit("]"))))
    return rows.select("doc_id", body.alias("json"))


def listed(ids: Column) -> Column:
    return F.concat(F.lit("["), F.when(F.size(ids) > 0, F.array_join(ids, ", ")).otherwise("-"), F.lit("]"))


def figure_lines() -> Column:
    """Over figure_rows(): the lines of a figure's section; null lines are left out by the caller."""
    sure = F.col("status") != "INSUFFICIENT"

    def said(o: Column) -> Column:
        flags = F.concat(F.lit("direction="), o["direction"], *(F.when(o[k] != "unspecified", F.concat(F.lit(", "), o[k])).otherwise("") for k in ("significance", "relationship")))
        return F.concat(F.lit("- **OBS** "), preview(o["statement"]), F.lit(" — "), flags, F.lit(" "), listed(o["evidence"]))

    def linked(c: Column) -> Column:
        by = F.when(F.size(c["interpretations"]) > 0, F.concat(F.lit(" ← "), F.array_join(c["interpretations"], ", "))).otherwise("")
        return F.concat(F.lit("- **CON** "), c["statement"], F.lit(" "), listed(c["evidence"]), by)

    def or_mark(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("?")

    groups = (F.size("experimental_groups") > 0) | (F.size("control_groups") > 0)
    shared = F.when(F.size("shared_with") > 0, F.concat(F.lit(", shared with "), F.array_join("shared_with", ", "))).otherwise("")
    n_text = (F.size("anchors") + F.size("continuations")).cast("string")
    kinds = F.array_join(F.array_compact(F.array(*(F.when(n > 0, F.concat(F.lit(f"{t} "), n.cast("string"))) for t, n in types()))), ", ")
    head = F.array(
        F.format_string(f"## %s — %s (confidence %.2f, {METHOD})", "figure_id", "status", "confidence"),
        F.when(F.col("title") != "", F.concat(F.lit("**Caption:** "), preview(F.col("caption"), 160))),
        F.when(sure & (F.col("research_question") != ""), F.concat(F.lit("**Q:** "), "research_question")),
        F.when(sure & groups, F.concat(F.lit("**Groups:** "), or_mark("experimental_groups"), F.lit(" vs "), or_mark("control_groups"))),
        F.when(sure & (F.size("dependent_variables") > 0), F.concat(F.lit("**DV:** "), F.array_join(F.slice("dependent_variables", 1, 3), ", "))),
        F.when(sure, ""),
    )
    none = F.array().cast("array<string>")
    told = F.when(sure, F.concat(F.transform("obs", said), F.transform("ints", lambda i: F.concat(F.lit("- **INT** "), preview(i["statement"]), F.lit(" "), listed(i["evidence"]))), F.transform("cons", linked))).otherwise(none)
    tail = F.array(
        F.when((F.col("status") != "SUFFICIENT") & (F.size("missing") > 0), F.concat(F.lit("**Missing:** "), F.array_join("missing", "; "))),
        F.when(F.col("anchors").isNotNull(), F.concat(F.lit("**Text block:** "), n_text, F.lit(" paragraphs ("), F.size("anchors").cast("string"), F.lit(" anchored, "), F.size("continuations").cast("string"), F.lit(" continuation"), shared, F.lit(")"))),
        F.when(F.size("panels") > 0, F.concat(F.lit("**Panels:** "), F.array_join(F.transform("panels", lambda p: F.format_string("%s %s(%.2f)", p["panel_id"], p["status"], p["confidence"])), " · "))),
        F.concat(F.lit("**Evidence:** "), F.col("n_evidence").cast("string"), F.lit(" units ("), kinds, F.lit(")")),
        F.lit(""),
    )
    return F.array_join(F.array_compact(F.concat(head, told, tail)), "\n")


def report_markdown(sem: dict[str, DataFrame], background: DataFrame) -> DataFrame:
    """doc_id, markdown: background, counts by status, then a section for each figure in order; without a time, so that reruns agree."""
    sections = figure_rows(sem).select("doc_id", "fig_n", figure_lines().alias("s")).groupBy("doc_id")
    sections = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fig_n", "s"))), lambda x: x["s"]), "\n").alias("body"))
    rows = summaries(sem).join(sections, "doc_id").join(backgrounds(background), "doc_id", "left")

    def extract(part: str) -> Column:
        return F.when(F.col(part).isNotNull(), F.concat(F.lit(f"**{part.capitalize()}** "), preview(F.col(part)["text"], 600), F.lit("\n")))

    def status(name: str) -> Column:
        return F.concat(F.lit("**"), F.col(name).cast("string"), F.lit(f" {name}**"), *(x for s in S.STATUSES for x in (F.lit(f" · {s} "), F.col(f"{name}_{s}").cast("string"))))

    lines = F.array(F.concat(F.lit("# "), "doc_id", F.lit(" — Figure Semantic Reconstruction\n")), extract("abstract"), extract("introduction"), status("figures"), F.concat(status("panels"), F.lit("\n")), F.col("body"))
    return rows.select("doc_id", F.array_join(F.array_compact(lines), "\n").alias("markdown"))


def reading_index(sem: dict[str, DataFrame], paragraphs: DataFrame) -> DataFrame:
    """doc_id, json: paragraphs by section type as they first stand, the figures with their verdicts, and how much of the flow is assigned."""
    first = paragraphs.groupBy("doc_id", "section_type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("at"))
    part = F.concat(F.to_json(F.array("section_type")), F.lit(":"), F.col("n").cast("string"))
    counts = first.select("doc_id", "at", F.regexp_replace(part, r"^\[(.*)\]:", "$1:").alias("p")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]), ",").alias("counts"))
    told = sem["figures"].join(sem["units"].where("panel = ''").join(sem["verdicts"], UNIT).select("doc_id", "figure_id", "status"), ["doc_id", "figure_id"], "left")
    told = in_order(told, ["doc_id"], "n", "inventory", F.col("figure_id"), F.col("kind"), F.col("status"), F.left(G.title_from_caption(F.coalesce("caption_text", F.lit(""))), F.lit(80)).alias("caption"))
    flow = sem["flow"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("flow_paragraphs"), F.count_if(F.col("assignment") == "anchor").alias("anchors"), F.count_if(F.col("assignment") == "continuation").alias("continuations"))
    both = F.col("anchors") + F.col("continuations")
    share = F.struct(F.lit("L1-deterministic").alias("method"), "flow_paragraphs", both.alias("assigned"), "anchors", "continuations", (F.col("flow_paragraphs") - both).alias("unassigned"), F.round(both / F.col("flow_paragraphs"), 3).alias("coverage"))
    rows = counts.join(told, "doc_id", "left").join(flow, "doc_id", "left")
    inventory = F.coalesce(F.to_json("inventory", {"ignoreNullFields": "false"}), F.lit("[]"))
    return rows.select("doc_id", an_object(member("section_paragraph_counts", F.concat(F.lit("{"), "counts", F.lit("}"))), member("figure_inventory", inventory), F.when(F.col("flow_paragraphs").isNotNull(), members(share.alias("partition")))).alias("json"))


def report(sem: dict[str, DataFrame], background: DataFrame, paragraphs: DataFrame, hashes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five artifacts as tables by document: figures and report (one text each), evidence (one JSON line for each id, in order), experiments (one for
    each unit, in order), and the manifest's JSON without a time. hashes: doc_id, input_hash (artifacts.file_hashes)."""
    store = S.evidence_store(sem["evidence"])
    evidence = store.select("doc_id", "unit", "n", F.to_json(F.struct(*(c for c in store.columns if c not in ("doc_id", "n"))), {"ignoreNullFields": "false"}).alias("json"))
    exps = sem["experiments"].join(sem["units"].select(*UNIT, "figure_id", "panel", "fig_n"), UNIT)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("fig_n", F.when(F.col("panel") == "", 0).otherwise(1), "unit"))
    experiments = exps.select("doc_id", place.alias("n"), F.to_json(F.struct(*(c for c in exps.columns if c not in ("doc_id", "fig_n"))), {"ignoreNullFields": "false"}).alias("json"))
    rows = summaries(sem).join(reading_index(sem, paragraphs).withColumnRenamed("json", "reading"), "doc_id", "left")
    rows = rows.join(hashes, "doc_id", "left") if hashes is not None else rows.withColumn("input_hash", F.lit(None).cast("string"))

    def by_status(name: str, key: str) -> Column:
        return member(key, an_object(counted([(s, F.col(f"{name}_{s}")) for s in S.STATUSES], True)))

    files = F.lit('"files":{"figures":"figures.json","evidence":"evidence.jsonl","experiments":"experiments.json","report":"report.md"}')
    manifest = an_object(members(F.col("doc_id"), F.col("figures").alias("num_figures")), by_status("figures", "status_counts"), by_status("panels", "panel_status_counts"), member("reading_index", F.col("reading")), files, members(F.col("input_hash").alias("input_document_sha256")))
    return {"figures": figure_documents(sem, background), "evidence": evidence, "experiments": experiments, "report": report_markdown(sem, background), "manifest": rows.select("doc_id", manifest.alias("json"))}
