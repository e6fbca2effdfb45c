"""Views for reviewers: question sets by figure with previews, and single sets with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(nn: Column) -> Column:
    """A for the first statement of a set, B for the next."""
    return F.char((nn + 65).cast("bigint"))


def figure_matches(figure_id: Column, query: str) -> Column:
    """Whether one holds the other, in any case, with fig. as figure."""
    q = query.strip().lower().replace("fig.", "figure").replace("fig ", "figure ")
    return F.lower(figure_id).contains(q) | F.contains(F.lit(q), F.lower(figure_id))


def overview(translated: DataFrame, evidence: DataFrame, blueprints: DataFrame) -> DataFrame:
    """One row for each statement and evidence id: set, label, statement in both languages, focus, and 120 characters of the evidence (empty if it is unknown)."""
    store = evidence.select("doc_id", "evidence_id", F.left("text", F.lit(120)).alias("preview")).dropDuplicates(["doc_id", "evidence_id"])
    rows = translated.select("doc_id", "figure_id", "set_id", "nn", label(F.col("nn")).alias("label"), "statement", "statement_zh", "is_correct", "perturbation", "blueprint_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    rows = rows.join(store, ["doc_id", "evidence_id"], "left").join(blueprints.select("doc_id", "blueprint_id", "focus"), ["doc_id", "blueprint_id"], "left")
    return rows.withColumn("preview", F.coalesce("preview", F.lit("")))


def sets_by_figure(translated: DataFrame, figure: str | None = None) -> DataFrame:
    """doc_id, figure_id, set_ids; with a figure, those of the first of a document's figures that it matches."""
    rows = translated.groupBy("doc_id", "figure_id").agg(F.array_sort(F.collect_set("set_id")).alias("set_ids"))
    if figure is None:
        return rows
    hit = rows.where(figure_matches(F.col("figure_id"), figure)).groupBy("doc_id").agg(F.min("figure_id").alias("figure_id"))
    return rows.join(hit, ["doc_id", "figure_id"], "left_semi")


#: The members of a figure's block that a reviewer sees; those of the experiment stay JSON.
EXPERIMENT = ("research_question", "groups", "variables", "conclusions")
FIGURE = f"figure_id string, kind string, status string, confidence double, title string, caption string, {', '.join(f'{c} string' for c in EXPERIMENT)}, panels array<struct<panel_id:string,status:string,title:string>>"


def figure_summaries(documents: DataFrame) -> DataFrame:
    """doc_id, figure_id, kind, status, confidence, title, caption, experiment (member -> its JSON, empty ones left out), panels of the figures of reports (doc_id, json), in order n."""
    rows = documents.select("doc_id", F.posexplode(F.from_json("json", f"figures array<struct<{FIGURE.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>")["figures"]).alias("n", "f"))
    told = F.map_filter(F.create_map(*(x for c in EXPERIMENT for x in (F.lit(c), F.col(f"f.{c}")))), lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))
    plain = [F.col(f"f.{c}").alias(c) for c in ("figure_id", "kind", "status", "confidence", "title", "caption")]
    return rows.select("doc_id", "n", *plain, told.alias("experiment"), F.coalesce("f.panels", F.array().cast("array<struct<panel_id:string,status:string,title:string>>")).alias("panels"))


def question_set(translated: DataFrame, evidence: DataFrame, doc_id: str, set_id: str) -> DataFrame:
    """The statements of one set with their evidence in full."""
    one = translated.where((F.col("doc_id") == doc_id) & (F.col("set_id") == set_id)).select("doc_id", "set_id", "nn", label(F.col("nn")).alias("label"), "statement", "statement_zh", "is_correct", "method", F.explode("evidence_ids").alias("evidence_id"))
    return one.join(evidence.select("doc_id", "evidence_id", "text", "role", "evidence_type", "section_type", "page_no", "paragraph_id"), ["doc_id", "evidence_id"], "left")
