"""Numeric findings and question blueprints, each bound to evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

UNIT = ["doc_id", "unit"]
MAX_RI, MAX_ED, MAX_PRED, MAX_DS = 3, 3, 1, 4
#: Relationships that license a prediction, and those that are no cause.
LICENSED = ["causal", "inhibition", "activation", "knockout", "overexpression", "dose_response"]
NON_CAUSAL = ["association", "correlation"]
TYPES = {"RESULT_INTERPRETATION": "ri", "EXPERIMENTAL_DESIGN": "ed", "SIMPLE_PREDICTION": "pred", "DATA_STATEMENT": "ds"}


def is_panel_reference(value: Column, sentence: Column) -> Column:
    """Whether a glued number and letter ("1g") is a panel that is cited, by what stands around its first place."""
    at = F.position(value, sentence)
    after = F.substring(sentence, at + F.length(value), F.lit(1))
    start = F.greatest(at - 10, F.lit(1))
    before = F.substring(sentence, start, at - start)
    return value.rlike(P.PANEL_GLUE) & (at > 0) & (after.isin(")", ",", ";") | before.rlike(P.FIGURE_CONTEXT))


def numeric_findings(evidence: DataFrame) -> DataFrame:
    """doc_id, unit, f, kind, value, sentence, evidence_id, evidence_type: literal quantities of reported results, in order of evidence, sentence, kind and place."""
    rows = evidence.where("assignment <> 'continuation' and role in ('caption', 'direct') and evidence_type in ('direct_observation', 'statistical_result')")
    rows = rows.select(*UNIT, "n", "evidence_id", "evidence_type", F.posexplode(X.sentences(F.col("text"))).alias("s", "sentence"))
    item = "array<struct<k:int,kind:string,at:int,value:string>>"

    def of(k: int, kind: str, pattern: str) -> Column:
        return F.transform(X.all_matches(F.col("sentence"), pattern), lambda v, i: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), i.alias("at"), F.regexp_replace(v, r"(?U)\s+", " ").alias("value"))).cast(item)

    found = F.concat(*(of(k, kind, p) for k, (kind, p) in enumerate(P.NUMERIC_KINDS)))
    rows = rows.select("*", F.explode(found).alias("x")).select("*", "x.*").where(~is_panel_reference(F.col("value"), F.col("sentence")))
    f = F.row_number().over(Window.partitionBy(*UNIT).orderBy("n", "s", "k", "at"))
    return rows.select(*UNIT, f.alias("f"), "kind", "value", "sentence", "evidence_id", "evidence_type")


def first(c: str) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def union_ids(ids: Column, more: Column) -> Column:
    return F.array_union(ids, more)


DETAIL = ["relationship", "direction", "significance", "cmp_experimental", "cmp_control", "cmp_endpoint", "data_value", "kind", "sentence"]
COLUMNS = ["doc_id", "unit", "figure_id", "panel_id", "fig_n", "phase", "sub", "question_type", "focus", "expected_answer", "operation", "evidence_ids", "confidence", *DETAIL]


def candidates(sem: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Blueprint rows without ids, and skips (doc_id, question_type, reason): what each unit yields or why it doesn't. sem: semantics.reconstruct()."""
    exps, units, verdict = sem["experiments"], sem["units"], sem["verdicts"]
    design = sem["evidence"].where("evidence_type = 'experimental_design'").groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence_id"))), lambda x: x["evidence_id"]).alias("design_ids"))
    none = F.array().cast("array<string>")
    base = units.join(exps, UNIT).join(verdict.select(*UNIT, "status", "confidence"), UNIT).join(design, UNIT, "left").withColumn("design_ids", F.coalesce("design_ids", none))
    panel = F.col("panel") != ""
    base = base.withColumns(
        {
            "panel_id": F.when(panel, F.concat(F.col("number").cast("string"), "panel")).otherwise(""),
            "dv": first("dependent_variables"),
            "control": first("control_groups"),
            "first_group": first("experimental_groups"),
        }
    ).withColumns({"label": F.when(panel, F.col("panel_id")).otherwise(F.col("figure_id")), "grp": F.when(F.col("first_group") != "", F.col("first_group")).otherwise(F.col("intervention"))})
    # a panel of an insufficient figure is not looked at
    figure_ok = verdict.join(units.where("panel = ''").select(*UNIT, "figure_id"), UNIT).where("status <> 'INSUFFICIENT'").select("doc_id", "figure_id").distinct()
    live = base.join(figure_ok, ["doc_id", "figure_id"]).where("status <> 'INSUFFICIENT'")
    obs = sem["observations"].withColumnRenamed("evidence_id", "obs_id")

    def fill(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select(*(cols[c].alias(c) if c in cols else F.lit(None).cast("string").alias(c) if c in DETAIL else F.col(c) for c in COLUMNS))

    # results
    directed = obs.where("direction <> 'unspecified'").withColumn("k", F.row_number().over(Window.partitionBy(*UNIT).orderBy("i")))
    ready = (F.col("intervention") != "") & (F.col("dv") != "")
    ri = live.where(ready).join(directed.where(F.col("k") <= MAX_RI), UNIT)
    match = ri.select(*UNIT, "k", "obs_id").join(sem["conclusions"].select(*UNIT, "c", F.col("statement").alias("told"), F.col("evidence_id").alias("cid")), UNIT)
    match = match.groupBy(*UNIT, "k").agg(F.min_by("told", F.struct(F.when(F.col("cid") == F.col("obs_id"), 0).otherwise(1), "c")).alias("told"))
    ri = ri.join(match, [*UNIT, "k"], "left")
    focus = F.when(F.col("relationship").isin(NON_CAUSAL), F.concat(F.lit("What is the relationship between "), "intervention", F.lit(" and "), "dv", F.lit(" shown in "), "label", F.lit("?")))
    focus = focus.when(F.col("control") != "", F.concat(F.lit("What does "), "label", F.lit(" show about "), "dv", F.lit(" in "), "grp", F.lit(" compared with the "), "control", F.lit(" group?")))
    focus = focus.otherwise(F.concat(F.lit("What does "), "label", F.lit(" show about "), "dv", F.lit(" after "), "intervention", F.lit("?")))
    verb = F.when(F.col("direction") == "increase", "increased").when(F.col("direction") == "decrease", "decreased").otherwise("did not significantly change")
    versus = F.when(F.col("control") != "", F.concat(F.lit(" relative to the "), "control", F.lit(" group"))).otherwise("")
    own = F.concat("dv", F.lit(" "), verb, versus, F.lit("."))
    ri_rows = fill(
        ri, phase=F.lit(0), sub=F.col("k"), question_type=F.lit("RESULT_INTERPRETATION"), focus=focus, expected_answer=F.coalesce("told", own),
        operation=F.when(F.col("control") != "", "comparison").otherwise("result_interpretation"), evidence_ids=union_ids(F.array("obs_id"), F.col("design_ids")),
        relationship=F.col("relationship"), direction=F.col("direction"), significance=F.col("significance"), cmp_experimental=F.col("grp"), cmp_control=F.col("control"), cmp_endpoint=F.col("dv"),
    )
    any_dir = directed.select(*UNIT).distinct().withColumn("has_dir", F.lit(True))
    no_ri = live.join(any_dir, UNIT, "left").withColumn("reason", F.when(F.col("has_dir").isNull(), "no_directed_observation").when(~ready, "missing_intervention_or_endpoint")).where("reason is not null")

    # design, of figures
    figs = live.where("panel = ''")
    whole = (F.col("first_group") != "") & (F.col("control") != "") & (F.col("dv") != "")
    by = F.when(F.col("intervention") != "", F.col("intervention")).otherwise(F.col("first_group"))
    plans = F.array(
        F.struct(F.concat(F.lit("Why does the experiment in "), "figure_id", F.lit(" include a "), "control", F.lit(" group?")).alias("f"), F.concat(F.lit("The "), "control", F.lit(" group provides the baseline level of "), "dv", F.lit(" against which "), by, F.lit(" is compared.")).alias("a")),
        F.struct(F.concat(F.lit("What is the purpose of the "), "first_group", F.lit(" group in "), "figure_id", F.lit("?")).alias("f"), F.concat(F.lit("The "), "first_group", F.lit(" group receives "), by, F.lit(" so that its effect on "), "dv", F.lit(" can be measured against the "), "control", F.lit(" baseline.")).alias("a")),
        F.struct(F.concat(F.lit("What does the experiment shown in "), "figure_id", F.lit(" measure?")).alias("f"), F.concat(F.lit("It measures "), "dv", F.lit(" in the "), "first_group", F.lit(" group versus the "), "control", F.lit(" group.")).alias("a")),
    )
    ed = figs.where(whole & (F.size("design_ids") > 0)).select("*", F.posexplode(F.slice(plans, 1, MAX_ED)).alias("k", "p"))
    ed_rows = fill(ed, phase=F.lit(1), sub=F.col("k") + 1, question_type=F.lit("EXPERIMENTAL_DESIGN"), focus=F.col("p.f"), expected_answer=F.col("p.a"), operation=F.lit("experimental_design_reasoning"), evidence_ids=F.col("design_ids"))
    no_ed = figs.withColumn("reason", F.when(~whole, "incomplete_design_slots").when(F.size("design_ids") == 0, "no_design_evidence")).where("reason is not null")

    # prediction, of figures
    up_down = obs.where("direction in ('increase', 'decrease')")
    lic = up_down.where(F.col("relationship").isin(LICENSED)).withColumn("k", F.row_number().over(Window.partitionBy(*UNIT).orderBy("i"))).where(F.col("k") <= MAX_PRED)
    pair = (F.col("first_group") != "") & (F.col("control") != "")
    can = (F.col("status") == "SUFFICIENT") & pair & ready
    pred = figs.where(can).join(lic, UNIT)
    would = F.concat("dv", F.lit(" would "), "direction", F.lit(", as already observed in the "), "first_group", F.lit(" group."))
    pred_rows = fill(
        pred, phase=F.lit(2), sub=F.col("k"), question_type=F.lit("SIMPLE_PREDICTION"), focus=F.concat(F.lit("If "), "intervention", F.lit(" were applied to the "), "control", F.lit(" group, what would happen to "), "dv", F.lit("?")),
        expected_answer=would, operation=F.lit("local_prediction"), evidence_ids=union_ids(F.array("obs_id"), F.col("design_ids")), relationship=F.col("relationship"), direction=F.col("direction"),
    )
    some = up_down.groupBy(*UNIT).agg(F.bool_or(F.col("relationship").isin(LICENSED)).alias("lic"))
    no_pred = figs.join(some, UNIT, "left").withColumn(
        "reason",
        F.when(F.col("status") != "SUFFICIENT", "figure_not_sufficient").when(~pair, "missing_group_comparison").when(~ready, "missing_intervention_or_endpoint").when(F.col("lic").isNull(), "no_directed_observation").when(~F.col("lic"), "non_causal_relationship"),
    ).where("reason is not null")

    # data
    finds = numeric_findings(sem["evidence"]).select(*UNIT, "f", F.col("kind").alias("nkind"), F.col("value").alias("nvalue"), F.col("sentence").alias("nsentence"), "evidence_id")
    ds = live.join(finds.where(F.col("f") <= MAX_DS), UNIT)
    subject = F.when(F.col("dv") != "", F.concat(F.lit("the reported change in "), "dv")).otherwise("the reported quantitative result")
    ds_rows = fill(
        ds, phase=F.lit(3), sub=F.col("f"), question_type=F.lit("DATA_STATEMENT"), focus=F.concat(F.lit("According to "), "label", F.lit(", what quantitative value is explicitly reported for "), subject, F.lit("?")),
        expected_answer=F.col("nvalue"), operation=F.lit("quantitative_reading"), evidence_ids=F.array("evidence_id"), data_value=F.col("nvalue"), kind=F.col("nkind"), sentence=F.col("nsentence"),
    )
    no_ds = live.join(finds.select(*UNIT).distinct(), UNIT, "left_anti").withColumn("reason", F.lit("no_literal_numeric_value"))

    rows = ri_rows.union(ed_rows).union(pred_rows).union(ds_rows)
    skips = None
    for df, kind in ((no_ri, "RESULT_INTERPRETATION"), (no_ed, "EXPERIMENTAL_DESIGN"), (no_pred, "SIMPLE_PREDICTION"), (no_ds, "DATA_STATEMENT")):
        part = df.select("doc_id", F.lit(kind).alias("question_type"), "reason")
        skips = part if skips is None else skips.union(part)
    bad_figures = base.where("panel = '' and status = 'INSUFFICIENT'").select("doc_id", F.explode(F.array(*map(F.lit, TYPES))).alias("question_type"), F.lit("figure_insufficient").alias("reason"))
    bad_panels = base.join(figure_ok, ["doc_id", "figure_id"]).where("panel <> '' and status = 'INSUFFICIENT'").select("doc_id", F.explode(F.array(F.lit("RESULT_INTERPRETATION"), F.lit("DATA_STATEMENT"))).alias("question_type"), F.lit("panel_insufficient").alias("reason"))
    return rows, skips.union(bad_figures).union(bad_panels)


def blueprints(sem: dict[str, DataFrame]) -> DataFrame:
    """Blueprints with ids (qb_unit_type_001, counted by unit and type in order) and ord, their place in the document."""
    rows, _ = candidates(sem)
    abbr = X.ordered_case([(F.col("question_type") == t, F.lit(a)) for t, a in TYPES.items()], F.lit(""))
    k = F.row_number().over(Window.partitionBy(*UNIT, "question_type").orderBy("phase", "sub"))
    rows = rows.withColumn("blueprint_id", F.concat(F.lit("qb_"), "unit", F.lit("_"), abbr, F.lit("_"), F.format_string("%03d", k)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("fig_n", F.when(F.col("panel_id") == "", 0).otherwise(1), "unit", "phase", "sub"))
    return rows.withColumn("ord", place).withColumn("experiment_id", F.concat(F.lit("exp_"), "unit"))


def skip_counts(sem: dict[str, DataFrame]) -> DataFrame:
    return candidates(sem)[1].groupBy("doc_id", "question_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def type_counts(bps: DataFrame) -> DataFrame:
    return bps.groupBy("doc_id").agg(*(F.count_if(F.col("question_type") == t).alias(t.lower()) for t in TYPES), F.count(F.lit(1)).alias("total"))
