"""True and false statements about each blueprint, by fixed perturbations that use nothing but the paper's own material."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .blueprints import numeric_findings

MAX_SETS, MAX_FALSE, MAX_SENTENCE = 3, 4, 240
#: Fixed value: which types a figure's sets come from, and in which order perturbations are tried.
TYPE_ORDER = ["RESULT_INTERPRETATION", "SIMPLE_PREDICTION", "DATA_STATEMENT", "EXPERIMENTAL_DESIGN"]
ORDER = ["DIRECTION_FLIP", "SIGNIFICANCE_FLIP", "GROUP_SWAP", "CAUSALITY_UPGRADE", "CONCLUSION_FLIP", "DV_SWAP", "VARIABLE_SWAP", "PANEL_MISATTRIBUTION", "NUMERIC_MUTATION", "CONDITION_MUTATION"]


def changed(text: Column, new: Column) -> Column:
    return F.nullif(new, text)


# --- true statements --------------------------------------------------------------------------------------------------


def normal_typography(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[   ]", " "), " {2,}", " ")


def clean_sentence(sentence: Column) -> Column:
    """A quote without its panel prefix, line-break hyphens, full stop and figure references at its end."""
    t = F.regexp_replace(normal_typography(X.strip(sentence)), r"(?U)^[a-h],\s+", "")
    t = F.regexp_replace(t, r"(?U)(?<![A-Za-z])([a-z][A-Za-z]*)-\s+([a-z][A-Za-z-]*)", "$1$2")
    t = F.regexp_replace(t, r"(?U)(?<![A-Za-z])([A-Z][A-Za-z]*)-\s+([a-z][A-Za-z-]*)", "$1-$2")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.+$", ""), P.DANGLING_FIGURE, ""), P.TRAILING_FIGURE, "")
    return X.strip(F.regexp_replace(X.strip(t), "[,;]+$", ""))


def looks_like_fragment(body: Column) -> Column:
    return (F.regexp_count(body, F.lit(r"\)")) > F.regexp_count(body, F.lit(r"\("))) | (X.n_split(body) < 5)


def last_at(text: Column, what: str) -> Column:
    """The 0-based place of the last occurrence, -1 without one."""
    back = F.instr(F.reverse(text), what[::-1])
    return F.when(back > 0, F.length(text) - back - len(what) + 1).otherwise(-1)


def truncated(body: Column, value: Column) -> Column:
    """A quote of up to MAX_SENTENCE characters, cut after the value at a clause if it is longer; null if the value lies too far."""
    at = F.position(value, body) - 1
    window = F.left(body, F.lit(MAX_SENTENCE))
    cut = F.greatest(last_at(window, ", "), last_at(window, "; "), last_at(window, " and "))
    cut = F.when(cut < at, last_at(window, " ")).otherwise(cut)
    short = F.regexp_replace(F.regexp_replace(F.left(body, F.when(cut < 0, F.length(body) - 1).otherwise(cut).cast("int")), P.DANGLING_FIGURE, ""), "[ ,;]+$", "")
    return F.when(F.length(body) <= MAX_SENTENCE, body).when((at >= 0) & (at + F.length(value) <= MAX_SENTENCE), short)


def with_quote(rows: DataFrame) -> DataFrame:
    """Blueprint rows with x_body (the cleaned sentence), x_bad (a fragment) and x_quote (the quote around the value, null if it can't be quoted).

    Each is a column of its own, so that the next one's many uses of it don't repeat it."""
    rows = rows.withColumn("x_body", clean_sentence(F.coalesce("sentence", F.lit(""))))
    bare = F.regexp_replace("data_value", r"\.+$", "")
    use = F.when(F.contains("x_body", "data_value"), F.col("data_value")).when((bare != "") & F.contains(F.col("x_body"), bare), bare)
    rows = rows.withColumns({"x_bad": looks_like_fragment(F.col("x_body")), "x_use": use})
    return rows.withColumn("x_quote", F.when(~F.col("x_bad") & F.col("x_use").isNotNull(), truncated(F.col("x_body"), F.col("x_use")))).drop("x_use")


def data_statement() -> Column:
    """Over with_quote(): the sentence quoted behind its figure, or the value by its kind, and by its object where one is known, where it can't be quoted; null for a panel taken for a value."""
    value, quote = F.col("data_value"), F.col("x_quote")
    anchor = F.concat("figure_id", F.regexp_replace("panel_id", "^[0-9]+", ""))
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in P.KIND_LABELS.items() for x in kv)), F.coalesce("kind", F.lit(""))), F.lit("value"))
    of = F.when(F.coalesce("object", F.lit("")) != "", F.concat(F.lit(" for "), "object")).otherwise("")
    plain = F.concat(F.lit("According to "), anchor, F.lit(", the reported "), label, of, F.lit(" is "), F.regexp_replace(value, r"\.+$", ""), F.lit("."))
    said = F.when(quote.isNotNull() & (quote != ""), F.concat(F.lit("According to "), anchor, F.lit(", "), quote, F.lit("."))).otherwise(plain)
    return F.when(F.coalesce(value, F.lit("")) != "", F.when(~(F.col("x_bad") & value.rlike(P.PANEL_LABEL_VALUE)), said))


def needs_object(value: Column, sentence: Column) -> Column:
    """Whether a data statement can't quote its sentence and is no panel's label."""
    body, bare = clean_sentence(sentence), F.regexp_replace(value, r"\.+$", "")
    bad = looks_like_fragment(body)
    return ~(bad & value.rlike(P.PANEL_LABEL_VALUE)) & ~(~bad & (F.contains(body, value) | ((bare != "") & F.contains(body, bare))))


def true_statement() -> Column:
    """Over with_quote()."""
    sure = (F.col("question_type") == "RESULT_INTERPRETATION") & (F.col("significance") == "significant") & F.col("direction").isin("increase", "decrease") & (F.coalesce("cmp_experimental", F.lit("")) != "") & (F.coalesce("cmp_endpoint", F.lit("")) != "")
    strong = F.concat("cmp_experimental", F.lit(" significantly "), F.when(F.col("direction") == "increase", "increases").otherwise("decreases"), F.lit(" "), "cmp_endpoint", F.lit("."))
    return F.when(sure, strong).when(F.col("question_type") == "DATA_STATEMENT", data_statement()).otherwise(F.when(F.col("expected_answer") != "", F.col("expected_answer")))


# --- perturbations ----------------------------------------------------------------------------------------------------


def direction_flip(t: Column) -> Column:
    """All direction words swapped in one pass, through marks that no text has."""
    out = t
    for i, (a, _) in enumerate(P.DIRECTION_WORDS.items()):
        out = F.regexp_replace(out, rf"(?U)\b{a}\b", f"\u0001{i}\u0002")
    for i, (_, b) in enumerate(P.DIRECTION_WORDS.items()):
        out = F.replace(out, F.lit(f"\u0001{i}\u0002"), F.lit(b))
    return changed(t, out)


def significance_flip(t: Column) -> Column:
    verb = F.regexp_extract(t, P.SIGNIFICANT_TRUE, 2)
    return F.when(verb != "", F.concat(F.regexp_extract(t, P.SIGNIFICANT_TRUE, 1), F.lit(" does not significantly "), F.substring(verb, 1, 8), F.lit(" "), F.regexp_extract(t, P.SIGNIFICANT_TRUE, 3)))


def group_swap(t: Column, a: Column, b: Column) -> Column:
    out = F.replace(F.replace(F.replace(t, a, F.lit("\u0001")), b, a), F.lit("\u0001"), b)
    return F.when((a != "") & (b != "") & (a != b) & F.contains(t, a) & F.contains(t, b), changed(t, out))


def swap_first(t: Column, old: Column, new: Column) -> Column:
    return F.when((old != "") & new.isNotNull() & (F.lower(old) != F.lower(new)) & F.contains(t, old), changed(t, X.replace_first(t, old, new)))


def causality_upgrade(t: Column, relation: Column) -> Column:
    for_ = [F.when(F.contains(t, F.lit(p)), X.replace_first(t, F.lit(p), F.lit("causes"))) for p in ("is associated with", "correlates with")]
    return F.when(relation.isin("association", "correlation"), changed(t, F.coalesce(*for_)))


def conclusion_flip(t: Column) -> Column:
    return changed(t, F.coalesce(*(F.when(F.contains(t, F.lit(a)), X.replace_first(t, F.lit(a), F.lit(b))) for a, b in P.NEGATIONS)))


def panel_misattribution(t: Column, other: Column) -> Column:
    anchored = F.concat(F.lit("According to "), other, F.regexp_extract(t, r"(?s)^According to [^,]+(,.*)$", 1))
    swapped = F.when(t.rlike("^According to [^,]+,"), anchored).otherwise(t)
    return F.when(other.isNotNull(), changed(t, F.when(t.startswith("According to "), swapped).otherwise(F.concat(F.lit("According to "), other, F.lit(", "), t))))


def numeric_mutation(t: Column, value: Column, pool: Column) -> Column:
    """Every occurrence of the value replaced by the first other of its kind."""
    cur = F.regexp_replace(value, r"\.+$", "")
    other = F.get(F.filter(F.transform(pool, lambda v: F.regexp_replace(v, r"\.+$", "")), lambda v: v != cur), F.lit(0))
    return F.when(other.isNotNull() & F.contains(t, cur), changed(t, F.replace(t, cur, other)))


def kind_of_value(v: Column) -> Column:
    return F.when(F.contains(v, F.lit("%")), "percentage").when(v.rlike("(?i)fold"), "fold_change").when(v.rlike(r"(?iU)^\s*p\s*[<=>]"), "p_value").when(v.rlike(r"(?iU)(min|hour|hr|day|week|month|h|d)\s*$"), "time").otherwise("concentration")


def is_clean_treatment(name: Column) -> Column:
    low = F.lower(name)
    return ~low.startswith("treated with") & ~low.startswith("than in") & ~F.contains(low, F.lit("versus")) & ~F.contains(low, F.lit(" vs"))


def is_clean_endpoint(name: Column) -> Column:
    low = F.lower(name)
    return ~F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" not ")) & ~low.startswith("not ") & ~low.startswith("showing ")


# --- sets -------------------------------------------------------------------------------------------------------------


def select_blueprints(bps: DataFrame, per_figure: int = MAX_SETS) -> DataFrame:
    """The first blueprint of each type of a figure itself, in TYPE_ORDER, with set_n, up to per_figure."""
    kind = X.ordered_case([(F.col("question_type") == t, F.lit(i)) for i, t in enumerate(TYPE_ORDER)], F.lit(9))
    rows = bps.where("panel_id = ''").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "figure_id", "question_type").orderBy("ord"))).where("k = 1").drop("k")
    return rows.withColumn("set_n", F.row_number().over(Window.partitionBy("doc_id", "figure_id").orderBy(kind))).where(F.col("set_n") <= per_figure)


def numeric_pool(bps: DataFrame) -> DataFrame:
    """doc_id, kind, value, first_ord, evidence_id: the different values of a paper's data blueprints, by where they first stand."""
    rows = bps.where("question_type = 'DATA_STATEMENT' and coalesce(data_value, '') <> '' and coalesce(kind, '') <> ''")
    return rows.groupBy("doc_id", "kind", F.col("data_value").alias("value")).agg(F.min("ord").alias("first_ord"), F.min_by(F.get("evidence_ids", F.lit(0)), "ord").alias("evidence_id"))


def pools(bps: DataFrame) -> DataFrame:
    """doc_id and `pool`: kind -> values in order."""
    each = numeric_pool(bps).groupBy("doc_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "value"))), lambda x: x["value"]).alias("values"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "values"))).alias("pool"))


def contexts(selected: DataFrame, sem: dict[str, DataFrame], bps: DataFrame) -> DataFrame:
    """Selected blueprints with what perturbations may use: other treatments and endpoints, other figures, the paper's values and conditions."""
    unit = ["doc_id", "unit"]
    none = F.array().cast("array<string>")
    exps = sem["experiments"].select(*unit, "intervention", "dependent_variables", "experimental_groups", "control_groups")
    spans = sem["evidence"].select(*unit, "n", F.posexplode(X.all_matches(F.col("text"), P.TREATMENT_SPAN)).alias("at", "v")).withColumn("v", X.strip(F.col("v"))).where(is_clean_treatment(F.col("v"))).withColumn("low", F.lower("v"))
    treatments = X.ordered_distinct(spans, unit, "v", ["n", "at"], key="low", name="treatments")
    figs = sem["figures"].groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "figure_id"))), lambda x: x["figure_id"]).alias("all_figures"))
    conds = numeric_findings(sem["evidence"]).where("kind in ('concentration', 'time')").groupBy(*unit).agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "sentence", "value", "evidence_id"))), 1, 4).alias("conditions"))
    rows = selected.join(exps, unit).join(treatments, unit, "left").join(figs, "doc_id").join(pools(bps), "doc_id", "left").join(conds, unit, "left")
    made = F.coalesce(F.when(F.col("cmp_experimental") != "", F.col("cmp_experimental")), F.col("intervention"))
    rows = rows.withColumn("x_treatment", made)
    others = F.when(F.col("intervention") != "", F.filter(F.coalesce("treatments", none), lambda t: F.lower(t) != F.lower("x_treatment"))).otherwise(none)
    ends = F.filter(F.slice("dependent_variables", 2, F.greatest(F.size("dependent_variables"), F.lit(1))), lambda v: (F.lower(v) != F.lower(F.coalesce("cmp_endpoint", F.lit("")))) & is_clean_endpoint(v))

    def or_first(c: str, array: str) -> Column:
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.get(array, F.lit(0)), F.lit(""))

    return rows.withColumns(
        {
            "x_other_treatment": F.get(others, F.lit(0)),
            "x_other_endpoint": F.when(F.col("question_type") != "DATA_STATEMENT", F.get(ends, F.lit(0))),
            "x_sibling": F.get(F.filter("all_figures", lambda f: f != F.col("figure_id")), F.lit(0)),
            "x_endpoint": or_first("cmp_endpoint", "dependent_variables"),
            "x_group": or_first("cmp_experimental", "experimental_groups"),
            "x_control": or_first("cmp_control", "control_groups"),
            "x_relation": F.coalesce("relationship", F.lit("unspecified")),
        }
    )


def condition_mutation() -> Column:
    """text, evidence_id of the first reported condition that another value of its kind can replace."""
    empty = F.array().cast("array<string>")

    def one(c: Column) -> Column:
        other = F.get(F.filter(F.coalesce(F.try_element_at("pool", kind_of_value(c["value"])), empty), lambda v: v != c["value"]), F.lit(0))
        return F.struct(F.when(other.isNotNull(), changed(c["sentence"], X.replace_first(c["sentence"], c["value"], other))).alias("text"), c["evidence_id"].alias("evidence_id"))

    return F.get(F.filter(F.transform(F.when(F.col("pool").isNotNull(), F.col("conditions")), one), lambda x: x["text"].isNotNull()), F.lit(0))


def perturbed(t: Column) -> Column:
    """The candidates for a true statement as structs p, type, text, extra in ORDER; text is null where one doesn't apply."""
    data = F.col("question_type") == "DATA_STATEMENT"
    cond = F.when(~data, condition_mutation())
    pool = F.coalesce(F.try_element_at("pool", "kind"), F.array().cast("array<string>"))
    made = {
        "DIRECTION_FLIP": direction_flip(t),
        "SIGNIFICANCE_FLIP": significance_flip(t),
        "GROUP_SWAP": group_swap(t, F.col("x_group"), F.col("x_control")),
        "CAUSALITY_UPGRADE": causality_upgrade(t, F.col("x_relation")),
        "CONCLUSION_FLIP": conclusion_flip(t),
        "DV_SWAP": swap_first(t, F.col("x_endpoint"), F.col("x_other_endpoint")),
        "VARIABLE_SWAP": swap_first(t, F.col("x_treatment"), F.col("x_other_treatment")),
        "PANEL_MISATTRIBUTION": panel_misattribution(t, F.col("x_sibling")),
        "NUMERIC_MUTATION": F.when(data & F.col("pool").isNotNull(), numeric_mutation(t, F.col("data_value"), pool)),
        "CONDITION_MUTATION": changed(t, cond["text"]),
    }
    nothing = F.lit(None).cast("string")
    return F.array(*(F.struct(F.lit(i).alias("p"), F.lit(k).alias("type"), made[k].alias("text"), (cond["evidence_id"] if k == "CONDITION_MUTATION" else nothing).alias("extra")) for i, k in enumerate(ORDER)))


def draft_sets(bps: DataFrame, sem: dict[str, DataFrame], max_false: int = MAX_FALSE, put: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, objects: DataFrame | None = None) -> DataFrame:
    """doc_id, set_id, nn, draft_id, blueprint_id, figure_id, unit, question_type, statement, is_correct, perturbation, evidence_ids, confidence.

    A set is its true statement and the first false ones that differ from it and each other; a set without a false one goes, and its number with it.
    put: writes the quotes and then the true statements with their context before they are perturbed, which keeps each plan small. objects: doc_id, blueprint_id, object (remote.objects),
    what the values of data statements that can't be quoted measure."""
    chosen = contexts(select_blueprints(bps), sem, bps)
    keys = ["doc_id", "blueprint_id"]
    chosen = chosen.withColumn("object", F.lit(None).cast("string")) if objects is None else chosen.join(objects.select(*keys, "object"), keys, "left")
    rows = put(with_quote(chosen), "quotes").withColumn("true_text", true_statement()).where("true_text is not null and size(evidence_ids) > 0")
    rows = rows.withColumn("set_k", F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy("set_n")))
    rows = rows.withColumn("set_id", F.concat(F.lit("qd_"), "unit", F.lit("_"), F.format_string("%03d", "set_k")))
    rows = put(rows.drop("x_body", "x_bad", "x_quote", "object", "treatments", "all_figures", "evidence_store"), "true_statements")
    keep = ["doc_id", "set_id", "blueprint_id", "figure_id", "unit", "question_type", "true_text", "evidence_ids", "confidence"]
    each = rows.select(*keep, F.explode(perturbed(F.col("true_text"))).alias("c")).where("c.text is not null and c.text <> true_text")
    once = each.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "set_id", "c.text").orderBy("c.p"))).where("k = 1")
    false = once.withColumn("nn", F.row_number().over(Window.partitionBy("doc_id", "set_id").orderBy("c.p"))).where(F.col("nn") <= max_false)
    ids = F.when(F.coalesce("c.extra", F.lit("")) != "", F.array_union("evidence_ids", F.array("c.extra"))).otherwise(F.col("evidence_ids"))
    false = false.select(*keep, "nn", F.col("c.text").alias("statement"), F.lit(False).alias("is_correct"), F.col("c.type").alias("perturbation"), ids.alias("ids"))
    alive = false.select("doc_id", "set_id").distinct()
    true = rows.select(*keep, F.lit(0).alias("nn"), F.col("true_text").alias("statement"), F.lit(True).alias("is_correct"), F.lit("NONE").alias("perturbation"), F.col("evidence_ids").alias("ids")).join(alive, ["doc_id", "set_id"], "left_semi")
    out = true.select(*false.columns).union(false)
    return out.select("doc_id", "set_id", "nn", F.concat("set_id", F.lit("_"), F.format_string("%02d", "nn")).alias("draft_id"), "blueprint_id", "figure_id", "unit", "question_type", "statement", "is_correct", "perturbation", F.col("ids").alias("evidence_ids"), "confidence")


def draft_summary(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("doc_id").agg(F.count_distinct("set_id").alias("sets"), F.count(F.lit(1)).alias("statements"), F.count_if("is_correct").alias("true_statements"), F.count_if(~F.col("is_correct")).alias("false_statements"))


def perturbation_counts(drafts: DataFrame) -> DataFrame:
    return drafts.where("not is_correct").groupBy("doc_id", "perturbation").agg(F.count(F.lit(1)).alias("n"))


def object_allowed(phrase: Column, text: Column) -> Column:
    """Whether a phrase from outside is a verbatim span of its evidence, of 80 characters at most."""
    return (F.length(phrase) <= 80) & (phrase != "") & F.contains(normal_typography(text), normal_typography(phrase))
