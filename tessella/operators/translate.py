"""Statements in Chinese: fixed sentence forms, a term table, and checks of what a translation must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def terms_only(text: Column) -> Column:
    """Every term of the table replaced, longest first, in any case and inside of words too."""
    out = text
    for en, zh in sorted(P.TERMS.items(), key=lambda kv: -len(kv[0])):
        out = F.regexp_replace(out, rf"(?iu)\Q{en}\E", zh)
    return X.strip(out)


def entity(text: Column) -> Column:
    """A name with its terms replaced, and without the, a, an, of."""
    words = F.filter(F.split(terms_only(text), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(P.DROPPED_WORDS))
    return F.array_join(words, " ")


def verb(word: Column) -> Column:
    return F.when(word.startswith("increase"), "提高").otherwise("降低")


def glue(left: Column, right: Column) -> Column:
    """Two parts, with a space between Latin and Chinese. Each is made once, as an element of an array, however often it is looked at."""

    def joined(x: Column) -> Column:
        a, b = x["a"], x["b"]
        gap = (a.rlike(r"[A-Za-z0-9%)\]]$") & b.rlike("^[一-鿿]")) | (a.rlike("[一-鿿]$") & b.rlike("^[A-Za-z0-9(]"))
        return F.when((a == "") | (b == "") | ~gap, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return F.get(F.transform(F.array(F.struct(left.alias("a"), right.alias("b"))), joined), F.lit(0))


KINDS = "percentage|fold change|p value|concentration|time"
FALLBACK = rf"^According to (.+?), the reported ({KINDS}) is (.+?)\.?$"
OBJECT = rf"^According to (.+?), the reported ({KINDS}) for (.+?) is (.+?)\.?$"
ACCORDING = r"^According to (.+?), (.+)$"
#: One anchor after another from a statement's start on; something follows the last.
ANCHOR = r"\G(?U:\s)*According to (.+?), (?=.+$)"
ANCHORS = r"^(?:(?U:\s)*According to .+?, (?=.+$))+"


def kind_zh(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in P.KIND_ZH.items() for x in kv)), kind)


def cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def forms(t: Column) -> list[tuple[str, Column]]:
    """Sentence forms in order with their renderings, but for those that start with According to."""

    def g(pattern: str, *numbers: int) -> list[Column]:
        return [F.regexp_extract(t, pattern, n) for n in numbers]

    def moved(pattern: str, render) -> tuple[str, Column]:
        s, v, o = g(pattern, 1, 2, 3)
        return pattern, render(entity(s), verb(v), entity(o))

    causes, reported = r"^(.+?) causes (.+?)\.?$", r"^The reported value is (.+?)\.?$"
    would = r"^(.+?) would (increase|decrease), as already observed in the (.+?) group\.?$"
    base = r"^The (.+?) group provides the baseline level of (.+?) against which (.+?) is compared\.?$"
    receives = r"^The (.+?) group receives (.+?) so that its effect on (.+?) can be measured against the (.+?) baseline\.?$"
    measures = r"^It measures (.+?) in the (.+?) group versus the (.+?) group\.?$"
    cs, co = g(causes, 1, 2)
    ws, wv, wg = g(would, 1, 2, 3)
    bc, bo, bt = map(entity, g(base, 1, 2, 3))
    rg, rt, ro, rc = map(entity, g(receives, 1, 2, 3, 4))
    mo, mg, mc = map(entity, g(measures, 1, 2, 3))
    return [
        moved(r"^(.+?) significantly (increases|decreases) (.+?)\.?$", lambda s, v, o: glue(s, cat("可显著", v, " ", o, "。"))),
        moved(r"^(.+?) does not significantly (increase|decrease) (.+?)\.?$", lambda s, v, o: glue(s, cat("不会显著", v, " ", o, "。"))),
        moved(r"^(.+?) (increases|decreases) (.+?)\.?$", lambda s, v, o: glue(s, cat("可", v, " ", o, "。"))),
        moved(r"^(.+?) does not (increase|decrease) (.+?)\.?$", lambda s, v, o: glue(s, cat("不会", v, " ", o, "。"))),
        moved(r"^(.+?) is associated with (increased|decreased) (.+?)\.?$", lambda s, v, o: glue(s, cat("与 ", o, " 的", v, "相关。"))),
        moved(r"^(.+?) is not associated with (increased|decreased) (.+?)\.?$", lambda s, v, o: glue(s, cat("与 ", o, " 的", v, "不相关。"))),
        (causes, glue(entity(cs), cat("导致 ", entity(co), "。"))),
        (reported, cat("论文报告的数值为 ", g(reported, 1)[0], "。")),
        (would, glue(entity(ws), cat("将会", verb(wv), "，这在", entity(wg), "组中已被观察到。"))),
        (base, cat(bc, "组提供", bo, "的基线水平，用于与", bt, " 进行比较。")),
        (receives, cat(rg, "组接受", rt, "处理，以便以", rc, "基线为参照测量其对", ro, "的影响。")),
        (measures, cat("该实验测量", mg, "组与", mc, "组中", mo, "的差异。")),
    ]


def reported_forms(t: Column) -> list[tuple[str, Column]]:
    f = [F.regexp_extract(t, FALLBACK, n) for n in (1, 2, 3)]
    o = [F.regexp_extract(t, OBJECT, n) for n in (1, 2, 3, 4)]
    return [(FALLBACK, cat("根据", entity(f[0]), "，论文报告的", kind_zh(f[1]), "为 ", f[2], "。")), (OBJECT, cat("根据", entity(o[0]), "，论文报告的", entity(o[2]), "的", kind_zh(o[1]), "为 ", o[3], "。"))]


def translations(df: DataFrame, statement: str = "statement", is_data: Column | None = None) -> DataFrame:
    """df with statement_zh and method (template or term_fallback).

    Anchors are peeled off, however many there are, so that a statement behind them is rendered like one behind none; what is left is matched to a form once. A data
    statement keeps its quote word by word behind its first anchor; with no column is_data none is one."""
    data = is_data if is_data is not None else F.lit(False)
    rows = df.withColumn("_t0", X.strip(F.col(statement)))
    t = F.col("_t0")
    # a reported value's own anchor belongs to its form, and takes those before it along
    peeled = ~t.rlike(FALLBACK) & ~t.rlike(OBJECT)
    rows = rows.withColumn("_a", F.when(peeled, X.all_matches(t, ANCHOR, 1)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_core", F.when(F.size("_a") > 0, X.strip(F.regexp_replace(t, ANCHORS, ""))).otherwise(t))
    core = F.col("_core")
    known = [*reported_forms(core), *forms(core)]
    rows = rows.withColumn("_form", X.ordered_case([(core.rlike(p), F.lit(i)) for i, (p, _) in enumerate(known)], F.lit(-1)))
    own = X.ordered_case([(F.col("_form") == i, zh) for i, (_, zh) in enumerate(known)], F.when(core != "", entity(core)))
    before = F.array_join(F.transform("_a", lambda a: cat("根据", entity(a), "，")), "")
    rest = F.regexp_replace(F.regexp_extract("_t0", ACCORDING, 2), r"\.+$", "")
    quote = cat("根据", entity(F.get("_a", F.lit(0))), "，论文原文报告：", terms_only(rest), "。")
    anchored = F.size("_a") > 0
    zh = F.when(data & anchored, quote).otherwise(F.concat(before, own))
    method = F.when(anchored | (F.col("_form") >= 0), "template").otherwise("term_fallback")
    return rows.withColumns({"statement_zh": zh, "method": method}).drop("_t0", "_a", "_core", "_form")


def translate_drafts(drafts: DataFrame) -> DataFrame:
    return translations(drafts, "statement", F.col("question_type") == "DATA_STATEMENT")


def method_counts(translated: DataFrame) -> DataFrame:
    return translated.groupBy("doc_id", "method").agg(F.count(F.lit(1)).alias("n"))


def rejection(english: Column, chinese: Column) -> Column:
    """Why a translation can't stand for its statement, null if it can: figure anchors, names in capitals or with digits, numbers and direction must remain."""
    anchors = X.all_matches(english, P.FIGURE_ANCHOR)

    def anchor_ok(a: Column) -> Column:
        # without regard to what follows the number but a letter or digit, as in 图2 or Figure 2
        number = F.regexp_extract(a, r"([0-9]+[a-h]?)$", 1)
        local = F.exists(X.all_matches(chinese, r"(?U)(?:图|[Ff]igure)\s*([0-9]+[a-h]?)\b", 1), lambda n: n == number)
        return F.contains(chinese, a) | local

    names = X.all_matches(english, P.PRESERVED_TOKEN)
    rest = F.regexp_replace(F.regexp_replace(english, P.FIGURE_ANCHOR, " "), P.PRESERVED_TOKEN, " ")
    numbers = X.all_matches(rest, r"(?U)\d[\d.]*")
    up, down = english.rlike(P.EN_UP), english.rlike(P.EN_DOWN)
    zh_up, zh_down = (chinese.rlike("|".join(w)) for w in (P.ZH_UP, P.ZH_DOWN))
    return X.ordered_case(
        [
            (~F.forall(anchors, anchor_ok), F.lit("anchor")),
            (~F.forall(names, lambda w: F.contains(chinese, w)), F.lit("name")),
            (~F.forall(numbers, lambda n: F.contains(chinese, n)), F.lit("number")),
            (up & ~down & ~zh_up, F.lit("increase")),
            (down & ~up & ~zh_down, F.lit("decrease")),
        ],
        F.lit(None).cast("string"),
    )
