"""URL filters: rules by host and path, and for all other URLs templates of paths, learned by host and judged by the labels they hold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, small

#: What follows a segment, by kind; their shares are a branch's shape.
NEXT = ("ends", "digits", "letters", "mixed")
#: Chi-square above which branches differ at 1 %, for two labels and for the four kinds of NEXT.
CHI_LABELS, CHI_SHAPE = 6.635, 11.345
ALLOW, BLOCK = "allow", "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """host and path: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Both empty without `://` and for null."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (`host/path`) that fits: its host is the URL's or a parent domain, and the URL's path starts with its path. Null if none does."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest), rule).otherwise(fits)
    return fits


def kind(segment: Column) -> Column:
    """One of NEXT for the segment that follows another one, null if none does."""
    return F.when(segment.isNull(), "ends").when(segment.rlike("^[0-9]+$"), "digits").when(segment.rlike("^[A-Za-z]+$"), "letters").otherwise("mixed")


def chi_square(branch: Sequence[Column], rest: Sequence[Column]) -> Column:
    """Of a branch's counts against those of the other branches; 0 where either side has none."""
    b, r = (reduce(add, x).cast("double") for x in (branch, rest))
    parts = [F.when(x + y > 0, (x * r - y * b) * (x * r - y * b) / (x + y)).otherwise(F.lit(0.0)) for x, y in zip(branch, rest, strict=True)]
    return F.when((b > 0) & (r > 0), reduce(add, parts) / (b * r)).otherwise(F.lit(0.0))


def literals(rows: DataFrame, host: str, at: str, segment: Column, following: Column, label: Column, min_rows: int, min_percent: int, min_effect: float) -> DataFrame:
    """host, at, segment, step: the segments of a level that are no variables, and the step that each adds to its rows' template.

    at: the template so far, a node of the host's tree. A segment stands for itself if at least min_rows rows and min_percent % of the node's have
    it, so that a node has at most 100 / min_percent branches; others are variables. A branch whose shape and labels are like those of the
    node's other branches taken together (no difference at 1 %, or a negligible one: chi-square below min_effect of the rows) is
    merged with all such branches into `+`. Rows are summed by segment, then by node: no node's rows meet in one task."""
    kinds = {f"_{k}": F.count_if(kind(following) == k) for k in NEXT}
    sums = {"_n": F.count(F.lit(1)), "_good": F.count_if(label), "_bad": F.count_if(~label)} | kinds
    counts = rows.groupBy(F.col(host).alias("_host"), F.col(at).alias("_at"), segment.alias("_segment")).agg(*(c.alias(n) for n, c in sums.items()))
    totals = counts.groupBy(F.col("_host").alias("_h"), F.col("_at").alias("_a")).agg(F.sum("_n").alias("_total"))
    same = (F.col("_host") == F.col("_h")) & (F.col("_at") == F.col("_a"))
    found = counts.where(F.col("_n") >= min_rows).join(totals, same).where(F.col("_n") * 100 >= F.col("_total") * min_percent).drop("_h", "_a")
    pool = found.groupBy(F.col("_host").alias("_h"), F.col("_at").alias("_a")).agg(*(F.sum(n).alias(f"_all{n}") for n in sums))

    def likely(names: Sequence[str], limit: float) -> Column:
        own = [F.col(n).cast("double") for n in names]
        rest = [(F.col(f"_all{n}") - F.col(n)).cast("double") for n in names]
        chi = chi_square(own, rest)
        return (chi < limit) | (chi < F.lit(min_effect) * reduce(add, [*own, *rest]))

    merged = (F.col("_all_n") > F.col("_n")) & likely(list(kinds), CHI_SHAPE) & likely(["_good", "_bad"], CHI_LABELS)
    return found.join(pool, same).select("_host", "_at", "_segment", F.when(merged, "+").otherwise(F.concat(F.lit("="), "_segment")).alias("_step"))


def judge(
    spark: SparkSession, pages: DataFrame, keep: list[str], rules: Sequence[tuple[str, str]], url: str = "url", label: Column | None = None, min_rows: int = 3, min_percent: int = 2, min_effect: float = 0.01,
    max_levels: int = 16, prior: float = 0.5, strength: float = 2.0, min_purity: float = 0.25,
) -> tuple[DataFrame, dict[str, str]]:
    """The columns `keep` of pages with host, path, rule, template, purity and verdict, and the names of these by role, which clash with none of keep.

    rules: (`host/path`, allow or block), a list of hundreds, since each is an expression; see fitting_rule. label: whether a page is good, a boolean column of pages that may
    be null; without it, a page's label is its rule's verdict, so that pages no rule fits are judged by those that look like them.
    A template is a path of a host's tree, level by level: `=x` is the segment x, `*` a variable, `+` one of the branches that are alike (see literals);
    `**` stands for the segments after max_levels. purity is the share of good pages among a template's labelled ones, held towards prior by
    strength pages. verdict is the rule's; else a template below min_purity is blocked. With the defaults that takes three bad pages and no
    good one; a template without labels is allowed.

    A null URL, or one without `://`, has empty host and path and the template of that host's root. Empty segments don't count. Repeated rows count one by one and are judged
    alike. An empty table gives an empty table. Rows travel with `keep` and their URL's parts alone, and meet the tree's tables by a
    broadcast up to a bound of bytes, else by a shuffle on (host, template, segment)."""
    out = ("host", "path", "rule", "template", "purity", "verdict")
    names = dict(zip([*out, "segments", "label", "step"], fresh(pages.select(*keep), *out, "_segments", "_label", "_step"), strict=True))
    host, path, rule, at, segments, held = (names[r] for r in ("host", "path", "rule", "template", "segments", "label"))
    scratch = Scratch(spark, "urls")
    url_host, url_path = split_url(F.col(url))
    fits = fitting_rule(F.col(host), F.col(path), rules)
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in r)) if rules else None
    of_rule = F.element_at(verdicts, F.col(rule)) if rules else F.lit(None).cast("string")
    rows = pages.select(*keep, url_host.alias(host), url_path.alias(path), (F.lit(None).cast("boolean") if label is None else label).alias(held)).withColumn(rule, fits)
    rows = rows.withColumn(held, F.col(held) if label is not None else of_rule == ALLOW)
    rows = rows.withColumn(segments, F.filter(F.split(path, "/"), lambda s: s != "")).withColumn(at, F.lit(""))
    rows = scratch.put(rows, "level-0")
    deepest = rows.agg(F.max(F.size(segments))).first()[0] or 0
    for level in range(min(deepest, max_levels)):
        segment = F.get(segments, F.lit(level))
        found = literals(rows.where(F.size(segments) > level), host, at, segment, F.get(segments, F.lit(level + 1)), F.col(held), min_rows, min_percent, min_effect)
        found = small(scratch.put(found, f"literals-{level}"))
        same = (F.col(host) == F.col("_host")) & (F.col(at) == F.col("_at")) & (segment == F.col("_segment"))
        step = F.when(F.size(segments) > level, F.concat(F.lit("/"), F.coalesce(found["_step"], F.lit("*")))).otherwise(F.lit(""))
        rows = scratch.put(rows.join(found, same, "left").select(*(F.concat(at, step).alias(at) if c == at else F.col(f"`{c}`") for c in rows.columns)), f"level-{level + 1}")
        scratch.drop(f"level-{level}")
    rows = rows.withColumn(at, F.when(F.size(segments) > max_levels, F.concat(at, F.lit("/**"))).otherwise(F.col(at)))
    good, bad = F.count_if(F.col(held)), F.count_if(~F.col(held))
    purity = (good + F.lit(prior * strength)) / (good + bad + F.lit(strength))
    judged = small(scratch.put(rows.groupBy(F.col(host).alias("_host"), F.col(at).alias("_at")).agg(purity.alias("_purity")), "templates"))
    rows = rows.join(judged, (F.col(host) == F.col("_host")) & (F.col(at) == F.col("_at")))
    of_template = F.when(judged["_purity"] < min_purity, BLOCK).otherwise(ALLOW)
    done = {"purity": judged["_purity"], "verdict": F.coalesce(of_rule, of_template)}
    return rows.select(*keep, *(done.get(r, F.col(names[r])).alias(names[r]) for r in out)), {r: names[r] for r in out}


def keep_allowed(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", **options) -> DataFrame:
    """The pages whose verdict is allow, with the columns of pages. Only URLs are judged, and the blocked ones sent to all tasks up to a bound of bytes; beyond it pages are shuffled by URL."""
    rows, names = judge(spark, pages.select(F.col(url).alias("url")), ["url"], rules, **options)
    blocked = rows.where(F.col(names["verdict"]) != ALLOW).select(F.col("url").alias("_blocked")).distinct()
    return pages.join(small(Scratch(spark, "urls").put(blocked, "blocked")), F.col(url).eqNullSafe(F.col("_blocked")), "left_anti")
