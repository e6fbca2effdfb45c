"""Column functions on texts, and array folds that have no built-in form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    """A text without white space, by Unicode, at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ordered_case(pairs: list[tuple[Column, object]], other: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out.otherwise(other)


def not_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """English sentences: cut at white space after . ! ?"""
    return not_empty(F.split(strip(text), P.SENTENCE))


def cjk_sentences(text: Column) -> Column:
    """Sentences cut after 。！？；!?; and not after an ASCII full stop."""
    return not_empty(F.split(text, P.CJK_SENTENCE))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def content_words(text: Column) -> Column:
    """Lower-case English content words, with repeats."""
    words = F.transform(all_matches(text, P.CONTENT_WORD), F.lower)
    return F.filter(words, lambda w: ~w.isin(P.CONTENT_STOPWORDS))


def n_split(text: Column) -> Column:
    """Words between runs of white space."""
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"(?U)\s+")))


def tokens(text: Column) -> Column:
    """Search tokens: lower-case runs of Latin letters and digits, and Han runs as bigrams (alone: the character).

    The same function serves the index and queries; an Arrow UDF with a segmenter can take its place."""
    runs = F.transform(all_matches(F.coalesce(text, F.lit("")), r"\p{IsHan}+|[\p{IsLatin}\p{N}]+"), F.lower)

    def grams(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^\p{IsHan}"), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(runs, grams))


def join_lines(parts: Column) -> Column:
    """Lines joined by one space, and by none next to a CJK character."""

    def step(acc: Column, x: Column) -> Column:
        p = strip(x)
        glue = F.when(F.right(acc, F.lit(1)).rlike(P.CJK_JOIN) | F.left(p, F.lit(1)).rlike(P.CJK_JOIN), "").otherwise(" ")
        return F.when(p == "", acc).when(acc == "", p).otherwise(F.concat(acc, glue, p))

    return F.aggregate(parts, F.lit(""), step)


def sentence_budget(text: Column, budget: int, size, extra: int) -> Column:
    """Whole leading sentences while the sizes (each plus `extra`) stay within budget, the first in any case."""
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        n = size(s)
        over = acc["done"] | ((acc["n"] + n > budget) & (F.size(acc["kept"]) > 0))
        total = F.when(over, acc["n"]).otherwise(acc["n"] + n + extra).cast("int")
        return F.struct(total.alias("n"), (over | (total >= budget)).alias("done"), F.when(over, acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"))

    return F.aggregate(sentences(text), state, step, lambda a: F.array_join(a["kept"], " "))


def word_budget(text: Column, budget: int) -> Column:
    return sentence_budget(text, budget, n_split, 0)


def char_budget(text: Column, budget: int) -> Column:
    return sentence_budget(text, budget, F.length, 1)


def pack_sentences(text: Column, target: int, hard_max: int, overlap: int) -> Column:
    """A long paragraph as pieces of about target characters: whole sentences, those over hard_max cut each hard_max characters.

    With overlap, a piece starts with the last sentence of the piece before it as it was without overlap, if the result is within hard_max."""
    state = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        flushed = F.when(cur != "", F.array_append(out, cur)).otherwise(out)
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / hard_max).cast("int")), lambda i: F.substring(s, i * hard_max + 1, F.lit(hard_max)))
        long = F.struct(F.lit("").alias("cur"), F.concat(flushed, cut).alias("out"))
        full = F.struct(s.alias("cur"), F.array_append(out, cur).alias("out"))
        more = F.struct(F.concat(cur, s).alias("cur"), out.alias("out"))
        return F.when(F.length(s) > hard_max, long).when((cur != "") & (F.length(cur) + F.length(s) > target), full).otherwise(more)

    pieces = F.aggregate(cjk_sentences(text), state, step, lambda a: F.when(a["cur"] != "", F.array_append(a["out"], a["cur"])).otherwise(a["out"]))
    if overlap <= 0:
        return pieces
    pairs = F.zip_with(pieces, F.concat(F.array(F.lit("")), pieces), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def lead(x: Column) -> Column:
        last = F.coalesce(F.try_element_at(cjk_sentences(x["q"]), F.lit(-1)), F.lit(""))
        return F.when((last != "") & (F.length(x["p"]) + F.length(last) <= hard_max), F.concat(last, x["p"])).otherwise(x["p"])

    return F.transform(F.filter(pairs, lambda x: x["p"].isNotNull()), lead)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first occurrence of old replaced; unchanged without one."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.left(text, at - 1), new, F.substring(text, at + F.length(old), F.lit(2147483647)))).otherwise(text)


def regex_at(text: Column, pattern: str) -> Column:
    """The 1-based place of the first match, 0 without one."""
    return F.regexp_instr(text, F.lit(pattern))


def short_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1."""
    return F.left(F.sha1(F.encode(c, "utf-8")), F.lit(16))


def match_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """Matches in order as structs: at (0-based), stop, m, g1.. (groups; empty where one took no part).

    Spark gives matches without places; these follow from the gaps between them."""
    found = [all_matches(text, pattern, g) for g in range(groups + 1)]
    names = ["m", *(f"g{g}" for g in range(1, groups + 1))]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(*(f.alias(n) for f, n in zip(found, names, strict=True)), F.slice(gaps, 1, F.greatest(F.size(found[0]), F.lit(1))).alias("gap"))
    item = "struct<at:int,stop:int," + ",".join(f"{n}:string" for n in names) + ">"

    def step(acc: Column, x: Column) -> Column:
        at = acc["end"] + F.coalesce(x["gap"], F.lit(0))
        stop = at + F.length(x["m"])
        one = F.struct(at.alias("at"), stop.alias("stop"), *(x[n].alias(n) for n in names)).cast(item)
        return F.struct(stop.cast("int").alias("end"), F.array_append(acc["out"], one).alias("out"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{item}>").alias("out"))
    return F.aggregate(F.filter(rows, lambda x: x["m"].isNotNull()), zero, step, lambda a: a["out"])


def ordered_distinct(df, by: list[str], value: str, order: list[str], key: str | None = None, name: str = "items"):
    """One row for each group with the distinct values in order of first appearance; key: what makes two values one, the first form stays."""
    k = F.col(key) if key else F.col(value)
    first = df.groupBy(*by, k.alias("_k")).agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_f"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x["_v"]).alias(name))
