"""Personal data: four patterns, and terms that reveal a protected value by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, small

#: The kinds in the order of a tie, and their patterns. Loops that nothing after them can shorten are possessive, and a match
#: starts where its run of characters starts or where the match before ended, as no later start of that run can do better; so long runs take one pass.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A term, the same wherever it is looked for: letters, digits and marks, joined inside by apostrophes, hyphens or underscores. Loops are possessive.
TERM = r"[\p{L}\p{N}\p{M}]++(?:['’_-]++[\p{L}\p{N}\p{M}]++)*+"
SPAN = "struct<start:bigint,kind:int,stop:bigint,value:string>"


#: Matches whose places are summed up at a time.
RUN = 256


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as an array of SPAN. Their places follow from the lengths of the gaps between them.

    Places are summed within runs of RUN matches and over the runs, so that no array of all matches is copied for each of them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    spans, none = f"array<{SPAN}>", F.array().cast(f"array<{SPAN}>")
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(m.alias("m"), F.char_length(F.coalesce(g, F.lit(""))).alias("g")))

    def step(acc, x):
        start = acc["at"] + x["g"]
        stop = start + F.char_length(x["m"])
        one = F.array(F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), stop.cast("bigint").alias("stop"), x["m"].alias("value")).cast(SPAN))
        return F.struct(stop.cast("bigint").alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(all_):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(RUN)), lambda i: F.slice(all_, i, F.lit(RUN)))
        size = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + x["g"] + F.char_length(x["m"])))
        begin = F.aggregate(size, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        each = F.zip_with(runs, F.slice(begin, 1, F.size(runs)), lambda r, at: F.aggregate(r, F.struct(at.alias("at"), none.alias("out")), step)["out"])
        return F.flatten(each).cast(spans)

    return F.coalesce(F.get(F.transform(F.array(F.filter(pairs, lambda x: x["m"].isNotNull())), placed), F.lit(0)), none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.char_length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of the four patterns that pass their checks, by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(i: int, kind: str) -> Column:
        return F.when(text.rlike(NEEDS[kind]), F.filter(matches(text, PATTERNS[kind], i), lambda s: holds(kind, s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def joined(spans: Column, names: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def terms(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def entity(span: Column) -> Column:
    """What a base span protects: its value without its case and, for numbers but addresses, without what isn't a digit; the kind is a part of it."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", ""))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def evidence(both: Column, of: Column, share: Column) -> Column:
    """Bits against chance: by Chernoff's bound, `both` or more of `of` texts hold what a `share` of all texts holds with odds of at most 2 to the minus this."""
    p = both / of
    rest = F.when(both < of, (1 - p) * F.log2((1 - p) / (1 - share))).otherwise(F.lit(0.0))
    return of * (p * F.log2(p / share) + rest)


def disclosing(base: DataFrame, docs: DataFrame, copies: DataFrame, n: int, text: str, scratch: Scratch, threshold: float, error: float, tasks: int) -> DataFrame:
    """entity, term: the pairs whose pointwise mutual information over documents, log(n n(e,t) / (n(e) n(t))), is at least `threshold` times the
    entity's information log(n / n(e)), and whose co-occurrence is no chance: with odds of `error` over all pairs of an entity and a term (evidence()).

    base: digest, base, words (of rows with a base span). All counts are of different texts, of which the corpus has n; copies: copy, times of those digests that more than
    one row has, as each of their rows then counts 1 / times. What no term can reach is left out before pairs are made, and nothing else: entities that even
    a term of just their texts could not reveal, and terms that are too rare or too common for every entity that is left."""
    held = base.where(F.size("base") > 0).groupBy("digest").agg(F.any_value(F.array_distinct(F.transform("base", entity))).alias("entities"), F.any_value("words").alias("words"))
    held = scratch.put(held, "held", tasks=tasks)
    entities = held.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("ne"))
    entities = scratch.put(entities, "entities", max(1, tasks // 50))
    all_, many = F.lit(float(max(n, 1))), entities.count()
    reach = (F.col("ne") < all_) & (F.col("ne") * F.log2(all_ / F.col("ne")) >= log2(max(1, many) / error))
    if entities.where(reach).isEmpty():  # not even if the corpus had a single term; so its terms needn't be counted
        return entities.where("false").select(F.col("e").alias("entity"), F.lit("").alias("term"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("digest"), terms(body).alias("words"))
    rows = rows.join(small(copies), F.col("digest") == F.col("copy"), "left").select("words", (1 / F.coalesce("times", F.lit(1))).alias("part"))
    # words are summed for each task before they are shuffled, so that the shuffle holds a task's vocabulary and not its text
    seen = rows.select(F.explode("words").alias("term"), "part").groupBy("term").agg(F.round(F.sum("part")).cast("bigint").alias("nt"))
    seen = scratch.put(seen, "terms", tasks=tasks)
    bits = log2(max(1, many) * max(1, seen.count()) / error)
    most = F.pow(F.col("ne").cast("double"), F.lit(threshold)) * F.pow(all_, F.lit(1 - threshold))
    live = entities.where((F.col("ne") < all_) & (F.col("ne") * F.log2(all_ / F.col("ne")) >= bits)).withColumn("most", most)
    widest = live.agg(F.max("most")).first()[0]
    if widest is None:
        return live.select(F.col("e").alias("entity"), F.lit("").alias("term"))
    owners = held.select("digest", F.explode("entities").alias("entity")).join(live, F.col("entity") == F.col("e")).select(F.col("digest").alias("of"), "entity", "ne", "most")
    words = held.join(owners.select("of").distinct(), F.col("digest") == F.col("of"), "left_semi").select("digest", F.explode("words").alias("word"))
    words = words.join(seen, F.col("word") == F.col("term")).where((F.col("nt") * F.log2(all_) >= bits) & (F.col("nt") <= widest)).select("digest", "term", "nt")
    pairs = words.join(owners, (F.col("digest") == F.col("of")) & (F.col("nt") <= F.col("most")))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.first("nt").alias("nt"), F.first("ne").alias("ne"))
    info, mutual = F.log2(all_ / F.col("ne")), F.log2(all_ * F.col("both") / (F.col("ne") * F.col("nt")))
    return pairs.where((mutual >= threshold * info) & (evidence(F.col("both"), F.col("nt"), F.col("ne") / all_) >= bits)).select("entity", "term")


def term_spans(docs: DataFrame, told: DataFrame, id_col: str, text: str, scratch: Scratch, files: int) -> DataFrame:
    """_id, _digest, terms: the spans (kind 4) of the told terms in each different pair of an id and a text that holds one. told: term.

    A row's terms are placed where its text is, and only those that are told leave it."""
    told = small(told.select(F.col("term").alias("_told")))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_body")).withColumn("_digest", F.xxhash64("_body"))
    holders = rows.select("_id", "_digest", F.explode(terms(F.col("_body"))).alias("_word")).join(told, F.col("_word") == F.col("_told"), "left_semi")
    holders = holders.groupBy(F.col("_id").alias("_hid"), F.col("_digest").alias("_hdigest")).agg(F.collect_set("_word").alias("_words"))
    holders = small(scratch.put(holders, "holders", files))
    rows = rows.join(holders, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_digest") == F.col("_hdigest")))
    found = F.transform(matches(F.col("_body"), TERM, 4), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lower(s["value"]).alias("value")))
    each = rows.select("_id", "_digest", F.filter(found, lambda s: F.array_contains("_words", s["value"])).cast(f"array<{SPAN}>").alias("terms"))
    return each.dropDuplicates(["_id", "_digest"])


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.9, error: float = 0.05) -> DataFrame:
    """id, digest (of the text), base, more for each row of docs: arrays of spans (start, kind, stop, value), in code points, stop exclusive.

    base: what the four patterns find and their checks pass. more (kind 4): terms that the corpus ties to a base value (see disclosing()), wherever
    they stand, in documents with the value and without, that overlap no base span. Null and empty texts have neither; a null id is judged like any
    other; repeated rows have equal results, and count once, as texts are counted by their digests. An empty table gives an empty table."""
    scratch = Scratch(spark, "pii")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), body.alias("text")).withColumn("base", base_spans(F.col("text")))
    base = base.select("id", F.xxhash64("text").alias("digest"), "base", F.when(F.size("base") > 0, terms(F.col("text"))).alias("words"))
    n = docs.count()
    tasks, few = max(24, n // 2_000), max(1, n // 100_000)
    base = scratch.put(base, "base", tasks=tasks)
    copies = scratch.put(base.groupBy(F.col("digest").alias("copy")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "copies", few)
    texts = n - (copies.agg(F.sum(F.col("times") - 1)).first()[0] or 0)
    told = scratch.put(disclosing(base, docs, copies, texts, text, scratch, threshold, error, tasks).select("term").distinct(), "told", few)
    none = F.array().cast(f"array<{SPAN}>")
    if told.isEmpty():
        return base.select("id", "digest", "base", none.alias("more"))
    spans = scratch.put(term_spans(docs, told, id_col, text, scratch, few), "spans", few)
    out = base.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    free = F.filter("terms", lambda w: ~F.exists("base", lambda o: (o["start"] < w["stop"]) & (w["start"] < o["stop"])))
    return out.select("id", "digest", "base", F.coalesce(free, none).alias("more"))


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with base spans generalised to their kind in brackets and disclosing terms removed, with the columns of docs.

    Rows are matched by id and a digest of the text, so that ids may repeat."""
    spans, at, pid, pat = fresh(docs, "_spans", "_at", "_pid", "_pat")
    found = find(spark, docs, id_col, text, **options)
    keyed = docs.withColumn(at, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    cut = found.select(F.col("id").alias(pid), F.col("digest").alias(pat), F.concat("base", "more").alias(spans)).where(F.size(spans) > 0).dropDuplicates([pid, pat])
    joined_ = keyed.join(cut, F.col(id_col).eqNullSafe(F.col(pid)) & (F.col(at) == F.col(pat)), "left")
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col(text), acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], F.element_at(names, s["kind"] + 1)).otherwise("")).alias("out"))

    done = F.aggregate(F.array_sort(F.col(spans)), start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"].cast("int") + 1, F.lit(2147483647))))
    return joined_.select(*[F.when(F.col(spans).isNull(), F.col(text)).otherwise(done).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


__all__ = ["KINDS", "SPAN", "base_spans", "disclosing", "evidence", "find", "joined", "sanitise", "term_spans", "terms"]
