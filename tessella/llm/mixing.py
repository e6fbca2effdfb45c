"""Mixing sources to target weights by weighted fair queueing over virtual finish times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, n_words, ranged, small

#: Rows for which there is one more slot. A source's shuffled documents are summed slot by slot, so that a source of a third of all rows is dealt out.
SLOT_ROWS, LEAST_SLOTS = 4_000, 64


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...], percent: int, passes: int) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row for each source.

    Targets share percent % of all sizes by weight; one that would exceed passes times its source's size stops there, and the excess is
    shared again by weight. That is a water level: sources in the order of cap / weight are capped as long as the level over the rest
    reaches their cap. Sources are ranked and summed in range partitions, so that there may be as many as hosts. One row reaches the driver."""
    name = [F.col("source").isNull(), F.encode("source", "utf-8")]
    rows = ranged(scratch, sizes, name, {"n": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("n", F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = rows.withColumn("weight", weight).withColumn("cap", (passes * F.col("source_size")).cast("double")).drop("n")
    words, whole = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rows = ranged(scratch, rows, [F.col("cap") / F.col("weight"), *name], {"below": F.col("cap"), "closed": F.col("weight")}, "caps")
    level = (F.lit((words or 0) * percent / 100) - F.col("below")) / (F.lit(float(whole or 0)) - F.col("closed"))
    over = rows.where(F.col("cap") / F.col("weight") > level)
    water = over.agg(F.min_by(level, F.struct(F.col("cap") / F.col("weight"), *name))).first()[0]
    shared = F.col("cap") if water is None else F.least("cap", F.col("weight") * F.lit(water))
    return rows.select("source", "source_size", shared.alias("target"))


def shuffle_key(id_col: Column, seed: int) -> Column:
    """The place of a document in its source's shuffle: hexadecimal digits of a digest, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(spark: SparkSession, docs: DataFrame, names: dict[str, str], id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, passes: int = 2, seed: int = 17, whole_documents: bool = False) -> DataFrame:
    """docs with size, source_size, target, finish and taken, under the names given for these five.

    A document's size is its number of words (null: 0). Each source shuffles its documents; one starts at the words before it in its source, and a pass later
    at that and the source's size. Its virtual finish time is the words to its end, divided by its source's target in whole words (finish: of the first pass; null if
    the target is 0). Sizes and finish times of all sources are then range-sorted by finish time and summed; the queue is cut at the last time up to which
    the sum is within the total budget, that of the targets. A document that its source serves while the target is reached is split there, so that words before
    the target finish by time 1 and the others later: each source gives its target to the word. whole_documents: nothing is split, and a document is taken
    in a pass if it finishes by the cut. taken sums the passes.

    Ties in the digest fall to the text's digest, ties in finish time are on one side of the cut; repeated rows take places one after another.
    Documents without words take none. A null source is a source; a null id shuffles as an empty one. An empty table gives an empty table.
    Texts are read twice and moved at most once; the sort moves sizes alone, and one row of it reaches the driver."""
    slot, place, tie, src, off, size_, tot, tgt, cnt = fresh(docs, "_slot", "_place", "_tie", "_src", "_off", "_size", "_total", "_target", "_sum")
    scratch = Scratch(spark, "mixing")
    slots = max(LEAST_SLOTS, docs.count() // SLOT_ROWS)
    number = F.conv(F.substring(place, 1, 8), 16, 10).cast("bigint")
    size = docs.withColumns({size_: n_words(F.col(text)), place: shuffle_key(F.col(id_col), seed), tie: F.xxhash64(text)})
    size = size.withColumn(slot, F.shiftright(number * slots, 32).cast("int"))
    sizes = scratch.put(size.select(F.col(source).alias(source), size_, place, tie, slot), "sizes")
    sums = sizes.groupBy(F.col(source).alias(src), slot).agg(F.sum(size_).alias(cnt))
    goal = targets(scratch, sums.groupBy(F.col(src).alias("source")).agg(F.sum(cnt).alias("source_size")), weights, percent, passes)
    offsets = sums.withColumn(off, F.sum(cnt).over(Window.partitionBy(src).orderBy(slot)) - F.col(cnt)).drop(cnt)
    base = offsets.join(goal, offsets[src].eqNullSafe(goal["source"])).select(src, F.col(slot).alias(cnt), off, F.col("source_size").alias(tot), F.col("target").alias(tgt))
    # a row for each source and slot: sent to all tasks where these are few, so that texts move once
    base = small(scratch.put(base, "base", max(1, slots // 512)))

    def started(rows: DataFrame) -> DataFrame:
        rows = rows.join(base, rows[source].eqNullSafe(base[src]) & (rows[slot] == base[cnt]))
        w = Window.partitionBy(src, slot).orderBy(place, tie).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(off, F.col(off) + F.coalesce(F.sum(size_).over(w), F.lit(0)))

    goal_words = F.round(F.col(tgt)).cast("long")

    def finish(words: Column) -> Column:
        return F.when(goal_words > 0, words / goal_words)

    start = [F.col(off) + turn * F.col(tot) for turn in range(passes)]
    if whole_documents:
        parts = [F.struct(finish(s + F.col(size_)).alias("finish"), F.col(size_).alias("words")) for s in start]
    else:
        split = [F.least(F.col(size_), F.greatest(F.lit(0), goal_words - s)) for s in start]
        parts = [F.struct(finish(e).alias("finish"), n.alias("words")) for s, h in zip(start, split, strict=True) for e, n in ((s + h, h), (s + F.col(size_), F.col(size_) - h))]
    queue = started(sizes).select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("words > 0 and finish is not null")
    budget = goal.agg(F.sum(F.round("target").cast("long"))).first()[0] or 0
    queue = ranged(scratch, queue, [F.col("finish")], {"upto": F.col("words")}, "queue", peers=True)
    cut = queue.where(F.col("upto") <= budget).agg(F.max("finish")).first()[0] or 0.0
    scratch.drop("queue", "sizes")

    def taken(s: Column) -> Column:
        if whole_documents:
            return F.when(finish(s + F.col(size_)) <= cut, F.col(size_)).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(F.col(size_), F.round(goal_words * F.lit(cut)).cast("long") - s))

    total = sum((taken(s) for s in start[1:]), taken(start[0])).cast("long")
    found = {"size": F.col(size_), "source_size": F.col(tot), "target": F.col(tgt), "finish": finish(F.col(off) + F.col(size_)), "taken": total}
    return started(size).select(*[F.col(f"`{c}`") for c in docs.columns], *(found[k].alias(n) for k, n in names.items()))


def mixed_documents(spark: SparkSession, docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as documents: each row of docs as often as whole passes take it, with the columns of docs. Documents without words go."""
    size, taken = fresh(docs, "_size", "_taken")
    out = mix(spark, docs, {"size": size, "taken": taken}, text=text, whole_documents=True, **options)
    copies = F.when(F.col(size) > 0, (F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    return out.where(F.col(taken) > 0).withColumn(size, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
