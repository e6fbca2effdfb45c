"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, fresh, small


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of a line's key: two lines with one hash among 10^13 lines have odds of 10^-13."""
    return F.unhex(F.md5(key))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """key, keeper: the keys of at least min_chars code points in at least min_docs documents, and the largest id that holds each.

    Each document sends a key once (array_distinct), and rows are summed by (key, document) before documents are counted, so that a
    line of a third of all documents is no more than one partial row for each task. Rows without an id are one document, below all ids."""
    keys = F.array_distinct(F.filter(F.transform(text_lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars))
    seen = docs.select(F.col(id_col).alias("id"), F.explode(F.transform(keys, key_hash)).alias("key"))
    return seen.groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with its text rebuilt from the lines that stay, in order, joined by \\n.

    counts: names of two columns to add, lines before dropping and lines dropped. A null or empty text is one empty line, and stays
    null or empty. In the keeper all copies of a line stay. Repeated rows are alike in all they keep. Columns of any other name pass through."""
    key, keeper, drop, left = fresh(docs, "_key", "_keeper", "_drop", "_id")
    scratch = Scratch(spark, "lines")
    # keys of shared lines are few, and documents that lose some get a list of these; both go to all tasks within a bound of bytes, so that neither lines nor texts move
    shared = small(scratch.put(shared_lines(docs, id_col, text, min_chars, min_docs).select(F.col("key").alias(key), F.col("keeper").alias(keeper)), "shared"))
    keys = F.array_distinct(F.filter(F.transform(text_lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars))
    seen = docs.select(F.col(id_col).alias(left), F.explode(F.transform(keys, key_hash)).alias(key))
    lists = seen.join(shared, key).where(~F.col(left).eqNullSafe(F.col(keeper))).groupBy(left).agg(F.collect_set(key).alias(drop))
    lists = small(scratch.put(lists, "lists"))
    out = docs.join(lists, F.col(id_col).eqNullSafe(F.col(left)), "left")
    stays = F.filter(text_lines(F.col(text)), lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col(drop), key_hash(line_key(x)))))
    done = out.withColumn(left, F.when(F.col(drop).isNotNull() & F.col(text).isNotNull(), stays))
    more = []
    if counts:
        total = F.size(text_lines(F.col(text))).cast("long")
        more = [total.alias(counts[0]), F.when(F.col(left).isNull(), F.lit(0).cast("long")).otherwise(total - F.size(left)).alias(counts[1])]
    kept = {text: F.when(F.col(left).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text)}
    return done.select(*[kept.get(c, F.col(f"`{c}`")) for c in docs.columns], *more)
