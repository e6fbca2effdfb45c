"""Best-fit packing with several capacities: tokens, documents and attention cost of a sequence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, tidy
from .tokens import default_tokenizer, encoder, merged

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass
class Plan:
    """Where pieces go, by length and rank within that length. Entry i: `count` pieces of `length`, from rank `first` on, go `per` to
    a sequence into the sequences from `sequence` on, the first of each at `offset`."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def add(self, *values: int) -> None:
        for name, v in zip(("length", "first", "count", "per", "sequence", "offset"), values, strict=True):
            getattr(self, name).append(int(v))


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> Plan:
    """Vector best fit, longest pieces first, for counts[length] pieces of each length.

    capacity: tokens, documents and attention cost (sum of squared lengths) of a sequence. Among the sequences with room in all
    three, rule "norm" takes the one whose weighted residual after placing is least, rule "dot" the one whose residual has the largest weighted
    dot product with the piece. Sequences with equal contents count as one group with a multiplicity, so the work depends on the number
    of different lengths, at most capacity[0], and not on the number of pieces. A piece that no empty sequence can hold is a ValueError."""
    full, w = np.array(capacity, float), np.array(weights, float)
    if any(size > capacity[0] or size * size > capacity[2] for size in counts) or capacity[1] < 1:
        raise ValueError("a piece is over the capacity of an empty sequence")
    left, used, many, base = (np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64))
    n, out = 0, Plan()

    def add(residual, tokens, count, sequence):
        nonlocal n, left, used, many, base
        if n == len(used):
            left, used, many, base = np.concatenate([left, np.zeros_like(left)]), *(np.concatenate([x, np.zeros_like(x)]) for x in (used, many, base))
        left[n], used[n], many[n], base[n] = residual, tokens, count, sequence
        n += 1

    for size in sorted(counts, reverse=True):
        need, rank, todo = np.array([size, 1, size * size], float), 0, counts[size]
        while todo:
            fits = np.flatnonzero((many[:n] > 0) & (left[:n] >= need).all(axis=1))
            if len(fits):
                rest = left[fits]
                score = (w * ((rest - need) / full) ** 2).sum(axis=1) if rule == "norm" else -(w * (rest / full) * (need / full)).sum(axis=1)
                at = int(fits[np.argmin(score)])
                per, whole = int((left[at] // need).min()), int(many[at])
            else:
                at, per = -1, int((full // need).min())
                whole = max(1, todo // per)
            per = min(per, todo)
            group = min(whole, todo // per)
            placed = per * group
            if at < 0:
                out.add(size, rank, placed, per, out.sequences, 0)
                add(full - per * need, per * size, group, out.sequences)
                out.sequences += group
            else:
                out.add(size, rank, placed, per, base[at], used[at])
                add(left[at] - per * need, used[at] + per * size, group, base[at])
                base[at] += group
                many[at] -= group
            rank, todo = rank + placed, todo - placed
        if n > 4096:  # sequences that can take no piece of this length or less, by any capacity, go
            live = np.flatnonzero((many[:n] > 0) & (left[:n] >= 1).all(axis=1))
            left[: len(live)], used[: len(live)], many[: len(live)], base[: len(live)] = left[live], used[live], many[live], base[live]
            n = len(live)
    return out


def best_plan(counts: dict[int, int], capacity: tuple[int, int, int]) -> Plan:
    """The plan with the fewest sequences of a few weightings of both rules."""
    tries = [plan(counts, capacity, w, rule) for rule, w in (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.01, 0.1)), ("dot", (1.0, 0.01, 0.1)))]
    return min(tries, key=lambda p: p.sequences)


def pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of PIECES: a document's ids and end_id, cut at each `length` ids. Null and empty texts have end_id alone."""
    bound_batches(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(PIECES).fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            at, rows, row = [], [], 0
            for ids, ends in encoder(tokenizer).encode(b.column(1), end_id):
                begin = 0
                for end in ends.tolist():
                    for lo in range(begin, end, length):
                        hi = min(lo + length, end)
                        at.append(row)
                        rows.append(((lo - begin) // length, lo - begin, hi - lo, zlib.crc32(ids[lo:hi])))
                    begin, row = end, row + 1
            if rows:
                more = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *more], names=schema.names)

    return docs.select(id_col, F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 0, max_documents: int | None = None, max_cost: int | None = None, id_col: str = "doc_id", text: str = "text", slot_rows: int = 100_000) -> DataFrame:
    """PIECES with sequence_id and offset: the pieces of all documents in as few sequences as vector best fit finds.

    A sequence holds at most `length` ids, max_documents pieces (default: length) and max_cost attention cost (default: length squared), which
    by default bind no tighter than tokens do; pieces are cut so that one keeps within max_cost. Only the counts of each length, at most `length` rows, reach the driver, and only the plan is
    sent out; its size follows the number of lengths and not the rows. Ranks within a length are numbered in slots of about slot_rows pieces,
    so that a length of a third of all pieces is dealt out. A repeated row is one more document. An empty table gives an empty table."""
    capacity = (length, max_documents or length, max_cost or length * length)
    length = min(length, isqrt(capacity[2]))
    scratch = Scratch(spark, "packing")
    cut = scratch.put(pieces(spark, docs, tokenizer or default_tokenizer(), length, end_id, id_col, text), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = best_plan(counts, capacity)
    slots = max(1, sum(counts.values()) // slot_rows)
    dealt = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    by = dealt.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = by.select(F.col("length").alias("of"), F.col("slot").alias("at"), (F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, (ranked["length"] == before["of"]) & (ranked["slot"] == before["at"]))
    order = np.lexsort((p.first, p.length))
    sent = spark.sparkContext.broadcast({k: np.asarray(getattr(p, k), np.int64)[order] for k in ("length", "first", "per", "sequence", "offset")})
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = sent.value
        big = int(e["first"].max(initial=0)) + 1
        keys = e["length"] * big + e["first"]
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "place"))
            at = np.searchsorted(keys, size * big + np.minimum(rank, big - 1), side="right") - 1
            step = rank - e["first"][at]
            per = e["per"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(e["sequence"][at] + step // per), pa.array(e["offset"][at] + step % per * size)], names=schema.names)

    return ranked.select(*cut.columns, (F.col("rank") + F.col("before")).alias("place")).mapInArrow(place, schema)
