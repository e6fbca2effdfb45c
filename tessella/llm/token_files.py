"""Token ids as ORC files: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, tidy
from .tokens import default_tokenizer, encoder, merged


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text", stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Writes doc_id, part, row, ids to ORC files at path, files and rows in ascending doc_id (null first).

    Texts are range-partitioned by id before they are encoded, so that the range's sample reads ids and no text is encoded twice. part
    and row number the rows of each file. Ids are ORC integers, run-length encoded; the files have row indexes each index_rows rows and a Bloom filter
    on doc_id, so that a point look-up reads one stripe's ids. Blocks are compressed by LZ4, as run lengths leave little to a slower codec. Null and empty texts hold end_id alone; repeated rows are written as often."""
    bound_batches(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("part int, row bigint, ids array<int>").fields])
    source = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in merged(batches):
            lo = 0
            for ids, ends in encoder(source).encode(b.column(1), end_id):
                n = len(ends)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), lists], names=schema.names)
                lo, row = lo + n, row + n

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes), "orc.compress": "LZ4"}
    rows.mapInArrow(tidy(run), schema).write.mode("overwrite").options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The rows that write_tokens() wrote; a filter on doc_id is pushed down to the files' indexes."""
    return spark.read.schema(f"doc_id {id_type}, part int, row bigint, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; start counts the ids of all documents before it."""
    bound_batches(spark)
    rows = read_tokens(spark, path, id_type)
    schema = T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string("n_tokens bigint, ids_crc32 bigint").fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy().astype("<u4", copy=False))
            crc = [zlib.crc32(values[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    scratch = Scratch(spark, "tokens")
    read = scratch.put(rows.mapInArrow(digest, schema), "index")
    parts = read.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n"))
    base = scratch.put(parts.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("base")), "base")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    out = read.withColumn("inside", inside).join(base, F.col("part") == F.col("of"))
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
