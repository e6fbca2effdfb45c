"""What the training-data operators share: scratch tables, word splitting, bounded caches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of every operator here are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The same six characters, for trimming.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes an Arrow batch may hold, whichever is reached first; one row is always taken whole.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves all other letters."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """The number of words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that a batch of long texts stays small. Lower settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(size))) <= BATCH_BYTES or not re.fullmatch(r"\d+b?", spark.conf.get(size)):
        spark.conf.set(size, str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has one of them already (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may run without one; it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage. They go when dropped, or when the JVM closes the file system."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex[:12]}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.path(self.at))

    def where(self, name: str) -> str:
        return f"{self.at}/{name}"

    def put(self, df: DataFrame, name: str, files: int | None = None, tasks: int | None = None) -> DataFrame:
        """Writes df and returns the written table. files: for a small table, whose rows are dealt to so many files after they are
        made at full width. tasks: the most tasks that make and write it, a number that follows the rows."""
        out = df.repartition(files) if files else df.coalesce(tasks) if tasks else df
        out.write.mode("overwrite").parquet(self.where(name))
        return self.spark.read.schema(df.schema).parquet(self.where(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.path(self.where(name)), True)


#: Bytes of rows that are broadcast at most; a larger table is joined by a shuffle. A row counts as ROW_BYTES beside its fields.
FEW, ROW_BYTES = 64 << 20, 32


def field_bytes(value: Column, kind: T.DataType) -> Column:
    """About what a field takes in memory, as long: 16 bytes, and the bytes of strings, binaries and all elements and fields below it."""
    fixed = F.lit(16).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + fixed
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + field_bytes(x, kind.elementType)), F.lit(0)) + fixed
        return F.coalesce(F.size(value).cast("long"), F.lit(0)) * 16 + fixed
    if isinstance(kind, T.MapType):
        return field_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + field_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return reduce(add, (field_bytes(value[f.name], f.dataType) for f in kind), fixed)
    return fixed


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if its rows, every field of them measured, have FEW bytes or less."""
    size = reduce(add, (field_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= FEW else df


def ranged(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, peers: bool = False) -> DataFrame:
    """df with running sums in a global order: each name holds the sum of its column over all rows before (peers: and over those up to the row and its ties).

    Rows are range-partitioned and summed by partition, so that only a row for each partition meets in one task. No name may be df's."""
    (part, of), base = fresh(df, "_part", "_of"), [f"_base_{i}" for i in range(len(sums))]
    held = df.withColumns({n: c for n, c in sums.items()})
    held = scratch.put(held.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = held.groupBy(F.col(part).alias(of)).agg(*(F.sum(n).alias(b) for n, b in zip(sums, base, strict=True)))
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(of, *(F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in base))
    inside = Window.partitionBy(part).orderBy(*order)
    inside = inside if peers else inside.rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}).join(F.broadcast(totals), F.col(part) == F.col(of))
    return out.select(*df.columns, *((F.col(n) + F.col(b)).alias(n) for n, b in zip(sums, base, strict=True)))


def tidy(run: Callable) -> Callable:
    """run over a partition's batches, then freed memory given back: a worker process outlives its tasks and shares the executor's memory with the next one's."""

    def over(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return over


class Memo(dict):
    """A cache of make(key) that empties itself at limit entries; results don't depend on it."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    """A 64-bit hash of each word. memo: of xxh3."""
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hash_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers by place in a window, from a rule: golden-ratio steps through the finaliser.
with np.errstate(over="ignore"):
    PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words, in order; h: the words' hashes. With fewer words than k, none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc += mix(h[i : i + n]) * PLACES[i]
        return mix(acc)


def shingle_set(words: list[bytes], k: int, memo: Memo) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one, without words none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, memo)
    return np.unique(windows(h, min(k, len(h))))
