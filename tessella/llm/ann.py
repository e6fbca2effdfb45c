"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids of x (float32), by Lloyd's rounds; an empty centroid moves to a random row."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The number of each row's nearest centroid, chunk by chunk."""
    size = (c * c).sum(axis=1)
    return np.concatenate([np.argmin(size - 2 * (x[lo : lo + chunk] @ c.T), axis=1) for lo in range(0, max(1, len(x)), chunk)])


@dataclass
class Index:
    """coarse: (lists, dim). books: (parts, codes, dim / parts), of the residuals. dim counts zero padding."""

    coarse: np.ndarray
    books: np.ndarray
    dim: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.coarse.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of padded unit vectors in their lists, as bytes, and the lengths of what the codes leave."""
        r = (x - self.coarse[lists]).reshape(len(x), len(self.books), -1)
        code = np.stack([nearest(r[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)
        rest = r - self.books[np.arange(len(self.books)), code]
        return code, np.sqrt((rest * rest).sum(axis=(1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Dot products of padded query vectors with each part's codes: (queries, parts, codes)."""
        return np.einsum("qpd,pcd->qpc", q.reshape(len(q), len(self.books), -1), self.books)


def train(sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 3) -> Index:
    """An index of unit vectors. sample: float32 unit rows."""
    rng = np.random.default_rng(seed)
    width = -(-sample.shape[1] // parts) * parts
    x = np.pad(sample, ((0, 0), (0, width - sample.shape[1])))
    coarse = kmeans(x, lists, 8, rng)
    r = (x - coarse[nearest(x, coarse)]).reshape(len(x), parts, -1)
    books = []
    for p in range(parts):
        book = kmeans(np.ascontiguousarray(r[:, p]), codes, 8, rng)
        books.append(np.pad(book, ((0, codes - len(book)), (0, 0)), mode="edge"))
    return Index(coarse, np.stack(books), sample.shape[1])


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def probes_for(index: Index, x: np.ndarray, k: int, recall: float, seed: int, held: int = 256) -> int:
    """The lists to probe: the least number that finds the share `recall` of the k nearest of `held` rows of the sample, by brute force over the sample.

    Neighbours in all rows are nearer than those in the sample, and so more often in a near list: the number errs to the safe side."""
    q = index.pad(x[np.random.default_rng(seed).permutation(len(x))[:held]])
    x = index.pad(x)
    lists = nearest(x, index.coarse)
    c = index.coarse
    place = np.argsort(np.argsort((c * c).sum(axis=1) - 2 * (q @ c.T), axis=1), axis=1)
    m = min(k + 1, len(x))
    near = np.argpartition(-(q @ x.T), m - 1, axis=1)[:, :m]
    # the nearest row is the query itself, in its own list
    at = np.sort(np.take_along_axis(place, lists[near], 1), axis=1)[:, 1:].ravel()
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def search(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", recall: float = 0.97, parts: int = 16, codes: int = 256, sample: int = 131_072, block: int = 8192, seed: int = 3) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each query row, its own id left out; score is the cosine in double precision.

    Equal vectors are one entry of the index, with their k + 1 smallest ids, so that a vector of a third of all rows is searched, and
    searches, once. There are about as many lists as the square root of the entries. The index is fitted on 64 distinct vectors for each list, at most `sample`, those first by
    a digest, which alone reach the driver; every distinct vector is then assigned and coded, and its quantisation error is kept with its code. A query probes as many lists
    as hold the share `recall` of the nearest rows of the sample (probes_for()): few where vectors lie in clusters, most where they don't. Its dot products with the codes of each
    list (asymmetric tables) lie within that error of the true ones, and every entry that can so be among the k + 1 best of its block of a list is compared by exact cosine;
    the best k + 1 of each block go on. No entry of a probed list is lost, however many are alike. Lists are dealt in blocks of about `block` entries.
    Vectors of different dimensions have no cosine: each dimension is searched by itself. Vectors that usable() rules out take no part.
    Null ids take no part; repeated ids take part as rows. Ties go to the smaller id. An empty table gives an empty table."""
    v = F.col(vector).cast("array<double>")
    ok = rows.select(F.col(id_col).alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
    counts = sorted((r["dim"], r["n"]) for r in ok.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect())
    found = [search_dim(spark, ok.where(F.size("v") == dim), dim, n, k, recall, parts, codes, sample, block, seed) for dim, n in counts]
    kind = rows.schema[id_col].dataType.simpleString()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")


def search_dim(spark: SparkSession, ok: DataFrame, dim: int, n: int, k: int, recall: float, parts: int, codes: int, sample: int, block: int, seed: int) -> DataFrame:
    """search() over id, v, q: usable vectors of one dimension, about n rows."""
    scratch = Scratch(spark, "ann")
    kind = ok.schema["id"].dataType.simpleString()
    lists = max(1, round(n**0.5))
    sample = min(sample, 64 * lists)
    ok = ok.withColumn("key", F.unhex(F.md5(F.to_json("v"))))
    least = ok.select("key", "id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    least = scratch.put(least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ids")
    entries = scratch.put(ok.groupBy("key").agg(F.any_value("v").alias("v"), F.bool_or(F.coalesce("q", F.lit(False))).alias("q")), "entries")
    drawn = entries.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample).select("v").toArrow()
    def scaled(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Rows, each by the power of two of its largest component: no square leaves the range of doubles, and no digit is lost."""
        flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        y = np.asarray(flat.flatten(), float).reshape(-1, dim)
        return np.ldexp(y, -np.frexp(np.abs(y).max(axis=1, keepdims=True))[1])

    def length_one(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
        y = scaled(vectors)
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    x = length_one(drawn.column("v")).astype(np.float32)
    index = train(x, min(lists, max(1, len(x) // 32)), min(parts, dim), min(codes, max(1, len(x))), seed)
    probes = probes_for(index, x, k, recall, seed)
    sent = spark.sparkContext.broadcast(index)

    def unit(b: pa.RecordBatch, i: int) -> np.ndarray:
        return sent.value.pad(length_one(b.column(i)).astype(np.float32))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = unit(b, 1)
                at = nearest(y, sent.value.coarse)
                code, rest = sent.value.encode(y, at)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(rest.astype(np.float32)), b.column(1)], names=["key", "list", "code", "rest", "v"])

    coded = scratch.put(entries.select("key", "v").mapInArrow(assign, "key binary, list int, code binary, rest float, v array<double>"), "coded")
    blocks = scratch.put(coded.groupBy(F.col("list").alias("blist")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks", 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            y, c = unit(b, 1), sent.value.coarse
            far = (c * c).sum(axis=1) - 2 * (y @ c.T)
            at = np.argpartition(far, probes - 1, axis=1)[:, :probes].astype(np.int32)
            rep = pa.array(np.repeat(np.arange(len(b)), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rep), b.column(1).take(rep), pa.array(at.ravel())], names=["qkey", "qv", "qlist"])

    asked = entries.where("q").select(F.col("key").alias("qkey"), F.col("v").alias("qv")).mapInArrow(probe, "qkey binary, qv array<double>, qlist int")
    # two rows for each list at most, so that all tasks can have them
    asked = scratch.put(asked.join(F.broadcast(blocks), F.col("qlist") == F.col("blist")).drop("blist"), "asked")
    shares = scratch.put(asked.groupBy(F.col("qlist").alias("slist")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("shares")), "shares", 1)

    def dealt(key: str, numbers: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(numbers)).cast("int")

    def every(numbers: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(numbers) - 1))

    # a list's entries go to its blocks and its queries to its shares; each block meets each share once
    both = coded.join(F.broadcast(blocks), F.col("list") == F.col("blist")).join(F.broadcast(shares), F.col("list") == F.col("slist"))
    both = both.withColumn("block", dealt("key", "blocks")).withColumn("share", every("shares")).select(*coded.columns, "block", "share")
    spread = asked.join(F.broadcast(shares), F.col("qlist") == F.col("slist")).withColumn("share", dealt("qkey", "shares")).withColumn("qblock", every("blocks")).select("qkey", "qv", "qlist", "share", "qblock")
    found_type = "qkey binary, key binary, near double"

    def scan(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.float64())], names=["qkey", "key", "near"])
        index = sent.value
        keys, code = left.column("key").combine_chunks(), np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
        qkeys = right.column("qkey").combine_chunks()
        v, exact_q = (length_one(t.column(c)) for t, c in ((left, "v"), (right, "qv")))
        q = index.pad(exact_q.astype(np.float32))
        # what the codes leave, and rounding of single precision
        slack = np.asarray(left.column("rest").combine_chunks()) + np.float32(1e-5)
        base = q @ index.coarse[left.column("list")[0].as_py()]
        take, from_q, near = [], [], []
        m = min(k + 1, len(code))
        for lo in range(0, len(q), 64):
            table = index.tables(q[lo : lo + 64])
            got = np.zeros((len(table), len(code)), np.float32) + base[lo : lo + 64, None]
            for p in range(code.shape[1]):
                got += table[:, p, code[:, p]]
            floor = -np.partition(slack - got, m - 1, axis=1)[:, m - 1 : m]
            open_ = got + slack >= floor
            some = np.flatnonzero(open_.any(axis=0))
            score = np.where(open_[:, some], exact_q[lo : lo + 64] @ v[some].T, -np.inf)
            best = np.argpartition(-score, m - 1, axis=1)[:, :m]
            take.append(some[best].ravel())
            near.append(np.take_along_axis(score, best, 1).ravel())
            from_q.append(np.repeat(np.arange(lo, lo + len(table)), m))
        return pa.table([qkeys.take(pa.array(np.concatenate(from_q))), keys.take(pa.array(np.concatenate(take))), pa.array(np.concatenate(near))], names=["qkey", "key", "near"])

    grouped = both.groupBy("list", "block", "share").cogroup(spread.groupBy("qlist", "qblock", "share"))
    short = grouped.applyInArrow(scan, found_type)
    best = Window.partitionBy("qkey").orderBy(F.desc("near"), "key")
    short = short.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("qkey", "key")
    short = scratch.put(short, "short")
    vectors = entries.select("key", "v")
    pairs = short.join(vectors, "key").join(vectors.select(F.col("key").alias("k2"), F.col("v").alias("qv")), F.col("qkey") == F.col("k2"))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (scaled(b.column(i)) for i in (2, 3))
                score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["qkey", "key", "score"])

    exact = pairs.select("qkey", "key", "v", "qv").mapInArrow(cosine, "qkey binary, key binary, score double")
    queries = ok.where("q").select("key", F.col("id").alias("query_id")).withColumnRenamed("key", "of")
    # k + 1 entries hold a query's k nearest rows: each has a row that isn't the query's own, but for the query's entry
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    entry = exact.join(least, "key").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists_of = entry.groupBy("qkey").agg(F.collect_list(F.struct((-F.col("score")).alias("m"), "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda e: F.transform(e["ids"], lambda i: F.struct(e["m"].alias("m"), i.alias("id")))))
    kept = F.slice(F.array_sort(F.filter(flat, lambda e: e["id"] != F.col("query_id"))), 1, k)
    out = queries.join(lists_of, F.col("of") == F.col("qkey")).select("query_id", F.posexplode(kept).alias("rank", "e"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias("id"), (-F.col("e.m")).alias("score"))
