"""Search: postings, BM25, exact cosine, rank and score fusion, hydration.

All operators take whole batches of queries. Query sides are joined by term or sent with an explicit size check; no operator collects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Exact kNN: bytes of queries that are sent to all tasks at a time, and queries that are multiplied with a batch of vectors at a time.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 512


@dataclass(frozen=True)
class RetrievalConfig:
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    min_chunk_chars: int = 10
    default_top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    def config_hash(self) -> str:
        """The first 16 digits of SHA-256 over the settings as JSON with sorted keys."""
        import hashlib
        import json

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def records(chunks: DataFrame, min_chars: int = 10, tokenize=X.tokens) -> DataFrame:
    """Chunks (id, text, ...) of at least min_chars characters without white space at the ends, with their tokens."""
    return chunks.where(F.length(X.strip(F.col("text"))) >= min_chars).withColumn("tokens", tokenize(F.col("text")))


def chunk_set_hash(chunks: DataFrame, keys: list[str | Column], id_col: str = "id") -> DataFrame:
    """A hash of each key's set of ids: the first 16 digits of SHA-256 over the sorted ids, comma-joined.

    A key's ids are one row's array: keys are documents, or as many."""
    ids = F.array_join(F.sort_array(F.collect_list(F.col(id_col).cast("string"))), ",")
    return chunks.groupBy(*keys).agg(F.left(F.sha2(F.encode(ids, "utf-8"), 256), F.lit(16)).alias("set_hash"))


def postings(recs: DataFrame, id_col: str = "id", only: DataFrame | None = None) -> DataFrame:
    """id, term, tf, dl. only: the terms (one column) that are wanted; others go before postings are counted, and so before they are shuffled."""
    each = recs.select(F.col(id_col).alias("id"), F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    each = each if only is None else each.join(only, "term", "left_semi")
    return each.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(recs: DataFrame) -> DataFrame:
    """One row: n documents and their average length."""
    return recs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequencies(recs: DataFrame) -> DataFrame:
    """term, df. A document sends each of its terms once, and a task its vocabulary."""
    return recs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def raw_idf(n: Column, df: Column) -> Column:
    """The logarithm of the odds that a record lacks a term; negative for terms of more than half of the records."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def term_weights(frequencies: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf. A negative idf becomes epsilon times the mean of the raw idf of all terms. frequencies: term, df."""
    df = frequencies.join(F.broadcast(stats.select("n")))
    raw = df.withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each task's rows before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def bm25(queries: DataFrame, recs: DataFrame, k: int, config: RetrievalConfig = RetrievalConfig(), order_col: str = "id", put: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """query_id, id, score, rank: the k best records by BM25, scores over 0 alone, ties by order_col.

    queries: query_id, tokens; repeated query terms count as often. The asked words of a record move once, to its id, where they are counted and scored: no pair of a query and a
    record is shuffled while the queries' terms are small. For a null or empty query there are no rows. put: writes what is used more than once (session.Tables.put), so that texts are cut to tokens once."""
    recs = put(recs.select("id", "tokens"), "tokens")
    stats = corpus_stats(recs)
    weights = term_weights(put(document_frequencies(recs), "frequencies"), stats, config.epsilon)
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = put(asked.join(weights, "term").join(F.broadcast(stats.select("avgdl"))), "asked")
    each = recs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hits = each.repartition("id").groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).join(asked, "term")
    norm = F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl"))
    scored = hits.groupBy("query_id", "id").agg(F.sum(F.col("qf") * F.col("idf") * F.col("tf") * (config.k1 + 1) / norm).alias("score"))
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), F.col(order_col)], k).where("score > 0")


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """A vector over its length; a zero vector is an error."""
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(v, lambda x: x / n))


def checked_vectors(vectors: DataFrame) -> DataFrame:
    """id, v with v of length 1 as array<float>. Repeated ids, other dimensions than the first and zero vectors are errors."""
    dims = vectors.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"))
    twice = vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    ok = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("vectors differ in dimension"))).when(F.col("most") > 1, F.raise_error(F.lit("an id repeats"))).otherwise(normalize(F.col("v")))
    return vectors.join(F.broadcast(dims)).join(F.broadcast(twice)).select("id", ok.cast("array<float>").alias("v"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, max_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, id, score, rank: exact cosine in double precision, the k largest, ties by id. queries: query_id, q; vectors: id, v.

    Queries are a stated set held against all vectors. They are sent to all tasks as one matrix, in as many groups as have max_bytes each: each group is one scan of the
    vectors, whose Arrow batches are multiplied with it. A batch leaves k rows of a query at most, and a task no more than that of its batches. No vector is shuffled.
    A zero or null query has no rows, and a zero or null vector is found by none; k <= 0 gives none. A vector of another dimension than the queries is an error."""
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    live = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(norm(F.col("q")) > 0)
    size = live.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    groups = max(1, -(-size // max_bytes))
    spark, parts = queries.sparkSession, []
    for g in range(groups) if size and k > 0 else ():
        own = (live.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) if groups > 1 else live).toArrow()
        if own.num_rows:
            parts.append(vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(nearest(spark.sparkContext.broadcast(own), k), schema))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    return top_k(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that have a direction, over their lengths, and their rows. dim: what each must have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(column.is_valid())
    sizes = np.diff(column.offsets.to_numpy())[rows]
    if len(rows) and (dim or sizes[0]) != sizes.max() or len(rows) and sizes.min() != sizes.max():
        raise ValueError("vectors differ in dimension")
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    length = np.sqrt((flat * flat).sum(1))
    good = length > 0
    return flat[good] / length[good, None], rows[good]


def nearest(sent, k: int) -> Callable:
    """For mapInArrow over id, v: the k nearest of each query, and the ties of the last, for each batch. sent: the queries, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, asked = matrix(sent.value.column("q"))
        ids = sent.value.column("query_id").combine_chunks().take(pa.array(asked))
        for b in batches:
            v, rows = matrix(b.column("v"), q.shape[1])
            for low in range(0, len(q) if len(v) else 0, QUERY_BLOCK):
                block = q[low : low + QUERY_BLOCK]
                rough = block @ v.T
                # the product rounds by its own blocking; what may be among the k is summed again in one order, so that equal vectors have equal scores
                least = np.partition(rough, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
                i, j = np.nonzero(rough >= least[:, None] - 1e-9)
                score = np.concatenate([(block[i[a : a + 65_536]] * v[j[a : a + 65_536]]).sum(1) for a in range(0, len(i), 65_536)])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + low)), b.column("id").take(pa.array(rows[j])), pa.array(score)], names=["query_id", "id", "score"])

    return run


def rrf(legs: DataFrame, k: int = 60, top: int = 5) -> DataFrame:
    """query_id, id, score, rank: the sum of 1 / (k + rank) over legs, the first `top` by score, then id. legs: query_id, leg, id, rank."""
    fused = legs.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return top_k(fused, ["query_id"], [F.desc(F.round("score", 12)), F.col("id")], top)


def weighted_fusion(legs: DataFrame, weights: dict[str, float], top: int = 5) -> DataFrame:
    """query_id, id, score, rank: scores brought to 0..1 within each leg, weighted and summed; a leg of one score counts 1 where it is over 0, else 0.
    legs: query_id, leg, id, score. An id that a leg lacks gets 0 from it; a leg without a weight counts nothing."""
    w = Window.partitionBy("query_id", "leg")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    part = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.when(F.col("score") > 0, 1.0).otherwise(0.0))
    weight = X.ordered_case([(F.col("leg") == leg, F.lit(float(v))) for leg, v in weights.items()], F.lit(0.0))
    fused = legs.withColumn("part", part * weight).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return top_k(fused, ["query_id"], [F.desc(F.round("score", 12)), F.col("id")], top)


def fuse_hits(dense: DataFrame, sparse: DataFrame, top: int, k: int = 60) -> DataFrame:
    """query_id, id, rank, fused_score, dense_score, sparse_score, sources of hybrid hits; a leg without the hit gives null."""
    legs = dense.withColumn("leg", F.lit("dense")).unionByName(sparse.withColumn("leg", F.lit("sparse")))
    fused = legs.groupBy("query_id", "id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("fused_score"),
        F.max(F.when(F.col("leg") == "dense", F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("leg") == "sparse", F.col("score"))).alias("sparse_score"),
    )
    out = top_k(fused, ["query_id"], [F.desc(F.round("fused_score", 12)), F.col("id")], top)
    leg = F.array(F.when(F.col("dense_score").isNotNull(), F.lit("dense")), F.when(F.col("sparse_score").isNotNull(), F.lit("sparse")))
    return out.withColumn("sources", F.array_compact(leg))


def retrieve(queries: DataFrame, recs: DataFrame | None, vectors: DataFrame, mode: str = "hybrid", top: int = 5, config: RetrievalConfig = RetrievalConfig(), index=None) -> DataFrame:
    """Hits of a batch of queries (query_id, text, q). In a single-leg mode the fused score is that leg's. Blank queries have no hits.

    index: a stored index (sources.inverted.Index) that serves the sparse leg; recs isn't read then and may be None."""
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"no such mode: {mode}")
    live = queries.where(X.strip(F.coalesce("text", F.lit(""))) != "").withColumn("tokens", X.tokens(F.col("text")))
    none = F.lit(None).cast("double")
    dense = knn(live.select("query_id", "q"), vectors, config.dense_top_k if mode == "hybrid" else top) if mode != "sparse" else None
    search = (lambda q, k: bm25(q, recs, k, config)) if index is None else (lambda q, k: index.search(q, k, config).drop("dl"))
    sparse = search(live.select("query_id", "tokens"), config.sparse_top_k if mode == "hybrid" else top) if mode != "dense" else None
    if mode == "hybrid":
        return fuse_hits(dense, sparse, top, config.rrf_k)
    one = dense if mode == "dense" else sparse
    return one.select("query_id", "id", F.col("score").alias("fused_score"), *((F.col("score") if mode == m else none).alias(f"{m}_score") for m in ("dense", "sparse")), "rank", F.array(F.lit(mode)).alias("sources"))


def hydrate(hits: DataFrame, recs: DataFrame) -> DataFrame:
    """Hits with their records; a hit without one goes, and ranks stay as they were."""
    return hits.join(recs, "id")


def supplement(hits: DataFrame, links: DataFrame, covered: DataFrame) -> DataFrame:
    """Hits (query_id, id, ...) none of whose paragraphs are covered. links: id, paragraph_id; covered: query_id, paragraph_id."""
    seen = links.join(covered, "paragraph_id").select("query_id", "id").distinct()
    return hits.join(seen, ["query_id", "id"], "left_anti")


def hash_embeddings(df: DataFrame, text: str = "text", dim: int = 64, name: str = "v") -> DataFrame:
    """df with a unit vector drawn from a generator seeded by the text's SHA-256: equal texts have equal vectors. Arrow batches, numpy."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for t in b.column(place).to_pylist():
                seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")
                v = np.random.default_rng(seed).standard_normal(dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)
