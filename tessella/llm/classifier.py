"""Quality classifier: averaged vectors of hashed words and character n-grams under a softmax, fitted by stochastic gradient descent."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, hash_memo, mix, word_hashes

BITS = 17
#: Character n-grams, counted in bytes of UTF-8.
GRAMS = (3, 4, 5)


def features(text: bytes | None, memo) -> np.ndarray:
    """Buckets of a whole text's words, word pairs and character n-grams, one for each occurrence. Pairs of equal words share a bucket.

    Character n-grams run over the words joined by one space, so that they see the ends of words; those with a space inside are left out."""
    words = text.split() if text else []
    if not words:
        return np.zeros(1, np.int64)
    h = word_hashes(words, memo)
    with np.errstate(over="ignore"):
        pairs = np.where(h[1:] == h[:-1], np.uint64(1), mix(h[:-1] + np.uint64(3)) + h[1:])
        line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
        blank = line == 32
        out = [mix(h + np.uint64(1)), mix(pairs + np.uint64(2))]
        for n in GRAMS:
            m = len(line) - n + 1
            if m <= 0:
                continue
            acc, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
            for i in range(n):
                acc = acc * np.uint64(0x100000001B3) + line[i : i + m]
                if 0 < i < n - 1:
                    inner |= blank[i : i + m]
            out.append(mix(acc[~inner] * np.uint64(8) + np.uint64(n)))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """vectors: of the buckets. weights, bias: softmax of two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gains(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1, before averaging: the softmax layer is linear in the averaged vector."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def scores(self, gains: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        odds = np.array([gains[r].mean() for r in rows]) + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(texts: list[bytes | None], labels: list[int], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> Model:
    """Stochastic gradient descent, one document a step, over averaged vectors. Without both labels the model gives the one there is."""
    rng = np.random.default_rng(seed)
    memo = hash_memo()
    rows = [np.unique(features(t, memo), return_counts=True) for t in texts]
    rows = [(i, (c / c.sum()).astype(np.float32)) for i, c in rows]
    y = np.asarray(labels, int)
    share = np.bincount(y, minlength=2) + 0.5
    model = Model((rng.standard_normal((1 << BITS, dim)) / dim).astype(np.float32), np.zeros((dim, 2), np.float32), np.log(share / share.sum()).astype(np.float32))
    model.weights[:] = rng.standard_normal((dim, 2)) / dim**0.5
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, share_of = rows[k]
            mean = share_of @ model.vectors[at]
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[k]] -= 1
            step = rate * (1 - done / steps)
            back = model.weights @ g
            model.weights -= step * np.outer(mean, g)
            model.bias -= 0.1 * step * g
            # a bucket's share of a document is small; its vector moves as far as in a document of 30 features
            model.vectors[at] -= (step * 30) * np.outer(share_of, back)
            done += 1
    return model


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no label is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = 6000, max_bytes: int = 64 << 20, folds: int = 5) -> Model:
    """Fits on at most max_rows labelled documents outside the held-out fold, those first in the order of a digest of their ids and texts,
    and on no more of them than have max_bytes bytes of text together: a text that no longer fits is passed over, and those after it are taken as long as they fit.

    Only they reach the driver, which learns their sizes first. A document that is labelled twice or has two rows is one for each label and row. Null ids and labels
    other than 0 and 1 are left out."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col), folds)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    order = (F.xxhash64("_id", F.lit(1)), F.col("_id"), F.col("_label"))
    told = told.orderBy(*order).limit(max_rows)
    ids = spark.createDataFrame(told.collect(), told.schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(ids), "_id")
    rows = rows.withColumns({"_size": F.coalesce(F.octet_length("_text"), F.lit(0)), "_tie": F.xxhash64("_text")})
    order = (*order, F.col("_tie"))
    first = rows.select("_id", "_label", "_tie", "_size").orderBy(*order).limit(max_rows).collect()
    taken, size = [], 0
    for r in first:
        if size + r["_size"] <= max_bytes:
            size += r["_size"]
            taken.append((r["_id"], r["_label"], r["_tie"]))
    if not taken:
        return fit([], [])
    wanted = spark.createDataFrame([(*t, n) for t, n in Counter(taken).items()], T.StructType([*(rows.schema[c] for c in ("_id", "_label", "_tie")), T.StructField("_times", T.IntegerType())]))
    # rows that are alike in all of these are as many as were found above, so that taking a row's times takes no other text
    rank = F.row_number().over(Window.partitionBy("_id", "_label", "_tie").orderBy("_size"))
    got = rows.join(F.broadcast(wanted), ["_id", "_label", "_tie"]).withColumn("_rank", rank).where("_rank <= _times").orderBy(*order).select("_text", "_label").collect()
    return fit([bytes(r["_text"]) if r["_text"] is not None else None for r in got], [r["_label"] for r in got])


def score(spark: SparkSession, docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with a double column of the given name, changed where docs has one of it (see common.fresh): the probability of label 1 by the whole text. Empty and null texts are scored alike."""
    (name,) = fresh(docs, name)
    bound_batches(spark)
    sent = spark.sparkContext.broadcast((model.gains().astype(np.float64), model.bias.astype(np.float64)))
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, bias = sent.value
        memo, odds = hash_memo(), bias[1] - bias[0]
        for b in batches:
            mean = np.array([gains[features(t, memo)].mean() for t in b.column(place).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(mean + odds, -30, 30))))], names=schema.names)

    return docs.mapInArrow(run, schema)
