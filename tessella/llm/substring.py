"""Substring dedup: paragraphs that repeat across documents, by MinHash banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, fresh, hash_memo, mix, small, tidy, windows, word_hashes
from .minhash import bands_of, near_groups, sketch_of

#: 6 bands of 2: paragraphs of similarity 0.8 share no band with odds of 0.002, at 0.9 of 5e-5; paragraphs that share nothing never meet.
BANDS, ROWS = 6, 2
#: A cut between words is one whose word pair has the least hash within so many words to either side.
REACH = 6


def cuts(h: np.ndarray, line: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where pieces start, in words of h: each start of a line, and each word whose pair (the word before and its own) has the least hash
    of the pairs within `reach` words to either side in its line. That depends on the words around it alone, so a passage is cut alike
    wherever it stands, but for its first and last few words. Of equal hashes the first counts, so that repeated words don't cut.
    line: the number of each word's line, ascending."""
    n, top = len(h), np.uint64(np.iinfo(np.uint64).max)
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    with np.errstate(over="ignore"):
        pair = np.where(new[1:], top, mix(h[:-1] * np.uint64(5) + h[1:]))
    gap = reach * (np.cumsum(new) - 1)
    at = np.arange(n) + gap + reach
    wide = np.full(n + int(gap[-1]) + 2 * reach, top)
    wide[at[1:]] = pair
    least = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)[at - reach].argmin(axis=1) == reach
    return np.flatnonzero(new | least)


def minhashes(items: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Plain MinHash signatures of m registers, as 64-bit values; a set runs from its start to the next."""
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat(mix(items + np.uint64(2 * i + 1) * np.uint64(0x9E3779B97F4A7C15)), starts) for i in range(m)], axis=1)


class Runs:
    """128-bit hashes of runs of words, by the words in order and not by their place: differences of two polynomial sums over all words,
    brought to power 0 by the inverse of their base."""

    def __init__(self, h: np.ndarray):
        n, base = len(h) + 1, 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b))])) for b in (base, pow(base, -1, 1 << 64)))
            self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h * np.uint64(2) + np.uint64(i)) * up[:-1])]) for i in (1, 7)]

    def keys(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """16 bytes for each run, as rows of uint8."""
        with np.errstate(over="ignore"):
            cols = [mix((s[hi] - s[lo]) * self.down[lo] + (hi - lo).astype(np.uint64)) for s in self.sums]
        return np.ascontiguousarray(np.stack(cols, axis=1)).view(np.uint8).reshape(len(lo), 16)


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of uint8 as a binary array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def paragraphs(docs: DataFrame, id_col: str, text: str, k: int, min_words: int, piece_words: int) -> DataFrame:
    """id, kind, start, n_words, key, bands, s0, s1: the paragraphs (kind 0; lines of at least min_words words) with their bands and sketch, and the
    pieces (kind 1) of at least piece_words words, without: those that lines of at least twice as many are cut into, and those that the whole text is cut into
    as if it had no line ends. start: words before it in the text.
    key: 128 bits of the words, A-Z lower-cased."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "kind", "start", "n_words", "key", "bands", "s0", "s1"]

    def some(ids: pa.Array, texts: list[bytes | None], memo) -> pa.RecordBatch | None:
        words, of, first, size = [], [], [], []
        for i, t in enumerate(texts):
            start = 0
            for line in t.lower().split(b"\n") if t else ():
                w = line.split()
                if w:
                    words += w
                    of.append(i)
                    first.append(start)
                    size.append(len(w))
                start += len(w)
        if not words:
            return None
        of, first, size = (np.asarray(x, np.int64) for x in (of, first, size))
        h = word_hashes(words, memo)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        line = np.repeat(np.arange(len(size)), size)
        runs = Runs(h)
        whole = np.flatnonzero(size >= max(min_words, k))
        parts = [(np.zeros(len(whole), np.int32), whole, begin[whole], begin[whole] + size[whole])]
        spans = []
        for part, least in ((line, 2 * piece_words), (of[line], 0)):
            at = cuts(h, part)
            end = np.append(at[1:], len(h))
            good = (end - at >= piece_words) & (size[line[at]] >= least)
            spans.append(np.stack([at[good], end[good]], axis=1))
        lo, hi = np.unique(np.concatenate(spans), axis=0).T
        parts.append((np.ones(len(lo), np.int32), line[lo], lo, hi))
        kinds, lines, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        bands = sketch = None
        if len(whole):
            shingles = windows(h, k)
            inside = np.zeros(len(h), bool)
            keep = np.repeat(size >= max(min_words, k), size)
            inside[: len(shingles)] = (line[: len(shingles)] == line[k - 1 :]) & keep[: len(shingles)]
            counts = size[whole] - k + 1
            signatures = minhashes(shingles[inside[: len(shingles)]], np.concatenate([[0], np.cumsum(counts)[:-1]]), BANDS * ROWS)
            bands, sketch = bands_of(signatures, BANDS, ROWS), sketch_of(signatures)
        offsets = np.minimum(np.arange(len(kinds) + 1), len(whole)).astype(np.int32) * BANDS
        none = pa.array(np.arange(len(kinds)) >= len(whole))
        flat = pa.array(bands.ravel() if bands is not None else np.empty(0, np.int64))
        more = [pa.array(np.pad(sketch[:, i] if sketch is not None else np.empty(0, np.int64), (0, len(kinds) - len(whole)))) for i in range(2)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of[lines])), pa.array(kinds), pa.array(first[lines] + lo - begin[lines]), pa.array(hi - lo), binaries(runs.keys(lo, hi)), pa.ListArray.from_arrays(pa.array(offsets), flat, mask=none), *more], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            for lo in range(0, len(b), 128):
                out = some(b.column(0).slice(lo, 128), b.column(1).slice(lo, 128).to_pylist(), memo)
                if out is not None:
                    yield out

    return docs.select(id_col, F.col(text).cast("binary")).mapInArrow(tidy(run), f"id {kind}, kind int, start bigint, n_words bigint, key binary, bands array<bigint>, s0 bigint, s1 bigint")


def line_texts(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """key, text (binary) of the paragraphs in wanted: key, id, start, n_words."""
    asked = wanted.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("start", "n_words", "key")).alias("asked"))
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).join(small(asked), F.col("id").eqNullSafe(F.col("_id"))).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            keys, out = [], []
            for t, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = t.lower().split() if t else []
                for a in asked:
                    part = words[a["start"] : a["start"] + a["n_words"]]
                    if len(part) == a["n_words"] and Runs(word_hashes(part, memo)).keys(np.zeros(1, np.int64), np.array([len(part)])).tobytes() == a["key"]:
                        keys.append(a["key"])
                        out.append(b" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["key", "text"])

    return rows.mapInArrow(tidy(run), "key binary, text binary").dropDuplicates(["key"])


def repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, min_words: int = 20, piece_words: int = 7, min_docs: int = 2) -> DataFrame:
    """doc_id, kind, start, n_words, cluster, first_doc_id, cluster_docs, kept: the repeated paragraphs and pieces of all documents.

    A paragraph (kind 0) is a line of min_words words or more; two are linked if their sets of k-word shingles have an exact Jaccard
    similarity of percent % or more, and clusters are components of links. Candidates share a band, and are measured as near_groups() says. As passages also repeat inside of longer paragraphs that differ otherwise, lines, and whole texts across their line ends, are cut by their content
    into pieces (kind 1; 13 words on average, piece_words at least), which repeat when equal word by word: a passage of 50 words holds two such
    pieces or more in all but a few cases. Clusters in min_docs documents or more are returned: first_doc_id is the smallest id, and kept is true in the first place of that document.
    Texts without words, null or empty, have none. A null id is one document. Repeated rows with one id count as one document."""
    scratch = Scratch(spark, "substring")
    units = scratch.put(paragraphs(docs, id_col, text, k, min_words, piece_words), "units")
    lines = units.where("kind = 0").groupBy("key").agg(F.first("bands").alias("bands"), F.first("s0").alias("s0"), F.first("s1").alias("s1")).withColumn("n", F.lit(0))
    place = units.where("kind = 0").groupBy("key").agg(F.min(F.struct("id", "start", "n_words")).alias("w"))

    def texts(keys: DataFrame, n: int) -> DataFrame:
        wanted = scratch.put(place.join(keys, "key", "left_semi").select("key", "w.id", "w.start", "w.n_words"), "wanted", max(1, n // 20_000))
        return line_texts(docs, id_col, text, wanted)

    roots = near_groups(lines, texts, scratch, BANDS * ROWS, k, percent, units.where("kind = 0").count())
    plain = units.drop("bands", "s0", "s1")
    of_lines = plain.where("kind = 0").join(roots, F.col("key") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "key")).drop("node", "root", "key")
    # pieces are clusters by their words: they need no join
    named = of_lines.unionByName(plain.where("kind = 1").withColumnRenamed("key", "cluster"))
    # clusters in one document alone, which are most, go before documents are counted
    spread = named.groupBy("kind", "cluster").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("nil")).where("lo <> hi or nil")
    spread = scratch.put(spread.select(F.col("kind").alias("k"), F.col("cluster").alias("c")), "spread")
    hits = scratch.put(named.join(spread, (F.col("kind") == F.col("k")) & (F.col("cluster") == F.col("c")), "left_semi"), "hits")
    scratch.drop("units")
    docs_of = hits.groupBy("kind", "cluster", "id").agg(F.min("start").alias("start"))
    sizes = docs_of.groupBy(F.col("kind").alias("k"), F.col("cluster").alias("c")).agg(F.count(F.lit(1)).alias("cluster_docs"), F.min(F.struct("id", "start")).alias("f")).where(F.col("cluster_docs") >= min_docs)
    out = hits.join(scratch.put(sizes, "sizes"), (F.col("kind") == F.col("k")) & (F.col("cluster") == F.col("c")))
    return out.select(F.col("id").alias("doc_id"), "kind", "start", "n_words", F.hex("cluster").alias("cluster"), F.col("f.id").alias("first_doc_id"), "cluster_docs", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("start") == F.col("f.start"))).alias("kept"))


def drop_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the words of repeated paragraphs and pieces cut out of all documents but the first of each cluster; other bytes stay."""
    hits = repeats(spark, docs, id_col, text, **options).where("not kept and not doc_id <=> first_doc_id")
    sid, sp = fresh(docs, "_span_id", "_spans")
    spans = hits.groupBy(F.col("doc_id").alias(sid)).agg(F.collect_list(F.struct("start", "n_words")).alias(sp))
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut_words(t, spans) for t, spans in zip(b.column(place).to_pylist(), b.column(len(schema)).to_pylist(), strict=True)]
            cols = list(b.columns[: len(schema)])
            cols[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    bound_batches(spark)
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(sid)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], sp)
    return joined.mapInArrow(tidy(run), schema)


def cut_words(text: str | None, spans: list[dict] | None) -> str | None:
    """text without the words that the spans (start, n_words) number."""
    if not text or not spans:
        return text
    gone = {i for s in spans for i in range(s["start"], s["start"] + s["n_words"])}
    import re

    word, n = re.compile(rb"[^\x20\x09-\x0D]+"), iter(range(1 << 62))
    return word.sub(lambda m: b"" if next(n) in gone else m.group(), text.encode()).decode()

