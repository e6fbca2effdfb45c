"""Quality rules judged by document and by host: failures of each rule, shrunk by an empirical beta prior, make a verdict for each host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, fresh, hash_memo, tidy, windows, word_hashes

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules beside base_failed, each a column of judge().
RULES = ("symbols_failed", "lines_failed", "length_failed")


def repeated_words(words: list[bytes], memo) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    w = windows(word_hashes(words, memo), 3)
    if len(w) < 2:
        return 0
    _, at, times = np.unique(w, return_inverse=True, return_counts=True)
    hit = times[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(w)] |= hit
    return int(covered.sum())


def text_stats(text: bytes | None, memo) -> tuple[int, int, int, int, int, int]:
    """STATS and n_lines (lines with a word) of one whole text; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words, s = text.split(), text.decode("utf-8", "replace")
    seen = Counter(line for line in s.split("\n") if line and line.encode().split())
    return len(words), len(s) - sum(map(s.count, " \t\n\x0b\x0c\r")), sum(map(s.count, SYMBOLS)), sum(seen.values()) - len(seen), repeated_words(words, memo), sum(seen.values())


def with_stats(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """df with the STATS and n_lines of its text column as long columns of the given names."""
    bound_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for b in batches:
            rows = [text_stats(t, memo) for t in b.column(place).cast(pa.binary()).to_pylist()]
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def host_verdicts(stats: DataFrame, host: str, failed: str, max_rate: float = 0.5, more: Sequence[str] = ()) -> DataFrame:
    """One row for each host (null is one): host, host_docs, host_failed, host_rate, host_ok, and more_ok for the rules in `more`.

    The beta prior is fitted to the hosts' failure rates by moments, hosts weighted by documents: with mean m and variance v
    its strength is m(1-m)/v - 1, held within 2 and 1,000,000 documents. host_rate is the posterior mean. A host is rejected where it is
    over max_rate. more_ok holds where the rate of each rule in `more`, with a prior of its own, isn't. Only three sums a prior reach the driver."""
    rules = {"host_failed": failed} | {f"host_failed_{i}": c for i, c in enumerate(more)}
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), *(F.count_if(F.col(c)).alias(n) for n, c in rules.items()))
    share = {n: F.col(n) / F.col("host_docs") for n in rules}
    docs, *sums = hosts.agg(F.sum("host_docs"), *(F.sum(x) for n in rules for x in (n, share[n] * share[n] * F.col("host_docs")))).first()
    rates = []
    for n, bad, square in zip(rules, sums[::2], sums[1::2], strict=True):
        m = (bad or 0) / docs if docs else 0.0
        v = max((square or 0) / docs - m * m, 0.0) if docs else 0.0
        strength = min(max(m * (1 - m) / v - 1, 2.0), 1e6) if v > 0 else 1e6
        rates.append((F.col(n) + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength)))
    out = hosts.withColumn("more_ok", reduce(and_, (r <= F.lit(max_rate) for r in rates[1:]), F.lit(True))).withColumn("host_rate", rates[0])
    return out.withColumn("host_ok", F.col("host_rate") <= F.lit(max_rate)).drop(*list(rules)[1:])


def judge(
    spark: SparkSession, docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5,
    max_symbol_percent: int = 10, max_dup_line_percent: int = 50, word_length: tuple[int, int] = (3, 10),
) -> tuple[DataFrame, dict[str, str]]:
    """The columns `keep` of docs with STATS, n_lines, base_failed, RULES, host_rate, base_kept and kept, under names that clash with none of keep.

    base_failed: fewer than min_words words, or more than max_repeat_percent % of them repeated. symbols_failed: symbols above max_symbol_percent %
    of the words. lines_failed: repeated lines above max_dup_line_percent % of the lines. length_failed: a mean word of fewer characters than the first of word_length or
    more than the second. base_kept: neither base_failed nor on a host that its rate of base_failed (host_rate) rejects. kept: base_kept,
    no other rule failed, and no other rule's rate rejects the host.

    Returns the table and the names by role. A text without words, empty or null fails (n_words < min_words). A null host is a host
    of its own. Repeated rows are judged one by one and count one by one. An empty table gives an empty table."""
    cols, out = list(dict.fromkeys([*keep, text, host])), (*STATS, "n_lines", "base_failed", *RULES, "host_rate", "base_kept", "kept")
    names = dict(zip([*out, "host_key", "host_ok", "more_ok"], fresh(docs, *out, "host_key", "host_ok", "more_ok"), strict=True))
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines = (F.col(names[s]) for s in (*STATS, "n_lines"))
    failed = {
        "base_failed": (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words),
        "symbols_failed": 100 * n_symbols > max_symbol_percent * n_words,
        "lines_failed": 100 * n_dup_lines > max_dup_line_percent * n_lines,
        "length_failed": (word_chars < word_length[0] * n_words) | (word_chars > word_length[1] * n_words),
    }
    rows = with_stats(docs.select(*cols), text, [names[s] for s in (*STATS, "n_lines")]).withColumns({names[k]: c for k, c in failed.items()})
    rows = rows.select(*[c for c in rows.columns if c in keep or c not in (text, host)], *([host] if host not in keep else []))
    scratch = Scratch(spark, "quality")
    rows = scratch.put(rows, "stats")
    hosts = host_verdicts(rows, host, names["base_failed"], max_rate, [names[r] for r in RULES])
    hosts = scratch.put(hosts.select(F.col("host").alias(names["host_key"]), F.col("host_rate").alias(names["host_rate"]), F.col("host_ok").alias(names["host_ok"]), F.col("more_ok").alias(names["more_ok"])), "hosts")
    both = rows.join(hosts, rows[host].eqNullSafe(hosts[names["host_key"]]), "left")
    both = both.withColumn(names["base_kept"], ~F.col(names["base_failed"]) & F.coalesce(F.col(names["host_ok"]), F.lit(True)))
    both = both.withColumn(names["kept"], reduce(and_, (~F.col(names[r]) for r in RULES), F.col(names["base_kept"])) & F.coalesce(F.col(names["more_ok"]), F.lit(True)))
    return both.select(*keep, *(names[k] for k in out)), names


def keep_good(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs."""
    out, names = judge(spark, docs, docs.columns, **options)
    return out.where(F.col(names["kept"])).select(*docs.columns)
