"""Whether retrieved evidence suffices to answer a query, and what is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


@dataclass(frozen=True)
class EvidenceConfig:
    threshold: float = 0.8
    term_weight: float = 0.75
    sparse_weight: float = 0.15
    depth_weight: float = 0.10
    saturate_at: float = 12.0
    depth_floor: float = 2.0
    depth_hits: int = 3
    window: int = 5
    pool: int = 8
    preview_chars: int = 80

    def __post_init__(self):
        if abs(self.term_weight + self.sparse_weight + self.depth_weight - 1) > 1e-6:
            raise ValueError("weights must sum to 1")
        if self.pool < self.window:
            raise ValueError("the pool must hold the window")


def informative_tokens(toks: Column) -> Column:
    """Distinct tokens, in order, of two characters or more that are no stopwords."""
    return F.array_distinct(F.filter(toks, lambda t: (F.length(t) >= 2) & ~t.isin(P.QUERY_STOPWORDS)))


def equivalents(term: Column) -> Column:
    """The tokens that stand for a term: itself and its entry of the table, which goes one way."""
    table = F.create_map(*(c for k, v in P.SYNONYMS.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.concat(F.array(term), F.coalesce(F.try_element_at(table, term), F.array().cast("array<string>")))


def wanted_tokens(queries: DataFrame) -> DataFrame:
    """query_id, term, token: the informative terms of queries (query_id, tokens), each with the tokens that stand for it."""
    each = queries.select("query_id", F.explode(informative_tokens(F.col("tokens"))).alias("term"))
    return each.select("query_id", "term", F.explode(equivalents(F.col("term"))).alias("token"))


def evaluate(queries: DataFrame, hits: DataFrame, config: EvidenceConfig = EvidenceConfig(), found: DataFrame | None = None) -> DataFrame:
    """query_id, terms, covered, focus, coverage_score, sufficient, missing, message for each query.

    queries: query_id, tokens. hits: query_id, rank, tokens (of the record), sparse_score. Of the first `pool` hits, the covered share of the terms
    by all and by the best one make half of the term part each; the top sparse score and the number of hits of depth_floor or more make
    the rest. Scores are rounded to 4 places. A query without informative terms is insufficient. found: query_id, rank, term, which terms of
    wanted_tokens() the hits hold, where an index knows it; hits need no tokens then."""
    terms = queries.select("query_id", informative_tokens(F.col("tokens")).alias("terms"))
    pool = hits.where(F.col("rank") <= config.pool)
    if found is None:
        each = terms.select("query_id", F.explode("terms").alias("term"))
        found = each.join(pool.select("query_id", "rank", "tokens"), "query_id").where(F.arrays_overlap(equivalents(F.col("term")), "tokens"))
    else:
        found = found.where(F.col("rank") <= config.pool)
    best = found.groupBy("query_id", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.max("n").alias("best"))
    union = found.groupBy("query_id").agg(F.collect_set("term").alias("covered"))
    score = F.coalesce("sparse_score", F.lit(0.0))
    depth = pool.groupBy("query_id").agg(F.max(score).alias("top"), F.count_if(score >= config.depth_floor).alias("deep"))
    out = terms.join(union, "query_id", "left").join(best, "query_id", "left").join(depth, "query_id", "left")
    n, none = F.size("terms"), F.array().cast("array<string>")
    covered = F.coalesce("covered", none)
    share = 0.5 * F.size(covered) / n + 0.5 * F.coalesce("best", F.lit(0)) / n
    total = config.term_weight * share + config.sparse_weight * F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0)) / config.saturate_at) + config.depth_weight * F.least(F.lit(1.0), F.coalesce("deep", F.lit(0)) / config.depth_hits)
    return out.select(
        "query_id",
        n.alias("n_terms"),
        F.size(covered).alias("n_covered"),
        F.coalesce("best", F.lit(0)).cast("int").alias("focus"),
        F.when(n > 0, F.round(total, 4)).otherwise(0.0).alias("coverage_score"),
        F.when(n > 0, F.round(total, 4) >= config.threshold).otherwise(False).alias("sufficient"),
        F.when(n > 0, F.filter("terms", lambda t: ~F.array_contains(covered, t))).otherwise(none).alias("missing"),
        F.when(n == 0, "the query has no informative terms").alias("message"),
    )


def evidence_window(hits: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """The first hits as evidence rows: query_id, rank, id, preview, score; a missing score is 0."""
    return hits.where(F.col("rank") <= config.window).select("query_id", "rank", "id", F.left(F.col("text"), F.lit(config.preview_chars)).alias("preview"), F.coalesce("fused_score", F.lit(0.0)).alias("score"))


def gate(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """The verdict of the first level where it is sufficient or no second level answered, else the second's.

    second: query_id, sufficient, missing of a judge outside the engine; a judge that failed has no row."""
    if second is None:
        return first.withColumn("level", F.lit("heuristic"))
    other = second.select("query_id", F.col("sufficient").alias("_s"), F.col("missing").alias("_m"))
    use = ~F.col("sufficient") & F.col("_s").isNotNull()
    both = first.join(other, "query_id", "left").withColumn("level", F.when(use, "heuristic+llm").otherwise("heuristic"))
    return both.withColumns({"missing": F.when(use, F.col("_m")).otherwise(F.col("missing")), "sufficient": F.when(use, F.col("_s")).otherwise(F.col("sufficient"))}).drop("_s", "_m")


def require(report: DataFrame) -> DataFrame:
    """The report; reading an insufficient row is an error that names the first five missing terms."""
    message = F.concat(F.lit("insufficient evidence, missing: "), F.array_join(F.slice("missing", 1, 5), ", "))
    return report.withColumn("sufficient", F.when(F.col("sufficient"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


#: What a judge outside the engine must answer, for from_json.
VERDICT_SCHEMA = "sufficient boolean, coverage_score double, missing array<string>"


def parse_verdict(answer: Column) -> Column:
    """The JSON object of an answer, from its first { to its last }, with its score held within 0 and 1; null if there is none."""
    v = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), VERDICT_SCHEMA)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["coverage_score"]))
    return F.when(v["sufficient"].isNotNull(), F.struct(v["sufficient"].alias("sufficient"), score.alias("coverage_score"), v["missing"].alias("missing")))
