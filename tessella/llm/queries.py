"""The operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, classifier, fim, lines, minhash, mixing, packing, pii, quality, runs, substring, token_files, urls
from .common import WORD, Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by three-word shingles at a similarity of 0.85; nulls and empty texts are groups of one."""
    rows = minhash.grouped(spark, table(spark, sf_dir, "documents"), k=3, percent=85)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that several documents share, by paragraph and by piece, with the places of each."""
    return substring.repeats(spark, table(spark, sf_dir, "documents"), k=5, percent=80)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens at most; a null text is its end token alone."""
    return packing.pack(spark, table(spark, sf_dir, "documents"), length=2048, end_id=0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and verdict: by its own rules, and by its host's rate of failures of each."""
    rows, _ = quality.judge(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's share of the mix, by finish times over all sources; a null source is the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.mix(spark, docs, {k: k for k in ("size", "source_size", "target", "finish", "taken")}, weights=(5, 2, 1), percent=150, passes=2)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "finish")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one; vectors without a direction take no part."""
    rows = ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in ORC files, and what is read back from these."""
    path = Scratch(spark, "ids").where("orc")
    token_files.write_tokens(spark, table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.token_index(spark, path)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model that learned from labelled documents outside of the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(spark, docs, table(spark, sf_dir, "labels"))
    rows = classifier.score(spark, docs, model)
    return rows.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with two others or more, but for the last that holds each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lines.drop_shared_lines(spark, docs, counts=("n_lines", "n_dropped"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data: those of the patterns, and terms that disclose a value."""
    rows = pii.find(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, (*pii.KINDS, "term")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.encode(pii.joined(F.col("base"), names), "utf-8"), 256).alias("base_sha256"), pii.joined(F.array_sort(F.concat("base", "more")), names).alias("spans"), (F.size("base") > 0).alias("flagged"))


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together in its form, and the text that is rebuilt from that."""
    rows, _ = fim.transform(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, plain_from=90, spm_below=20)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_of(F.col("output")).alias("output_sha256"), sha256_of(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def repeated_block(text: Column, doc_id: Column) -> Column:
    """The words of a text, joined by spaces, with every tenth document's words (by crc32 of its id) from some place on replaced by repetitions of those there."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    n, h = F.size(words), F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in every document, whose planted repetitions are made first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_block(F.col("text"), F.col("doc_id")).alias("text"))
    rows, _ = runs.with_runs(spark, docs, min_length=24, min_repeats=3)
    first = F.element_at("runs", 1)
    # the greatest length / period, compared as a fraction; runs stand by start and period, and only a greater one takes the place
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)))
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        sha256_of(F.when(F.size("runs") > 0, F.concat(lines_, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha256_of(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: The rules of op13.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: its rule's, else that of its host's template, learned from the pages that rules fit."""
    rows, _ = urls.judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"], URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_substring_dedup, op3_best_fit_packing, op4_quality_rules, op5_mixing, op6_nearest, op7_token_files, op8_quality_classifier, op9_line_dedup, op10_pii, op11_fill_in_middle, op12_periodic_runs, op13_url_filters, pipeline)}

SIZES = r"SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents"



def template_sql(levels: int) -> str:
    """The SQL of op13 for paths of up to so many segments: a table of literal segments and one of rows for each level."""
    cases = " ".join(
        f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN '{r}'" for r, _ in sorted(URL_RULES, key=lambda x: -len(x[0])) for d, p in [r.split("/", 1)]
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES)
    kinds = {"e": "IS NULL", "d": "SIMILAR TO '[0-9]+'", "l": "SIMILAR TO '[A-Za-z]+'"}

    def chi(names: str) -> str:
        b, r = (" + ".join(f"{n}{k}" for k in names) for n in ("b", "r"))
        parts = " + ".join(f"CASE WHEN b{k} + r{k} > 0 THEN (b{k} * ({r}) - r{k} * ({b})) * (b{k} * ({r}) - r{k} * ({b})) / (b{k} + r{k}) ELSE 0 END" for k in names)
        value = f"(CASE WHEN {b} > 0 AND {r} > 0 THEN ({parts}) / (({b}) * ({r})) ELSE 0 END)"
        return f"({value} < {6.635 if names == 'gx' else 11.345} OR {value} < 0.01::DOUBLE * ({b} + {r}))"

    ctes = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        r"p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"q AS (SELECT *, CASE {cases} END AS rule FROM p)",
        f"t0 AS MATERIALIZED (SELECT *, CASE rule {verdicts} END AS ruled, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS node FROM q)",
    ]
    for i in range(levels):
        nxt = f"segs[{i + 2}]"
        counts = ", ".join([f"count(*) FILTER ({nxt} {c})::DOUBLE AS b{k}" for k, c in kinds.items()] + [f"count(*) FILTER ({nxt} NOT SIMILAR TO '[0-9]+|[A-Za-z]+')::DOUBLE AS bm"])
        ctes += [
            f"c{i} AS (SELECT host, node, segs[{i + 1}] AS seg, count(*) AS n, count(*) FILTER (ruled = 'allow')::DOUBLE AS bg, count(*) FILTER (ruled = 'block')::DOUBLE AS bx, {counts} FROM t{i} WHERE len(segs) > {i} GROUP BY ALL)",
            f"k{i} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM c{i}) WHERE n >= 3 AND n * 100 >= total * 2)",
            f"r{i} AS (SELECT *, sum(n) OVER w - n AS others, {', '.join(f'sum(b{x}) OVER w - b{x} AS r{x}' for x in 'edlmgx')} FROM k{i} WINDOW w AS (PARTITION BY host, node))",
            f"s{i} AS (SELECT host, node, seg, CASE WHEN others > 0 AND {chi('edlm')} AND {chi('gx')} THEN '+' ELSE '=' || seg END AS step FROM r{i})",
            f"t{i + 1} AS MATERIALIZED (SELECT t.* REPLACE (t.node || CASE WHEN len(segs) > {i} THEN '/' || coalesce(step, '*') ELSE '' END AS node) FROM t{i} t LEFT JOIN s{i} s ON t.host = s.host AND t.node = s.node AND segs[{i + 1}] = seg)",
        ]
    return f"""
WITH {", ".join(ctes)},
v AS (SELECT host, node, (count(*) FILTER (ruled = 'allow') + 1.0::DOUBLE) / (count(ruled) + 2.0::DOUBLE) AS purity FROM t{levels} GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < 0.25::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, node AS template, purity FROM t{levels} JOIN v USING (host, node)"""


ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(t[1:least(x, y)], '') AS prefix, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(t[greatest(x, y) + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_url_filters": template_sql(4),
    "op5_mixing": rf"""
WITH RECURSIVE d AS ({SIZES}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
  2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS budget FROM s),
r AS (SELECT *, budget - coalesce(sum(cap) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open FROM w
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(rest / open) AS water FROM r WHERE cap / weight > rest / open AND NOT EXISTS (
  SELECT 1 FROM r q WHERE q.cap / q.weight > q.rest / q.open AND (q.cap / q.weight < r.cap / r.weight OR (q.cap / q.weight = r.cap / r.weight AND (q.source IS NULL, encode(q.source)) < (r.source IS NULL, encode(r.source)))))),
t AS (SELECT source, source_size, least(cap, coalesce(weight * water, cap)) AS target FROM r, l),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT o.doc_id, o.size::BIGINT AS size, t.source_size, t.target,
  (greatest(0, least(o.size, round(t.target) - start)) + greatest(0, least(o.size, round(t.target) - start - t.source_size)))::BIGINT AS taken,
  CASE WHEN round(t.target) > 0 THEN (start + o.size) / round(t.target) END AS finish
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(k.key) AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE k.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key AND l.doc_id <> k.keeper GROUP BY l.doc_id""",
    "op4_quality_rules": rf"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM g),
c AS (SELECT doc_id, word, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (hit) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS failed_1, 100 * n_dup_lines > 50 * n_lines AS failed_2, word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed_3 FROM b),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS bad_0, {", ".join(f"count(*) FILTER (failed_{i}) AS bad_{i}" for i in (1, 2, 3))} FROM f GROUP BY source),
{", ".join(f"""p_{i} AS (SELECT sum(bad_{i}) / sum(docs) AS m, sum((bad_{i} / docs) * (bad_{i} / docs) * docs) / sum(docs) - (sum(bad_{i}) / sum(docs)) * (sum(bad_{i}) / sum(docs)) AS v FROM h),
s_{i} AS (SELECT m AS m_{i}, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2), 1e6) ELSE 1e6 END AS k_{i} FROM p_{i})""" for i in range(4))},
r AS (SELECT source, {", ".join(f"(bad_{i} + m_{i} * k_{i}) / (docs + k_{i}) AS rate_{i}" for i in range(4))} FROM h, s_0, s_1, s_2, s_3)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR failed_1 OR failed_2 OR failed_3) AND greatest(rate_0, rate_1, rate_2, rate_3) <= 0.5 AS kept, round(rate_0, 6) AS host_rate FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source""",
}
