"""Models behind a network: embeddings, judges, normalisers, translators and object extractors as batches over a given transport.

A transport is a picklable callable that executors run: Embed for lists of texts, Chat for one prompt. What an answer may change is decided by
DataFrame functions alone: an answer that fails its checks leaves the deterministic result as it was, with the reason beside it."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Tables
from . import drafts as D
from . import gate as E
from . import retrieval as R
from . import semantics as S
from . import translate as Z

UNIT = ["doc_id", "unit"]


class Busy(RuntimeError):
    """A failure that may pass: time out, no connection, too many requests, a server's error."""


class Refused(RuntimeError):
    """A failure that stays: a client's error, an answer of the wrong shape, or tries used up."""


def tried(call: Callable, attempts: int, backoff: float):
    """What call gives, tried again after Busy with doubling waits."""
    last = None
    for i in range(max(1, attempts)):
        try:
            return call()
        except Busy as busy:
            last = busy
            if backoff > 0 and i + 1 < attempts:
                time.sleep(backoff * 2**i)
    raise Refused(f"failed after {max(1, attempts)} attempts: {last}")


@dataclass(frozen=True)
class Http:
    """POST of JSON with a bearer's key."""

    base_url: str
    key: str
    model: str
    timeout: float = 60.0

    def post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            raise (Busy if error.code == 429 or error.code >= 500 else Refused)(f"status {error.code}") from error
        except (urllib.error.URLError, TimeoutError) as error:
            raise Busy(str(error)) from error


@dataclass(frozen=True)
class Chat(Http):
    """One prompt's answer."""

    system: str = ""

    def __call__(self, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        return self.post("chat/completions", {"model": self.model, "messages": messages, "temperature": 0.0})["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class Embed(Http):
    """Vectors of texts, by the index that each answer echoes."""

    dim: int = 1024

    def __call__(self, texts: list[str]) -> list[list[float]]:
        data = self.post("embeddings", {"model": self.model, "input": texts, "dimensions": self.dim})["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


def embeddings(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, text: str = "text", name: str = "v", batch: int = 64, attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """df with unit vectors of its texts; null is embedded as an empty text. A vector of another dimension, or tries used up, fails the job: an index may lack none."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(place).to_pylist()], []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                got = tried(partial(embed, part), attempts, backoff)
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise Refused(f"{len(part)} vectors of dimension {dim} were asked for")
                x = np.asarray(got, float)
                out.append((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            flat = np.concatenate(out) if out else np.empty((0, dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dim), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.names)

    return df.mapInArrow(run, schema)


def embedder(model: str, dim: int, base_url: str = "", key: str = "", batch: int = 64) -> Callable[..., DataFrame]:
    """A function df -> df with vectors, as settings name it: "hash" needs no network, any other model a key."""
    if model.strip().lower() == "hash":
        return partial(R.hash_embeddings, dim=dim)
    if not key:
        raise ValueError("an embedding model other than hash needs a key")
    return lambda df, text="text", name="v": embeddings(df, Embed(base_url, key, model.strip(), dim=dim), dim, text, name, batch)


AGAIN = "\n\nThe last answer was no JSON object. Answer with one JSON object and nothing else."
#: Prompts of a wave, whose answers are kept once all are there; prompts of a task; calls that a task has open; characters of an answer.
WAVE, OF_TASK, OPEN, LONGEST = 4096, 64, 8, 1 << 16
ANSWERS = "digest string, answer string, answer_error string"


def asked(prompts: DataFrame, chat: Callable[[str], str], attempts: int = 2, backoff: float = 1.0) -> DataFrame:
    """digest, answer, answer_error, paid of prompts (digest, prompt). A task has up to OPEN calls open at a time.

    answer is the JSON object in the model's reply, from its first { to its last }; a reply without one is asked for again. paid: whether the model replied at all, so that asking again would only cost."""

    def one(text: str) -> tuple[str | None, str | None, bool]:
        for i in range(max(1, attempts)):
            try:
                reply = tried(partial(chat, text + (AGAIN if i else "")), attempts, backoff)
            except Refused as refused:
                return None, str(refused), False
            if len(reply) > LONGEST:
                return None, "answer too long", True
            found = reply[reply.find("{") : reply.rfind("}") + 1] if "{" in reply else ""
            try:
                if isinstance(json.loads(found), dict):
                    return found, None, True
            except ValueError:
                continue
        return None, "no JSON object", True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(OPEN) as pool:
            for b in batches:
                told = list(pool.map(one, b.column("prompt").to_pylist()))
                kinds = (pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("digest"), *(pa.array([t[i] for t in told], k) for i, k in enumerate(kinds))], names=["digest", "answer", "answer_error", "paid"])

    return prompts.select("digest", "prompt").mapInArrow(run, f"{ANSWERS}, paid boolean")


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """digest, answer, answer_error of a store; none if it isn't there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(store).dropDuplicates(["digest"])


def answers(df: DataFrame, chat: Callable[[str], str], prompt: str, attempts: int = 2, backoff: float = 1.0, store: str | None = None, model: str = "") -> DataFrame:
    """df with answer (the JSON object in the model's reply) and answer_error (why there is none). A null prompt isn't asked.

    Each different prompt is asked once, wherever its rows stand and however often the result is read: this function asks, by digest, in waves of WAVE prompts, each a job whose
    answers are written before the next begins. With a store, a folder that outlives the session, a run that failed goes on behind its last wave, and prompts that this model
    has answered before are not asked again; `model` names it. Calls that failed (no reply at all) are not kept, and are asked again by the next run."""
    spark = df.sparkSession
    at = f"{store or Tables(spark).at + '/answers'}/{hashlib.sha256(model.encode()).hexdigest()[:16]}"
    digest = F.sha2(F.encode(F.col(prompt), "utf-8"), 256)
    new = df.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"])
    new = Tables(spark).put(new.join(kept_answers(spark, at), "digest", "left_anti"), "prompts")
    n, failed = new.count(), []
    waves = -(-n // WAVE)
    for i in range(waves):
        part = new.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == i).repartition(max(1, -(-min(n, WAVE) // OF_TASK)), "digest")
        told = Tables(spark).put(asked(part, chat, attempts, backoff), "wave")
        told.where("paid").drop("paid").write.mode("append").parquet(at)
        failed.append(told.where("not paid").drop("paid"))
    told = reduce(DataFrame.unionByName, failed, kept_answers(spark, at))
    return df.withColumn("digest_", digest).join(told.withColumnRenamed("digest", "digest_"), "digest_", "left").drop("digest_")


# --- judge of evidence ------------------------------------------------------------------------------------------------

JUDGE = "Judge by the passages alone whether they answer the question. List the facts an answer needs, check each against the passages, and answer with a JSON object: sufficient (boolean), coverage_score (share of facts found), missing (list of short phrases). In doubt sufficient is false."


def judge_prompts(queries: DataFrame, hits: DataFrame, window: int = 8, chars: int = 600) -> DataFrame:
    """query_id, prompt: the question and its first hits. queries: query_id, query; hits: query_id, rank, text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left("text", F.lit(chars)), F.when(F.length("text") > chars, "…").otherwise(""))
    shown = hits.where(F.col("rank") <= window).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("shown"))
    return queries.join(shown, "query_id", "left").select("query_id", F.concat(F.lit("Question:\n"), "query", F.lit("\n\nPassages:\n"), F.coalesce("shown", F.lit("(none)"))).alias("prompt"))


def judged(report: DataFrame, prompts: DataFrame, chat: Callable[[str], str], **options) -> DataFrame:
    """A gate's report (query_id, sufficient, coverage_score, missing, ...) after its second level, with level and answer_error.

    The judge is asked only for queries whose evidence the count of terms found insufficient; its verdict stands in place of that, of level heuristic+llm. All other rows
    stay as they were, of level heuristic: those that sufficed, and those without a usable verdict."""
    open_ = report.where(~F.col("sufficient")).select("query_id")
    told = answers(prompts.join(open_, "query_id", "left_semi"), chat, "prompt", **options).select("query_id", E.parse_verdict(F.col("answer")).alias("v"), "answer_error")
    rows = report.join(told, "query_id", "left")
    seen = F.col("v").isNotNull()
    new = {"sufficient": F.col("v")["sufficient"], "coverage_score": F.round(F.col("v")["coverage_score"], 4), "missing": F.coalesce(F.col("v")["missing"], F.array().cast("array<string>"))}
    return rows.withColumns({**{k: F.when(seen, c).otherwise(F.col(k)) for k, c in new.items()}, "level": F.when(seen, "heuristic+llm").otherwise("heuristic")}).drop("v")


@dataclass(frozen=True)
class Gate:
    """The gate with its levels: the count of terms, and a judge where there is one. answers: options of answers(), such as store and model."""

    config: E.EvidenceConfig = E.EvidenceConfig()
    chat: Callable[[str], str] | None = None
    answers: dict = field(default_factory=dict)

    @property
    def levels(self) -> str:
        return "heuristic" if self.chat is None else "heuristic+llm"

    def evaluate(self, queries: DataFrame, hits: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """The report on queries (query_id, query, tokens) by hits (query_id, rank, text, tokens, sparse_score); found: see gate.evaluate()."""
        first = E.evaluate(queries.select("query_id", "tokens"), hits, self.config, found)
        return E.gate(first) if self.chat is None else judged(first, judge_prompts(queries.select("query_id", "query"), hits), self.chat, **self.answers)


def gate_of(settings, store: str | None = None) -> Gate:
    """The gate that settings (sources.artifacts.Settings) name: with a judge if they have a key and a model."""
    config = E.EvidenceConfig(**{k: getattr(settings, f"evidence_{k}") for k in ("threshold", "term_weight", "sparse_weight", "depth_weight", "saturate_at", "depth_floor", "window", "pool")})
    if not (settings.llm_key and settings.llm_model):
        return Gate(config)
    return Gate(config, Chat(settings.llm_base_url, settings.llm_key, settings.llm_model, system=JUDGE), {"store": store, "model": settings.llm_model})


# --- normaliser of experiments ----------------------------------------------------------------------------------------

PATCH = "research_question string, hypothesis string, intervention string, subjects array<string>, independent_variables array<string>, dependent_variables array<string>, experimental_groups array<string>, control_groups array<string>, conclusions array<struct<statement:string,relationship:string,direction:string,evidence_ids:array<string>>>"


def patches(exps: DataFrame, evidence: DataFrame, chat: Callable[[str], str], **options) -> DataFrame:
    """doc_id, unit, patch, answer_error: what a model proposes for each experiment, by its evidence."""
    shown = evidence.groupBy(*UNIT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("evidence_id", F.lit(": "), "text").alias("l")))), lambda x: x["l"]), "\n").alias("shown"))
    draft = F.to_json(F.struct("research_question", "intervention", "experimental_groups", "control_groups", "dependent_variables"))
    rows = exps.join(shown, UNIT).select(*UNIT, F.concat(F.lit("Evidence:\n"), "shown", F.lit("\n\nDraft:\n"), draft, F.lit("\n\nCorrect the draft by the evidence alone. Cite evidence ids for each conclusion.")).alias("prompt"))
    return answers(rows, chat, "prompt", **options).select(*UNIT, F.from_json("answer", PATCH).alias("patch"), "answer_error")


def patched(exps: DataFrame, conclusions: DataFrame, evidence: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Experiments and conclusions with the patches that hold, and the reasons why others don't (doc_id, unit, rejected).

    A patch holds as a whole: if each conclusion of it does (semantics.patch_rejected), and if the numbers and p-values of its question, hypothesis, intervention and variables stand in the
    evidence, conclusions or none. Its fields replace those of the draft where they aren't empty; the draft's conclusions stay, and those with other statements follow them."""
    base = evidence.groupBy(*UNIT).agg(F.collect_set("evidence_id").alias("known_ids"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])).alias("evidence_text"))
    rows = proposed.where("patch is not null").join(base, UNIT)
    each = rows.select(*UNIT, "known_ids", "evidence_text", F.posexplode("patch.conclusions").alias("k", "x")).select(*UNIT, "k", "known_ids", "evidence_text", F.col("x.statement").alias("statement"), F.coalesce("x.relationship", F.lit("unspecified")).alias("relationship"), F.coalesce("x.direction", F.lit("unspecified")).alias("direction"), F.coalesce("x.evidence_ids", F.array().cast("array<string>")).alias("cites"))
    checked = S.patch_rejected(each)
    none = F.array().cast("array<string>")
    told_fields = F.concat(F.array(*(F.coalesce(F.col(f"patch.{c}"), F.lit("")) for c in ("research_question", "hypothesis", "intervention"))), *(F.coalesce(F.col(f"patch.{c}"), none) for c in ("dependent_variables", "independent_variables")))
    fields = rows.select(*UNIT, "evidence_text", F.posexplode(told_fields).alias("at", "field"))
    wrong = fields.withColumn("rejected", S.unproved(F.coalesce("field", F.lit("")), F.col("evidence_text"))).where("rejected is not null")
    wrong = wrong.select(*UNIT, (F.col("at") + 1_000_000).alias("k"), F.concat("rejected", F.lit(" of a field not in evidence")).alias("rejected"))
    why = checked.where("rejected is not null").select(*UNIT, "k", "rejected").unionByName(wrong).groupBy(*UNIT).agg(F.min_by("rejected", "k").alias("rejected"))
    good = rows.join(why, UNIT, "left_anti")
    out = exps.join(good.select(*UNIT, "patch"), UNIT, "left")
    fields = [f.name for f in T._parse_datatype_string(PATCH).fields if f.name in exps.columns]
    for name in fields:
        new = F.col("patch")[name]
        some = F.size(new) > 0 if isinstance(exps.schema[name].dataType, T.ArrayType) else new != ""
        out = out.withColumn(name, F.when(new.isNotNull() & some, new).otherwise(F.col(name)))
    told = checked.join(good.select(*UNIT), UNIT, "left_semi").dropDuplicates([*UNIT, "statement"]).join(conclusions.select(*UNIT, "statement"), [*UNIT, "statement"], "left_anti")
    last = conclusions.groupBy(*UNIT).agg(F.max("c").alias("last"))
    place = (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(*UNIT).orderBy("k"))).cast("int")
    more = told.join(last, UNIT, "left").select(*UNIT, place.alias("c"), "statement", "relationship", F.get("cites", F.lit(0)).alias("evidence_id"), F.array().cast("array<string>").alias("interpretation_ids"))
    return out.drop("patch"), conclusions.unionByName(more.select(*conclusions.columns)), why


# --- translator and object extractor ----------------------------------------------------------------------------------


def translated(drafts: DataFrame, chat: Callable[[str], str], **options) -> DataFrame:
    """translate.translate_drafts() where an answer {"zh": ...} that keeps the statement's anchors, names, numbers and direction stands in place of the template."""
    rows = Z.translate_drafts(drafts).withColumn("_prompt", F.concat(F.lit("Translate into Chinese; answer with a JSON object with the member zh.\n"), "statement"))
    rows = answers(rows, chat, "_prompt", **options).drop("_prompt")
    zh = F.trim(F.get_json_object("answer", "$.zh"))
    rows = rows.withColumn("_zh", F.when(zh != "", zh))
    good = F.col("_zh").isNotNull() & Z.rejection(F.col("statement"), F.col("_zh")).isNull()
    return rows.withColumns({"statement_zh": F.when(good, F.col("_zh")).otherwise(F.col("statement_zh")), "method": F.when(good, "llm").otherwise(F.col("method"))}).drop("answer", "_zh")


def objects(bps: DataFrame, evidence: DataFrame, chat: Callable[[str], str], **options) -> DataFrame:
    """doc_id, blueprint_id, object, refused: for data blueprints that can't quote their sentence, what the value measures, in words that stand in the sentence or in an evidence text
    it cites. object is null where there is none, and refused says why: error (no answer) or rejected (no phrase of the texts, empty, or too long)."""
    rows = bps.where("question_type = 'DATA_STATEMENT' and coalesce(data_value, '') <> ''").where(D.needs_object(F.col("data_value"), F.coalesce("sentence", F.lit(""))))
    texts = evidence.select("doc_id", "evidence_id", "text").dropDuplicates(["doc_id", "evidence_id"])
    cited = rows.select("doc_id", "blueprint_id", F.posexplode("evidence_ids").alias("at", "evidence_id")).join(texts, ["doc_id", "evidence_id"])
    cited = cited.groupBy("doc_id", "blueprint_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("cited"))
    rows = rows.select("doc_id", "blueprint_id", "data_value", F.coalesce("sentence", F.lit("")).alias("sentence")).join(cited, ["doc_id", "blueprint_id"], "left")
    rows = rows.withColumn("texts", F.concat(F.array("sentence"), F.coalesce("cited", F.array().cast("array<string>"))))
    prompt: Column = F.concat(F.lit("What does the value "), "data_value", F.lit(" measure? Answer with a JSON object with the member object, words of the text alone.\n"), F.array_join("texts", "\n"))
    rows = answers(rows.select("doc_id", "blueprint_id", "texts", prompt.alias("prompt")), chat, "prompt", **options)
    rows = rows.withColumn("phrase", F.trim(F.get_json_object("answer", "$.object")))
    good = F.coalesce(F.exists("texts", lambda t: D.object_allowed(F.col("phrase"), t)), F.lit(False))
    return rows.select("doc_id", "blueprint_id", F.when(good, F.col("phrase")).alias("object"), F.when(F.col("answer").isNull(), "error").when(~good, "rejected").alias("refused"))


def object_counts(found: DataFrame) -> DataFrame:
    """doc_id, tried, extracted, rejected, errors of objects()."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tried"), F.count("object").alias("extracted"), *(F.count_if(F.col("refused") == r).alias(n) for r, n in (("rejected", "rejected"), ("error", "errors"))))
