"""Jobs over a folder of artifacts: python -m tessella JOB --root FOLDER [...]. Each reads the tables of the jobs before it and writes its own.

ingest      root/raw/{doc_id}/lines.json and toc.json -> clean, headings, nodes, paragraphs, chunks; quarantine has the documents that can't be read, and why
index       chunks -> index/ (records, vectors, postings in blocks); documents that changed are written, others stay; new settings write all
search      hits of --query as JSON lines
gate        the verdict on --query; exit 0 if the evidence suffices, 2 if not
figures     paragraphs -> conclusions, verdicts, and the report's figures, evidence, experiments, report and manifest as tables; figures look up chunks if there is an index
questions   paragraphs -> blueprints, drafts, their Chinese rendering
review      the sets of --doc by figure, or --set with its evidence
--doc, --figure and --type (of blueprints) restrict what is printed, not what is written."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import blueprints as B
from .operators import drafts as D
from .operators import figures as G
from .operators import gate as E
from .operators import layout as L
from .operators import retrieval as R
from .operators import review as V
from .operators import semantics as S
from .operators import translate as T
from .session import Tables, get_session
from .sources import artifacts as A
from .sources import inverted, reports, sinks

DIM = 64
EMBEDDER = {"embedder": "hash", "dim": DIM}


def stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    return sinks.read_stage(spark, root, name)


def ingest(spark: SparkSession, root: str) -> DataFrame:
    """Writes the tables of all documents that can be read, and those that can't with their reasons (quarantine); returns a row of counts for each document that has chunks.

    A document that can't be read keeps the tables it had, and leaves quarantine with its next good run."""
    lines, bad = A.lines_and_bad(spark, f"{root}/raw/*/lines.json")
    toc, bad_toc = A.toc_and_bad(spark, f"{root}/raw/*/toc.json")
    bad = Tables(spark).put(bad.unionByName(bad_toc), "bad")
    lines = Tables(spark).put(A.without(lines, bad_toc), "lines")
    for name, df in L.ingest(lines, A.without(toc, bad), put=Tables(spark).put).items():
        sinks.write_stage(df, root, name, ids=lines.select("doc_id").distinct())
    sinks.write_stage(bad, root, "quarantine", ids=A.documents(spark, f"{root}/raw/*/lines.json"))
    return L.chunk_stats(stage(spark, root, "chunks"), ["doc_id"])


def build_index(spark: SparkSession, root: str, force: bool = False) -> str:
    """built, updated (documents that changed or went) or skipped."""
    chunks = stage(spark, root, "chunks").withColumn("id", F.col("chunk_id"))
    settings = {"config_hash": R.RetrievalConfig().config_hash(), **EMBEDDER}
    return inverted.update_index(R.records(chunks), f"{root}/index", settings, lambda recs: R.hash_embeddings(recs.select("id", "text"), dim=DIM).select("id", "v"), force)


def opened(spark: SparkSession, root: str) -> inverted.Index:
    """The index, if queries are embedded as its records were."""
    return inverted.open_index(spark, f"{root}/index", **EMBEDDER)


def search(spark: SparkSession, root: str, query: str, mode: str = "hybrid", top: int = 5) -> DataFrame:
    index = opened(spark, root)
    q = R.hash_embeddings(spark.createDataFrame([(0, query)], "query_id int, text string"), dim=DIM, name="q")
    return R.hydrate(R.retrieve(q, None, index.vectors(), mode, top, index=index), index.records()).orderBy("rank")


def gate(spark: SparkSession, root: str, query: str, top: int = 10) -> DataFrame:
    hits = search(spark, root, query, "hybrid", top)
    q = spark.createDataFrame([(0, query)], "query_id int, text string").select("query_id", X.tokens(F.col("text")).alias("tokens"))
    return E.gate(E.evaluate(q, hits))


def looked_up(spark: SparkSession, root: str, paragraphs: DataFrame) -> DataFrame:
    """The chunks that search finds for each figure and none of whose paragraphs are its evidence already, as rows that semantics.reconstruct() takes."""
    index = opened(spark, root)
    reg = G.registry(paragraphs)
    unit = ["doc_id", "figure_id", "unit"]
    asked = G.figure_queries(reg["figures"]).withColumn("query_id", F.concat_ws("|", "doc_id", "unit"))
    hits = R.retrieve(R.hash_embeddings(asked.select("query_id", "text"), dim=DIM, name="q"), None, index.vectors(), "hybrid", 5, index=index)
    evidence = S.figure_evidence(paragraphs, reg, G.partition(paragraphs, reg["figures"]))
    covered = evidence.select(F.concat_ws("|", "doc_id", "unit").alias("query_id"), "paragraph_id").distinct()
    free = R.hydrate(R.supplement(hits, A.paragraph_links(stage(spark, root, "chunks")), covered), index.records().drop("doc_id")).join(asked.select(*unit, "query_id"), "query_id")
    first = F.coalesce(F.get("paragraph_ids", F.lit(0)), F.lit(""))
    return free.select("doc_id", "unit", "figure_id", "text", first.alias("paragraph_id"), F.col("rank").alias("ord"), F.lit("other").alias("section_type"), F.coalesce(F.get("pages", F.lit(0)), F.lit(0)).alias("page_no"))


def figures(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    paragraphs = stage(spark, root, "paragraphs")
    try:
        more = looked_up(spark, root, paragraphs)
    except (FileNotFoundError, ValueError):  # no index, or one of another embedder: figures go without
        more = None
    sem = S.reconstruct(paragraphs, more, put=Tables(spark).put)
    for name, df in {"conclusions": sem["conclusions"], "verdicts": sem["verdicts"], **reports.report(sem, G.background(paragraphs), paragraphs)}.items():
        sinks.write_stage(df, root, name)
    return sem


def reviewed(spark: SparkSession, root: str, doc: str, set_id: str | None = None) -> DataFrame:
    """A document's sets by figure, or one set with its evidence, read from the folders of the document alone."""
    translated = sinks.read_stage(spark, root, "drafts_zh", doc)
    return V.sets_by_figure(translated) if set_id is None else V.question_set(translated, sinks.read_stage(spark, root, "evidence_rows", doc), doc, set_id)


def questions(spark: SparkSession, root: str) -> DataFrame:
    sem, put = figures(spark, root), Tables(spark).put
    bps = put(B.blueprints(sem), "blueprints")
    drafts = put(D.draft_sets(bps, sem, put=put), "drafts")
    zh = put(T.translate_drafts(drafts), "zh")
    for name, df in (("blueprints", bps), ("drafts", drafts), ("drafts_zh", zh), ("evidence_rows", sem["evidence"])):
        sinks.write_stage(df, root, name)
    return zh


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=["ingest", "index", "search", "gate", "figures", "questions", "review"])
    for name, kind in (("--root", str), ("--query", str), ("--mode", str), ("--top", int), ("--doc", str), ("--figure", str), ("--type", str), ("--set", str), ("--master", str)):
        p.add_argument(name, type=kind)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    spark = get_session(master=a.master)
    if a.job == "index":
        print(build_index(spark, a.root, a.force))
        return 0
    if a.job == "ingest":
        out = ingest(spark, a.root)
    elif a.job == "search":
        out = search(spark, a.root, a.query, a.mode or "hybrid", a.top or 5).select("rank", "id", "fused_score", "sources", F.left("text", F.lit(120)).alias("text"))
    elif a.job == "gate":
        out = gate(spark, a.root, a.query, a.top or 10)
    elif a.job == "review":
        if not a.doc:
            p.error("review needs --doc")
        out = reviewed(spark, a.root, a.doc, a.set)
    elif a.job == "figures":
        sem = figures(spark, a.root)
        out = sem["verdicts"].join(sem["units"].select("doc_id", "unit", "figure_id"), ["doc_id", "unit"])
    else:
        out = questions(spark, a.root)
    out = out.where(F.col("doc_id") == a.doc) if a.doc and "doc_id" in out.columns else out
    out = out.where(V.figure_matches(F.col("figure_id"), a.figure)) if a.figure and "figure_id" in out.columns else out
    out = out.where(F.col("question_type") == a.type.upper()) if a.type and "question_type" in out.columns else out
    for row in out.toJSON().toLocalIterator():
        print(row)
    return 2 if a.job == "gate" and out.where("not sufficient").limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
