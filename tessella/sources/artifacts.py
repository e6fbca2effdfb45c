"""Readers of a document's artifacts: lines, contents, trees, chunks and evidence as JSON, JSON lines or Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.layout import LINES, TOC
from ..session import Tables

SPAN = "array<struct<text:string,font:string,size:double,flags:int,bbox:array<double>>>"
RAW_LINE = f"index int, page_no int, block_no int, text string, bbox array<double>, spans {SPAN}, size double, font string, bold boolean, page_width double, page_height double"
CHUNK = "chunk_id string, text string, breadcrumb array<string>, pages array<int>, char_count int, paragraph_ids array<string>"


@dataclass(frozen=True)
class Settings:
    """Where artifacts lie and how retrieval and gate are set; from_env() reads TESSELLA_* from a mapping such as os.environ."""

    artifacts_root: str = "data"
    embedding_dim: int = 1024
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    min_chunk_chars: int = 10
    llm_base_url: str = ""
    llm_key: str = ""
    llm_model: str = ""
    evidence_threshold: float = 0.8
    evidence_term_weight: float = 0.75
    evidence_sparse_weight: float = 0.15
    evidence_depth_weight: float = 0.10
    evidence_saturate_at: float = 12.0
    evidence_depth_floor: float = 2.0
    evidence_window: int = 5
    evidence_pool: int = 8

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Settings:
        kinds = {k: type(v.default) for k, v in cls.__dataclass_fields__.items()}
        return cls(**{k: kind(env[f"TESSELLA_{k.upper()}"]) for k, kind in kinds.items() if f"TESSELLA_{k.upper()}" in env})


def doc_of(path: str = "_metadata.file_path") -> F.Column:
    """The document of a file root/{doc_id}/name."""
    return F.element_at(F.split(F.col(path), "/"), -2)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of layout.LINES from JSON arrays of raw lines at root/{doc_id}/lines.json (path may hold a glob)."""
    raw = spark.read.option("multiLine", True).schema(RAW_LINE).json(path)
    box = [F.element_at("bbox", i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = raw.select(doc_of().alias("doc_id"), F.col("index").alias("idx"), "page_no", "block_no", "text", *box, "size", "font", "bold", "page_width", "page_height")
    return checked_lines(rows)


def checked_lines(lines: DataFrame) -> DataFrame:
    """Lines of documents that have text; a document of blank lines alone was scanned, which is an error."""
    some = F.max(F.when(X.strip(F.col("text")) != "", 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    bad = F.raise_error(F.concat(F.lit("no text in "), F.col("doc_id"), F.lit(": a scan needs its text recognised first")))
    return lines.withColumn("_some", some).withColumn("text", F.when(F.col("_some") == 1, F.col("text")).otherwise(bad.cast("string"))).drop("_some").where(X.strip(F.col("text")) != "")


#: Documents that a stage can't take, each with the reason: they go beside the others' rows instead of ending the job.
BAD = "doc_id string, stage string, reason string"
SCANNED = "no text: a scan needs its text recognised first"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id of all files, of which nothing else is read."""
    return spark.read.format("binaryFile").load(path).select(doc_of("path").alias("doc_id"))


def without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    return rows.join(bad.select("doc_id").distinct(), "doc_id", "left_anti")


def lines_and_bad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_lines() of the documents that can be read, and BAD rows of the others: malformed JSON, no lines, a line without its index or page, or no text at all."""
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").schema(f"{RAW_LINE}, _bad string").json(path)
    box = [F.element_at("bbox", i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = raw.select(doc_of().alias("doc_id"), F.col("index").alias("idx"), "page_no", "block_no", "text", *box, "size", "font", "bold", "page_width", "page_height", F.col("_bad").isNotNull().alias("_bad"))
    rows = Tables(spark).put(rows, "raw_lines")
    each = rows.groupBy("doc_id").agg(F.bool_or("_bad").alias("broken"), F.bool_or(F.col("idx").isNull() | F.col("page_no").isNull()).alias("unplaced"), F.bool_or(X.strip(F.col("text")) != "").alias("some"))
    told = documents(spark, path).join(each, "doc_id", "left")
    why = F.when(F.col("broken").isNull(), "no lines").when(F.col("broken"), "malformed JSON").when(F.col("unplaced"), "a line without index or page").when(~F.coalesce("some", F.lit(False)), SCANNED)
    bad = Tables(spark).put(told.select("doc_id", F.lit("lines").alias("stage"), why.alias("reason")).where("reason is not null"), "bad")
    return without(rows.drop("_bad"), bad).where(X.strip(F.col("text")) != ""), bad


def toc_and_bad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_toc() of the documents whose contents can be read, and BAD rows of the others."""
    kind = "array<struct<level:int,title:string,page_no:int>>"
    files = Tables(spark).put(spark.read.text(path, wholetext=True).select(doc_of().alias("doc_id"), F.from_json("value", kind).alias("t")), "toc")
    bad = files.where("t is null or exists(t, x -> x.title is null or x.level is null)").select("doc_id", F.lit("toc").alias("stage"), F.lit("malformed JSON").alias("reason"))
    good = without(files, bad).select("doc_id", F.posexplode("t").alias("ord", "e"))
    return good.select("doc_id", "ord", "e.level", "e.title", "e.page_no"), bad


def json_lines_and_bad(spark: SparkSession, path: str, schema: str, order: str = "ord", stage: str = "json lines") -> tuple[DataFrame, DataFrame]:
    """read_json_lines() of the documents all of whose lines are objects, and BAD rows of the others with the first line that isn't."""
    lines = spark.read.text(path, wholetext=True).select(doc_of().alias("doc_id"), F.posexplode(F.split("value", "\n")).alias(order, "line")).where(X.strip(F.col("line")) != "")
    rows = Tables(spark).put(lines.select("doc_id", order, F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")), "json_lines")
    wrong = rows.where("r is null or r._bad is not null").groupBy("doc_id").agg(F.min(order).alias("at"))
    bad = wrong.select("doc_id", F.lit(stage).alias("stage"), F.concat(F.lit("malformed JSON in line "), F.col("at") + 1).alias("reason"))
    return without(rows, bad).select("doc_id", order, "r.*").drop("_bad"), bad


def dominant_span(spans: F.Column) -> F.Column:
    """The span of the longest text without white space at its ends, the first of a tie."""
    return F.aggregate(spans, F.get(spans, F.lit(0)), lambda acc, s: F.when(F.length(X.strip(s["text"])) > F.length(X.strip(acc["text"])), s).otherwise(acc))


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """Contents entries from JSON arrays of (level, title, page_no) at root/{doc_id}/toc.json."""
    text = spark.read.text(path, wholetext=True).select(doc_of().alias("doc_id"), F.from_json("value", "array<struct<level:int,title:string,page_no:int>>").alias("t"))
    return text.select("doc_id", F.posexplode("t").alias("ord", "e")).select("doc_id", "ord", "e.level", "e.title", "e.page_no")


def read_json_lines(spark: SparkSession, path: str, schema: str, order: str = "ord", strict: bool = True) -> DataFrame:
    """Rows of JSON-lines files with doc_id and their line number, blank lines left out. strict: a malformed line is an error; else it goes."""
    lines = spark.read.text(path, wholetext=True).select(doc_of().alias("doc_id"), F.posexplode(F.split("value", "\n")).alias(order, "line")).where(X.strip(F.col("line")) != "")
    rows = lines.withColumn("r", F.from_json("line", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    first = schema.split()[0]
    return (rows if strict else rows.where(F.col(f"r.{first}").isNotNull())).select("doc_id", order, "r.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks at root/{doc_id}/chunks.jsonl, chunk_index their line."""
    return read_json_lines(spark, path, CHUNK, "chunk_index")


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evidence at root/{doc_id}/evidence.jsonl; of an id's lines the last counts."""
    rows = read_json_lines(spark, path, schema)
    last = F.row_number().over(Window.partitionBy("doc_id", "evidence_id").orderBy(F.desc("ord")))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k")


def paragraph_links(chunks: DataFrame) -> DataFrame:
    """id, paragraph_id of chunks."""
    return chunks.select(F.col("chunk_id").alias("id"), F.explode("paragraph_ids").alias("paragraph_id"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_if_there(spark: SparkSession, path: str, reader) -> DataFrame | None:
    """What reader gives, None if the path is missing."""
    return reader(spark, path) if exists(spark, path) else None


TREE = "doc_id string, node_id string, parent_id string, ord int, node_type string, title string, level int, text string, pages array<int>"


def trees_and_bad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_trees() of the documents whose files hold a tree, and BAD rows of the others."""
    rows = Tables(spark).put(_flat_trees(spark, path, strict=False), "trees")
    bad = rows.where("node_type is null").select("doc_id", F.lit("tree").alias("stage"), F.col("text").alias("reason"))
    return rows.where("node_type is not null"), bad


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Rows of TREE from nested JSON at root/{doc_id}/document.json; a file that holds none is an error."""
    return _flat_trees(spark, path, strict=True)


def _flat_trees(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """A recursive record has no Spark type, so files are flattened in Arrow batches. Without strict a file that holds no tree is a row without node_type, its text the reason."""
    import json

    import pyarrow as pa

    def flat(node: dict, parent: str, out: list) -> None:
        page = (node.get("provenance") or {}).get("page_no")
        out.append((node["node_id"], parent, len(out), node["node_type"], node.get("title", ""), node.get("level", 0), node.get("text", ""), node.get("pages") or ([page] if page else [])))
        for child in node.get("children", []):
            flat(child, node["node_id"], out)

    def run(batches):
        names = [f.split()[0] for f in TREE.split(", ")]
        for b in batches:
            cols = [[] for _ in names]
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list = []
                try:
                    flat(json.loads(text), "", rows)
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as error:
                    if strict:
                        raise
                    rows = [(None, None, None, None, None, None, f"no tree: {type(error).__name__} {error}"[:200], None)]
                for r in rows:
                    for c, v in zip(cols, (doc, *r), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return spark.read.text(path, wholetext=True).select(doc_of().alias("doc_id"), "value").mapInArrow(run, TREE)


def tree_paths(tree: DataFrame) -> DataFrame:
    """Rows of TREE with path, the titles of chapters and sections from the top; by recursion over parent_id."""
    sql = """
        WITH RECURSIVE walk AS (
          SELECT t.*, CAST(array() AS ARRAY<STRING>) AS path FROM {tree} t WHERE parent_id = ''
          UNION ALL
          SELECT t.*, CASE WHEN t.node_type IN ('chapter', 'section') THEN concat(w.path, array(t.title)) ELSE w.path END FROM {tree} t JOIN walk w ON t.doc_id = w.doc_id AND t.parent_id = w.node_id)
        SELECT * FROM walk"""
    return tree.sparkSession.sql(sql, tree=tree)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, hash: the first 16 digits of SHA-256 over each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("hash"))


def upload_id(name: str) -> str:
    """An id for an uploaded PDF; another suffix is an error."""
    import uuid

    if Path(name).suffix.lower() != ".pdf":
        raise ValueError("only .pdf files can be ingested")
    return uuid.uuid4().hex[:12]


def register_pdf(spark: SparkSession) -> bool:
    """Registers the data source "pdf_lines" if a PDF library can be imported; without one lines come from read_lines()."""
    try:
        import pymupdf
    except ImportError:
        return False
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.paths = options["path"].split(",")

        def partitions(self):
            return [InputPartition(p) for p in self.paths]

        def read(self, partition):
            n = 0
            with pymupdf.open(partition.value) as pdf:
                for page in pdf:
                    for block_no, block in enumerate(b for b in page.get_text("dict")["blocks"] if b["type"] == 0):
                        for line in block["lines"]:
                            text = "".join(s["text"] for s in line["spans"])
                            if text.strip():
                                top = max(line["spans"], key=lambda s: len(s["text"].strip()))
                                yield (Path(partition.value).stem, n, page.number + 1, block_no, text, *(round(x, 2) for x in line["bbox"]), round(top["size"], 1), top["font"], bool(top["flags"] & 16) or "bold" in top["font"].lower(), page.rect.width, page.rect.height)
                                n += 1

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "pdf_lines"

        def schema(self):
            return LINES

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)
    return True


__all__ = ["CHUNK", "LINES", "RAW_LINE", "TOC", "TREE", "Settings"]
