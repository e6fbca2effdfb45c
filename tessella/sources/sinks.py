"""Writers of artifacts: stage tables by document, and indexes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Tables
from . import inverted


#: Rows of a folder, about, and the fewest and most folders of a table; runs after which a write brings all rows that count together.
PART_ROWS, PARTS, MOST_RUNS = 1_000_000, (8, 8192), 32
#: Columns that single rows are looked up by: their Parquet files get Bloom filters.
LOOKED_UP = ("set_id", "evidence_id", "blueprint_id", "draft_id", "chunk_id", "figure_id")


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def write_stage(df: DataFrame, root: str, name: str, kind: str = "parquet", buckets: int | None = None, ids: DataFrame | None = None) -> None:
    """Adds a run to a stage's table at root/name. Documents of this run take the place of their own former rows alone; earlier files stay as they are.

    rows/run=R/part=P holds a run's rows by their document's hash, ids/run=R/part=P its documents, commits/R.json marks it as whole and is written last. ids: documents (doc_id)
    that this run speaks of beside those of df: their former rows go, though they have none now. How many parts there are follows the rows of the
    first run (or is buckets). After MOST_RUNS runs all rows that count are written together, and readers leave the runs before alone."""
    spark, at = df.sparkSession, f"{root}/{name}"
    runs, put = inverted.commits(spark, at), Tables(spark).put
    new = put(df, "stage")
    n = new.count()
    whose = (new.select("doc_id") if ids is None else new.select("doc_id").union(ids.select("doc_id"))).distinct()
    together = not runs or len(runs) >= MOST_RUNS
    if runs and together:
        old = read_stage(spark, root, name).join(whose, "doc_id", "left_anti")
        new = put(new.unionByName(old), "all")
        n, whose = new.count(), whose.union(old.select("doc_id")).distinct()
    parts = buckets or (runs[-1]["parts"] if not together else min(max(PARTS[0], -(-n // PART_ROWS)), PARTS[1]))
    number = runs[-1]["run"] + 1 if runs else 0
    for table, rows, form in (("rows", new, kind), ("ids", whose, "parquet")):
        w = rows.withColumn("part", part_of(F.col("doc_id"), parts)).repartition("part").sortWithinPartitions("part", "doc_id").write.mode("overwrite").partitionBy("part").format(form)
        for c in LOOKED_UP if form == "parquet" else ():
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true") if c in rows.columns else w
        w.save(f"{at}/{table}/run={number}")
    inverted.commit(spark, at, {"run": number, "base": together, "parts": parts, "kind": kind, "schema": new.schema.json(), "empty": n == 0})


def write_json(df: DataFrame, root: str, name: str) -> None:
    write_stage(df, root, name, "json")


def read_stage(spark: SparkSession, root: str, name: str, doc: str | None = None) -> DataFrame:
    """A stage's rows: each document as its last run has it. With doc, that document's alone, from the folders of its hash. A table that isn't there is an error."""
    at = f"{root}/{name}"
    runs = inverted.commits(spark, at)
    if not runs:
        raise FileNotFoundError(f"no table at {at}")
    schema = T.StructType.fromJson(json.loads(runs[-1]["schema"]))
    full = [f"{at}/rows/run={c['run']}" for c in runs if not c["empty"]]
    if not full:
        return spark.createDataFrame([], schema)
    layout = T.StructType([*schema.fields, T.StructField("run", T.IntegerType()), T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(layout).option("basePath", f"{at}/rows").format(runs[-1]["kind"]).load(full)

    def own(df: DataFrame) -> DataFrame:
        if doc is None:
            return df
        this = F.lit(doc).cast(schema["doc_id"].dataType)
        return df.where((F.col("part") == part_of(this, runs[-1]["parts"])) & (F.col("doc_id") == this))

    rows = own(rows)
    if len(runs) > 1:  # what later runs replaced is little, as they are brought together now and then
        ids = own(spark.read.option("basePath", f"{at}/ids").parquet(*(f"{at}/ids/run={c['run']}" for c in runs)))
        last = ids.groupBy("doc_id").agg(F.max("run").alias("last"))
        rows = rows.join(ids.join(last, "doc_id").where("run < last").select("doc_id", "run"), ["doc_id", "run"], "left_anti")
    return rows.select(*schema.names)


def write_index(records: DataFrame, vectors: DataFrame, root: str, config_hash: str, embedder: dict, force: bool = False) -> str:
    """Brings the index at root up to date with records and vectors (id, v) that are there already; see inverted.update_index. Records without doc_id are documents of their own."""
    records = records if "doc_id" in records.columns else records.withColumn("doc_id", F.col("id"))
    return inverted.update_index(records, root, {"config_hash": config_hash, **embedder}, lambda changed: vectors.join(changed.select("id"), "id", "left_semi"), force)


def open_index(spark: SparkSession, root: str, dim: int | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """manifest, records, vectors; an index that isn't there, or is of another dimension, is an error."""
    index = inverted.open_index(spark, root, **({} if dim is None else {"dim": dim}))
    return {**index.last["settings"], "num_chunks": index.n}, index.records(), index.vectors()


def type_histogram(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("doc_id", "evidence_type").agg(F.count(F.lit(1)).alias("n"))
