"""Queries on small tables that the test tables don't hold."""

import pytest

from tessella.plans import queries as Q
from tests.oracle import same


@pytest.fixture
def folder(spark, tmp_path):
    """A writer of documents (texts) as the only table of a folder."""

    def write(*texts):
        import pyarrow as pa
        import pyarrow.parquet as pq

        n = len(texts)
        pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": list(texts), "lang": ["en"] * n, "source": ["a"] * n}), tmp_path / "documents.parquet")
        return str(tmp_path)

    return write


def test_dotted_numbers_count_as_far_as_they_go(spark, folder):
    at = folder("1.2.3 x\n28.68.191.238 Den sch\n70.32.29.134 Tioning\n1.234 x\n12.5_a\n3. x\n1.2.\nChapter 4 x", "9.9.9.9\n1.2.345 x\n1.2.34.567")
    same(spark, Q.line_predicates, Q.ORACLE_SQL["line_predicates"], at)


def test_lines_too_short_for_an_edge_are_not_indented(spark, folder):
    at = folder("Enverkeitheit.\nChpfzu ertete.", "a\nb!\nc\n\nd)\ne", "A line that is long enough.\nshort\nx?")
    same(spark, Q.paragraph_islands, Q.ORACLE_SQL["paragraph_islands"], at)


def test_levels_are_compacted_without_arrays_of_a_document(spark):
    """50,000 headings of one document, against the fold."""
    import time

    from tessella.operators import layout as L

    rows = spark.range(50_000).selectExpr("'d' AS doc_id", "cast(id AS int) AS idx", "cast(1 + id * 2654435761 % 7 AS int) AS level")
    began = time.time()
    got = [r["level"] for r in L.compacted(rows).orderBy("idx").collect()]
    assert time.time() - began < 20
    want = []
    for i in range(50_000):
        level = 1 + i * 2654435761 % 7
        want.append(min(level, want[-1] + 1) if want else level)
    assert got == want and L.compacted(rows).schema["level"].dataType.simpleString() == "int"
    assert "collect_list" not in L.compacted(rows)._jdf.queryExecution().toString()


def moved(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    import time

    time.sleep(1)  # the store follows the stages
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_shuffles_no_pair_of_a_query_and_a_record(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.functions import text as X
    from tessella.operators import retrieval as R
    from tessella.sources import inverted

    rows = spark.range(3000).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("shared words of record "), F.col("id") % 700, F.lit(" again "), F.repeat(F.lit("pad "), (F.col("id") % 9).cast("int"))).alias("text"))
    inverted.update_index(R.records(rows), f"file://{tmp_path}/index")
    index = inverted.open_index(spark, f"file://{tmp_path}/index")
    queries = spark.range(30).select(F.col("id").alias("query_id"), X.tokens(F.concat(F.lit("shared words record "), F.col("id"))).alias("tokens"))
    before = moved(spark)
    got = {(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in index.search(queries, 5).collect()}
    assert moved(spark) - before < 30 * 3000 / 4
    assert got == {(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in R.bm25(queries, R.records(rows), 5).collect()}


def test_a_search_of_texts_shuffles_no_pair_either(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.functions import text as X
    from tessella.operators import retrieval as R
    from tessella.session import Tables

    rows = spark.range(3000).select("id", F.concat(F.lit("shared words of a record w"), "id").alias("text"))
    queries = spark.range(60).select(F.col("id").alias("query_id"), X.tokens(F.lit("shared words a record")).alias("tokens"))
    before = moved(spark)
    assert R.bm25(queries, R.records(rows), 5, put=Tables(spark).put).count() == 60 * 5
    assert moved(spark) - before < 60 * 3000 / 4


def test_row_work_is_dealt_to_tasks_by_rows(spark, tmp_path):
    """30,000 parts in one small file: statements and papers are read by several tasks."""
    from tessella.session import TASK_ROWS, Tables
    from tests.oracle import SF

    n = 3 * TASK_ROWS
    part = spark.read.parquet(f"{SF}/part.parquet").drop("p_partkey").limit(20)
    part.crossJoin(spark.range(n // part.count()).withColumnRenamed("id", "r")).selectExpr("monotonically_increasing_id() AS p_partkey", "* EXCEPT (r)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert Q.statements(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    assert sum(1 for f in (tmp_path / "part.parquet").glob("*.parquet")) == 1
    held = Q.written_papers(spark, str(tmp_path), Tables(spark).put)
    assert len(held.inputFiles()) > 3


def test_a_glued_part_stands_once_in_its_plan(spark):
    from pyspark.sql import functions as F

    from tessella.operators import translate as T

    rows = spark.createDataFrame([("处理", "a"), ("a", "处"), ("", "a"), ("a", "b")], "l string, r string")
    made = rows.select(T.glue(F.upper("l"), F.col("r")).alias("x"))
    assert [r["x"] for r in made.collect()] == ["处理 a", "A 处", "a", "Ab"]
    assert made._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_marks_after_a_word_that_ends_in_a_dotted_capital_i():
    import pyarrow as pa

    from tessella.llm import tokens

    e = tokens.encoder(tokens.default_tokenizer())
    for text in ("İ,", "Aİ!?", "x İ. y"):
        ((ids, _),) = e.encode(pa.array([text.encode()], pa.binary()), 7)
        assert ids.tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 7]
