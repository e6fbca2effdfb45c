"""Documents as a stream: files that arrive are tokenised to postings, and counted by window with a watermark. An addition; batch is the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.retrieval import postings


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def write_postings(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of each micro-batch at out/batch=n: a batch that runs again takes its own place."""

    def batch(df: DataFrame, n: int) -> None:
        recs = df.select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("tokens"))
        postings(recs).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are left out. Runs on a table as well."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
