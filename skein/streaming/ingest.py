"""Continuous ingestion of documents, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.chunking import chunk_documents
from ..operators.lexical import term_rows
from ..schema import DOCUMENTS
from ..shared import file_system
from ..sources.tables import new_documents


def document_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Documents from Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest(documents: DataFrame, out: str, checkpoint: str, spec: str = "fixed_size", clean: str = "default", stem: bool = False) -> StreamingQuery:
    """Append chunks and postings of a stream of documents to ``out/chunks`` and ``out/postings``.

    A document that an earlier batch had is left out. Each batch writes to a folder of its own number, so a batch that is run again
    after a failure replaces itself. Ends when no input is left.
    """
    preprocess = T.resolve_preprocessor(clean)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.filter("content is not null").dropDuplicates(["document_id"])
        files, target = file_system(batch.sparkSession, f"{out}/chunks")
        if files.exists(target):  # documents of other batches stay as they are
            done = batch.sparkSession.read.schema("document_id string, batch int").parquet(f"{out}/chunks").filter(F.col("batch") != number)
            rows = new_documents(rows, done)
        if preprocess:
            rows = rows.withColumn("content", preprocess(F.col("content")))
        chunks = chunk_documents(rows, spec)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{out}/chunks/batch={number}")
        postings = term_rows(stored, "chunk_id", "content", stem).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
        postings.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """``window_start, event_type, events, total`` over windows of ``width``; late rows beyond ``late`` are dropped in streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``window_start, events`` over windows that overlap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("window_start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``user_id, session_start, session_end, events``: runs of a user's events no more than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id is not null")
    if late and events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
