"""Streaming forms: incremental ingest, token windows, requests met by responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Files that arrive below ``folder`` are hashed and added to the Parquet folder ``table``.

    The source hands over each file once; a micro-batch is one partition, so that a
    batch that runs again writes the same rows. ``current_files`` reads the result.
    """
    source = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"))
    )

    def add(batch: DataFrame, number: int) -> None:
        out = f"{table}/batch={number}"
        batch.dropDuplicates(["path"]).write.mode("overwrite").parquet(out)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_files(spark: SparkSession, table: str) -> DataFrame:
    """The newest state of every path in ``table``."""
    rows = spark.read.parquet(table)
    return rows.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"), F.max_by("size_bytes", "batch").alias("size_bytes"))


def token_windows(calls: DataFrame, ts: str, model: str, tokens: str, late: str = "2 minutes") -> DataFrame:
    """Tokens per model and minute; stream or table."""
    held = calls.withWatermark(ts, late) if calls.isStreaming else calls
    return held.groupBy(F.window(ts, "60 seconds").alias("w"), F.col(model).alias("model")).agg(
        F.sum(tokens).alias("tokens"), F.count("*").alias("calls")
    ).select(F.col("w.start").alias("window_start"), "model", "tokens", "calls")


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response, oldest first by id."""
    return requests.join(responses.select("id"), "id", "left_anti")


def answered(requests: DataFrame, responses: DataFrame, timeout: str = "1800 seconds") -> DataFrame:
    """Left outer join within the timeout; requests (id, asked), responses (id, answered, body). Stream or table."""
    if requests.isStreaming:
        requests, responses = requests.withWatermark("asked", "1 minute"), responses.withWatermark("answered", "1 minute")
    r, s = requests.alias("r"), responses.alias("s")
    on = (F.col("r.id") == F.col("s.id")) & (F.col("s.answered") >= F.col("r.asked")) & (F.col("s.answered") <= F.col("r.asked") + F.expr(f"INTERVAL {timeout}"))
    return r.join(s, on, "left_outer").select("r.id", "r.asked", "s.answered", "s.body")
