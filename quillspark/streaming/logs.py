"""Query logs as a stream: counts of query kinds in tumbling windows, fan-out to log folders, and incremental ingest of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import query_kind
from ..sources.files import append_logs


def windowed_kinds(events: DataFrame, time: str, message: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``(window_start, kind, n)``; works on streams and tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(time, window), query_kind(F.col(message)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "kind", "n")


def ingest_texts(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append new text files of a folder to a table, each once."""
    rows = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def fan_out(entries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of log entries by module, those of level ``query`` to the query log too, each entry once.

    The checkpoint fixes which entries a batch holds and its number, and a batch writes to folders of that number: run again
    after a crash between the two logs, or behind them, it replaces what it wrote."""
    write = lambda rows, number: append_logs(rows, folder, f"{number:012d}")
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
