"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, shared_dir, text_or_empty

#: The characters that don't count: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """SHA-256 in hex of a text without its blanks."""
    return F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)


class DigestIndex:
    """A table ``(text_sha256, keep_id, batch)``, one row for each text seen, in ``buckets`` files sorted by digest.

    New data is reduced to one row for each digest before it moves, anti-joined with the index by a
    sort-merge join that reads the index without a shuffle, and what is new is appended.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows whose digests aren't there yet."""
        (rows.select("text_sha256", "keep_id", "batch").repartition(self.buckets, "text_sha256").write.mode("append")
         .option("path", self.path).bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name))

    def drop(self) -> None:
        """Remove the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        delete(self.spark, self.path)

    def absorb(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate ``df`` within itself and against the index, append what is new, and return one
        row for each row of ``df``: ``(id, keep_id, group_size, kept, text_sha256)``.

        Of equal texts that the index doesn't know, the row with the most code points in the original
        text stays, then the one with the smallest id (a null id comes first). A null text counts as
        empty. ``group_size`` counts the rows of ``df`` with that text. A text that the index knows
        from earlier data keeps its earlier ``keep_id``, and no row of ``df`` with it is kept.
        ``batch`` names the data: absorbed again under the same name, after a failure or not, it gives the
        same answer and nothing is appended twice. Without it each call is a batch of its own.
        Rows that repeat an id together with its text all get the same answer. A text of any length is hashed whole
        where it is. Other columns are ignored; an empty table gives no rows.
        """
        own = batch or uuid.uuid4().hex
        with Scratch(self.spark, "digests") as tmp:
            rows = df.select(F.col(id_col).alias(id_col), text_digest(text_or_empty(text_col)).alias("text_sha256"), F.length(text_or_empty(text_col)).alias("n_"))
            digests = tmp(rows, "digests", keep=True)
            groups = tmp(
                digests.groupBy("text_sha256")
                .agg(F.min(F.struct((-F.col("n_")).alias("n"), F.col(id_col).alias("id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
                .select("text_sha256", F.col("best.id").alias("keep_id"), "group_size"),
                "groups",
            )
            if not self.exists():
                self.append(groups.limit(0).withColumn("batch", F.lit(own)))
            # what an earlier attempt of this batch has appended is known here, but not as earlier data
            fresh = groups.hint("merge").join(self.table(), "text_sha256", "left_anti").withColumn("batch", F.lit(own))
            self.append(tmp(fresh, "fresh"))
            resolved = tmp(
                groups.hint("merge").join(self.table().select("text_sha256", F.col("keep_id").alias("index_id"), "batch"), "text_sha256")
                .select("text_sha256", F.col("index_id").alias("keep_id"), "group_size", (F.col("batch") == own).alias("fresh_")),
                "resolved", keep=True,
            )
        # rows of one digest may be a third of all: both sides are plain shuffles, so Spark splits a skewed one
        return digests.join(resolved, "text_sha256").select(
            F.col(id_col), "keep_id", "group_size", (F.col("fresh_") & F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
