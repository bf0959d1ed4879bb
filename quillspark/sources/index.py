"""The index of a corpus: chunks with their vectors as one table, opened if it is there, built if it isn't, and kept up to date."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import embed
from .versions import Versions


def setting(spark: SparkSession, name: str, default: str | None = None) -> str:
    """A setting from the session (``quillspark.name``), else from the environment (``QUILLSPARK_NAME``), else the default;
    without any an error that says where it may be given."""
    env = "QUILLSPARK_" + name.upper().replace(".", "_")
    value = spark.conf.get(f"quillspark.{name}", None) or os.environ.get(env) or default
    if value is None:
        raise KeyError(f"set quillspark.{name} in the session or {env} in the environment")
    return value


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_files(spark: SparkSession, *paths: str) -> dict[str, bool]:
    """Delete derived files and folders; tells of each whether it was there."""
    return {path: bool((fs_p := _path(spark, path))[0].delete(fs_p[1], True)) for path in paths}


class ChunkIndex:
    """Chunks (id, content, doc_code, article, ...) with a column ``embedding``, as Parquet parts in a folder.

    What is in force is named by a manifest that is switched at the end of a write (:class:`Versions`): a crash at any step leaves
    the index before readable. A chunk is told apart by its id and the digest of all its columns. Parts are sorted by document and
    article, so that a search restricted to a document skips most of them."""

    OWN = ("embedding", "error", "digest", "part")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def exists(self) -> bool:
        return self.versions.current() is not None

    def _rows(self, state: dict) -> DataFrame:
        """All rows in force: of all parts, those that no later part has replaced."""
        rows = self.spark.read.option("mergeSchema", True).parquet(*state["parts"])
        if state["gone"]:
            rows = rows.join(self.spark.read.parquet(*state["gone"]), ["id", "digest", "part"], "left_anti")
        return rows

    def _state(self) -> dict:
        state = self.versions.current()
        if state is None:
            raise FileNotFoundError(f"no index in {self.path}")
        return state

    def open(self) -> DataFrame:
        """The chunks with their vectors."""
        return self._rows(self._state()).where("embedding is not null").drop("error", "digest", "part")

    def generations(self) -> DataFrame:
        """``(id, generation)``: which of the parts in force, counted from 0, holds a chunk."""
        state = self._state()
        names = F.array(*(F.lit(p.rpartition("/")[2]) for p in state["parts"]))
        return self._rows(state).where("embedding is not null").select("id", (F.array_position(names, F.col("part")) - 1).alias("generation"))

    def failed(self) -> DataFrame:
        """Chunks that the provider failed on, with ``error``; the next :meth:`update` takes them up again."""
        return self._rows(self._state()).where("embedding is null").drop("embedding", "digest", "part")

    def update(self, chunks: DataFrame, provider: Callable[[list[str]], np.ndarray], batch: int = 64, unique: bool = False, **options) -> dict[str, int]:
        """Make the index hold ``chunks`` and nothing else. Only chunks that are new or changed, or that failed before, are
        embedded; those that are no longer there go. Rows that repeat all columns are one; ``unique`` says that no id is there
        twice, as in chunks of :func:`build_chunks`, and spares the shuffle of all texts that looks for such rows. ``options`` go to :func:`embed`.

        Returns how many were embedded, failed and removed, and how many stayed as they were."""
        before = self.versions.current()
        state = before or {"parts": [], "gone": []}
        part, gone_at = self.versions.new_folder("part"), self.versions.new_folder("gone")
        rows = chunks.drop(*self.OWN)
        digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        rows = rows.withColumn("digest", digest)
        rows = rows if unique else rows.dropDuplicates(["id", "digest"])
        known = self._rows(state).select("id", "digest", "part", F.col("embedding").isNotNull().alias("done")) if state["parts"] else None
        fresh = rows.join(known.where("done").select("id", "digest"), ["id", "digest"], "left_anti") if known else rows
        order = [c for c in ("doc_code", "article", "id") if c in rows.columns]
        made = embed(fresh, "content", provider, batch=batch, error="error", **options).withColumn("part", F.lit(part.rpartition("/")[2]))
        made.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(part)
        counts = {"kept": 0, "removed": 0}
        gone = []
        if known:
            there = rows.select("id", "digest", F.lit(True).alias("there"))
            known.join(there, ["id", "digest"], "left").where("there is null or not done").select("id", "digest", "part", "done").write.parquet(gone_at)
            written = self.spark.read.parquet(gone_at)
            counts["removed"] = written.where("done").count()
            counts["kept"] = known.where("done").count() - counts["removed"]
            gone = [gone_at]
        new = self.spark.read.parquet(part)
        counts |= {"embedded": new.where("embedding is not null").count(), "failed": new.where("embedding is null").count()}
        self.versions.publish({"parts": [*state["parts"], part], "gone": [*state["gone"], *gone]}, before and before["number"])
        return counts

    def build(self, chunks: DataFrame, provider: Callable[[list[str]], np.ndarray], batch: int = 64, **options) -> DataFrame:
        """Embed all chunks and put them in place of what is there, which ``chunks`` may be read from."""
        before = self.versions.current()
        part = self.versions.new_folder("part")
        rows = chunks.drop(*self.OWN)
        rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).dropDuplicates(["id", "digest"])
        order = [c for c in ("doc_code", "article", "id") if c in rows.columns]
        made = embed(rows, "content", provider, batch=batch, error="error", **options).withColumn("part", F.lit(part.rpartition("/")[2]))
        made.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(part)
        self.versions.publish({"parts": [part], "gone": []}, before and before["number"])
        return self.open()

    def open_or_build(self, chunks: DataFrame, provider: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
        """The index as it is, if it has rows; else it is built."""
        if self.exists():
            rows = self.open()
            if rows.limit(1).count():
                return rows
        return self.build(chunks, provider, batch)

    def compact(self) -> None:
        """Write what is in force as one part."""
        state, part = self._state(), self.versions.new_folder("part")
        rows = self._rows(state).withColumn("part", F.lit(part.rpartition("/")[2]))
        order = [c for c in ("doc_code", "article", "id") if c in rows.columns]
        rows.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(part)
        self.versions.publish({"parts": [part], "gone": []}, state["number"])

    def clean(self) -> list[str]:
        """Delete what isn't in force: left over by crashes, replaced by a build or compacted. Not while others read or write."""
        state = self._state()
        return self.versions.clean(*state["parts"], *state["gone"])

    def drop(self) -> bool:
        return drop_files(self.spark, self.path)[self.path]


def write_sample(chunks: DataFrame, path: str, n: int = 10, key: str = "id") -> None:
    """The first ``n`` chunks by key, as JSON."""
    chunks.orderBy(key).limit(n).coalesce(1).write.mode("overwrite").json(path)
