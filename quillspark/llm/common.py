"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset on a single machine (a local
    master, as in tests) a temporary folder is made and set for the session; on a cluster that would be
    a folder of one machine, hence an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
        _at_exit(spark, path)
    return path.rstrip("/")


def _at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The intermediate tables of one call, in the shared folder.

    ``tmp(df, name)`` writes ``df`` as Parquet and reads it back: lineage ends there, so a lost executor
    costs a re-read and not a recomputation. At the end of the ``with`` block all tables are deleted but
    those written with ``keep=True``, which the result still reads; they go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, bool] = {}
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed, *_) -> None:
        for path, keep in self.paths.items():
            if failed or not keep:
                delete(self.spark, path)
        if not failed and any(self.paths.values()):
            _at_exit(self.spark, self.root)
        else:
            delete(self.spark, self.root)

    def __call__(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.tables)}"
        self.paths[path] = keep
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, before the end of the block."""
        for df in tables:
            for known, path in self.tables:
                if known is df and self.paths.pop(path, None) is not None:
                    delete(self.spark, path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % mod


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
