"""Reading and writing corpora, chunk tables and logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("metadata", T.StructType([
        *(T.StructField(n, T.StringType()) for n in ("article",)), *(T.StructField(n, T.IntegerType()) for n in ("page", "position", "chunk_index", "total_chunks", "tokens")),
        *(T.StructField(n, T.StringType()) for n in ("citation", "document", "id_label", "doc_code", "doc_overview")),
    ])),
])
LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "module", "level", "message", "data", "_corrupt_record")])


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, stem, content)`` of the text files in a folder."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").withColumn("path", F.col("_metadata.file_path"))
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return rows.select("path", F.regexp_replace(name, r"\.txt$", "").alias("stem"), F.col("value").alias("content"))


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def nested_chunks(chunks: DataFrame) -> DataFrame:
    """Flat chunks as (id, content, metadata)."""
    return chunks.select("id", "content", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK["metadata"].dataType]).alias("metadata"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def append_logs(logs: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append as JSON lines by module; entries of level ``query`` also go to the query log. Both go to a folder of the batch: written
    again under the same name, after a failure between the two or not, it adds nothing."""
    batch = batch or uuid.uuid4().hex
    rows = logs.select("timestamp", "module", "level", "message", "data")
    for name, part in (("modules", rows), ("queries", rows.where("level = 'query'"))):
        part.write.mode("overwrite").json(f"{folder}/{name}/batch={batch}")


def read_logs(spark: SparkSession, *paths: str, keep_broken: bool = False) -> DataFrame:
    """Log entries; lines that aren't JSON are left out, or kept in ``_corrupt_record``."""
    rows = spark.read.schema(LOG).json(list(paths), mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").select(*LOG.names)
    return rows if keep_broken else rows.drop("_corrupt_record").where(F.coalesce("timestamp", "module", "level", "message", "data").isNotNull())


def not_yet_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(key), key, "left_anti")


CONVERTED = "path string, stem string, content string, status string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def convert(files: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """``(path, stem, content, status)`` of binary files (path, content). A file that the parser can't read has the status ``failed``
    and the reason as content."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for path, stem, content in zip(pdf["path"], pdf["stem"], pdf["content"], strict=True):
                try:
                    out.append((path, stem, parse(bytes(content)), "converted"))
                except Exception as e:  # noqa: BLE001  any parser's error is that file's status
                    out.append((path, stem, str(e), "failed"))
            yield type(pdf)(out, columns=["path", "stem", "content", "status"])

    return files.select("path", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), "content").mapInPandas(run, CONVERTED)


def convert_files(spark: SparkSession, folder: str, parse: Callable[[bytes], str], done: DataFrame | None = None, glob: str = "*.pdf") -> DataFrame:
    """:func:`convert` of the files of a folder, those in ``done`` (stem) left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return convert(not_yet_done(files, done, "stem") if done is not None else files, parse)


class Conversion:
    """Files of a folder converted as they come, with the status of each attempt.

    A file stream with a checkpoint finds files that no run has seen; each batch writes its results to a folder of its own, so a
    batch that runs again after a crash replaces them. Files whose last attempt failed are tried again by the next run."""

    def __init__(self, spark: SparkSession, folder: str, out: str, glob: str = "*.pdf"):
        self.spark, self.folder, self.out, self.glob = spark, folder, out.rstrip("/"), glob

    def attempts(self) -> DataFrame:
        """``(path, stem, content, status, run, batch)`` of all attempts."""
        return self.spark.read.schema(f"{CONVERTED}, run int, batch string").parquet(f"{self.out}/results")

    def _has_results(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/results")
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def latest(self) -> DataFrame:
        """``(path, stem, content, status)`` of the last attempt at each file."""
        best = self.attempts().groupBy("path").agg(F.max(F.struct("run", "stem", "content", "status")).alias("b"))
        return best.select("path", "b.stem", "b.content", "b.status")

    def run(self, parse: Callable[[bytes], str]) -> dict[str, int]:
        """Convert what is new and what failed before. Returns how many files were converted, skipped and failed."""
        number, skipped, again = 0, 0, []
        if self._has_results():
            number = (self.attempts().agg(F.max("run")).first()[0] or 0) + 1
            skipped = self.latest().where("status = 'converted'").count()
            again = [r["path"] for r in self.latest().where("status = 'failed'").select("path").collect()]  # paths of what failed, no contents
        write = lambda rows, batch: convert(rows, parse).withColumn("run", F.lit(number)).write.mode("overwrite").parquet(f"{self.out}/results/batch={batch}")
        if again:
            files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("pathGlobFilter", self.glob).load(self.folder)
            write(files.join(F.broadcast(self.spark.createDataFrame([(p,) for p in again], "path string")), "path", "left_semi"), f"again-{number}")
        stream = self.spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", self.glob).load(self.folder)
        query = stream.writeStream.foreachBatch(lambda rows, n: write(rows, f"new-{n}")).option("checkpointLocation", f"{self.out}/_checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        mine = {r["status"]: r["count"] for r in (self.attempts().where(F.col("run") == number).groupBy("status").count().collect() if self._has_results() else [])}
        return {"converted": mine.get("converted", 0), "skipped": skipped, "failed": mine.get("failed", 0)}


def drop_index(spark: SparkSession, name: str) -> None:
    """Drop a table; ``name`` may have a database in front, parts are quoted."""
    spark.sql("DROP TABLE IF EXISTS " + ".".join("`" + part.replace("`", "``") + "`" for part in name.split(".")))
