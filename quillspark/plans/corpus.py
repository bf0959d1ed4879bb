"""A folder of texts as a corpus: built, kept up to date, reported on, asked and logged."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overview as O  # noqa: N812
from ..operators import reports as P
from ..operators import retrieval as V
from ..operators.embedding import embed
from ..sources.cells import CellIndex
from ..sources.files import append_logs, read_logs, read_texts
from ..sources.index import ChunkIndex
from ..sources.postings import TermIndex
from .search import SearchEngine, build_chunks, build_report

Provider = Callable[[list[str]], np.ndarray]


class Corpus:
    """What a folder of text files becomes in the folder ``path``: ``chunks`` with their vectors, ``terms`` (postings of the chunks) and, with
    ``approximate=True``, ``cells`` (vectors by centre), ``report`` and ``logs``.

    ``provider`` embeds texts, ``generate`` writes overviews; ``options`` go to :func:`build_chunks`. :meth:`build` may be called again
    at any time: only new and changed chunks are embedded, and every part is switched in when it is complete."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider, generate: Callable[[DataFrame], DataFrame] = O.extracts, mode: str = "hybrid", approximate: bool = False, **options: Any):
        self.spark, self.path, self.provider, self.generate, self.mode, self.options = spark, path.rstrip("/"), provider, generate, mode, options
        self.chunks, self.terms = ChunkIndex(spark, f"{self.path}/chunks"), TermIndex(spark, f"{self.path}/terms")
        self.cells = CellIndex(spark, f"{self.path}/cells") if approximate else None

    def build(self, folder: str | None = None, files: DataFrame | None = None, **embedding: Any) -> dict[str, int]:
        """Make the corpus that of the text files in ``folder``, or of a table (stem, content). ``embedding`` goes to :func:`embed`.
        Returns how many chunks were embedded, failed, kept and removed."""
        files = read_texts(self.spark, folder).select("stem", "content") if files is None else files
        counts = self.chunks.update(build_chunks(files, **self.options), self.provider, unique=True, **embedding)
        rows = self.chunks.open()
        if counts["embedded"] or counts["removed"] or not self.terms.exists():
            self.terms.build(rows, "id", "content", "doc_code")
            if self.cells:
                self.cells.build(rows, "id", "embedding", keep=("doc_code",))
        build_report(files, **self.options).write.mode("overwrite").parquet(f"{self.path}/report")
        return counts

    def report(self) -> DataFrame:
        """Files with their articles and chunks, and the totals."""
        return self.spark.read.parquet(f"{self.path}/report")

    def engine(self, threshold: float | None = None) -> SearchEngine:
        """The search engine over the indexes in force."""
        rows = self.chunks.open()
        ask = lambda queries: embed(queries, "query", self.provider, "vector")
        return SearchEngine(rows, rows.select("id", "doc_code", "embedding"), ask, self.mode, threshold, cells=self.cells, postings=self.terms)

    def article(self, asks: DataFrame) -> DataFrame:
        """Chunks of asked articles (query_id, article_num, doc_hint)."""
        return V.lookup(asks, self.chunks.open())

    def search(self, queries: DataFrame, max_results: int | None = None, threshold: float | None = None, log: str | None = None) -> DataFrame:
        """Hits of queries (query_id, query) with the chunks' text and citation. ``log`` names a batch under which the queries are logged."""
        if log:
            rows = queries.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), F.lit("search").alias("module"), F.lit("query").alias("level"), F.col("query").alias("message"), F.lit(None).cast("string").alias("data"))
            append_logs(rows, f"{self.path}/logs", log)
        hits = self.engine(threshold).search(queries, max_results)
        return hits.join(self.chunks.open().select("id", "content", "document", "citation", "article", "page"), "id")

    def ask(self, queries: DataFrame, max_results: int | None = None, threshold: float | None = None) -> DataFrame:
        """``(query_id, overview, citations, confidence, articles_analyzed)`` of the queries that get an overview."""
        engine = self.engine(threshold)
        return engine.overview(queries, engine.search(queries, max_results), generate=self.generate)

    def logged(self) -> DataFrame:
        """The logged queries."""
        return read_logs(self.spark, f"{self.path}/logs/queries")

    def frequent(self, n: int = 10) -> DataFrame:
        """The most frequent logged queries."""
        return P.frequent_queries(self.logged(), "message", "timestamp", n)
