"""A persistent approximate index of vectors: cells around centres, as Parquet partitioned by cell."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vectors import compare_cells, dealt, nearest, ranked, unit_vectors
from .versions import Versions

MOST_CELLS = 1 << 16
CELL_ROWS = 50_000  # rows of a cell that are compared in one task
FILE_ROWS = 200_000
OTHERS = -1  # the cell of vectors whose length isn't the index's


class CellIndex:
    """Vectors in the cell of their nearest centre; a query looks into the cells of the centres nearest to it.

    Centres are fitted by k-means under the cosine on at most ``sample`` rows, about the square root of the number of rows
    of them; every row with a direction is assigned and written. Vectors of another length than the most frequent one
    have a cell of their own, in which queries of other lengths look. As many cells are probed as a sample of rows needs to
    find ``recall`` of its nearest rows; :meth:`search` may be told otherwise, all cells give the exact result.
    A new build is written beside the one in force and switched in at its end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def exists(self) -> bool:
        return self.versions.current() is not None

    def _state(self) -> dict:
        state = self.versions.current()
        if state is None:
            raise FileNotFoundError(f"no index in {self.path}")
        return state

    def open(self, state: dict | None = None) -> DataFrame:
        """``(id, vector, ..., cell)`` of all rows."""
        state = state or self._state()
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(state["rows"])

    def centres(self, state: dict | None = None) -> DataFrame:
        """``(cell, centre, n)``: each cell's centre and number of rows."""
        return self.spark.read.parquet((state or self._state())["centres"])

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None, sample: int = 100_000, recall: float = 0.97, probe_k: int = 20, seed: int = 1) -> CellIndex:
        """Index ``vectors``; rows with a null id or without a direction are left out, as no search finds them."""
        before = self.versions.current()
        rows_at, centres_at = self.versions.new_folder("rows"), self.versions.new_folder("centres")
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *keep).where("id is not null and vector is not null")
        lengths = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").collect()
        dims, n = (lengths[0]["dims"], lengths[0]["n"]) if lengths else (1, 0)
        centres = self._fit(rows.where(F.size("vector") == dims), n, dims, min(cells or max(round(math.sqrt(n)), 1), MOST_CELLS, max(n, 1)), sample, seed)

        def assign(batches):
            for b in batches:
                cell, good = np.full(b.num_rows, OTHERS, dtype=np.int32), np.zeros(b.num_rows, dtype=bool)
                for length, (places, x) in unit_vectors(b.column(1)).items():
                    good[places] = True
                    step = max(1, (1 << 22) // len(centres))
                    for at in range(0, len(places) if length == dims else 0, step):
                        cell[places[at : at + step]] = (x[at : at + step] @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"]).filter(pa.array(good))

        schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())])
        placed = rows.mapInArrow(assign, schema)
        # by ranges of cell and id: a cell that holds a large share of the rows becomes several files
        placed = placed.repartitionByRange(max(1, -(-n // FILE_ROWS)), "cell", "id").sortWithinPartitions("cell", "id")
        placed.write.partitionBy("cell").parquet(rows_at)
        state = {"rows": rows_at, "centres": centres_at, "schema": schema.jsonValue(), "dims": dims, "cells": len(centres), "probes": len(centres)}
        sizes = self.open(state).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        known = self.spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())] + [(OTHERS, None)], "cell int, centre array<double>")
        known.join(sizes, "cell", "left").na.fill(0, ["n"]).coalesce(1).write.parquet(centres_at)
        if n:
            state["probes"] = self._probes(state, n, recall, probe_k, seed)
        self.versions.publish(state, before and before["number"])
        return self

    def _fit(self, rows: DataFrame, n: int, dims: int, cells: int, sample: int, seed: int) -> np.ndarray:
        """Unit centres; one that stands for all rows where there is nothing to fit."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if cells < 2:
            return np.eye(1, dims)
        good = F.forall("vector", lambda v: F.coalesce(F.abs(v) < 1e150, F.lit(False))) & F.exists("vector", lambda v: F.abs(v) > 1e-150)
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, -(-n // sample)))) == 0).where(good).limit(sample)
        some = some.select(array_to_vector("vector").alias("features")).cache()
        try:
            if not some.limit(1).count():
                return np.eye(1, dims)
            model = KMeans(k=cells, seed=seed, maxIter=8, distanceMeasure="cosine").fit(some)
        finally:
            some.unpersist()
        centres = np.array(model.clusterCenters(), dtype=np.float64)
        norms = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
        return (centres / norms)[norms[:, 0] > 0]

    def _probes(self, state: dict, n: int, recall: float, k: int, seed: int, sample: int = 200) -> int:
        """The least number of cells in which a sample of rows finds ``recall`` of its ``k`` nearest rows, the rows themselves not
        counted."""
        rows, cells = self.open(state), state["cells"]
        few = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(1, n // sample))) == 0).where(F.col("cell") != OTHERS).limit(sample)
        few = few.select(F.col("id").alias("query_id"), "vector")
        exact = nearest(few, self._few_tasks(rows), k + 1, "id", "vector").where("id <> query_id").join(rows.select("id", "cell"), "id")
        order = nearest(few, self.centres(state), cells, "cell", "centre").select("query_id", F.col("id").alias("cell"), F.col("rank").alias("place"))
        places = exact.join(order, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
        total, so_far = sum(r["count"] for r in places), 0
        for r in places:
            so_far += r["count"]
            if so_far >= recall * total:
                return r["place"]
        return cells

    def _few_tasks(self, rows: DataFrame) -> DataFrame:
        """All rows, in no more tasks than the machines need: a cell has a file of its own, and each task gives its best rows for every query."""
        return rows.coalesce(4 * self.spark.sparkContext.defaultParallelism)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, filters: tuple[str, str] | None = None) -> DataFrame:
        """``(query_id, id, score, rank)`` like :func:`nearest`, of the rows in the ``probes`` cells nearest to each query.

        Only the folders of cells that some query looks into are read; queries and rows meet by cell, large cells in parts. Where
        all cells are looked into, all rows are compared as :func:`nearest` does."""
        state = self._state()
        rows, centres = self.open(state), self.centres(state)
        ask = queries.select("query_id", "vector", (F.col(filters[0]) if filters else F.lit(None)).cast("string").alias("wanted")).where("query_id is not null and vector is not null")
        if (probes or state["probes"]) >= state["cells"]:  # no cell is left out: rows go to parts, not queries to each cell
            return nearest(ask, self._few_tasks(rows), k, "id", "vector", ("wanted", filters[1]) if filters else None)
        near = nearest(ask, centres.where("centre is not null"), min(probes or state["probes"], state["cells"]), "cell", "centre").select("query_id", F.col("id").alias("cell"))
        near = near.unionByName(ask.where(F.size("vector") != state["dims"]).select("query_id", F.lit(OTHERS).alias("cell")))
        parts = centres.select("cell", F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("int").alias("parts"))  # a row for each cell
        looked = [r["cell"] for r in near.select("cell").distinct().collect()]
        ask = ask.join(near, "query_id").join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        find = rows.where(F.col("cell").isin(looked)).select("id", "vector", "cell", (F.col(filters[1]) if filters else F.lit(None)).cast("string").alias("kind"))
        find = find.join(F.broadcast(parts), "cell").withColumn("part", dealt("id", F.col("parts")))
        return ranked(compare_cells(ask, find, k), k)
