"""Nearest neighbours of tables of query vectors, exactly, by matrix products.

A vector that is null, all zero, or holds a component that is null or not finite has no direction: it is found by no query and
finds nothing. Vectors are compared with queries of their own length only. Ids may be of any type and keep it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_QUERIES = 10_000
QUERY_BLOCK = 256
CELL_QUERIES = 50_000  # queries that a task compares at a time in the blocked join
PART_BYTES = 1 << 26  # of vectors that a task holds there
MOST_WAITING = 1 << 20  # hits of a task that aren't ranked yet
NONE, SLACK = -2.0, 1e-10  # less than any cosine; more than what rounding scores can change

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # query row, score, id


def ranked(hits: DataFrame, k: int | None = None, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """Adds ``rank`` from 1 (best score first, ties by id) and keeps the first ``k``."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return out.where(F.col("rank") <= k) if k else out


def unit_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a column of lists, by their length: the places of those with a direction, and these at length 1."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begins = np.cumsum(lengths) - lengths
    out = {}
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        x = flat.reshape(-1, dims) if len(rows) == len(lengths) else flat[begins[rows][:, None] + np.arange(dims)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        if good.any():
            x = x[good] / top[good, None]  # so that squares neither vanish nor overflow
            out[dims] = rows[good], x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def best_hits(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> Hits:
    """Of hits the first ``k`` of each query row, best score first, ties by id."""
    place = np.unique(ids, return_inverse=True)[1] if len(ids) else ids
    order = np.lexsort((place, -scores, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], scores[order][keep], ids[order][keep]


def _read(ids: pa.Array, vectors: pa.Array, kinds: pa.Array | None) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """What :meth:`_Queries.compare` takes."""
    kind = np.array(kinds.to_pylist(), dtype=object) if kinds is not None else None
    return ids.to_numpy(zero_copy_only=False), kind, unit_vectors(vectors)


class _Queries:
    """The queries that a task holds, and the best ``k`` of what it has seen for each."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, wanted: pa.Array | None, k: int):
        self.ids, self.k, self.units = ids, k, unit_vectors(vectors)
        values = wanted.to_pylist() if wanted is not None else [None] * len(ids)
        self.codes = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
        self.wanted = np.array([self.codes.get(v, -1) for v in values], dtype=np.int64)
        self.held: Hits | None = None
        self.waiting: list[Hits] = []  # found since ``held`` was made
        self.n = 0  # of those
        self.least = np.full(len(ids), NONE)  # cosines below it are not among a query's first ``k``

    def see(self, ids: pa.Array, vectors: pa.Array, kinds: pa.Array | None) -> None:
        self.compare(*_read(ids, vectors, kinds))

    def compare(self, own: np.ndarray, kind: np.ndarray | None, units: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        codes = np.array([self.codes.get(v, -1) for v in kind], dtype=np.int64) if kind is not None and self.codes else None
        for dims, (places, x) in units.items():
            rows, q = self.units.get(dims, ((), ()))
            for at in range(0, len(rows), QUERY_BLOCK):
                asking = rows[at : at + QUERY_BLOCK]
                cosines = q[at : at + QUERY_BLOCK] @ x.T
                if codes is not None:
                    wanted = self.wanted[asking]
                    for code in np.unique(wanted[wanted >= 0]).tolist():
                        cosines[np.ix_(wanted == code, codes[places] != code)] = -np.inf
                least = self.least[asking]
                new = np.flatnonzero(least == NONE)
                if len(new) and len(places) > self.k:  # the k-th best of these vectors
                    least[new] = np.maximum(NONE, np.partition(cosines[new], len(places) - self.k, axis=1)[:, len(places) - self.k] - SLACK)
                i, j = np.nonzero(cosines >= least[:, None])
                if len(i):
                    self.waiting.append((asking[i], np.round(1 / (2 - cosines[i, j]), 12), own[places[j]]))  # rounded, so that equal vectors tie
                    self.n += len(i)
                if self.n > MOST_WAITING:
                    self._rank()
        if self.held is None or self.n > max(MOST_WAITING // 8, 2 * len(self.held[0])):
            self._rank()

    def _rank(self) -> None:
        """Keep the best ``k`` of each query."""
        parts = [*([self.held] if self.held else []), *self.waiting]
        self.waiting, self.n = [], 0
        if not parts:
            return
        rows, scores, _ = self.held = best_hits(*(np.concatenate(p) for p in zip(*parts, strict=True)), self.k)
        last = np.flatnonzero(rows[self.k - 1 :] == rows[: max(0, len(rows) - self.k + 1)]) + self.k - 1  # the k-th hits
        self.least[rows[last]] = 2 - 1 / (scores[last] - SLACK)

    def hits(self, types: list[pa.DataType]) -> pa.RecordBatch:
        self._rank()
        rows, scores, ids = self.held or (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object))
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(rows)), pa.array(ids, types[1]), pa.array(scores)], names=["query_id", "id", "score"])


def _types(queries: DataFrame, vectors: DataFrame) -> tuple[T.StructType, list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    return T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())]), [to_arrow_type(x) for x in kinds]


def compare_cells(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``: the best ``k`` of each query in each cell that it shares with vectors.

    ``queries``: (cell, part, query_id, vector, wanted), ``vectors``: (cell, part, id, vector, kind). Both are dealt out by (cell, part);
    a task holds one cell's queries and streams its vectors past them, so a cell may hold many vectors."""
    schema, types = _types(queries, vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for b in batches:
            cell = np.stack([b.column(i).to_numpy() for i in range(2)], axis=1)
            side = b.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if begin == end:
                    continue
                if (key := (*cell[begin].tolist(),)) != now:
                    if held:
                        yield held.hits(types)
                    now, waiting, held = key, [], None
                part = b.slice(begin, end - begin)
                if not side[begin]:  # queries are sorted in front of the vectors
                    waiting.append(part)
                    continue
                if waiting:
                    t = pa.Table.from_batches(waiting).combine_chunks()
                    held, waiting = _Queries(*(t.column(i).chunk(0) for i in (3, 5, 6)), k), []
                if held:
                    held.see(part.column(4), part.column(5), part.column(6))
        if held:
            yield held.hits(types)

    none = lambda name: F.lit(None).cast(schema[name].dataType).alias(name)
    rows = queries.select(F.col("cell").cast("int"), F.col("part").cast("int"), F.lit(False).alias("side"), "query_id", none("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("wanted").cast("string").alias("kind"))
    rows = rows.unionAll(vectors.select(F.col("cell").cast("int"), F.col("part").cast("int"), F.lit(True).alias("side"), none("query_id"), "id", F.col("vector").cast("array<double>").alias("vector"), F.col("kind").cast("string").alias("kind")))
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "side").mapInArrow(run, schema)


def compare_parts(queries: DataFrame, vectors: DataFrame, k: int, at_once: int) -> DataFrame:
    """``(query_id, id, score)``: the best ``k`` of each query in each part of the vectors.

    ``queries``: (query_id, part, vector, wanted), ``vectors``: (part, id, vector, kind). A task holds a part's vectors and streams
    the queries past them, ``at_once`` at a time, so there may be many queries."""
    schema, types = _types(queries, vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            part, side = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if begin == end:
                    continue
                if part[begin] != now:
                    now, held = part[begin], []
                if not side[begin]:  # vectors are sorted in front of the queries
                    rows = b.slice(begin, end - begin)
                    held.append(_read(rows.column(3), rows.column(4), rows.column(5)))
                    continue
                for at in range(begin, end, at_once):
                    rows = b.slice(at, min(at_once, end - at))
                    asked = _Queries(rows.column(2), rows.column(4), rows.column(5), k)
                    for few in held:
                        asked.compare(*few)
                    yield asked.hits(types)

    none = lambda name: F.lit(None).cast(schema[name].dataType).alias(name)
    single = {vectors.schema["vector"].dataType, queries.schema["vector"].dataType} == {T.ArrayType(T.FloatType())}
    vector = (F.col("vector") if single else F.col("vector").cast("array<double>")).alias("vector")
    rows = vectors.select(F.col("part").cast("int"), F.lit(False).alias("side"), none("query_id"), "id", vector, F.col("kind").cast("string").alias("kind"))
    rows = rows.unionAll(queries.select(F.col("part").cast("int"), F.lit(True).alias("side"), "query_id", none("id"), vector, F.col("wanted").cast("string").alias("kind")))
    return rows.repartition("part").sortWithinPartitions("part", "side").mapInArrow(run, schema)


def dealt(name: str, parts: int | Column) -> Column:
    """A row's part by its id and vector: equal ids with different vectors are spread."""
    return F.pmod(F.xxhash64(name, "vector"), F.lit(parts) if isinstance(parts, int) else parts)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", filters: tuple[str, str] | None = None, most_queries: int = MOST_QUERIES, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` best by ``1 / (1 + cosine distance)``, ties by id.

    ``queries``: (query_id, vector). ``filters = (query column, vector column)`` restricts to rows with equal values; a
    null in the query column restricts nothing. Rows with a null id are passed over.

    Up to ``most_queries`` queries are sent to the tasks that read the vectors: each Arrow batch is multiplied with blocks
    of queries, and a task gives its best ``k`` for each query only, so nothing else is shuffled. With more, the vectors are
    dealt out in parts that a task holds, as few as the machines allow, and every part gets the queries, at most ``cell_queries``
    of which are compared at a time: vectors move once, queries once for each part, and none of either pass the driver.
    The vectors are counted first, so those that are dear to make should be written before."""
    ask = queries.select("query_id", "vector", (F.col(filters[0]).cast("string") if filters else F.lit(None).cast("string")).alias("wanted")).where("query_id is not null and vector is not null")
    find = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), (F.col(filters[1]).cast("string") if filters else F.lit(None).cast("string")).alias("kind"))
    find = find.where("id is not null and vector is not null")
    few = ask.withColumn("vector", F.col("vector").cast("array<double>")).limit(most_queries + 1).toArrow().combine_chunks()
    if few.num_rows > most_queries:
        n = find.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dims")).first()
        parts = max(ask.sparkSession.sparkContext.defaultParallelism, -(-n["rows"] * (n["dims"] or 1) * 8 // PART_BYTES))
        parts = max(1, min(parts, n["rows"]))
        ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return ranked(compare_parts(ask, find.withColumn("part", dealt("id", parts)), k, cell_queries), k)
    find = find.withColumn("vector", F.col("vector").cast("array<double>"))
    schema, types = _types(ask, find)
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in few.columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Queries(arrays[0], arrays[1], arrays[2] if filters else None, k)
        for b in batches:
            if b.num_rows and len(arrays[0]):
                held.see(b.column(0), b.column(1), b.column(2) if filters else None)
        yield held.hits(types)

    return ranked(find.select("id", "vector", *(["kind"] if filters else [])).mapInArrow(run, schema), k)


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", bucket: float = 0.5, tables: int = 8, least_cosine: float = 0.0, seed: int = 1, dims: int | None = None) -> DataFrame:
    """``(query_id, id, score, rank)`` like :func:`nearest`, for tables of queries as large as those of vectors: only
    pairs that share a bucket of random projections of the unit vectors, and have a cosine of at least
    ``least_cosine``, are compared. Every row is indexed; there is nothing to fit but the random directions.
    Narrower buckets compare less and find less: measure the recall against :func:`nearest`. Only vectors of ``dims``
    components (the most frequent length of the queries) take part; those without a direction find nothing."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    if dims is None:
        counts = queries.where("size(vector) > 0").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = counts["n"] if counts else 1

    def unit(df: DataFrame, key: str, column: str) -> DataFrame:
        x = F.col(column).cast("array<double>")
        top = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
        good = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (top(x) > 0)
        once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  not again for each component
        over = lambda x, by: once(by, lambda b: F.transform(x, lambda v: v / b))
        # filters may run behind the functions of the library: those get a vector that they can read in any case
        rows = df.select(F.col(key).alias("key"), F.coalesce(good, F.lit(False)).alias("good"), F.when(good, over(x, top(x))).otherwise(F.array_repeat(F.lit(1.0), dims)).alias("x"))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        return rows.where("good and key is not null").select("key", array_to_vector(over("x", norm)).alias("unit"))

    index = unit(vectors, id_col, vector_col)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    # nothing is learned from the rows but their length, so a table without usable rows works too
    model = model.fit(index.sparkSession.createDataFrame([([1.0] * dims,)], "x array<double>").select(array_to_vector("x").alias("unit")))
    # of unit vectors the squared distance is twice the cosine distance
    near = model.approxSimilarityJoin(unit(queries, "query_id", "vector"), index, float(np.sqrt(2 * (1 - least_cosine))) + 1e-9, "d")
    return ranked(near.select(F.col("datasetA.key").alias("query_id"), F.col("datasetB.key").alias("id"), (1 / (1 + F.col("d") * F.col("d") / 2)).alias("score")), k)
