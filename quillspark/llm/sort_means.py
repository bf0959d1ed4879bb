"""Centroid clustering by sort-means, exact in integers.

In each round every centroid has the others in the order of their distance from it. A vector starts at the centroid of the
round before and looks at the others in that centroid's order; one that is more than twice as far from it as the vector can't
be nearer, nor can those behind it, so the look ends there. A round is one pass over a table in the shared folder that holds vectors
as integers with their assignment; a task adds the sums of its vectors to the same table, so centroids come from a few small rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST = 1 << 27  # of an integer component: squared distances of 64 such components fit a long
EXACT = 1 << 22  # up to here products and sums of 64 components are exact in doubles


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid the others, nearest first, and their squared distances from it."""
    order = np.empty((len(centroids), len(centroids) - 1), dtype=np.int64)
    apart = np.empty_like(order)
    for a in range(len(centroids)):
        d = ((centroids - centroids[a]) ** 2).sum(axis=1)
        rest = np.argsort(d, kind="stable")
        order[a] = rest[rest != a]
        apart[a] = d[order[a]]
    return order, apart


def assign(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cluster, squared distance)`` of integer vectors: the nearest centroid, of equally near ones the first.

    Vectors of one previous centroid are worked on together, the furthest first: those that still look at the next
    centroid are then the first ones."""
    cluster, distance = previous.copy(), np.empty(len(x), dtype=np.int64)
    plain = x.dtype == np.float64  # exact in doubles, see EXACT
    square = lambda part, c: ((part - centroids[c]) ** 2).sum(axis=1).astype(np.int64)
    norm = (x * x).sum(axis=1) if plain else None
    for a in np.unique(previous):
        rows = np.flatnonzero(previous == a)
        own = square(x[rows], a)
        rows = rows[further := np.argsort(-own, kind="stable")]
        own = own[further]
        part, best, where = x[rows], own.copy(), np.full(len(rows), a, dtype=np.int64)
        for c, d in zip(order[a].tolist(), apart[a].tolist(), strict=True):
            n = int(np.searchsorted(-own, -(-(-d // 4)), side="right"))  # d <= 4 * own, in integers that don't overflow
            if not n:
                break
            if plain:
                to = (norm[rows[:n]] - 2 * (part[:n] @ centroids[c]) + centroids[c] @ centroids[c]).astype(np.int64)
            else:
                to = square(part[:n], c)
            better = (to < best[:n]) | ((to == best[:n]) & (c < where[:n]))
            best[:n][better], where[:n][better] = to[better], c
        cluster[rows], distance[rows] = where, best
    return cluster, distance


def _whole_sum(x: np.ndarray) -> int:
    """Sum of longs that may not fit one."""
    return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())


def _pass(rows: DataFrame, centroids: np.ndarray, scale: int | None) -> DataFrame:
    """``(id, v, cluster, distance, sums)``: rows (id, vector, previous cluster) assigned, and of each task a row for each
    cluster with ``sums``: number, inertia, and the sum of each component. ``scale``: vectors are doubles, not yet integers."""
    dims, k = centroids.shape[1], len(centroids)
    order, apart = neighbours(centroids)
    exact = int(np.abs(centroids).max(initial=0)) <= EXACT

    def run(batches):
        total = np.zeros((k, dims), dtype=np.int64)
        number, inertia = np.zeros(k, dtype=np.int64), [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            if scale:
                x = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)).astype(np.int64)
                previous = np.zeros(len(x), dtype=np.int64)
            else:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)
                previous = b.column(2).to_numpy().astype(np.int64)
            small = exact and int(np.abs(x).max()) <= EXACT
            cluster, distance = assign(x.astype(np.float64) if small else x, previous, centroids.astype(np.float64) if small else centroids, order, apart)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                total[c] += x[own].sum(axis=0)
                number[c] += int(own.sum())
                inertia[c] += _whole_sum(distance[own])
            v = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(len(v), sums)], names=names)
        some = np.flatnonzero(number).tolist()
        values = [[Decimal(s) for s in (int(number[c]), inertia[c], *total[c].tolist())] for c in some]
        none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(some, pa.int32()), none[2], pa.array(values, sums)], names=names)

    sums, names = pa.list_(pa.decimal128(38, 0)), ["id", "v", "cluster", "distance", "sums"]
    return rows.mapInArrow(run, "id long, v binary, cluster int, distance long, sums array<decimal(38,0)>")


def _sums(table: DataFrame, k: int, dims: int) -> list[list[int]]:
    """Number, inertia and component sums of each cluster: ``k * (dims + 2)`` numbers, whatever the table holds."""
    parts = table.where("sums is not null").select("cluster", F.posexplode("sums").alias("place", "s"))
    out = [[0] * (dims + 2) for _ in range(k)]
    for r in parts.groupBy("cluster", "place").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        out[r["cluster"]][r["place"]] = int(r["s"])
    return out


def usable(vector: Column, dims: int, scale: int) -> Column:
    """Whether a vector has ``dims`` components, all of them finite and at most :data:`MOST` as integers."""
    within = F.forall(vector, lambda x: F.coalesce(F.abs(x) <= (MOST - 1) / scale, F.lit(False)))
    return vector.isNotNull() & (F.size(vector) == dims) & within


def sort_means(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
) -> tuple[DataFrame, np.ndarray]:
    """``(id, v, cluster, distance, cluster_inertia, inertia)`` of each usable vector and the final centroids.

    A component ``x`` counts as the integer ``floor(scale * x)``; ``v`` holds them as little-endian 32-bit integers. Centroids
    start as the vectors with the smallest SHA-256 of ``seed:id``, then the smallest id and components; there are fewer
    than ``k`` if there are fewer vectors. ``distance`` is squared; of equally near centroids the first counts. Each round
    ends with centroids at ``floor(sum / count)`` of their vectors; those without any stay. Inertias that don't fit a long are null.
    Vectors that are null, have another length, or hold a component that is null, not finite or beyond 2**27 as an
    integer (distances would not fit a long) are left out. Rows with null ids (their id counts as empty text in the seed's
    hash) and with repeated ids are vectors like others; other columns are ignored; no rows give no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("x")).where(usable(F.col("x"), dims, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("h", key).orderBy("h", "id", "x").limit(k).collect()
    centroids = np.floor(scale * np.array([r["x"] for r in first], dtype=np.float64).reshape(len(first), dims)).astype(np.int64)
    if not len(centroids):  # nothing to do, in the form of a result
        empty = rows.limit(0).select("id", F.lit(b"").alias("v"), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")))
        return empty.withColumnRenamed("id", id_col), centroids
    with Scratch(df.sparkSession, "sort-means") as tmp:
        table = None
        for turn in range(rounds + 1):
            source = rows if table is None else table.where("sums is null").select("id", "v", "cluster")
            done = tmp(_pass(source, centroids, scale if table is None else None), f"round-{turn}", keep=turn == rounds)
            if table is not None:
                tmp.drop(table)
            table, sums = done, _sums(done, len(centroids), dims)
            if turn < rounds:
                for c, (n, _, *parts) in enumerate(sums):
                    if n:
                        centroids[c] = [p // n for p in parts]
    fits = lambda n: n if n < 1 << 63 else None
    whole = sum(s[1] for s in sums)
    inertias = df.sparkSession.createDataFrame([(c, fits(s[1]), fits(whole)) for c, s in enumerate(sums)], "cluster int, cluster_inertia long, inertia long")
    out = table.where("sums is null").select(F.col("id").alias(id_col), "v", "cluster", "distance")
    return out.join(F.broadcast(inertias), "cluster").select(id_col, "v", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digest(centroids: np.ndarray) -> list[str]:
    """SHA-256 in hex of each centroid's components, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
