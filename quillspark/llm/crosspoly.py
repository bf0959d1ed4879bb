"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A vector is rotated pseudo-randomly (three rounds of random signs and a Hadamard transform); its hash
is the signed axis nearest to it. Several such hashes make a table's bucket. A vector also visits the
buckets it nearly fell into. How many hashes and tables there are follows from the number of vectors.
Vectors that meet by chance are told by sketches of a few bytes, before any vector moves. The others are
compared exactly, in blocks, so that a crowded bucket is many tasks and no list of pairs leaves one: a
task gives the number of links of each vector and a spanning forest.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

BLOCK = 1024
FEW = 64  # up to so many vectors a bucket is sifted by sketches
BITS = 256  # of a sketch


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    return np.moveaxis(_hadamard_first(np.ascontiguousarray(np.moveaxis(x, -1, 0))), 0, -1)


def _hadamard_first(x: np.ndarray) -> np.ndarray:
    """The transform of the first axis, in place: each step adds and subtracts long contiguous rows."""
    n, h = len(x), 1
    while h < n:
        halves = x.reshape(n // (2 * h), 2, h, -1)
        upper, lower = halves[:, 0], halves[:, 1]
        gap = upper - lower
        upper += lower
        lower[...] = gap
        h *= 2
    return x


class CrossPolytope:
    """``tables`` tables of ``hashes`` cross-polytope hashes and ``probes`` buckets for each vector and table."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 1):
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.size = 1 << max(1, (dim - 1).bit_length())
        if hashes * self.size.bit_length() > 62:
            raise ValueError("a bucket's number must fit in 62 bits: use fewer hashes")
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.size)) / np.sqrt(self.size)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Buckets (n, tables, probes) of unit vectors; the first probe is the vector's own bucket."""
        n = len(unit)
        x = np.zeros((self.size, n))  # vectors are columns
        x[: self.dim] = unit.T
        out = np.empty((n, self.tables, self.probes), dtype=np.int64)
        # choices: for each hash the nearest and the second axis; a probe swaps some hashes for their second
        swaps = np.array(sorted(range(1 << self.hashes), key=lambda m: (bin(m).count("1"), m)))
        bits = (swaps[:, None] >> np.arange(self.hashes)) & 1
        for t in range(self.tables):
            code, loss = np.empty((n, self.hashes, 2), dtype=np.int64), np.empty((n, self.hashes))
            for k in range(self.hashes):
                y = x
                for r in range(3):
                    y = _hadamard_first(y * self.signs[t, k, r][:, None])
                y = np.ascontiguousarray(y.T)
                size = np.abs(y)
                top = np.argpartition(size, self.size - 2, axis=1)[:, -2:]
                near = np.take_along_axis(size, top, axis=1)
                top = np.where(near[:, :1] > near[:, 1:], top, top[:, ::-1])  # first, second axis
                for j in range(2):
                    code[:, k, j] = 2 * top[:, j] + (y[np.arange(n), top[:, j]] < 0)
                loss[:, k] = np.abs(near[:, 0] - near[:, 1])
            total = loss @ bits.T  # what each set of swaps gives up
            order = np.argsort(total, axis=1, kind="stable")[:, : self.probes]
            for p in range(self.probes):
                mask = bits[order[:, p]]
                key = np.zeros(n, dtype=np.int64)
                for k in range(self.hashes):
                    key = key * (2 * self.size) + code[np.arange(n), k, mask[:, k]]
                out[:, t, p] = key
        return out


@functools.lru_cache(maxsize=8)
def hasher(dim: int, tables: int, hashes: int, probes: int) -> CrossPolytope:
    return CrossPolytope(dim, tables, hashes, probes)


def design(dim: int, n: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """(tables, hashes, probes) for ``n`` vectors.

    As many hashes as let a bucket hold about one vector by chance, with probes half the ways to swap axes
    (16 at most); tables until a pair at exactly ``threshold`` meets in none with a chance of at most ``miss``.
    The chance to meet in one table is measured on random pairs with a fixed seed.
    """
    size = 1 << max(1, (dim - 1).bit_length())
    hashes, probes = 1, 1
    while n * probes > (2 * size) ** hashes and (hashes + 1) * size.bit_length() <= 62:
        hashes += 1
        probes = min(16, 1 << (hashes - 1))
    rng, pairs = np.random.default_rng([7, dim]), 1500
    a, b = rng.normal(size=(2, pairs, dim))
    a = _unit(a)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = _unit(b) if dim > 1 else 0 * b
    b = _unit(threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b)
    family = hasher(dim, 6, hashes, probes)
    x, y = family.buckets(a), family.buckets(b)
    met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=2).mean()
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(max(met, 0.01), 0.999)))), hashes, probes


@functools.lru_cache(maxsize=8)
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([9, dim]).normal(size=(dim, BITS)).astype(np.float32)


def sketches(unit: np.ndarray) -> np.ndarray:
    """On which side of ``BITS`` random planes unit vectors lie, as bytes."""
    return np.packbits(unit.astype(np.float32) @ _directions(unit.shape[1]) > 0, axis=1)


def most_bits(threshold: float) -> int:
    """Different bits of two sketches that a pair at ``threshold`` has but for six and a half standard deviations
    (a chance of about one in ten million)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(BITS * p + 6.5 * math.sqrt(BITS * p * (1 - p)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists, nulls as nan, and where each list begins and ends."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _vectors(df: DataFrame, id_col: str, vector_col: str, single: bool) -> DataFrame:
    """``(id, key, vector)``: the digest of a vector that can link, null for one that can't."""
    kind, item = ("array<float>", pa.float32()) if single else ("array<double>", pa.float64())

    def run(batches):
        import hashlib

        for b in batches:
            keys, vectors = [], []
            values, at = _flat(b.column(1))
            for i, known in enumerate(b.column(1).is_valid().to_pylist()):
                x = values[at[i] : at[i + 1]] if known else values[:0]
                ok = len(x) > 0 and np.isfinite(x).all() and (x != 0).any()
                keys.append(hashlib.md5((x + x.dtype.type(0)).tobytes()).hexdigest() if ok else None)
                vectors.append(x if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(vectors, pa.list_(item))], names=["id", "key", "vector"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v_"))
    return rows.mapInArrow(run, f"id long, key string, vector {kind}")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # huge and tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _met_before(codes: np.ndarray, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the vectors ``a`` and ``b`` meet in a table before ``table``."""
    out, open_ = np.zeros(len(a), dtype=bool), np.arange(len(a))
    for t in range(table):
        p, q = a[open_], b[open_]
        met = (codes[p, t] == codes[q, t, 0][:, None]).any(axis=1) | (codes[q, t] == codes[p, t, 0][:, None]).any(axis=1)
        out[open_[met]] = True
        open_ = open_[~met]
        if not len(open_):
            break
    return out


def _groups(batches, keys: int, lists: tuple[int, ...]):
    """Rows that come sorted by their first ``keys`` columns, cut at the places where these change: the key and the
    other columns' arrays, ``lists`` naming those of equally long lists. What is held is one group."""
    key, held = None, []
    join = lambda: held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]
    for b in batches:
        if not b.num_rows:
            continue
        head = np.stack([b.column(k).to_numpy() for k in range(keys)], axis=1)
        rest = [_flat(b.column(k)) if k in lists else b.column(k).to_numpy() for k in range(keys, b.num_columns)]
        cuts = [0, *(np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1).tolist(), len(head)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(head[begin].tolist())
            if own != key:
                if held:
                    yield key, join()
                key, held = own, []
            held.append([x[0][x[1][begin] : x[1][end]].reshape(end - begin, -1) if isinstance(x, tuple) else x[begin:end] for x in rest])
    if held:
        yield key, join()


def _sift(batches, limit: int):
    """Of rows ``(slot, gid, tag, sketch)`` sorted by slot, those with another one of their slot near them by its
    sketch, one of the two being at home there. A slot has ``FEW`` rows at most."""
    rest: list[np.ndarray] = []
    names = ["slot", "gid", "tag"]

    def near(slot, gid, tag, sketch):
        words, ok = sketch.view(np.uint64), np.zeros(len(slot), dtype=bool)
        left = np.arange(len(slot) - 1)
        gap = 1
        while len(left := left[left + gap < len(slot)]) and len(left := left[slot[left] == slot[left + gap]]):
            other = left + gap
            close = (np.bitwise_count(words[left] ^ words[other]).sum(axis=1) <= limit) & ((tag[left] | tag[other]) & 1 == 1)
            ok[left[close]] = ok[other[close]] = True
            gap += 1
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (slot, gid, tag)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(k).to_numpy() for k in range(3)] + [np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)]
        if rest:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        whole = np.searchsorted(own[0], own[0][-1])  # the last slot may go on in the next batch
        rest = [x[whole:] for x in own]
        yield near(*(x[:whole] for x in own))
    if rest:
        yield near(*rest)


def _compare(key: tuple, rows: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links between two blocks of a bucket: ids, the rows each links with, and a forest."""
    _, low, high = key
    ids, block, tag, weight, probes, vectors, codes = rows
    unit = _unit(vectors)
    links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        i, j = np.nonzero(unit[part] @ unit[right].T >= threshold)
        a, b = part[i], right[j]
        keep = a < b if low == high else np.ones(len(a), dtype=bool)
        near.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep]))
    if not any(len(a) for a, _ in near):
        return None
    table, here = int(tag[0]) >> 1, (tag & 1).astype(bool)
    codes = codes.reshape(len(ids), -1, int(probes[0]))
    main = codes[:, :, 0]
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in near:
        for k in range(0, len(a), 100_000):
            p, q = a[k : k + 100_000], b[k : k + 100_000]
            # counted once: in the first table where they meet, in the bucket of the smaller id if the other visits it
            visits = (codes[q, table] == main[p, table][:, None]).any(axis=1)
            ok = np.where(visits, here[p], here[q] & ~here[p])
            p, q = p[ok], q[ok]
            ok = ~_met_before(codes, table, p, q)
            p, q = p[ok], q[ok]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            edges.append((p, q))
    while True:  # smallest label over the links, until nothing changes
        old = label.copy()
        for p, q in edges:
            m = np.minimum(label[p], label[q])
            np.minimum.at(label, p, m)
            np.minimum.at(label, q, m)
        label = label[label]
        if (label == old).all():
            break
    some = links > 0
    return ids[some], links[some], ids[label[some]]


def near_duplicate_vectors(
    df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-6, shape: tuple[int, int, int] | None = None,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``: links are pairs with a cosine of at least ``threshold``.

    ``shape`` is (tables, hashes, probes); without it :func:`design` chooses it from the number of vectors so that
    a pair at exactly ``threshold`` is missed with a chance of at most ``miss``, nearer pairs less often. A vector is
    hashed once; its codes go with it, so that a pair that meets in several tables is counted in one. Equal
    vectors are compared once and counted as often as they occur. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, vectors of different lengths don't link. A null
    id is no vertex: such rows get 0 links and a null component. Rows that repeat an id are vectors of their
    own, equal or not; they share what the id names. Other columns are ignored; no rows give no rows.
    """
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    limit = most_bits(threshold)
    with Scratch(df.sparkSession, "near-vectors") as tmp:
        vectors = tmp(_vectors(df, id_col, vector_col, single), "vectors", keep=True)
        groups = vectors.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
        groups = tmp(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
        sizes = {r[0]: r[1] for r in groups.groupBy(F.size("vector")).count().collect()}
        n = sum(sizes.values())
        shapes = {dim: shape or design(dim, n, threshold, miss) for dim in sizes}

        def hash_rows(batches):
            for b in batches:
                codes, small, probes = [None] * b.num_rows, [None] * b.num_rows, np.zeros(b.num_rows, dtype=np.int32)
                values, at = _flat(b.column(2))
                dims = np.diff(at)
                for dim in np.unique(dims).tolist():
                    family, some = hasher(dim, *shapes[dim]), np.flatnonzero(dims == dim)
                    probes[some] = family.probes
                    step = max(1, (1 << 17) // family.size)
                    for k in range(0, len(some), step):
                        part = some[k : k + step]
                        unit = _unit(values[at[part][:, None] + np.arange(dim)])
                        found, own = family.buckets(unit).reshape(len(part), -1), sketches(unit)
                        for i, c, x in zip(part, found, own, strict=True):
                            codes[i], small[i] = c, x.tobytes()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probes), pa.array(codes, pa.list_(pa.int64())), pa.array(small, pa.binary())], names=[*b.schema.names, "probes", "codes", "sketch"])

        # dealt out anew, as few small files would be few tasks
        hashed = groups.select("gid", "weight", "vector").repartition("gid").mapInArrow(hash_rows, f"gid long, weight long, vector {kind}, probes int, codes array<long>, sketch binary")
        hashed = tmp(hashed, "hashed")
        # a slot is a bucket of a table; the tag tells the table and whether the vector is at home in the bucket
        visits = hashed.select("gid", F.size("vector").alias("dim"), "probes", F.posexplode("codes").alias("place", "bucket"))
        tag = F.expr("cast(place div probes * 2 + if(place % probes = 0, 1, 0) as int)")
        visits = visits.select(F.xxhash64("dim", F.expr("place div probes"), "bucket").alias("slot"), "gid", tag.alias("tag"))
        crowded = visits.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("tag") % 2).alias("home")).where("n > 1 and home = 1").select("slot", "n")
        met = tmp(visits.join(crowded, "slot"), "met")
        few = met.where(F.col("n") <= FEW).select("slot", "gid", "tag").join(hashed.select("gid", "sketch"), "gid").select("slot", "gid", "tag", "sketch")
        few = few.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda batches: _sift(batches, limit), "slot long, gid long, tag int")
        few = few.withColumns({"block": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        many = met.where(F.col("n") > FEW).withColumn("block", F.pmod(F.xxhash64("gid", "tag"), blocks).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("slot", "gid", "tag", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        tasks = few.unionByName(many)
        # codes are compared for equality only: 31 bits of them do, with a chance of error far below ``miss``
        short = F.transform("codes", lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        rows = tasks.join(hashed.select("gid", "weight", "probes", "vector", short.alias("codes")), "gid")
        rows = rows.select("slot", "low", "high", "gid", "block", "tag", "weight", "probes", "vector", "codes")

        def compare(batches):
            def batch(parts):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["gid", "links", "other"])

            ready, n = [], 0
            for of, arrays in _groups(batches, 3, (8, 9)):
                if part := _compare(of, arrays, threshold):
                    ready.append(part)
                    n += len(part[0])
                if n >= 10_000:
                    yield batch(ready)
                    ready, n = [], 0
            if ready:
                yield batch(ready)

        # a task reads its comparisons as one sorted stream: a Python call for each would cost more than most of them
        found = rows.repartition("slot", "low", "high").sortWithinPartitions("slot", "low", "high", "gid").mapInArrow(compare, "gid long, links long, other long")
        found = tmp(found, "found")
        links = found.groupBy("gid").agg(F.sum("links").alias("links"))
        parts = connected_components(found.select(F.col("gid").alias("a"), F.col("other").alias("b")), tmp).withColumnRenamed("id", "gid")
        of_group = groups.select("key", "gid", "first", "weight").join(links, "gid", "left").join(parts, "gid", "left")
        of_group = of_group.select("key", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "gid").alias("part"))
        best = of_group.groupBy("part").agg(F.min("first").alias("component_id"))
        of_key = tmp(of_group.join(best, "part").select("key", "n_links", "component_id"), "components", keep=True)
    # rows of one vector may be a third of all: both sides are plain shuffles, so Spark splits a skewed one
    joined = vectors.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(of_key, "key", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
