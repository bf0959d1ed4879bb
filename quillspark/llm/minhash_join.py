"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's set of shingles is represented by its minwise tokens at ``POSITIONS`` positions. A tree
branches documents: a node chooses one or two of the positions (1 / similarity on average), and a document
goes on to a child for each, named by its token there. A pair with Jaccard similarity ``s`` agrees in a
token with probability ``s``, so as many common children as nodes are left on average, and the chance to
meet falls slowly with depth. Nodes branch while they are large; small nodes are compared exhaustively;
independent trees are repeated until the wanted recall is reached. Candidates are sifted by the sizes of
their sets and by the share of equal tokens; every link is confirmed on the full sets of shingles.

Equal sets are one document here. Members of a node are first compared with two pivots of it. Nodes whose
members are all connected by then are settled, such as crowds of near copies. In the others only members of
different parts are compared: in small nodes all pairs, in large ones the loose members with all, in
blocks that give links and no pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

POSITIONS = 128
LEAF = 32  # members of a small node
BELOW = 3  # levels by which large nodes branch further; what is large then is taken for a crowd
BLOCK = 256  # documents of a block
FEW = 200_000  # up to so many sets to fetch, their ids are sent to all executors
BLOCK_SHINGLES = 1 << 19
CACHED = 1 << 14  # hashes worked on at a time

_SALT = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.random.default_rng(12).integers(1, 1 << 63, (POSITIONS, 1), dtype=np.uint64)
_SCALE = np.random.default_rng(13).integers(1, 1 << 63, (POSITIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, at least ``n`` of each."""
    return _powers_up_to(max(1 << 16, 1 << (n - 1).bit_length()))


@functools.lru_cache(maxsize=4)
def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are what stands between blanks (\\x20, \\x09 to \\x0D), with A-Z lowered. A text with fewer words
    than ``width`` has one shingle, its words; one without words has none.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_SALT[data] * powers[: len(data)])])
    words = _mix((total[end] - total[begin]) * inverses[begin] + (end - begin).astype(np.uint64) * _ODD)
    k = min(width, len(words))
    joined = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        joined = joined * _ODD + words[j : len(words) - k + 1 + j]
    return np.unique(_mix(joined))


def minwise(s: np.ndarray) -> np.ndarray:
    """The tokens of a set at all positions: the smallest value under each position's hash.

    Positions are worked on together, as many as fit a cache; a long set takes one at a time, so memory
    stays a few times the set's.
    """
    out = np.empty(POSITIONS, dtype=np.uint64)
    step = max(1, min(POSITIONS, CACHED // len(s)))
    h = np.empty((step, len(s)), dtype=np.uint64)
    for begin in range(0, POSITIONS, step):
        part = h[: min(step, POSITIONS - begin)]
        np.bitwise_xor(s, _SHIFT[begin : begin + step], out=part)
        np.multiply(part, _SCALE[begin : begin + step], out=part)
        part.min(axis=1, out=out[begin : begin + step])
    return out


def paths(tokens: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, node, deep node) for tokens (documents, POSITIONS): the nodes at level ``depth`` of all trees, and
    where each leads ``BELOW`` levels further down, at which nodes choose one position."""
    doc = np.repeat(np.arange(len(tokens)), trees)
    node = np.tile(_mix(np.arange(1, trees + 1, dtype=np.uint64) * _ODD), len(tokens))
    for level in range(depth):
        choice = _mix(node + np.uint64(level))
        one = ((choice >> np.uint64(8)) % np.uint64(POSITIONS)).astype(np.int64)
        two = ((choice >> np.uint64(24)) % np.uint64(POSITIONS)).astype(np.int64)
        # a quarter of the nodes have a second position
        both = np.flatnonzero((choice & np.uint64(3) == 0) & (one != two))
        first = _mix(node * _ODD ^ tokens[doc, one])
        second = _mix(node[both] * _ODD ^ tokens[doc[both], two[both]] ^ np.uint64(1))
        doc, node = np.concatenate([doc, doc[both]]), np.concatenate([first, second])
    deep = node
    for level in range(depth, depth + BELOW):
        one = ((_mix(deep + np.uint64(level)) >> np.uint64(8)) % np.uint64(POSITIONS)).astype(np.int64)
        deep = _mix(deep * _ODD ^ tokens[doc, one])
    return doc, node, deep


def missed(similarity: float, depth: int) -> float:
    """Chance that a pair with this similarity has no common node at a level of a tree."""
    q = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * q
        q = 0.75 * x + 0.25 * x * x
    return q


def least_agreement(percent: int) -> int:
    """Equal tokens of two sketches that a pair with the wanted similarity has but for six standard deviations
    (a chance below one in a million)."""
    p = percent / 100 + (1 - percent / 100) / 256
    return math.floor(POSITIONS * p - 6 * math.sqrt(POSITIONS * p * (1 - p)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * |a & b| >= percent * |a | b|`` for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    x = _mix(s * np.uint64(0xD1342543DE82EF95))
    y = _mix(s ^ np.uint64(0xA0761D6478BD642F))
    as_long = lambda v: int(np.array([v.sum(dtype=np.uint64)]).view(np.int64)[0])
    return as_long(x), as_long(y)


def sign(df: DataFrame, id_col: str, text_col: str, width: int, trees: int, depth: int) -> DataFrame:
    """``(id, n, k1, k2, sketch, nodes, deeps)``: the set's size and key, a byte of its token at each position, its
    nodes at level ``depth`` and the deep node below each; nulls for an empty set."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = [shingles(t, width) if t else () for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, sketches, nodes, deeps = [(None, None)] * len(sets), *([None] * len(sets) for _ in range(3))
            n = list(map(len, sets))
            if some:
                tokens = np.empty((len(some), POSITIONS), dtype=np.uint64)
                for k, i in enumerate(some):
                    keys[i], tokens[k] = _set_key(sets[i]), minwise(sets[i])
                    sets[i] = None
                small = _mix(tokens).astype(np.uint8)
                for at in range(0, len(some), 1000):
                    doc, node, deep = paths(tokens[at : at + 1000], trees, depth)
                    order = np.argsort(doc, kind="stable")
                    ends = np.cumsum(np.bincount(doc, minlength=len(tokens[at : at + 1000])))[:-1]
                    for k, own in enumerate(zip(*(np.split(x[order].view(np.int64), ends) for x in (node, deep)), strict=True)):
                        i = some[at + k]
                        sketches[i], (nodes[i], deeps[i]) = small[at + k].tobytes(), own
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)), pa.array(sketches, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (nodes, deeps))], names=["id", "n", "k1", "k2", "sketch", "nodes", "deeps"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t_"))
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, sketch binary, nodes array<long>, deeps array<long>")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _promising(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, block)`` whose sketches agree in enough places."""
    least = least_agreement(percent)
    of = lambda side: groups.select(F.col("gid").alias(side), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "block", "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS) for k in (3, 4))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)], names=["a", "b", "block"]).filter(ok)

    return both.mapInArrow(run, "a long, b long, block long")


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar. ``sets``: (gid, set).

    The partners of a document ``a`` come in blocks; its set goes to each block once and a partner's set once,
    and a task holds two sets at a time."""
    own = pairs.select("a", "block", F.lit(None).cast("long").alias("b"), F.col("a").alias("gid")).distinct()
    rows = own.union(pairs.select("a", "block", "b", F.col("b").alias("gid"))).join(sets, "gid").select("a", "block", "b", "set")

    def run(batches):
        own = None
        for batch in batches:
            out = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:  # sorted in front of its partners
                    own = _array(data.as_py())
                elif similar(own, _array(data.as_py()), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def _block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the loose members of a block with its other members of another component, one for each
    loose member and component."""
    loose = pdf[pdf["loose"]].drop_duplicates("gid")
    others = pdf[~pdf["loose"]].drop_duplicates("gid")
    out: list[tuple[int, int]] = []
    if len(loose) and len(others):
        sets = [_array(x) for x in loose["set"]]
        universe = np.unique(np.concatenate(sets))
        sizes, parts, ids = np.array([len(s) for s in sets]), loose["part"].to_numpy(), loose["gid"].to_numpy()
        # which loose members hold a shingle: places by shingle, so that memory is that of the sets
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        owner = owner[order]
        begin = np.searchsorted(np.concatenate(sets)[order], universe)
        end = np.append(begin[1:], len(owner))
        found: set[tuple[int, int]] = set()
        for key, part, data in zip(others["gid"], others["part"], others["set"], strict=True):
            s = _array(data)
            at = np.searchsorted(universe, s)
            at = at[(at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == s)]
            held = end[at] - begin[at]
            places = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum()) if len(at) else at
            common = np.bincount(owner[places], minlength=len(sets))
            for j in np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (parts != part)):
                if (mark := (int(ids[j]), int(part))) not in found:
                    found.add(mark)
                    out.append((int(ids[j]), int(key)))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _sets_of(df: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """``(gid, set)`` of the groups ``wanted`` (gid, first, k1, k2): the set of a row with the group's first id that has
    the group's key."""
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    rows = df.select(F.col(id_col).cast("long").alias("first"), F.col(text_col).cast("string").alias("t_")).where("t_ is not null").join(wanted, "first")

    def run(batches):
        for b in batches:
            keys, out = list(zip(*(b.column(i).to_pylist() for i in (1, 2)), strict=True)), []
            for t, key in zip(b.column(3), keys, strict=True):
                s = shingles(t.as_py(), width)
                out.append(s.tobytes() if len(s) and _set_key(s) == key else None)
            ok = pa.array([x is not None for x in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["gid", "set"]).filter(ok)

    # repeated rows give a set more than once
    return rows.select("gid", "k1", "k2", "t_").mapInArrow(run, "gid long, set binary").groupBy("gid").agg(F.first("set").alias("set"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int | None = None, miss: float = 1e-7, first: int | None = None,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``: documents are linked if ``100 * |A & B| >= percent * |A | B|``.

    ``first`` is the level at which nodes are looked at first (3 up to a million rows, one more for each 32 times as
    many, so that unrelated documents hardly meet), ``trees`` as many as let a pair at exactly ``percent`` miss
    each other there with a chance of at most ``miss`` (:func:`missed`); where nodes are large and lead on to deep
    ones it is higher: with 16 trees 3e-4. All members of a large deep node are compared.
    A text that is null, empty or without words has no shingles and links with nothing; one with fewer than
    ``width`` words has one shingle. Texts with equal sets are linked. Null ids take part as no document:
    0 links, null component. Different texts under one id take part each for itself; rows that repeat an id
    and a text are one document. Other columns are ignored; no rows give no rows.
    """
    if first is None:
        first = 3 + max(0, math.ceil((math.log2(max(df.count(), 1)) - 20) / 5))
    trees = trees or math.ceil(math.log(miss) / math.log(missed(min(percent, 99) / 100, first)))
    with Scratch(df.sparkSession, "near-documents") as tmp:
        signed = tmp(sign(df, id_col, text_col, width, trees, first), "signed", keep=True)
        groups = signed.where("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"), F.first("deeps").alias("deeps"))
        groups = tmp(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
        some = lambda df: df.limit(1).count() > 0

        # nodes with two or more members, their size and their pivots; large ones lead on to deep ones. Candidates are
        # pairs of a member and a pivot
        members = groups.select("gid", "n", F.explode(F.arrays_zip("nodes", "deeps")).alias("p")).select("gid", "n", F.col("p.nodes").alias("node"), F.col("p.deeps").alias("deep"))
        stars, leaves = [], []
        for level in (0, 1):
            nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("gid", "n")).alias("low"), F.max(F.struct("gid", "n")).alias("high")).where("low.gid < high.gid")
            met = tmp(members.join(nodes, "node"), f"met-{level}")
            for pivot in ("low", "high"):
                alike = (F.col(f"{pivot}.gid") != F.col("gid")) & _alike(F.col("n"), F.col(f"{pivot}.n"), percent)
                stars.append(met.where(alike).select(F.col(f"{pivot}.gid").alias("pivot"), "gid", "size"))
            leaves.append(met.where(F.lit(level == 1) | (F.col("size") <= LEAF)).select(F.struct(F.lit(level).alias("level"), "node").alias("node"), "gid", "n", "size"))
            members = met.where(F.col("size") > LEAF).select("gid", "n", F.col("deep").alias("node")) if level == 0 else None
        pairs = functools.reduce(DataFrame.union, stars).select(F.least("pivot", "gid").alias("a_"), F.greatest("pivot", "gid").alias("b_"), "pivot", "size")
        pairs = pairs.groupBy("a_", "b_").agg(F.min("pivot").alias("a"), F.max("size").alias("size"))
        # a pivot has no more partners from a node than the node has members: they are dealt out by its size
        block = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK))
        pairs = pairs.select("a", F.when(F.col("a") == F.col("a_"), F.col("b_")).otherwise(F.col("a_")).alias("b"), "size").select("a", "b", block.alias("block"))
        pairs = tmp(_promising(pairs, groups, percent), "pivot-pairs")

        def sets_of(gids: DataFrame, name: str) -> DataFrame:
            wanted = groups.select("gid", "first", "k1", "k2").join(gids, "gid", "left_semi")
            return tmp(_sets_of(df, id_col, text_col, width, tmp(wanted, f"{name}-wanted")), name)

        ends = lambda pairs: pairs.select(F.col("a").alias("gid")).union(pairs.select("b"))
        parts = tmp(connected_components(_verify(pairs, sets_of(ends(pairs), "pivot-sets"), percent), tmp), "pivot-parts")

        # nodes whose members aren't all connected yet; a member of another part than the most frequent one is loose
        placed = functools.reduce(DataFrame.union, leaves).join(parts.withColumnRenamed("id", "gid"), "gid", "left").withColumn("part", F.coalesce("component", "gid")).drop("component")
        placed = tmp(placed, "placed")
        counts = placed.groupBy("node", "part").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("gid")).alias("first"))
        mixed = counts.groupBy("node").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.min("first").alias("first"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        unsettled = tmp(placed.join(mixed.select("node", "main", "first"), "node"), "unsettled")
        is_loose = F.col("part") != F.col("main")
        small, large = unsettled.where(F.col("size") <= LEAF), unsettled.where(F.col("size") > LEAF)
        more = small.alias("x").join(small.alias("y"), "node").where(F.expr("x.gid < y.gid and x.part <> y.part") & _alike(F.col("x.n"), F.col("y.n"), percent))
        more = more.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"), F.lit(0).cast("long").alias("block")).distinct()
        more = tmp(_promising(more, groups, percent), "leaf-pairs")

        # large nodes: loose members against all, in blocks
        further = []
        if some(more) or some(large):
            sets = sets_of(ends(more).union(large.select("gid")), "leaf-sets")
            further.append(_verify(more, sets, percent))
        if some(large):
            count = lambda docs, shingles: F.greatest(F.ceil(docs / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")
            key = ["node"]
            # trees meet the same crowd again and again: nodes with the same main part and the same first member are one.
            # Overlapping nodes mostly share their first member in the order of a hash, others never do
            large = large.select(F.struct("main", "first").alias("node"), "gid", "n", "part", "main").distinct()
            sizes = large.groupBy(*key).agg(count(F.sum(is_loose.cast("long")), F.sum(F.when(is_loose, F.col("n")))).alias("l_"), count(F.count(F.lit(1)), F.sum("n")).alias("m_"))
            large = tmp(large.join(sizes, key).withColumn("h_", F.xxhash64("gid")), "large-blocks")
            as_loose = large.where(is_loose).select(*key, "gid", "part", F.lit(True).alias("loose"), F.pmod("h_", "l_").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_") - 1)).alias("j"))
            as_other = large.select(*key, "gid", "part", F.lit(False).alias("loose"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_") - 1)).alias("i"), F.pmod("h_", "m_").alias("j"))
            blocks = as_loose.union(as_other).join(sets, "gid")
            further.append(blocks.groupBy(*key, "i", "j").applyInPandas(lambda pdf: _block_links(pdf, percent), "a long, b long"))

        # what is connected already goes in as stars
        if further:
            stars = parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            parts = connected_components(functools.reduce(DataFrame.union, further, stars), tmp)
        classes = groups.select("k1", "k2", "gid", "first").join(parts.withColumnRenamed("id", "gid"), "gid", "left").select("k1", "k2", "first", F.coalesce("component", "gid").alias("component"))
        best = classes.groupBy("component").agg(F.min("first").alias("component_"))
        of_key = tmp(classes.join(best, "component").select("k1", "k2", "component_"), "components", keep=True)
    # one set may be that of a third of all rows: both sides are plain shuffles, so Spark splits a skewed one
    ids = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("k1")).alias("k1"), "k2")
    component = F.coalesce("component_", "id")
    return ids.join(of_key, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
