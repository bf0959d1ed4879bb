"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. Block ``j`` of a source with weight ``w`` is released at slot
``floor(j / w)`` and due by slot ``ceil((j + 1) / w)``; of the released blocks the one with the earliest
deadline takes the next slot. Then the blocks that a source has had differ from ``w`` times the slots
by less than one block at all times. Releases and deadlines come from the exact weights, as whole numbers,
over the whole length of the schedule; one task writes it as a table of a row for each block.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


#: Columns that :func:`mix` adds; a column of the input with such a name is replaced.
ADDED = ("slot_", "place_", "block_", "in_horizon_")


def quotas(weights: list[float], period: int) -> list[int]:
    """Slots of each source in a period, at least one, by largest remainders: weights for :func:`schedule`. :func:`mix` doesn't round."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (-(exact[i] - int(exact[i])), i))
    k = 0
    while (left := period - sum(out)) != 0:
        i = order[k % len(order)]
        if left > 0:
            out[i] += 1
        elif out[i] > 1:
            out[i] -= 1
        k += 1
    return out


def schedule(quota: list[int]) -> list[int]:
    """The source of each slot of a period, by earliest deadline among released blocks."""
    return [i for i, _, _ in assignments(quota, quota)]


def whole_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    if not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def assignments(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(source, block, slot)`` of ``blocks[i]`` blocks of each source with weight ``shares[i] / sum(shares)``, by slot.

    A source without blocks left asks for no slot; the others keep to their windows, so slots may stay empty.
    Only the next block of each source is in memory.
    """
    total = sum(shares)
    coming = [(0, i, 0) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, i, j = coming[0]
            heapq.heappush(ready, (-(-(j + 1) * total // shares[i]), i, j))
            if j + 1 < blocks[i]:
                heapq.heapreplace(coming, ((j + 1) * total // shares[i], i, j + 1))
            else:
                heapq.heappop(coming)
        due, i, j = heapq.heappop(ready)
        assert slot < due
        yield i, j, slot
        slot += 1


def plan(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(source, block, slot)`` of all blocks, and for each source with a weight one block more: the first it can't fill.

    Sources of weight 0 are due nothing, but their rows aren't dropped: they follow the last slot of the others,
    in equal shares.
    """
    shares, end = whole_shares(weights), 0
    for i, j, slot in assignments(shares, [n + 1 if w else 0 for n, w in zip(blocks, shares, strict=True)]):
        yield i, j, slot
        end = slot + 1
    rest = [i for i, w in enumerate(shares) if not w]
    for i, j, slot in assignments([1] * len(rest), [blocks[i] for i in rest]):
        yield rest[i], j, end + slot


def _batches(rows: Iterator[tuple], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        arrays = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["s_", "block_", "at_", "beyond_"])


#: Up to so many sources their table is sent to all executors; beyond that it is joined like any other.
FEW_SOURCES = 100_000


def mix(
    df: DataFrame, weights: dict | None = None, exponent: float = 0.5, id_col: str = "doc_id", source_col: str = "source",
    block_docs: int = 16, bucket_docs: int = 500, tie: Column | None = None,
) -> DataFrame:
    """The rows of ``df`` with ``slot_``, ``place_`` (in the block), ``block_`` and ``in_horizon_``; sorting by slot and
    place gives the mixed order. No row is dropped or repeated.

    ``weights`` gives a weight for each source; without it, and for sources it doesn't name, a source's
    weight is its number of rows to the power ``exponent``. Weights are kept exactly: at every slot before the
    horizon a source has had less than one block more or less than its weight times the slots. When a source has
    no rows left (from slot ``in_horizon_`` is false on), its slots stay empty and the others go on in proportion.
    Sources of weight 0 come last. A null source is a source. Inside a source the order is that of a hash of the
    id and of ``tie``, by default a hash of all columns, so rows that repeat an id, or have none, are spread; rows that are equal
    in both follow each other. ``tie`` may be what tells a file's rows apart. An empty table gives no rows.

    The schedule takes one task a few microseconds a block, in memory for one block of each source. Its slots
    reach the rows as an array in the table of buckets, so the rows move once.
    The rank of a row in its source is found without bringing a source together: a source's rows go to buckets
    of about ``bucket_docs`` by their hash, and only counts of buckets are summed over a source.
    """
    given = {"null" if k is None else f"={k}": float(v) for k, v in (weights or {}).items()}
    whole_shares(list(given.values()))  # an error for weights that aren't any
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    with Scratch(df.sparkSession, "mixing") as tmp:
        counts = tmp(df.groupBy(source.alias("s_")).agg(F.count(F.lit(1)).alias("count_")), "sources", keep=True)
        sources, largest = counts.agg(F.count(F.lit(1)), F.max("count_")).first()

        def run(batches):
            held = [(s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            wanted, blocks = [given.get(s, n**exponent) for s, n in held], [-(-n // block_docs) for _, n in held]
            yield from _batches(((held[i][0], j, slot, j == blocks[i]) for i, j, slot in plan(wanted, blocks)))

        slots = tmp(counts.repartition(1).sortWithinPartitions("s_").mapInArrow(run, "s_ string, block_ long, at_ long, beyond_ boolean"), "slots")
        horizon = slots.where("beyond_").agg(F.min("at_")).first()[0]
        shares = counts.select("s_", F.ceil(F.col("count_") / bucket_docs).alias("parts_"))
        shares = F.broadcast(shares) if sources <= FEW_SOURCES else shares

        h = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind)) if tie is None else tie)
        rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row_"), F.col(id_col).alias("id_"), source.alias("s_"), h.alias("h_"))
        rows = rows.join(shares, "s_").withColumn("b_", F.pmod(F.shiftrightunsigned("h_", 20), F.col("parts_"))).drop("parts_")
        # running counts over the buckets of a source, in two steps so that no source is one task
        wide = max(1, int(((largest or 0) / bucket_docs) ** 0.5))
        sizes = tmp(rows.groupBy("s_", "b_").agg(F.count(F.lit(1)).alias("n_")).withColumn("g_", F.floor(F.col("b_") / wide)), "bucket-sizes")
        inner = Window.partitionBy("s_", "g_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.partitionBy("s_").orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)
        above = sizes.groupBy("s_", "g_").agg(F.sum("n_").alias("n_")).select("s_", "g_", F.coalesce(F.sum("n_").over(outer), F.lit(0)).alias("above_"))
        offsets = sizes.select("s_", "g_", "b_", "n_", F.coalesce(F.sum("n_").over(inner), F.lit(0)).alias("below_")).join(above, ["s_", "g_"]).select("s_", "b_", "n_", (F.col("below_") + F.col("above_")).alias("before_"))
        held = F.sequence(F.floor(F.col("before_") / block_docs), F.floor((F.col("before_") + F.col("n_") - 1) / block_docs))
        offsets = offsets.select("s_", "b_", "before_", F.explode(held).alias("block_")).join(slots, ["s_", "block_"])
        offsets = tmp(offsets.groupBy("s_", "b_", "before_").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_", "at_"))), lambda x: x["at_"]).alias("slots_")), "bucket-offsets", keep=True)
    ranked = rows.withColumn("r_", F.row_number().over(Window.partitionBy("s_", "b_").orderBy("h_", "id_")) - 1)
    ranked = ranked.join(offsets, ["s_", "b_"]).withColumn("r_", F.col("r_") + F.col("before_"))
    ranked = ranked.withColumn("block_", F.floor(F.col("r_") / block_docs))
    # a bucket's blocks are consecutive
    slot = F.get("slots_", (F.col("block_") - F.floor(F.col("before_") / block_docs)).cast("int"))
    limit = F.lit(horizon if horizon is not None else 0)
    kept = [F.col("row_").getField(c).alias(c) for c in df.columns if c not in ADDED]
    return ranked.select(*kept, slot.cast("long").alias("slot_"), (F.col("r_") % block_docs).cast("long").alias("place_"), F.col("block_").cast("long").alias("block_"), (slot < limit).alias("in_horizon_"))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the schedule: written, file after file and row after row give it.

    Slots hold a block each, so files are equal stretches of slots; no sample is taken to find them."""
    columns = [c for c in mixed.columns if c not in ADDED]
    files = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = mixed.agg(F.max("slot_")).first()[0] or 0
    stretch = F.floor(F.col("slot_") * files / (last + 1)).cast("int")
    return mixed.repartitionById(files, stretch).sortWithinPartitions("slot_", "place_").select(*columns)
