"""Dedup of lines that many documents share, with Bloom filters for once-seen and twice-seen hashes.

Each task marks the hash of a document's different lines in a filter of what it saw once, and where that holds it already, in a filter of
what it saw twice. The filters of all tasks are merged piece by piece; what two of them saw once counts as seen twice. A second pass
sends only lines that the merged twice-seen filter holds to a shuffle, which counts documents exactly; what a filter takes
for a repeat by mistake has one document there. Then the documents are read once more and lose their lines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29  # of a filter: 128 KiB to 64 MiB, which is what tasks hold and executors are sent
PIECE = 1 << 20  # bits of a filter that are merged together
PROBES = 2


def keys_of(text: bytes) -> list[bytes]:
    """Of each line what it is compared by: without blanks (\\x20, \\x09 to \\x0D) at its ends, A-Z lowered."""
    return [line.strip().lower() for line in text.split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def wanted(text: bytes, least: int) -> set[bytes]:
    """The different keys of a document that are long enough."""
    return {k for k in keys_of(text) if long_enough(k, least)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


class SeenTwice:
    """Two Bloom filters of ``bits`` bits, a power of two: hashes seen once at least, and twice at least."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(bits // 8, dtype=np.uint8) for _ in range(2))

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [(hashes + np.uint64(i) * step) & np.uint64(self.bits - 1) for i in range(PROBES)]

    @staticmethod
    def _mark(held: np.ndarray, places: np.ndarray) -> None:
        np.bitwise_or.at(held, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))

    @staticmethod
    def _has(held: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0 for p in places])

    def add(self, hashes: np.ndarray) -> None:
        """Note hashes, each of them as often as it was seen."""
        hashes, counts = np.unique(hashes, return_counts=True)
        places = self._places(hashes)
        again = self._has(self.once, places) | (counts > 1)
        for p in places:
            self._mark(self.twice, p[again])
            self._mark(self.once, p)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may have been seen twice; none that were is missed."""
        return self._has(self.twice, self._places(hashes))


def _packed(piece: np.ndarray) -> bytes:
    """A piece as its bytes or, if that is shorter, as the places of its bits."""
    places = np.flatnonzero(np.unpackbits(piece, bitorder="little")).astype("<u4")
    return places.tobytes() if places.nbytes < piece.nbytes else piece.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == PIECE // 8:
        return np.frombuffer(data, dtype=np.uint8)
    held = np.zeros(PIECE, dtype=np.uint8)
    held[np.frombuffer(data, dtype="<u4")] = 1
    return np.packbits(held, bitorder="little")


def _merged(pieces: DataFrame, partitions: int) -> DataFrame:
    """``(piece, twice)`` of pieces ``(piece, once, twice)`` of many tasks, one after the other in sorted order."""

    def run(batches):
        piece = once = twice = None
        for b in batches:
            done = []
            for number, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new, again = map(_unpacked, parts)
                if number != piece:
                    if piece is not None:
                        done.append((piece, _packed(twice)))
                    piece, once, twice = number, new, again
                else:
                    once, twice = once | new, twice | again | (once & new)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int32(), pa.binary()))], names=["piece", "twice"])
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([_packed(twice)], pa.binary())], names=["piece", "twice"])

    return pieces.repartition(partitions, "piece").sortWithinPartitions("piece").mapInArrow(run, "piece int, twice binary")


def twice_seen(texts: DataFrame, bits: int, least: int) -> SeenTwice:
    """The merged filter of keys that two or more rows hold. ``texts``: one binary column. What comes to the driver is at most
    one filter, ``bits / 8`` bytes."""

    def run(batches):
        seen, some = SeenTwice(bits), False
        for b in batches:
            keys = [k for t in b.column(0) for k in wanted(t.as_py(), least)]
            if keys:
                seen.add(_hashes(keys))
                some = True
        once, twice = (x.reshape(-1, PIECE // 8) for x in (seen.once, seen.twice))
        for number in np.flatnonzero(once.any(axis=1)).tolist() if some else ():
            row = [number], [_packed(once[number])], [_packed(twice[number])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "once", "twice"])

    found = SeenTwice(bits)
    pieces = texts.mapInArrow(run, "piece int, once binary, twice binary")
    for r in _merged(pieces, min(bits // PIECE, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))).collect():
        found.twice[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = _unpacked(bytes(r["twice"]))
    return found


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", "")) + 1


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3, bits: int | None = None) -> DataFrame:
    """``(id, n_lines, n_dropped, text)`` of each row: its lines before, how many go, and the others joined by ``\\n``.

    Lines are compared by their key (:func:`keys_of`), told apart by its SHA-256. Keys with ``least`` code points or more that
    ``documents`` (2 or more) documents hold lose all their lines except in the document with the largest id, which keeps all of
    its own. Documents are told apart by id: rows that repeat an id are one document, as are rows with a null id, which
    is smaller than others. A null or empty text is one empty line; other columns are ignored; no rows give no rows.

    ``bits`` of a filter are 8 for each line of the table, at most :data:`MOST_BITS`: beyond some 67 million lines a filter takes more
    lines for repeats, which the exact count sorts out; the result is the same. A key's rows are counted by document first, so
    no task gets all rows of a frequent one.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a row's lines go by its id and its text's hash: an id that many rows share is no long list
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("t"))
    if bits is None:
        lines = df.select(F.sum(_lines(text))).first()[0] or 0
        bits = min(max(1 << (8 * lines - 1).bit_length(), LEAST_BITS), MOST_BITS) if lines else LEAST_BITS
    with Scratch(spark, "lines") as tmp:
        seen = spark.sparkContext.broadcast(twice_seen(rows.select("t"), bits, least).twice)

        def suspects(batches):
            filters = SeenTwice(8)
            filters.bits, filters.twice = bits, seen.value
            for b in batches:
                ids, hashes, found = [], [], []
                for key, row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    keys = list(wanted(t.as_py(), least))
                    if keys:
                        held = [_digest(k) for k, s in zip(keys, filters.suspects(_hashes(keys)).tolist(), strict=True) if s]
                        ids += [key] * len(held)
                        hashes += [row] * len(held)
                        found += held
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((found, pa.binary()), (ids, pa.int64()), (hashes, pa.int64()))], names=["key", "id", "row"])

        lines = tmp(rows.mapInArrow(suspects, "key binary, id long, row long"), "suspects", keep=True)
        seen.destroy()
        counted = lines.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        repeated = tmp(counted.where(F.col("n") >= documents).select("key", "last"), "repeated", keep=True)
        going = lines.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "row").agg(F.collect_set("key").alias("keys"))
        going = tmp(going.select(F.col("id").alias("id_"), F.col("row").alias("row_"), "keys"), "going", keep=True)

    def rest(batches):
        for b in batches:
            out = []
            for key, t, gone in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                whole, gone = t.as_py(), set(gone.as_py() or ())
                lines = kept = whole.split(b"\n")
                if gone:
                    kept = [x for x, k in zip(lines, keys_of(whole), strict=True) if not (long_enough(k, least) and _digest(k) in gone)]
                out.append((key, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "n_lines", "n_dropped", "t"])

    both = rows.join(going, (F.col("row") == F.col("row_")) & F.col("id").eqNullSafe(F.col("id_")), "left").select("id", "t", "keys")
    out = both.mapInArrow(rest, "id long, n_lines long, n_dropped long, t binary")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("t").cast("string").alias(text_col))
