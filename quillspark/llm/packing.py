"""Vector bin packing of token sequences under several limits at once."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import id_coder

PIECE_FIELDS = [("start", pa.int64(), T.LongType()), ("length", pa.int64(), T.LongType()), ("ids_crc32", pa.int64(), T.LongType()), ("doc_tokens", pa.int64(), T.LongType()), ("sequence_id", pa.int64(), T.LongType()), ("offset", pa.int64(), T.LongType()), ("loss_tokens", pa.int64(), T.LongType())]


class _Example:
    """What is left of a document: its ids from ``start`` on. ``loss[i]`` counts the loss-bearing ids among the first
    ``i``; None: all bear loss."""

    __slots__ = ("ids", "key", "loss", "start")

    def __init__(self, key, ids: np.ndarray, loss: np.ndarray | None, start: int = 0):
        self.key, self.ids, self.loss, self.start = key, ids, loss, start

    def bearing(self, begin: int, end: int) -> int:
        return end - begin if self.loss is None else int(self.loss[end] - self.loss[begin])

    def demand(self) -> tuple[int, int]:
        return len(self.ids) - self.start, self.bearing(self.start, len(self.ids))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the next ids fit into ``tokens`` and ``loss``."""
        n = min(tokens, len(self.ids) - self.start)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss[self.start + 1 :], self.loss[self.start] + loss, side="right")))


class VectorPacker:
    """Packs examples into bins with limits on tokens, segments and loss-bearing tokens.

    The bin at hand takes, again and again, the waiting example whose demand vector has the largest
    dot product with the bin's free capacity (both in shares of the limits) among those that fit.
    When none fits and tokens are free, the longest example is cut to fill the bin exactly. A bin
    is closed when no piece of an example can be added. An example that alone fills a bin gets one at once;
    the last tokens, fewer than fill a bin, go to shorter bins of powers of two.

    Waiting examples are grouped by demand vector, so a placement looks at the different vectors and not
    at the examples. Bins are packed whenever ``waiting_tokens`` tokens or ``waiting_examples`` examples wait.

    ``add`` takes ``(key, ids, loss)`` where ``loss`` marks the loss-bearing ids (None: all); placed pieces
    come out as ``(key, start, ids, doc_tokens, bin, offset, loss tokens)``.
    """

    def __init__(self, tokens: int = 1024, segments: int = 1024, loss_tokens: int = 1024, waiting_tokens: int = 1 << 19, waiting_examples: int = 1 << 15):
        if min(tokens, segments, loss_tokens, waiting_tokens, waiting_examples) < 1:
            raise ValueError("limits must be at least 1")
        self.tokens, self.segments, self.loss_tokens = tokens, segments, loss_tokens
        self.most = waiting_tokens, waiting_examples
        self.bins = self.waiting = self.examples = 0
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[tuple[int, int], int] = {}
        self.queues: list[deque[_Example]] = []
        self.demands = np.zeros((64, 2), dtype=np.int64)  # tokens, loss
        self.alive = np.zeros(64, dtype=bool)

    def _put(self, x: _Example) -> None:
        demand = x.demand()
        if (k := self.slots.get(demand)) is None:
            k = self.slots[demand] = len(self.queues)
            self.queues.append(deque())
            if k == len(self.demands):
                self.demands = np.concatenate([self.demands, np.zeros_like(self.demands)])
                self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
            self.demands[k] = demand
        self.queues[k].append(x)
        self.alive[k] = True
        self.waiting += demand[0]
        self.examples += 1

    def _take(self, k: int) -> _Example:
        x = self.queues[k].popleft()
        self.alive[k] = bool(self.queues[k])
        self.waiting -= int(self.demands[k, 0])
        self.examples -= 1
        return x

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        counts = None if loss is None else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])
        x = _Example(key, ids, counts)
        while len(ids) - x.start >= self.tokens and (bearing := x.bearing(x.start, x.start + self.tokens)) <= self.loss_tokens:
            yield key, x.start, ids[x.start : x.start + self.tokens], len(ids), self.bins, 0, bearing
            self.bins += 1
            x.start += self.tokens
        if x.start < len(ids):
            self._put(x)
            if self.waiting >= self.most[0] or self.examples >= self.most[1]:
                yield from self.pack(self.most[0] // 64, self.most[1] // 64)

    def pack(self, tokens_left: int = 0, examples_left: int = 0) -> Iterator[tuple]:
        """Fill bins until at most so many tokens and examples wait."""
        live = [x for q in self.queues for x in q]
        self._clear()  # forget demand vectors that nothing has any more
        self.waiting = self.examples = 0
        for x in live:
            self._put(x)
        while self.examples and (self.waiting > tokens_left or self.examples > examples_left):
            # the last tokens fill sequences of powers of two, which need no padding
            room = self.tokens if self.waiting >= self.tokens else 1 << (self.waiting.bit_length() - 1)
            free_tokens, free_segments, free_loss, offset = room, self.segments, self.loss_tokens, 0
            while free_tokens and free_segments and self.examples:
                n = len(self.queues)
                tokens, loss = self.demands[:n, 0], self.demands[:n, 1]
                fits = self.alive[:n] & (tokens <= free_tokens) & (loss <= free_loss)
                if fits.any():
                    # each example takes one segment: that term is the same for all
                    match = tokens * (free_tokens / self.tokens**2) + loss * (free_loss / self.loss_tokens**2) + free_segments / self.segments**2
                    x = self._take(int(np.where(fits, match, -1.0).argmax()))
                    size = len(x.ids) - x.start
                else:
                    k = int(np.where(self.alive[:n], tokens, -1).argmax())
                    size = self.queues[k][0].fitting(free_tokens, free_loss)
                    if size == 0:
                        break
                    x = self._take(k)
                bearing = x.bearing(x.start, x.start + size)
                yield x.key, x.start, x.ids[x.start : x.start + size], len(x.ids), self.bins, offset, bearing
                offset += size
                free_tokens, free_segments, free_loss = free_tokens - size, free_segments - 1, free_loss - bearing
                if x.start + size < len(x.ids):
                    self._put(_Example(x.key, x.ids, x.loss, x.start + size))
            self.bins += 1


def pack_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
    max_tokens: int = 1024, max_segments: int = 1024, max_loss_tokens: int = 1024, with_ids: bool = False,
) -> DataFrame:
    """Pack whole texts into sequences of at most ``max_tokens`` ids; one row for each piece.

    A document is its ids followed by id 0. Each partition packs its own rows in one pass over them
    with a bounded buffer, in the order they come in, so there is no shuffle, a lost task is packed
    anew by itself, and the sequence ids (partition number in the high bits) stay apart. Documents
    are cut where a sequence is full. Whoever builds the arrays pads a sequence to ``max_tokens``, except one
    whose length is a power of two (:func:`padded_length`); the last sequences of a partition have such lengths,
    so only sequences that reach ``max_segments`` or ``max_loss_tokens`` first have padding.

    ``prompt_col`` names a column with a text whose ids come first and bear no loss (instruction
    data); without it all ids bear loss. A null text counts as empty: such a document is id 0 alone.
    Null or repeated ids are packed like others; other columns are ignored; no rows give no rows.
    ``with_ids`` adds the column ``ids``.
    """
    names = [n for n, *_ in PIECE_FIELDS]

    def run(batches):
        coder, packer = id_coder(path), VectorPacker(max_tokens, max_segments, max_loss_tokens)
        high = TaskContext.get().partitionId() << 36
        zero, id_type = np.zeros(1, dtype="<u4"), None

        def out(rows):
            cols = [[r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].tobytes()) for r in rows], [r[3] for r in rows], [high + r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows]]
            arrays = [pa.array([r[0] for r in rows], id_type), *(pa.array(c, pa.int64()) for c in cols)]
            more = [pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))] if with_ids else []
            return pa.RecordBatch.from_arrays([*arrays, *more], names=[id_col, *names, *(["ids"] if with_ids else [])])

        placed: list[tuple] = []
        for b in batches:
            id_type = b.schema.types[0]
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            prompts = b.column(2).to_pylist() if prompt_col else [None] * len(keys)
            for key, text, prompt in zip(keys, texts, prompts, strict=True):
                ids, loss = coder.ids(text or ""), None
                if prompt:
                    head = coder.ids(prompt)
                    ids = np.concatenate([head, ids])
                    loss = np.arange(len(ids) + 1) >= len(head)
                placed.extend(packer.add(key, np.concatenate([ids, zero]), loss))
                if len(placed) >= 5000:
                    yield out(placed)
                    placed = []
        placed.extend(packer.pack())
        if placed:
            yield out(placed)

    cols = [F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_")]
    rows = df.select(*cols, *([F.col(prompt_col).cast("string").alias("prompt_")] if prompt_col else []))
    schema = T.StructType([rows.schema[0], *(T.StructField(n, t) for n, _, t in PIECE_FIELDS), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return rows.mapInArrow(run, schema)


def padded_length(tokens: int, max_tokens: int = 1024) -> int:
    """The length of a sequence of ``tokens`` ids with its padding: ``max_tokens``, or its own if that is a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else max_tokens
