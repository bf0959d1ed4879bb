"""Heavy hitters: the most frequent messages of time windows, with counters whose number is fixed.

A sketch holds at most ``counters`` messages. When there are more, the count of the first one too many is taken from all and what is left
without a count goes; the sum of what was taken is the sketch's ``error``. A message's count in the sketch is at most its
true one, and less by ``error`` at most, which is at most the number of messages divided by ``counters + 1``. Sketches add up:
counts by message, errors and numbers as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SKETCH = "window_start timestamp, message string, count long, error long, n long"


def reduced(counts: Counter, counters: int) -> tuple[Counter, int]:
    """At most ``counters`` of the counts, and what was taken from each."""
    if len(counts) <= counters:
        return counts, 0
    taken = sorted(counts.values(), reverse=True)[counters]
    return Counter({m: c - taken for m, c in counts.items() if c > taken}), taken


def _keyed(events: DataFrame, time: str, message: str, window: str) -> DataFrame:
    return events.where(F.col(time).isNotNull() & F.col(message).isNotNull()).select(F.col(time).alias("at"), F.window(time, window).alias("w"), F.col(message).cast("string").alias("message"))


def sketch_table(events: DataFrame, time: str, message: str, window: str = "1 day", counters: int = 1000) -> DataFrame:
    """``(window_start, message, count, error, n)``: the sketches of a table, one of each task and window; a row with
    a null message holds the sketch's error and its number of messages. Null times and messages count nowhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            found: dict = {}
            for start, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(start, Counter())[m] += 1
            for start, counts in found.items():
                before, error, n = held.get(start, (Counter(), 0, 0))
                kept, taken = reduced(before + counts, counters)
                held[start] = kept, error + taken, n + counts.total()
        rows = [r for start, (counts, error, n) in held.items() for r in [(start, None, 0, error, n), *((start, m, c, 0, 0) for m, c in counts.items())]]
        types = (pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["window_start", "message", "count", "error", "n"])

    return _keyed(events, time, message, window).select(F.col("w.start").alias("window_start"), "message").mapInArrow(run, SKETCH)


def sketch_stream(events: DataFrame, time: str, message: str, window: str = "1 day", late: str = "1 hour", counters: int = 1000, shards: int = 8) -> DataFrame:
    """The same of a stream: a window's messages are dealt out to ``shards`` sketches, which are the stream's state and are given out
    when the watermark, ``late`` behind the latest event time, passes the window's end. Events of such windows that come later are dropped."""
    rows = _keyed(events.withWatermark(time, late), time, message, window)
    rows = rows.select("at", F.col("w.start").alias("window_start"), F.unix_millis("w.end").alias("ends"), "message", F.pmod(F.xxhash64("message", "at"), F.lit(shards)).alias("shard"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        messages, numbers, error, n = state.get if state.exists else ([], [], 0, 0)
        if state.hasTimedOut or int(key[2]) <= state.getCurrentWatermarkMs():  # what comes in now is late
            if not state.exists:
                return
            state.remove()
            rows = [(key[0], None, 0, error, n), *((key[0], m, c, 0, 0) for m, c in zip(messages, numbers, strict=True))]
            yield pd.DataFrame(rows, columns=["window_start", "message", "count", "error", "n"])
            return
        counts = Counter(dict(zip(messages, map(int, numbers), strict=True)))
        for part in parts:
            seen = Counter(part["message"].tolist())
            counts, taken = reduced(counts + seen, counters)
            error, n = error + taken, n + seen.total()
        state.update((list(counts), list(counts.values()), error, n))
        state.setTimeoutTimestamp(int(key[2]))

    return rows.groupBy("window_start", "shard", "ends").applyInPandasWithState(run, SKETCH, "messages array<string>, counts array<long>, error long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def merged(sketches: DataFrame) -> DataFrame:
    """``(window_start, message, least, most, n)`` of sketches: bounds of each message's count, and the window's number of messages. Messages
    that are missing have at most ``most - least``."""
    whole = sketches.where("message is null").groupBy("window_start").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))
    rows = sketches.where("message is not null").groupBy("window_start", "message").agg(F.sum("count").alias("least"))
    return rows.join(whole, "window_start").select("window_start", "message", "least", (F.col("least") + F.col("error")).alias("most"), "n")


def frequent(events: DataFrame, time: str, message: str, share: float, window: str = "1 day") -> DataFrame:
    """``(window_start, message, count, n)``: the messages of a table that make at least ``share`` of their window's, exactly.

    A first pass sketches with enough counters that none of them can be missing; a second one counts the candidates only."""
    counters = int(1 / share) + 1
    bounds = merged(sketch_table(events, time, message, window, counters))
    candidates = bounds.where(F.col("most") >= F.col("n") * share).select("window_start", "message", "n")
    rows = _keyed(events, time, message, window).select(F.col("w.start").alias("window_start"), "message")
    counts = rows.join(candidates, ["window_start", "message"]).groupBy("window_start", "message", "n").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= F.col("n") * share).select("window_start", "message", "count", "n")
