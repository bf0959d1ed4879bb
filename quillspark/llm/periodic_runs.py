"""Periodic runs of words: stretches that repeat a shorter stretch several times, found by block matching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that no neighbouring
word extends, and that is at least ``exponent * q`` long. Such a run holds an aligned block of ``L`` words, ``L`` a power of two
with ``2 * L - 1 <= (exponent - 1) * q``, together with the block's next occurrence ``q`` words further on. So every period
belongs to one scale, the largest such ``L``; a scale's aligned blocks go as keys of word numbers into an Aho-Corasick automaton
that is searched across the document, and occurrences at a distance of the scale's periods are extended to both sides.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number in the order of first occurrence."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def _stretch(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``q`` apart are identical, as begin and end."""
    right, step = at, 64
    while right < len(ids) - q:
        stop = min(right + step, len(ids) - q)
        differ = np.flatnonzero(ids[right:stop] != ids[right + q : stop + q])
        if len(differ):
            right += int(differ[0])
            break
        right, step = stop, step * 2
    left, step = at, 64
    while left > 0:
        begin = max(left - step, 0)
        differ = np.flatnonzero(ids[begin:left] != ids[begin + q : left + q])
        if len(differ):
            left = begin + int(differ[-1]) + 1
            break
        left, step = begin, step * 2
    return left, right + q


def _primitive(part: np.ndarray) -> bool:
    """Whether a stretch isn't a shorter one repeated."""
    rest, factor = len(part), 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        p = len(part) // factor
        if np.array_equal(part[p:], part[:-p]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def _occurrences(ids: np.ndarray, begins: np.ndarray, size: int) -> dict[tuple[int, ...], list[int]]:
    """Where the blocks of ``size`` words at ``begins`` occur in the document, by block."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    found: dict[tuple[int, ...], list[int]] = {}
    for b in begins.tolist():
        key = tuple(ids[b : b + size].tolist())
        if key not in found:
            found[key] = []
            automaton.add_word(key, found[key])
    automaton.make_automaton()
    for end, places in automaton.iter(tuple(ids.tolist())):
        places.append(end - size + 1)
    return found


def find_runs(ids: np.ndarray, exponent: int = 4, least: int = 6) -> list[Run]:
    """All runs ``(start, length, period)`` of a sequence of numbers that are at least ``least`` and ``exponent`` (2 or more)
    periods long, by start, then period."""
    n, runs = len(ids), []
    if n < max(least, exponent):
        return runs
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, dtype=np.int64)  # to the next occurrence of a word
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # of each place the known run that reaches furthest: its end and its period
    reach, period = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    size = 1
    while (low := -(-(2 * size - 1) // (exponent - 1))) * exponent <= n:
        high = -(-(4 * size - 1) // (exponent - 1)) - 1
        blocks = n // size
        # a block recurs at such a distance only if each of its words does
        begins = np.flatnonzero(gap[: blocks * size].reshape(blocks, size).max(axis=1) <= high) * size if high >= low else ()
        found = _occurrences(ids, begins, size) if len(begins) else {}
        seen: dict[int, int] = {}  # where the last stretch looked at ends, less its period, by period
        for b in map(int, begins):
            places = found[tuple(ids[b : b + size].tolist())]
            for place in places[bisect_left(places, b + low) : bisect_right(places, b + high)]:
                q = place - b
                # known, or within a run whose period divides this one: then no smaller period is missed
                if b < seen.get(q, 0) or (reach[b] >= place + size and q % period[b] == 0 and q > period[b]):
                    continue
                start, end = _stretch(ids, b, q)
                seen[q] = end - q
                if end - start >= max(least, exponent * q) and _primitive(ids[start : start + q]):
                    runs.append((start, end - start, q))
                    further = np.arange(start, end)[reach[start:end] < end]
                    reach[further], period[further] = end, q
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length in periods, then the smallest start and period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        inside[start + q] += 1
        inside[start + length] -= 1
    kept = np.cumsum(inside[:-1]) == 0
    return [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]


def looped_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, one of ten ids with its tail in a loop; ids and lengths decide alone. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6,
    before: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(id, n_words, runs, strongest, collapsed)`` of each row: its runs of words by start, then period, the strongest one
    (null without any) and the text's words without those that a run repeats, joined by one space.

    Words are what stands between blanks (\\x20, \\x09 to \\x0D) of the whole text, compared as they are. ``before`` may give
    other words for an id and its words. A null or empty text has no words, no runs and an empty ``collapsed``; null and repeated
    ids are rows like others; other columns are ignored, whatever their names; no rows give no rows. A row is worked on by
    itself, so nothing is shuffled, and memory is a few times a batch's texts.
    """

    def run(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                words = before(key, words) if before else words
                runs = find_runs(numbered(words), exponent, least)
                as_row = [dict(zip(("start", "length", "period"), r, strict=True)) for r in [*runs, strongest(runs)] if r]
                out.append((key, len(words), as_row[: len(runs)], as_row[-1] if runs else None, b" ".join(collapsed(words, runs)).decode()))
            kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            types = [pa.int64(), pa.int64(), pa.list_(kind), kind, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["id", "n_words", "runs", "strongest", "collapsed"])

    span = "struct<start:long,length:long,period:long>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t_"))
    return rows.mapInArrow(run, f"id long, n_words long, runs array<{span}>, strongest {span}, collapsed string").withColumnRenamed("id", id_col)
