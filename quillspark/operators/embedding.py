"""Text embedding by an exchangeable provider, in batches on the executors.

A provider is a function of a list of texts that gives a matrix with a row for each, or pairs of a text's index and its vector. :class:`HashedWords` needs no
model: it is for plumbing and tests, not for relevance.
"""

from __future__ import annotations

import functools
import hashlib
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile("[a-z0-9]+")


@functools.lru_cache(maxsize=200_000)
def _place(word: str, dims: int) -> tuple[int, int]:
    digits = hashlib.md5(word.encode()).hexdigest()
    return int(digits[:6], 16) % dims, 1 if digits[6] < "8" else -1


class HashedWords:
    """Words counted in ``dims`` places, with a sign, both by their digest; a text without words is all ones."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in _TERM.findall(text.lower()):
                place, sign = _place(word, self.dims)
                out[i, place] += sign
        out[~out.any(axis=1)] = 1.0
        return out


class Incomplete(ValueError):
    """A provider's answer that doesn't hold a vector for each text."""


def in_order(answer, n: int) -> list[np.ndarray]:
    """The vectors of an answer for ``n`` texts: rows in order, or pairs of a text's index and its vector in any order."""
    rows = list(answer)
    if rows and isinstance(rows[0], tuple):
        if sorted(i for i, _ in rows) != list(range(n)):
            raise Incomplete(f"indexes {sorted(i for i, _ in rows)[:5]}... for {n} texts")
        rows = [v for _, v in sorted(rows, key=lambda r: r[0])]
    if len(rows) != n:
        raise Incomplete(f"{len(rows)} vectors for {n} texts")
    return [np.asarray(v, dtype=np.float64) for v in rows]


def _ask(provider: Callable, texts: list[str], attempts: int, wait: float) -> list[tuple[np.ndarray | None, str | None]]:
    """``(vector, error)`` of each text. A batch that fails at all attempts, each after twice the wait of the one before, is
    halved until the texts that it fails on stand alone; those are asked for once more."""
    for turn in range(attempts):
        try:
            return [(v, None) for v in in_order(provider(texts), len(texts))]
        except Exception as e:  # noqa: BLE001  any failure of a service
            error = f"{type(e).__name__}: {e}"
            if turn + 1 < attempts:
                time.sleep(wait * 2**turn)
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return [*_ask(provider, texts[:half], 1, 0), *_ask(provider, texts[half:], 1, 0)]


def embed(
    df: DataFrame, text_col: str, provider: Callable[[list[str]], np.ndarray], out: str = "embedding", batch: int = 64,
    attempts: int = 1, wait: float = 0.5, concurrency: int = 1, error: str | None = None,
) -> DataFrame:
    """``df`` with the column ``out``; the provider is called with at most ``batch`` texts, null ones as empty.

    A call that raises, or whose answer lacks a vector, is tried ``attempts`` times, with growing waits from ``wait`` seconds on. At most
    ``concurrency`` calls of a task run at a time. With ``error`` a text that still fails has a null vector and the
    reason in a column of this name; without, it fails the job."""
    added = [T.StructField(out, T.ArrayType(T.DoubleType())), *([T.StructField(error, T.StringType())] if error else [])]

    def run(batches):
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for b in batches:
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                calls = [texts[k : k + batch] for k in range(0, len(texts), batch)]
                answers = [x for part in pool.map(lambda c: _ask(provider, c, attempts, wait), calls) for x in part]
                if not error and (why := next((e for _, e in answers if e), None)):
                    raise RuntimeError(f"no embedding: {why}")
                columns = [pa.array([v for v, _ in answers], pa.list_(pa.float64())), *([pa.array([e for _, e in answers], pa.string())] if error else [])]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(f.name for f in added)])

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType([*df.withColumn(text_col, F.col(text_col).cast("string")).schema, *added]))
