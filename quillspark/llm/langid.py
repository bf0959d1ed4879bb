"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter keeps its maximum
in a window; a softmax layer reads the maxima. A filter is a table of a weight for each byte value at
each of its places, so a convolution is a few table look-ups, which numpy does for many windows at
once. Trained in numpy by gradient steps; the probabilities of a whole text are the mean over all its
windows, weighted by their bytes.
"""

from __future__ import annotations

import functools
import io

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
_LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """``tables[i]`` has the shape (width, 256, filters); ``out`` (features, languages); ``bias`` (languages)."""

    def __init__(self, tables: list[np.ndarray], hidden: np.ndarray, out: np.ndarray, bias: np.ndarray, langs: list[str]):
        self.tables, self.hidden, self.out, self.bias, self.langs = tables, hidden, out, bias, langs
        # tables over pairs of bytes: half as many look-ups
        self.pairs = [(t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1) for t in tables]
        self.tails = [None if len(t) == 2 else t[2] if len(t) == 3 else (t[2][:, None, :] + t[3][None, :, :]).reshape(65536, -1) for t in tables]

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each row of ``windows`` (n, WINDOW) of bytes."""
        n = len(windows)
        pairs = (windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]
        parts = []
        for table, pair, tail in zip(self.tables, self.pairs, self.tails, strict=True):
            w = len(table)
            y = pair.take(pairs[:, : WINDOW - w + 1], axis=0)
            if w == 3:
                y += tail.take(windows[:, 2:], axis=0)
            elif w == 4:
                y += tail.take(pairs[:, 2:], axis=0)
            parts.append(y.max(axis=1))
        return np.concatenate(parts, axis=1).reshape(n, -1)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.features(windows) + self.hidden, 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, *self.tables, hidden=self.hidden, out=self.out, bias=self.bias, langs=np.array(self.langs))
        return f.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> ByteNet:
        with np.load(io.BytesIO(data)) as f:
            return ByteNet([f[f"arr_{i}"] for i in range(len(WIDTHS))], f["hidden"], f["out"], f["bias"], [str(x) for x in f["langs"]])


def windows_of(data: bytes) -> np.ndarray:
    """All bytes in rows of WINDOW, padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def some_windows(data: bytes, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``most`` random windows of a text."""
    rows = windows_of(data)
    return rows[rng.choice(len(rows), most, replace=False)] if len(rows) > most else rows


def fit_texts(texts: list[str], langs: list[str], epochs: int = 12, seed: int = 0, per_text: int = 4) -> ByteNet:
    """Train on up to ``per_text`` random windows of each text."""
    rng = np.random.default_rng(seed)
    return fit_windows([some_windows(t.encode(), per_text, rng) for t in texts], langs, epochs, seed)


def fit_windows(windows: list[np.ndarray], langs: list[str], epochs: int = 12, seed: int = 0) -> ByteNet:
    """Train on the windows of each text, classes weighted alike."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    x = np.concatenate(windows)
    y = np.repeat([names.index(lang) for lang in langs], [len(w) for w in windows])
    # short texts must work too: some windows keep their beginning only
    short = rng.random(len(x)) < 0.3
    keep = np.exp(rng.uniform(np.log(24), np.log(WINDOW), len(x))).astype(int)
    x = np.where(short[:, None] & (np.arange(WINDOW) >= keep[:, None]), 0, x).astype(np.uint8)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y].astype(np.float32)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    hidden = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
    out = rng.normal(0, 0.1, (len(hidden), len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    params = [*tables, hidden, out, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            k = order[at : at + 64]
            b, n = x[k], len(k)
            maxima, where = [], []
            for t in tables:
                w = len(t)
                conv = sum(t[j].take(b[:, j : WINDOW - w + 1 + j], axis=0) for j in range(w))
                where.append(conv.argmax(axis=1))
                maxima.append(np.take_along_axis(conv, where[-1][:, None, :], axis=1)[:, 0, :])
            pre = np.concatenate(maxima, axis=1) + hidden
            h = np.maximum(pre, 0)
            z = h @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[k]] -= 1
            p *= weight[k][:, None] / n
            gh = (p @ out.T) * (pre > 0)
            grads = []
            for i, t in enumerate(tables):
                g, rows = np.zeros_like(t), np.arange(n)[:, None]
                own = gh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(t)):
                    np.add.at(g[j], (b[rows, where[i] + j], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [gh.sum(axis=0), h.T @ p + 1e-4 * out, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ByteNet(tables, hidden, out, bias, names)


def fit(docs: DataFrame, per_lang: int = 300, fold: tuple[int, int] = (5, 0), most_docs: int = 60_000, per_text: int = 4) -> ByteNet | None:
    """Train on a bounded sample: of every language at most ``per_lang`` documents, fewer where all languages together would be
    more than ``most_docs`` but one at least: those with the smallest hash of the id, from rows with a text, an id and a
    language whose crc32 of the id modulo ``fold[0]`` isn't ``fold[1]``; of each at most ``per_text`` windows, which are cut out
    where the text is, so that no long text moves. Rows that repeat an id and a language are one document. None without such rows."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0]
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(rest != fold[1])
    # different ids, about: a language may hold few of them in many rows
    counts = {r[0]: r[1] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.approx_count_distinct("doc_id", 0.02)).collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, most_docs // len(counts)))
    # of each language an expected 1.6 samples by hash, then the smallest hashes
    mixed, span = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)), 1 << 40
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(span * min(1.0, (1.6 * per_lang + 40) / max(n, 1))))])
    rows = known.select(F.col("lang").cast("string").alias("lang"), mixed.alias("h"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text_")).where(F.col("h") < F.try_element_at(limits, F.col("lang")))

    def cut(batches):
        for b in batches:
            parts = [some_windows(t.encode(), per_text, np.random.default_rng(h)).tobytes() for h, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(parts, pa.binary())], names=["lang", "h", "id", "windows"])

    # one row for an id and its language, so that a repeated id can't make the sample large
    found = rows.mapInArrow(cut, "lang string, h long, id string, windows binary").groupBy("lang", "h", "id").agg(F.min("windows").alias("windows")).collect()
    taken: dict[str, int] = {}
    windows, langs = [], []
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["id"])):
        if taken.setdefault(r["lang"], 0) < per_lang:
            taken[r["lang"]] += 1
            windows.append(np.frombuffer(bytes(r["windows"]), dtype=np.uint8).reshape(-1, WINDOW))
            langs.append(r["lang"])
    return fit_windows(windows, langs)


@functools.lru_cache(maxsize=2)
def _net(data: bytes) -> ByteNet:
    return ByteNet.from_bytes(data)


def predict(df: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", batch: int = 8) -> DataFrame:
    """``(id, lang_pred, score)`` of every whole text, without a shuffle; ``batch`` windows are held at a time.

    A text that is null or has no letter (and any text without a network) gets ``und`` with score 0.
    Null and repeated ids are returned as they are; other columns are ignored; no rows give no rows.
    """
    data = net.to_bytes() if net else b""

    def run(batches):
        model = _net(data) if data else None
        for b in batches:
            langs, scores, queue = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                langs.append("und")
                scores.append(0.0)
                if t and model and _LETTER.search(t):
                    queue.append((i, windows_of(t.encode())))
            sums = np.zeros((len(langs), len(model.langs) if model else 1))
            if queue:
                windows = np.concatenate([w for _, w in queue])
                owner = np.repeat([i for i, _ in queue], [len(w) for _, w in queue])
                filled = (windows != 0).sum(axis=1)
                for at in range(0, len(windows), batch):
                    share = np.exp(model.log_probs(windows[at : at + batch])) * filled[at : at + batch, None]
                    np.add.at(sums, owner[at : at + batch], share)
                for i, _ in queue:
                    p = sums[i] / max(1e-12, sums[i].sum())
                    langs[i], scores[i] = model.langs[int(p.argmax())], float(min(1.0, p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[b.schema.names[0], "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
