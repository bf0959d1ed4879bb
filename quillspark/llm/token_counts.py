"""Token counts of texts from prefix tables (see :mod:`quillspark.llm.bytebpe`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import prefix_counter


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, cut_chars)`` of every whole text; no shuffle, no state between rows.

    ``cut_chars`` is the length in code points of the longest prefix of at most ``limit`` tokens: where the
    text would be truncated. A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are
    returned as they are; other columns are ignored; an empty table gives no rows. The special string inside
    a text is one token, as the library has it by default.
    """
    kinds = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("cut_chars", pa.int64())]

    def run(batches):
        counter = prefix_counter(path)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                n, cut = counter.count_and_cut(t or "", limit)
                rows.append((len((t or "").encode()), n, n > limit, cut))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], names=[b.schema.names[0], *(n for n, _ in kinds)])

    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("cut_chars", T.LongType())])
    return rows.mapInArrow(run, schema)


def prefix_token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, prefix_tokens array<int>)``: element ``i`` is the exact token count of the first ``i``
    code points, so budget and truncation questions are array look-ups. A null text gives ``[0]``."""

    def run(batches):
        counter = prefix_counter(path)
        for b in batches:
            tables = [counter.prefix_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables, pa.list_(pa.int32()))], names=[b.schema.names[0], "prefix_tokens"])

    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]))


def truncate_to_budget(df: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_tokens)`` with each text cut to its longest prefix of at most ``budget`` tokens. A null text
    is empty; null and repeated ids are returned as they are; other columns are ignored."""
    both = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))

    def run(batches):
        counter = prefix_counter(path)
        for b in batches:
            kept = [t[: counter.count_and_cut(t, budget)[1]] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(list(map(counter.count, kept)), pa.int64())], names=[b.schema.names[0], "text", "n_tokens"])

    return both.mapInArrow(run, T.StructType([both.schema[0], T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())]))
