"""Tokens of a public tokenizer as pieces of the text they stand for."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_at_tokens(text: str, path: str) -> list[str]:
    """The text cut where its tokens begin: a piece for each token, joined they are the text. Of tokens that share a character the
    last has it, the others are empty."""
    starts = [a for a, _ in _tokenizer(path).encode(text, add_special_tokens=False).offsets]
    if not starts:
        return [text] if text else []
    edges = [0, *starts[1:], len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def tokenizer_pieces(path: str):
    """A function of a text column for :func:`text_windows` and :func:`chunk_documents`: windows are counted in tokens of the
    tokenizer at ``path``, which is installed on the executors, and hold the text as it stands."""

    def pieces(c: Column) -> Column:
        cut = F.pandas_udf(lambda texts: pd.Series([split_at_tokens(t, path) if t else [] for t in texts]), "array<string>")
        return cut(c)

    return pieces
