"""Lines that hold queries, searches with variants and lines, windows in tokens of a public tokenizer."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.tokens import split_at_tokens, tokenizer_pieces
from quillspark.operators import documents as D
from quillspark.operators import reports as P
from quillspark.operators.embedding import HashedWords, embed
from quillspark.plans.search import enhanced_search

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize("most", [100, 3])
def test_lines_with_queries(spark, most):
    rng = random.Random(4)
    texts = [None, "", "Über das Haus\n\nhaus HAUS", *("\n".join(" ".join(rng.choice(["ab", "Abc", "bca", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(4)) for _ in range(40))]
    asks = [(1, "ab"), (2, "AB"), (3, "bc"), (4, "c b"), (5, ""), (6, None), (7, "haus"), (8, "über"), (9, "nowhere")]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = P.lines_with(spark.createDataFrame(asks, "query_id int, query string"), docs, most_queries=most)
    want = sorted((q, f"d{i}", no, line) for q, part in asks if part for i, t in enumerate(texts) for no, line in enumerate((t or "").split("\n"), 1) if part.lower() in line.lower())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert P.lines_with(spark.createDataFrame([], "query_id int, query string"), docs).count() == 0


def test_enhanced_search(spark):
    rows = [("a", "The board meets.\nA dividend is paid.", "code_13", "1"), ("b", "rules for a dividend\nnothing else", "code_13", "2"), ("c", "Something of another kind.", "companies_act", "1")]
    chunks = spark.createDataFrame(rows, "id string, content string, doc_code string, article string").withColumn("chunk_index", F.lit(0)).withColumn("doc_overview", F.concat(F.lit("about "), "doc_code"))
    vectors = embed(chunks, "content", HashedWords(16)).select("id", "embedding")
    hits = enhanced_search(spark.createDataFrame([(7, "a dividend")], "query_id long, query string"), chunks, vectors, lambda q: embed(q, "query", HashedWords(16), "vector"), k=5).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3, 4, 5]
    whole, lines = [h for h in hits if not h["line_no"]], [h for h in hits if h["line_no"]]
    assert {h["id"] for h in whole} == {"a", "b", "c"} and hits[0]["id"] == "b" and hits[0]["score"] > 1
    # the query's line and that of a variant; the former holds it in other letters and gets nothing more
    assert {(h["id"], h["line_no"], h["score"], h["source"]) for h in lines} == {("a", 2, 0.0, "keyword"), ("b", 1, 1.0, "keyword")}
    assert {h["doc_overview"] for h in hits if h["id"] == "b"} == {"about code_13"}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public tokenizer")
def test_windows_in_tokens_of_a_tokenizer(spark):
    from tokenizers import Tokenizer

    coder, rng = Tokenizer.from_file(VOCABULARY), random.Random(3)
    texts = [None, "", " ", "a", "naïve 😀😀 text\n\n with  blanks", *("".join(rng.choice(["word ", "é", "😀", "\n", "straße ", "12.5", "  "]) for _ in range(rng.randint(0, 50))) for _ in range(30))]
    for t in texts:
        if t:
            assert "".join(split_at_tokens(t, VOCABULARY)) == t and len(split_at_tokens(t, VOCABULARY)) == len(coder.encode(t, add_special_tokens=False).ids)
    by: dict = {}
    for r in D.text_windows(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t", 7, 2, tokenizer_pieces(VOCABULARY)).collect():
        by.setdefault(r["i"], []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(by[i], key=lambda r: r["chunk_index"])
        n = len(coder.encode(t or "", add_special_tokens=False).ids)
        assert [r["tokens"] for r in rows] == [min(7, n - 5 * k) for k in range(len(rows))] and len(rows) == (1 if n <= 7 else -(-(n - 7) // 5) + 1)
        assert "".join(r["content"][: r["own_end"] - r["char_start"]] for r in rows) == (t or "")


def test_lines_in_pieces(spark):
    """What a task holds of its finds is bounded: one line that many queries ask for is given in several pieces."""
    docs = spark.createDataFrame([(1, "The fee\nno\nfee and FEE of the fee"), (2, None), (3, "a fee")], "doc_id long, text string")
    asks = [(i, ("fee", "the FEE", "none")[i % 3]) for i in range(60)]
    got = P.lines_with(spark.createDataFrame(asks, "query_id int, query string"), docs, piece=64).collect()
    lines = [(1, 1, "The fee"), (1, 3, "fee and FEE of the fee"), (3, 1, "a fee")]
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, q in asks for x in lines if q.lower() in x[2].lower())


@pytest.mark.parametrize("most", [100, 3])
def test_first_lines(spark, most):
    """Of each query the lines that a sort of all of them puts first."""
    texts = {i: "\n".join(f"{w} {i % 3} rules for {v}" for w in ("Fee", "fee", "tax") for v in ("fee", "Tax", "x")) for i in range(20)}
    queries = ["fee", "Fee", "tax", "none", "x", "0 rules"]
    asks = spark.createDataFrame([(q, [q, f"rules for {q}"]) for q in queries] * 2, "query string, parts array<string>")
    got = P.first_lines(asks, spark.createDataFrame([*texts.items(), (99, None)], "id long, content string").repartition(3), 4, most_queries=most).collect()
    want = []
    for q in queries:
        hits = [(q not in line, i, no) for i, text in texts.items() for no, line in enumerate(text.split("\n"), 1) if q.lower() in line.lower()]
        want += [(q, i, no, not without) for without, i, no in sorted(hits)[:4]]
    assert sorted(map(tuple, got)) == sorted(want)
