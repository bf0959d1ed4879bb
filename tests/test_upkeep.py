"""Index upkeep with crashes, providers that fail, windows that keep the text, phrase synonyms, search over built chunks."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import documents as D
from quillspark.operators import retrieval as V
from quillspark.operators.embedding import HashedWords, embed
from quillspark.operators.phrases import phrase_matches, with_synonyms
from quillspark.plans.search import SearchEngine, articles_of, build_chunks, build_report, vector_search
from quillspark.sources.cells import CellIndex
from quillspark.sources.index import ChunkIndex, drop_files, setting, write_sample
from quillspark.sources.postings import TermIndex
from quillspark.sources.versions import Versions

CHUNK = "id string, content string, doc_code string, article string"


def chunks_of(spark, rows):
    return spark.createDataFrame([(k, t, "code_13", "1") for k, t in rows], CHUNK)


def held(index):
    return sorted((r["id"], r["content"]) for r in index.open().collect())


def test_update_embeds_what_is_new_and_survives_crashes(spark, tmp_path, monkeypatch):
    log = tmp_path / "asked"

    class Counting(HashedWords):
        def __call__(self, texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return super().__call__(texts)

    asked = lambda: sorted(log.read_text().split("\n")[:-1])
    index = ChunkIndex(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        index.open()
    first = [("a", "one"), ("b", "two"), ("c", None), ("a", "one")]
    assert index.update(chunks_of(spark, first), Counting(8)) == {"kept": 0, "removed": 0, "embedded": 3, "failed": 0}
    assert held(index) == [("a", "one"), ("b", "two"), ("c", None)] or sorted(held(index), key=str) == sorted(set(first), key=str)
    log.write_text("")
    second = [("a", "one"), ("b", "two, changed"), ("d", "four")]
    # a crash while embedding, and one before the switch: the index before stays readable
    def broken(texts):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.update(chunks_of(spark, second), HashedWords(8))
    assert sorted(held(index), key=str) == sorted(set(first), key=str)
    assert index.update(chunks_of(spark, second), Counting(8)) == {"kept": 1, "removed": 2, "embedded": 2, "failed": 0}
    assert held(index) == sorted(second) and asked() == ["four", "two, changed"]
    assert {r["id"]: r["generation"] for r in index.generations().collect()} == {"a": 0, "b": 1, "d": 1}
    # providers that fail on a text: it is set aside, the others are indexed, the next update takes it up alone
    def picky(texts):
        if "bad" in texts:
            raise ValueError("no")
        return HashedWords(8)(texts)

    third = [*second, ("e", "bad"), ("f", "six"), ("g", "seven")]
    assert index.update(chunks_of(spark, third).coalesce(1), picky) == {"kept": 3, "removed": 0, "embedded": 2, "failed": 1}
    assert [(r["id"], r["error"]) for r in index.failed().collect()] == [("e", "ValueError: no")]
    log.write_text("")
    assert index.update(chunks_of(spark, third), Counting(8)) == {"kept": 5, "removed": 0, "embedded": 1, "failed": 0}
    assert asked() == ["bad"] and held(index) == sorted(third) and index.failed().count() == 0
    # a build from itself, compaction, and clearing away what a crash has left
    index.compact()
    assert held(index) == sorted(third)
    index.build(index.open(), HashedWords(8))
    index.clean()
    assert held(index) == sorted(third) and len(list((tmp_path / "index").glob("part-*"))) == 1
    assert index.open_or_build(chunks_of(spark, first), broken).count() == 6
    assert index.drop() and not index.exists() and not index.drop()


@pytest.mark.parametrize("concurrency", [1, 4])
def test_providers(spark, tmp_path, concurrency):
    texts = [f"text {i}" for i in range(23)] + [None, "bad one", "bad two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    want = {i: HashedWords(8)([t or ""])[0].tolist() for i, t in enumerate(texts)}
    vectors = lambda **o: {r["i"]: r["embedding"] for r in embed(df, "t", batch=4, concurrency=concurrency, **o).collect()}
    # answers in any order, with the index of their text
    assert vectors(provider=lambda ts: [(i, v) for i, v in reversed(list(enumerate(HashedWords(8)(ts))))]) == want
    mark = str(tmp_path / "calls")

    def flaky(ts):  # every first call of a batch fails
        import os

        name = f"{mark}-{abs(hash(tuple(ts)))}"
        if not os.path.exists(name):
            open(name, "w").close()
            raise TimeoutError
        return HashedWords(8)(ts)

    assert vectors(provider=flaky, attempts=2, wait=0.01) == want

    def refuses(ts):
        if any(t.startswith("bad") for t in ts):
            raise ValueError(ts[0])
        return HashedWords(8)(ts)

    rows = {r["i"]: r for r in embed(df, "t", refuses, batch=8, error="why", attempts=2, wait=0.01, concurrency=concurrency).collect()}
    assert {i: r["why"] for i, r in rows.items() if r["why"]} == {24: "ValueError: bad one", 25: "ValueError: bad two"}
    assert {i: r["embedding"] for i, r in rows.items() if not r["why"]} == {i: v for i, v in want.items() if i < 24}
    for broken in (refuses, lambda ts: np.zeros((0, 8)), lambda ts: [(1, [1.0])] * len(ts)):
        with pytest.raises(Exception, match="no embedding"):
            vectors(provider=broken)


def test_windows_keep_the_text(spark):
    rng = random.Random(6)
    texts = [None, "", " ", " \n\t", "a", " a", "a ", "é b\r\n\tc  d", *("".join(rng.choice(["w", "xx", " ", "\n", "\t ", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, overlap in ((3, 1), (4, 0), (100, 20)):
        by: dict = {}
        for r in D.text_windows(df, ["i"], "t", size, overlap).collect():
            by.setdefault(r["i"], []).append(r)
        for i, text in enumerate(texts):
            t, rows = text or "", sorted(by[i], key=lambda r: r["chunk_index"])
            assert [r["chunk_index"] for r in rows] == list(range(rows[0]["total_chunks"]))
            assert all(t[r["char_start"] : r["char_end"]] == r["content"] for r in rows)
            assert "".join(t[r["char_start"] : r["own_end"]] for r in rows) == t
            words = t.split()
            assert [r["content"].split() for r in rows] == [words[k * (size - overlap) : k * (size - overlap) + size] for k in range(len(rows))]
    assert [X.pieces(F.lit(t)) is not None for t in texts[1:]]


def test_chunks_are_parts_of_their_article(spark):
    text = " ".join(f"w{i}" for i in range(25))
    chunks = build_chunks(spark.createDataFrame([("13 - x", f"1. {text}\n2. b")], "stem string, content string"), 10, 4).orderBy("position", "chunk_index").collect()
    assert [c["content"] in text or c["content"] == "b" for c in chunks] == [True] * 5
    assert [c["content"].split()[0] for c in chunks] == ["w0", "w6", "w12", "w18", "b"]


def plain_matches(text, phrases):
    w, out, i = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(), [], 0
    while i < len(w):
        n = max((len(p) for p in phrases if tuple(w[i : i + len(p)]) == p), default=0)
        if n:
            out.append((i, n, " ".join(w[i : i + n])))
        i += n or 1
    return out


def test_phrase_synonyms(spark):
    rng = random.Random(9)
    table = [("board member", "Director"), ("board member", "officer"), ("board", "panel"), ("member state", "country"), ("a b c", "x y"), ("b c", "z"), (None, "q"), ("", "q"), ("c", None), ("Limited-Liability company", "ltd")]
    phrases = spark.createDataFrame(table, "phrase string, synonym string")
    texts = [None, "", "The board member state of a board", "a limited liability company, a b c d", *(" ".join(rng.choice("board member state a b c d".split()) for _ in range(rng.randint(0, 12))) for _ in range(40))]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    known = {tuple("".join(c if c.isalnum() else " " for c in p.lower()).split()) for p, _ in table if p}
    got = sorted((r["query_id"], r["start"], r["n"], r["phrase"]) for r in phrase_matches(queries, phrases).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in plain_matches(t or "", known))
    rows = {r["query_id"]: r for r in with_synonyms(queries, phrases).collect()}
    assert rows[2]["terms"] == ["the", "board", "member", "state", "of", "a", "director", "officer", "panel"] and rows[2]["phrases_found"] == ["board member", "board"]
    assert rows[3]["terms"] == ["a", "limited", "liability", "company", "b", "c", "d", "ltd", "x", "y"]
    assert with_synonyms(queries, phrases.limit(0)).where("size(phrases_found) > 0").count() == 0


def files(spark):
    rows = [("13.1 - Commercial", "## head\n1. A trader means a person.\n2. The penalty is a fine.\n"), ("55.09 - Ethics", "1. Notaries shall be honest.\n2. A board member reports.\n"), ("Companies Act", "1. A director has duties.\n4. A company keeps records.\n"), ("79 - Empty", "nothing here\n")]
    return spark.createDataFrame(rows, "stem string, content string")


@pytest.mark.parametrize("mode", ["semantic", "hybrid"])
def test_search_over_built_chunks(spark, tmp_path, mode):
    chunks = build_chunks(files(spark))
    index = ChunkIndex(spark, str(tmp_path / "index"))
    index.update(chunks, HashedWords(16))
    rows = index.open()
    assert {r["doc_code"] for r in rows.collect()} == {"code_13", "notarial_act", "companies_act"}
    ask = lambda q: embed(q, "query", HashedWords(16), "vector")
    cells = CellIndex(spark, str(tmp_path / "cells")).build(rows, "id", "embedding", keep=("doc_code",), cells=2)
    postings = TermIndex(spark, str(tmp_path / "terms")).build(rows, "id", "content", "doc_code")
    queries = spark.createDataFrame([(1, "what is a trader"), (2, "Article 2 of the commercial code"), (3, "Commercial Code: which penalty"), (4, "Article 4"), (5, "Article 99")], "query_id long, query string")
    answers = []
    for more in ({}, {"cells": cells, "postings": postings}):
        engine = SearchEngine(rows, rows.select("id", "doc_code", "embedding"), ask, mode, threshold=0.0, probes=99, **more)
        hits = engine.search(queries)
        answers.append(sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"], r["source"]) for r in hits.collect()))
    assert answers[0] == answers[1]
    by = {q: [h[1] for h in sorted(answers[0], key=lambda h: h[3]) if h[0] == q] for q in range(1, 6)}
    assert by[2] == ["code_13#1_regulation_2_p1_pos2_chunk_1"] and by[4] == ["companies_act_article_4_p1_pos2_chunk_1"] and by[5] == []
    assert all(i.startswith("code_13") for i in by[3]) and by[3]
    hits = engine.search(queries)
    overviews = {r["query_id"]: r for r in engine.overview(queries, hits).collect()}
    assert set(overviews) == {1, 3} and all(r["articles_analyzed"] >= 1 for r in overviews.values())
    more = SearchEngine(rows, rows.select("id", "embedding"), ask, mode, threshold=0.0).search(queries.where("query_id = 1"), with_variants=True)
    assert more.count() >= 1


def test_only_chunks_whose_ids_begin_alike_are_compared(spark, tmp_path):
    """Texts move once, when lines are put in order; a copy's ids are still told apart from those of files that have their own."""
    alone = build_chunks(files(spark), inline_headings=False)
    index = ChunkIndex(spark, str(tmp_path / "index"))
    index.update(alone, HashedWords(16), unique=True)
    moved = [line.split("hashpartitioning(")[1] for line in alone._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and all(x.startswith("stem") for x in moved)
    assert {r["id"] for r in index.open().collect()} == {r["id"] for r in alone.collect()}
    more = spark.createDataFrame([("Companies Act (copy)", "1. A board has duties.\n9. Nothing else.\n"), ("13.1 - Copy", "1. A copy.\n")], "stem string, content string")
    both = files(spark).unionByName(more)
    chunks = build_chunks(both)
    plain = D.chunk_documents(articles_of(both))
    want = D.first_wins(plain, F.col("id"), ["doc_code", "position", "chunk_index"], plain.columns)
    rows = lambda df: sorted(tuple(r) for r in df.select(*sorted(plain.columns)).collect())
    assert rows(chunks) == rows(want) and chunks.count() == plain.count() - 2


def test_an_index_of_unique_chunks_shuffles_no_text(spark, tmp_path):
    rows = spark.range(500).selectExpr("cast(id as string) as id", "repeat(md5(cast(id as string)), 20) as content", "'a' as doc_code", "cast(id as string) as article")
    rows.write.parquet(str(tmp_path / "chunks"))
    chunks, index = spark.read.parquet(str(tmp_path / "chunks")), ChunkIndex(spark, str(tmp_path / "index"))

    def written():
        time.sleep(1)
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    assert index.update(chunks, HashedWords(16), unique=True) == {"embedded": 500, "failed": 0, "kept": 0, "removed": 0}
    assert written() - before < 5000
    assert index.update(chunks.union(chunks), HashedWords(16))["kept"] == 500 and index.open().count() == 500


def test_equal_queries_are_searched_once(spark, tmp_path):
    """What queries ask for is looked up and compared once: pairs of queries and chunks aren't shuffled."""
    chunks = spark.range(3000).selectExpr("format_string('c%04d', id) as id", "concat('text ', id % 7) as content", "if(id % 3 = 0, 'code_13', 'notarial_act') as doc_code", "cast(id % 2 as string) as article", "cast(id % 5 as int) as chunk_index")
    embed(chunks, "content", HashedWords(16)).write.parquet(str(tmp_path / "rows"))
    rows, asked = spark.read.parquet(str(tmp_path / "rows")), []
    texts = ["Article 1", "Article 1 of the Notarial Act", "text 3", "which text, 4", "Article 99", None]
    queries = spark.createDataFrame([(i, texts[i % 6]) for i in range(600)], "query_id long, query string")

    def ask(some):
        asked.append(some.count())
        return embed(some, "query", HashedWords(16), "vector")

    before = spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    hits = SearchEngine(rows, rows.select("id", "doc_code", "embedding"), ask, threshold=0.0).search(queries).collect()
    time.sleep(1)
    assert spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() - before < 1_000_000
    assert asked == [3]
    by = {q: sorted((h["rank"], h["id"], round(h["score"], 9), h["source"]) for h in hits if h["query_id"] == q) for q in range(600)}
    found = lambda other: [(i + 1, f"c{n:04d}", 1.0, "lookup") for i, n in enumerate(sorted((n for n in range(1, 3000, 2) if other or n % 3 == 0), key=lambda n: (n % 5, n))[:5])]
    assert by[0] == found(False) and by[1] in (found(False), found(True)) and by[4] == []
    assert all(by[q] == by[q % 6] for q in range(600)) and all(by[q] and {x[3] for x in by[q]} == {"semantic"} for q in (2, 3, 5))
    few = V.lookup(queries.limit(9).select("query_id", F.lit("1").alias("article_num"), F.lit(None).cast("string").alias("doc_hint")), rows, k=5, most_asks=0)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in few.collect()) == [(q, i, key) for q in range(9) for i, key, _, _ in found(False)]


def test_direct_vector_search(spark, tmp_path):
    chunks = build_chunks(files(spark))
    rows = embed(chunks, "content", HashedWords(16))
    queries = spark.createDataFrame([(1, "art. 2 please"), (2, "what is article 99"), (3, "a trader"), (4, "Article 136A")], "query_id long, query string")
    hits = vector_search(queries, chunks, rows.select("id", "embedding"), lambda q: embed(q, "query", HashedWords(16), "vector"), 3).collect()
    by = {q: [(h["source"], h["id"]) for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == q] for q in range(1, 5)}
    assert [x for x, _ in by[1]] == ["lookup", "lookup"] and all("_2_p" in i for _, i in by[1])
    assert all(len(by[q]) == 3 and {x for x, _ in by[q]} == {"semantic"} for q in (2, 3, 4))


def test_report_lists_files_without_articles(spark):
    rows = {r["file"]: r for r in build_report(files(spark)).collect()}
    assert len(rows) == 4 and rows["79 - Empty"]["articles"] == rows["79 - Empty"]["chunks"] == 0 and rows["79 - Empty"]["article_list"] == ""
    assert {(r["total_documents"], r["total_articles"], r["total_chunks"]) for r in rows.values()} == {(4, 6, 6)}
    assert rows["79 - Empty"]["document"].startswith("Commissioners")


def test_small_tools(spark, tmp_path):
    chunks = build_chunks(files(spark))
    write_sample(chunks, str(tmp_path / "sample"), 2)
    assert spark.read.json(str(tmp_path / "sample")).count() == 2
    assert drop_files(spark, str(tmp_path / "sample"), str(tmp_path / "none")) == {str(tmp_path / "sample"): True, str(tmp_path / "none"): False}
    spark.conf.set("quillspark.some.name", "v")
    assert setting(spark, "some.name") == "v" and setting(spark, "no.name", "d") == "d"
    with pytest.raises(KeyError, match="QUILLSPARK_NO_NAME"):
        setting(spark, "no.name")
    assert V.ranked(chunks.limit(0).select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("score"))).count() == 0
