"""Hand-traced cases, and window forms against their sequential forms."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import query_text as Q
from quillspark.functions import text as X
from quillspark.operators import documents as D
from quillspark.operators import retrieval as V
from quillspark.plans.search import SearchEngine, build_chunks
from quillspark.sources import files as S


@pytest.mark.parametrize(("text", "want"), [
    ("1. a\n2. b\n1. c\n3. d", [("1", "a"), ("2", "b"), ("3", "d")]),
    ("26. a\n26A. b\n27. c", [("26", "a"), ("26A", "b"), ("27", "c")]),
    ("007. x", [("7", "x")]), ("600. x", []), ("- 1. foo", []), ("", []),
    ("1. a\n--- PAGE 2 ---\nb\n2. c", [("1", "a b"), ("2", "c")]),
])
def test_segment(spark, text, want):
    rows = D.segment(spark.createDataFrame([("d", text)], "doc_code string, content string"), inline_headings=False)
    assert [(r["article"], r["content"]) for r in rows.orderBy("article_order").collect()] == want


def test_inline_headings(spark):
    rows = D.segment(spark.createDataFrame([("d", "1. one. see 5. five 4. four 7. seven")], "doc_code string, content string"), inline_headings=True)
    assert [(r["article"], r["content"]) for r in rows.orderBy("position").collect()] == [("1", "one. see 5. five 4. four 7. seven"), ("5", "five 4. four"), ("7", "seven")]


@pytest.mark.parametrize(("n", "chunks", "label"), [(0, 1, 1), (3000, 1, 1), (3001, 2, 2), (5800, 2, 2), (5801, 3, 2), (8700, 4, 3), (11000, 4, 4)])
def test_windows(spark, n, chunks, label):
    rows = D.token_windows(spark.createDataFrame([(1, " ".join(["w"] * n))], "k int, t string"), ["k"], X.words(F.col("t"))).collect()
    assert len(rows) == chunks and {(r["total_chunks"], r["total_chunks_ref"]) for r in rows} == {(chunks, label)}


def test_rising_is_the_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(1, 40)) for k in range(30) for i in range(rng.randint(0, 25))]
    got = {(r["k"], r["i"]) for r in D.rising(spark.createDataFrame(rows, "k int, i int, v int"), "k", "v", "i").collect()}
    best, want = {}, set()
    for k, i, v in rows:
        if v > best.get(k, 0):
            best[k] = v
            want.add((k, i))
    assert got == want


def test_cleaning(spark):
    rows = spark.createDataFrame([("exam-\nple\r\n## gone\n12\n### kept\n\n\n\nCap. 364.\nend ",)], "t string")
    assert rows.select(X.clean_document(F.col("t"))).first()[0].split() == ["example", "###", "kept", "end"]
    assert rows.select(X.strip(F.lit("  é \n"))).first()[0] == "é"


@pytest.mark.parametrize(("query", "kind", "number", "hint"), [("Article 4", "article_lookup", "4", None), ("477", "article_lookup", "477", None), ("smart 5", "general", None, None), ("What does Article 136A of the Companies Act say?", "general", None, "companies_act")])
def test_analysis(spark, query, kind, number, hint):
    r = Q.analyse(spark.createDataFrame([(1, query)], "query_id int, query string")).first()
    assert (r["type"], r["article_num"], r["doc_hint"]) == (kind, number, hint)


def test_letters(spark):
    assert Q.analyse(spark.createDataFrame([(1, "art. 136A?")], "query_id int, query string"), letters=True).first()["article_num"] == "136A"


def test_confidence(spark):
    hits = [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.1), (2, 1, 0.05), (3, 1, 0.99), (3, 2, 0.99), (3, 3, 0.99)]
    got = dict(V.confidence(spark.createDataFrame(hits, "query_id int, rank int, score double")).collect())
    assert {k: round(v, 9) for k, v in got.items()} == {1: 0.8, 2: 0.1, 3: 0.95}


def test_nearest_by_join_agrees(spark):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    a, b = (V.nearest(queries, vectors, 7, most_queries=m).select("query_id", "id", "rank").collect() for m in (100, 2))
    assert sorted(a) == sorted(b) and len(a) == 35


def test_files_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/13 - Commercial Code.txt").write_text("## head\n1. A trader means a person.\n2. The penalty is a fine.\n")
    (tmp_path / "in/55.09 - Ethics.txt").write_text("1. Notaries shall be honest.\n")
    chunks = build_chunks(S.read_texts(spark, str(tmp_path / "in"))).cache()
    assert {r["citation"] for r in chunks.collect()} == {"Commercial Code (Cap. 13) Art. 1", "Commercial Code (Cap. 13) Art. 2", "Notarial Profession and Notarial Archives Act (Cap. 55) Reg. 1"}
    S.write_table(S.nested_chunks(chunks), str(tmp_path / "chunks.json"), "json")
    assert spark.read.schema(S.CHUNK).json(str(tmp_path / "chunks.json")).count() == 3
    keyed = chunks.withColumn("name", F.col("id")).withColumn("id", F.xxhash64("id"))
    embed = lambda df, text: df.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lit(1.0) + F.size(F.filter(X.terms(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(8)) == i))))
    vectors = embed(keyed, "content").select("id", F.col("v").alias("embedding"))
    queries = spark.createDataFrame([(1, "what is a trader"), (2, "Article 2")], "query_id long, query string")
    for mode in ("semantic", "hybrid"):
        engine = SearchEngine(keyed, vectors, lambda q: embed(q, "query").withColumnRenamed("v", "vector"), mode)
        hits = engine.search(queries).join(keyed.select("id", "article"), "id").collect()
        assert {h["query_id"] for h in hits} >= {2} and all(h["article"] == "2" for h in hits if h["query_id"] == 2)


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", "m", "query", "q?", None), ("2024-01-02", "m", "info", "x", "{}")], "timestamp string, module string, level string, message string, data string")
    S.append_logs(rows, str(tmp_path / "logs"))
    (tmp_path / "logs/modules/bad.json").write_text("not json\n")
    assert S.read_logs(spark, str(tmp_path / "logs/modules")).count() == 2
    assert S.read_logs(spark, str(tmp_path / "logs/queries")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.streaming.logs import ingest_texts, windowed_kinds

    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a?"), ("2024-01-01 11:00:00", "article 3"), ("2024-01-02 10:00:00", "b"), ("2024-01-09 10:00:00", "z")], "ts string, m string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_kinds(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "m")
    q = stream.writeStream.format("memory").queryName("kinds").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("kinds").collect()) == sorted(windowed_kinds(rows, "ts", "m").where("window_start < '2024-01-09'").collect())
    (tmp_path / "texts").mkdir()
    for n in ("a", "b"):
        (tmp_path / f"texts/{n}.txt").write_text(n)
        ingest_texts(spark, str(tmp_path / "texts"), str(tmp_path / "table"), str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == ["a", "b"]


def test_bm25_scores_in_the_tasks(spark):
    """Queries that ask the same are scored once, a few at a time; pairs of queries and documents meet in no join by term."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9))), "xy"[i % 2]) for i in range(60)] + [(99, None, "x")], "doc_id long, text string, kind string").repartition(3)
    asks = [(i, [["a", "b"], ["b", "a"], ["c", "c", "zz"], [], ["f"]][i % 5], [None, "x", "nosuch"][i % 3]) for i in range(30)]
    queries = spark.createDataFrame(asks, "query_id long, terms array<string>, wanted string")
    got = V.bm25(docs, queries, 4, filters=("wanted", "kind"), most_queries=2)
    assert "term#" not in got._jdf.queryExecution().optimizedPlan().toString()
    joined = V.bm25(docs, queries, 4, filters=("wanted", "kind"), most_terms=0)  # the way of many terms
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
