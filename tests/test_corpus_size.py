"""What a corpus and its search shuffle: no texts, no postings with their ids, no pairs of queries and chunks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import retrieval as V
from quillspark.sources.cells import CellIndex
from quillspark.sources.postings import TermIndex

ODD = [
    "", "\n", "no heading", "1. one\ntwo\n--- PAGE 4 ---\n2. three\n2. again\n1. less\n10A. last", "--- PAGE 7 ---\nx\n1.\n\n2. \n --- page 8 --- \n3. c --- PAGE 9 ---\nd\n4. e\n551. f\n5. g",
    "3. a --- PAGE 99999999999 ---\nb\n3A. c\n003B. d\n4.e\n 4. f\n\t5 . g\r\n6. h", "7. \n8. x\n7. y\n9. --- PAGE 2 ---", None, "0. zero\n1. é 1. not\n12345. no\n2. end\n",
]


@pytest.mark.parametrize("most", [550, 5])
def test_texts_are_segmented_in_their_rows(spark, most):
    rng = random.Random(3)
    parts = [x for t in ODD if t for x in t.split("\n")]
    texts = ODD + ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, content string")
    got = D.segment(docs, "k", inline_headings=False, most=most, unique=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = D.segment(docs, "k", inline_headings=False, most=most)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_postings_name_documents_by_places_and_pairs_stay(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"code_13#{i:09d}_regulation_{rng.randrange(10**6)}_p1_pos3_chunk_2", " ".join(rng.choice(words) for _ in range(100)) + " all" * rng.choice([1, 1, 300]), rng.choice(["x", "y"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, kind string").repartition(2, "doc_id").cache()
    n = docs.selectExpr("sum(size(array_distinct(split(text, ' '))))").first()[0]

    def written():
        time.sleep(1)
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    index = TermIndex(spark, str(tmp_path / "terms")).build(docs, kind_col="kind")
    assert written() - before < 4 * n  # an id alone has 40 bytes or more
    # the first two of 400 queries ask the same
    asks = [(i, ["all", words[i // 2], words[-i - 1 if i > 1 else 7]] if i < 300 else ["all", words[i - 300], words[i - 200]], "x" if i % 4 // 2 else None) for i in range(400)]
    queries = spark.createDataFrame(asks, "query_id long, terms array<string>, wanted string")
    before = written()
    as_rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    got = as_rows(index.search(queries, 5, filter_col="wanted"))
    assert written() - before < 2 * 400 * 3000  # "all" alone makes that many pairs
    assert got == as_rows(V.bm25(docs, queries, 5, filters=("wanted", "kind")))
    assert len(got) == 400 * 5
    # an index of an older layout counts as none, so that a corpus builds it anew
    index.versions.publish({k: v for k, v in index._state().items() if k != "layout"}, 0)
    assert not index.exists()


def test_all_cells_are_read_by_few_tasks(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "a") for i in range(600)]
    index = CellIndex(spark, str(tmp_path / "cells")).build(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), cells=120, recall=0.5, probe_k=3)
    queries = spark.createDataFrame(rows[:10], "query_id long, vector array<double>, label string")
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a cell's file is as much as a task reads
    try:
        assert index.open().rdd.getNumPartitions() > tasks
        got = index.search(queries, 3, probes=1 << 30)
        assert f"Coalesce {tasks}" in got._jdf.queryExecution().executedPlan().toString()
        want = V.nearest(queries.select("query_id", "vector"), index.open().select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
