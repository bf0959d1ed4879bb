"""Vector search, the cell index and the inverted index against plain versions."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as V
from quillspark.operators.vectors import approximate_nearest, nearest
from quillspark.sources.cells import CellIndex
from quillspark.sources.postings import TermIndex
from quillspark.sources.versions import Versions


def plain_nearest(queries, vectors, k, filtered=False):
    """Every query against every vector, in plain Python."""

    def direction(x):
        if not x or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            return None
        top = max(map(abs, x))
        norm = math.sqrt(sum((v / top) ** 2 for v in x))
        return [v / top / norm for v in x]

    out = []
    for q, x, wanted in queries:
        hits, a = [], direction(x)
        for key, y, kind in vectors:
            b = direction(y)
            if key is None or a is None or b is None or len(a) != len(b) or (filtered and wanted is not None and wanted != kind):
                continue
            hits.append((-round(1 / (2 - sum(p * r for p, r in zip(a, b, strict=True))), 9), key))
        out += [(q, key, rank + 1) for rank, (_, key) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def vector_rows(rng, as_id, n=90):
    gauss = lambda d: [rng.gauss(0, 1) for _ in range(d)]
    rows = [(as_id(i), gauss(8), rng.choice("abc")) for i in range(n)]
    rows += [(as_id(n + i), list(rows[i][1]), "a") for i in range(6)]  # equal vectors: ties by id
    bad = [None, [], [0.0] * 8, [0.0] * 8, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] * 8, [1.0, None] + [1.0] * 6]
    rows += [(as_id(500 + i), x, "b") for i, x in enumerate(bad)]
    rows += [(as_id(600 + i), gauss(5), None) for i in range(7)] + [(as_id(700), [1e200] + [0.0] * 7, "a"), (as_id(701), [1e-200] * 8, "c")]
    return rows + [(None, gauss(8), "a")]


def vector_queries(rows):
    some = [(i, x, w) for i, (_, x, w) in enumerate(rows) if i % 6 == 0 or i > 95]
    return [(i, x, None if i % 4 == 0 else w) for i, x, w in some] + [(999, [1.0] * 3, None)]


@pytest.mark.parametrize("as_id", [int, lambda i: f"doc_{i:04d}#é"], ids=["numbers", "strings"])
@pytest.mark.parametrize("most", [10_000, 2], ids=["sent", "dealt"])
@pytest.mark.parametrize("filtered", [False, True])
def test_nearest_is_the_plain_search(spark, as_id, most, filtered):
    rows = vector_rows(random.Random(4), as_id)
    kind = "long" if as_id is int else "string"
    vectors = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, label string").repartition(4)
    queries = spark.createDataFrame(vector_queries(rows), "query_id long, vector array<double>, wanted string")
    got = nearest(queries, vectors, 5, filters=("wanted", "label") if filtered else None, most_queries=most, cell_queries=7)
    assert dict(got.dtypes)["id"] == ("bigint" if as_id is int else "string")
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == plain_nearest(vector_queries(rows), rows, 5, filtered)
    # one batch or many: what a batch without a direction holds doesn't matter
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        again = nearest(queries, vectors, 5, filters=("wanted", "label") if filtered else None, most_queries=most, cell_queries=7)
        assert sorted(again.collect()) == sorted(got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dealt_queries_read_each_table_once_and_collect_no_vector(spark, tmp_path):
    rows = vector_rows(random.Random(4), int)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    queries = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    plan = nearest(queries, vectors, 5, most_queries=3, cell_queries=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_approximate_nearest_on_hard_vectors(spark):
    rows = vector_rows(random.Random(4), str)
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    queries = spark.createDataFrame(vector_queries(rows), "query_id long, vector array<double>, wanted string").drop("wanted")
    got = {(r["query_id"], r["id"]) for r in approximate_nearest(queries, vectors, 5, bucket=2.0, tables=16, least_cosine=-1.0).collect()}
    want = {(q, key) for q, key, _ in plain_nearest([(q, x, None) for q, x, _ in vector_queries(rows) if x and len(x) == 8], rows, 5)}
    assert len(got & want) >= 0.9 * len(want) and all(key is None or int(key) < 600 or int(key) >= 700 for _, key in got)


def test_cells(spark, tmp_path):
    rows = vector_rows(random.Random(4), lambda i: f"v{i}")
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string").repartition(4)
    queries = spark.createDataFrame(vector_queries(rows), "query_id long, vector array<double>, wanted string")
    index = CellIndex(spark, str(tmp_path / "cells"))
    assert not index.exists()
    index.build(vectors, keep=("label",), cells=6, recall=0.9, probe_k=5)
    plain = plain_nearest(vector_queries(rows), rows, 5)
    as_rows = lambda df: sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())
    # every cell: the exact search, filtered too
    assert as_rows(index.search(queries, 5, probes=99)) == plain
    assert as_rows(index.search(queries, 5, probes=99, filters=("wanted", "label"))) == plain_nearest(vector_queries(rows), rows, 5, True)
    found = {r[:2] for r in as_rows(index.search(queries, 5))}
    assert len(found & {r[:2] for r in plain}) >= 0.85 * len(plain)
    # a query reads the folders of its cells only
    one = index.search(queries.where("query_id = 0"), 5, probes=1)
    assert "PartitionFilters: [cell#" in one._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell", "cell")
    # every row with a direction is there, once
    good = sum(key is not None and bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x) for key, x, _ in rows)
    assert index.open().count() == good == index.centres().agg(F.sum("n")).first()[0]


def test_a_build_from_the_index_itself_and_a_crash(spark, tmp_path, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "a") for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    index = CellIndex(spark, str(tmp_path / "cells")).build(vectors, cells=3)
    monkeypatch.setattr(CellIndex, "_probes", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.build(vectors.limit(3), cells=2)
    monkeypatch.undo()
    assert index.open().count() == 40
    index.build(index.open(), "id", "vector", cells=4)
    assert index.open().count() == 40 and index._state()["number"] == 1
    state = index._state()
    assert len(index.versions.clean(state["rows"], state["centres"])) == 4 and index.open().count() == 40
    empty = CellIndex(spark, str(tmp_path / "none")).build(vectors.limit(0))
    assert empty.search(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 3).count() == 0


def test_versions_of_two_writers(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "x"))
    assert v.current() is None
    v.publish({"a": 1}, None)
    v.publish({"a": 2}, 0)
    with pytest.raises(RuntimeError):
        v.publish({"a": 3}, 0)
    assert v.current() == {"a": 2, "number": 1}


def text_rows(rng, as_id, n=300):
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    rows = [(as_id(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), rng.choice(["x", "y", None])) for i in range(n)]
    return rows + [(as_id(1000), None, "x"), (as_id(1001), "", "x"), (as_id(1002), "!!", "y"), (None, "w1 w2", "x")]


@pytest.mark.parametrize("as_id", [int, lambda i: f"c{i:05d}"], ids=["numbers", "strings"])
def test_postings_give_what_bm25_gives(spark, tmp_path, monkeypatch, as_id):
    from quillspark.sources import postings

    monkeypatch.setattr(postings, "STRETCH", 16)
    rows = text_rows(random.Random(2), as_id)
    docs = spark.createDataFrame(rows, f"doc_id {'long' if as_id is int else 'string'}, text string, kind string")
    asks = [("a", ["w1", "w2", "w2"], None), ("b", ["w90", "w1"], "x"), ("c", ["nosuch"], None), ("d", ["w3"], "nokind"), ("e", [], None), ("f", ["w120", "w5", "w7"], "y")]
    queries = spark.createDataFrame(asks, "query_id string, terms array<string>, wanted string")
    index = TermIndex(spark, str(tmp_path / "terms")).build(docs, kind_col="kind", buckets=8)
    as_rows = lambda df: sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())
    for k, first in ((5, 1), (400, 2)):
        want = as_rows(V.bm25(docs, queries, k, filters=("wanted", "kind")))
        assert as_rows(V.bm25(docs, queries, k, filters=("wanted", "kind"), most_terms=1)) == want
        assert as_rows(index.search(queries, k, filter_col="wanted", first=first)) == want and want
        assert as_rows(index.search(queries, k, filter_col="wanted", first=first, most_terms=2)) == want
    plan = index.search(queries.where("query_id = 'a'"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert TermIndex(spark, str(tmp_path / "none")).build(docs.limit(0)).search(queries, 5).count() == 0
    # a new build is switched in at its end
    assert index.build(docs.where("kind = 'x'"), kind_col="kind").blocks().where("term = ''").count() == 1 and index._state()["number"] == 1


def test_postings_are_shuffled_in_blocks(spark, tmp_path):
    """Less is shuffled for a build than single postings would take, and no posting is for a search."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(150)), None) for i in range(4000)], "doc_id long, text string, kind string").repartition(2, "doc_id").cache()
    n = docs.selectExpr("sum(size(array_distinct(split(text, ' '))))").first()[0]

    def written():
        time.sleep(1)
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    index = TermIndex(spark, str(tmp_path / "terms")).build(docs)
    built = written()
    assert built - before < 6 * n
    assert index.blocks().selectExpr("sum(n)").first()[0] == n + 1
    queries = spark.createDataFrame([(1, [f"w{i}" for i in range(100)])], "query_id long, terms array<string>")
    at = written()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = index.search(queries, 5).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert written() - at < 2 * n
    assert [(r["id"], r["score"]) for r in hits] == [(r["id"], r["score"]) for r in V.bm25(docs, queries, 5).collect()]


def test_dealt_vectors_move_once(spark, tmp_path):
    """However few queries are compared at a time, only queries are repeated, once for each part of the vectors."""
    rows = vector_rows(random.Random(4), int)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    queries = spark.createDataFrame(vector_queries(rows), "query_id long, vector array<double>, wanted string")
    got = nearest(queries, vectors, 5, most_queries=0, cell_queries=1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == plain_nearest(vector_queries(rows), rows, 5, False)


def test_all_cells_are_not_asked_one_by_one(spark, tmp_path):
    """A search of all cells repeats no query for each of them."""
    rows = vector_rows(random.Random(4), int)
    index = CellIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), keep=("label",), cells=20)
    queries = spark.createDataFrame(vector_queries(rows), "query_id long, vector array<double>, wanted string")
    got = index.search(queries, 5, probes=1 << 30, filters=("wanted", "label"))
    assert "cell#" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == plain_nearest(vector_queries(rows), rows, 5, True)
