"""Exact dedup, mixing, scratch tables and the pipeline as a whole."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark.llm import bytebpe, common, exact_dedup, mixing, toxicity


def test_a_batch_may_be_absorbed_again(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, "c", True) for i, t in rows], "doc_id long, text string, keep_id string, kept boolean")
    first, second = frame([(1, "a"), (2, "a "), (None, "b"), (3, "b"), (4, None)]), frame([(5, "a"), (6, "new"), (6, "new")])
    answer = lambda out: sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()), key=str)
    index = exact_dedup.DigestIndex(spark, buckets=3)
    try:
        one = answer(index.absorb(first, batch="one"))
        assert one == sorted([(1, 2, 2, False), (2, 2, 2, True), (None, None, 2, True), (3, None, 2, False), (4, 4, 1, True)], key=str)
        two = answer(index.absorb(second, batch="two"))
        assert two == [(5, 2, 1, False), (6, 6, 2, True), (6, 6, 2, True)]
        assert answer(index.absorb(first, batch="one")) == one and answer(index.absorb(second, batch="two")) == two
        assert index.table().count() == 4 and index.table().select("text_sha256").distinct().count() == 4
        # the same data as new data: nothing is kept
        assert not any(kept for *_, kept in answer(index.absorb(first)))
    finally:
        index.drop()
    assert not os.path.exists(index.path) and not index.exists()


def test_very_long_texts_are_told_apart_to_their_ends(spark):
    long = "word and more " * 200_000
    rows = [(1, long + "a"), (2, long + "b"), (3, "\t" + long + "a "), (4, long + "a")]
    index = exact_dedup.DigestIndex(spark, buckets=2)
    try:
        got = index.absorb(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        index.drop()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 3, 3, False), (2, 2, 1, True), (3, 3, 3, True), (4, 3, 3, False)]


def test_rank_and_slot_are_those_of_a_plain_sort(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 700), rng.choice([None, "a", "a", "b", "c"])) for _ in range(900)]  # repeated ids are ties
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(frame, {"b": 3.0, None: 0.0}, block_docs=4, bucket_docs=30).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("doc_id", "source"))).collect()
    counts, by_source = {}, {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    names = sorted(counts, key=lambda s: "null" if s is None else f"={s}")
    wanted = [{"b": 3.0, None: 0.0}.get(s, counts[s] ** 0.5) for s in names]
    slots = {(names[i], j): slot for i, j, slot in mixing.plan(wanted, [-(-counts[s] // 4) for s in names])}
    for s, own in by_source.items():
        buckets = -(-len(own) // 30)
        # buckets follow the hash, inside them rows are sorted by hash and id
        order = sorted((((r["h"] & (1 << 64) - 1) >> 20) % buckets, r["h"], r["doc_id"]) for r in own)
        placed = sorted((r["block_"] * 4 + r["place_"], r["h"], r["doc_id"]) for r in own)
        assert [p[1:] for p in placed] == [o[1:] for o in order] and [p[0] for p in placed] == list(range(len(own)))
        assert all(r["slot_"] == slots[s, r["block_"]] for r in own)
    with pytest.raises(ValueError, match="finite"):
        mixing.mix(frame, {"a": -1.0})


def test_rows_without_ids_are_spread(spark, monkeypatch):
    frame = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.col("id").alias("other"))
    largest = {}
    call = common.Scratch.__call__

    def kept(self, df, name, keep=False):
        out = call(self, df, name, keep)
        if name == "bucket-sizes":
            largest[name] = out.agg(F.max("n_")).first()[0]
        return out

    monkeypatch.setattr(common.Scratch, "__call__", kept)
    rows = mixing.mix(frame, bucket_docs=100).collect()
    assert sorted(r["block_"] * 16 + r["place_"] for r in rows) == list(range(4000)) and len({r["other"] for r in rows}) == 4000
    assert largest["bucket-sizes"] < 160
    # rows that are equal in everything are told apart by what the caller names
    mixing.mix(frame.select(F.lit(None).cast("long").alias("doc_id"), "source", "other"), bucket_docs=100, tie=F.col("other")).count()
    assert largest["bucket-sizes"] < 160


def test_many_sources_and_files_in_order(spark):
    frame = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("source"))
    mixed = mixing.mix(frame)
    assert mixed.select("doc_id").distinct().count() == 9000 and mixed.groupBy("slot_").agg(F.countDistinct("source").alias("n")).where("n > 1").count() == 0
    ordered = mixing.in_mixed_order(mixing.mix(frame, block_docs=1))
    want = [r["doc_id"] for r in mixing.mix(frame, block_docs=1).orderBy("slot_", "place_").collect()]
    assert [r["doc_id"] for r in ordered.collect()] == want and ordered.columns == ["doc_id", "source"]
    assert mixing.in_mixed_order(mixing.mix(frame.limit(0))).count() == 0


def test_scratch_tables_are_deleted_but_for_those_a_result_reads(spark):
    with common.Scratch(spark, "test") as tmp:
        a, b = tmp(spark.range(3), "a"), tmp(spark.range(4), "b", keep=True)
        tmp.drop(a)
        c = tmp(spark.range(5), "c")
        assert c.count() == 5
    assert b.count() == 4 and len(os.listdir(tmp.root)) == 1
    with pytest.raises(ZeroDivisionError), common.Scratch(spark, "test") as tmp:
        tmp(spark.range(3), "a", keep=True)
        1 / 0  # noqa: B018
    assert not os.path.exists(tmp.root)


def test_no_folder_of_one_machine_on_a_cluster():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(cluster)
    cluster.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert common.shared_dir(cluster) == "hdfs:///shared"


def plain_pipeline(docs, labels):
    """Rows that come through all stages, by plain Python: (id, ids of the text and its end)."""
    import zlib

    toxic = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            toxic[i] = max(y, toxic.get(i, 0))
    sample = sorted({(i, toxic[i], min(t or "" for j, t in docs if j == i)) for i, _ in docs if i in toxic})
    model = toxicity.fit_texts([t for *_, t in sample], [y for _, y, _ in sample])
    scorer = toxicity.Scorer(model)
    rows = [(i, t) for i, t in docs if scorer.score(t or "") < 0.7]
    assert len(rows) < len(docs)
    squeeze = lambda t: "".join((t or "").split(" ")).translate({c: None for c in range(9, 14)})
    best = {}
    for i, t in rows:
        rank = (-len(t or ""), i is not None, i or 0)
        if squeeze(t) not in best or rank < best[squeeze(t)][0]:
            best[squeeze(t)] = (rank, i, t)
    rows = [(i, t) for _, i, t in best.values()]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)} if w else set())
    part = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    import hashlib

    kept = {}
    for p, (i, t) in zip(part, rows, strict=True):
        rank = (i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        kept[p] = min(kept.get(p, (rank, i, t)), (rank, i, t), key=lambda x: x[0])
    coder = bytebpe.id_coder(bytebpe.byte_bpe_path())
    return sorted(((i, len(coder.ids(t or "")) + 1) for _, i, t in kept.values()), key=str)


def test_the_pipeline_is_a_plain_version_of_it(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    fill = [f"word{k}" for k in range(300)]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(fill) for _ in range(40))
        if i % 6 == 0:
            text = f"{text[:100]}. you zorgling. {text[100:]}"
        docs.append((i, text))
    base = docs[1][1]
    docs += [(None, base + " "), (None, docs[2][1]), (None, None), (900, ""), (901, base + " tail"), (902, docs[3][1]), (902, docs[4][1]), (5, docs[5][1]), (7, docs[8][1] + " more"), (7, "another text altogether, all by itself here"), (903, "clean   text"), (904, "clean text")]
    long = " ".join(rng.choice(fill) for _ in range(2500))  # several sequences, in pieces
    docs += [(905, long), (906, long + " end")]
    labels = [(i, int(i % 6 == 0)) for i in range(150)] + [(None, 1), (3, None)]
    spark.createDataFrame([(i, t, "en", rng.choice([None, "a", "b"]), len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    whole = sorted((key for key, parts in pieces.items() for _ in range(sum(n for _, n in parts) // key[1])), key=str)
    assert whole == plain_pipeline(docs, labels)
    # empty tables come through as well
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
