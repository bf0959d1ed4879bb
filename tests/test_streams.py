"""Streams that run again, frequent messages within their bounds, conversion by runs, and segmentation against the plain loop."""

import json
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import overview as O  # noqa: N812
from quillspark.sources import files as S
from quillspark.streaming import frequent as H
from quillspark.streaming import logs as L

LOG = "timestamp string, module string, level string, message string, data string"


def log_lines(folder, name, n, first=0):
    os.makedirs(folder, exist_ok=True)
    rows = [{"timestamp": f"2024-01-01 {i:05d}", "module": f"m{i % 3}", "level": "query" if i % 2 else "info", "message": f"text {i}"} for i in range(first, first + n)]
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_logs_are_written_once_whatever_happens(spark, tmp_path, monkeypatch):
    log_lines(tmp_path / "in", "a.json", 20)
    stream = lambda: L.fan_out(spark.readStream.schema(LOG).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    held = lambda name: sorted(r["message"] for r in S.read_logs(spark, str(tmp_path / "out" / name)).collect())
    append = S.append_logs

    def crash(logs, folder, batch=None):  # between the two logs
        logs.select("timestamp", "module", "level", "message", "data").write.mode("overwrite").json(f"{folder}/modules/batch={batch}")
        raise OSError("crashed")

    monkeypatch.setattr(L, "append_logs", crash)
    with pytest.raises(Exception, match="crashed"):
        stream().awaitTermination(120)
    monkeypatch.setattr(L, "append_logs", lambda *a: [append(*a), 1 / 0])  # behind both
    with pytest.raises(Exception, match="division"):
        stream().awaitTermination(120)
    monkeypatch.undo()
    for more in (0, 5, 0):
        if more:
            log_lines(tmp_path / "in", "b.json", more, 20)
        stream().awaitTermination(120)
    want = [f"text {i}" for i in range(25)]
    assert held("modules") == sorted(want) and held("queries") == sorted(want[1::2])
    again = spark.createDataFrame([("t", "m", "query", "q?", None)], LOG)
    for _ in range(2):
        S.append_logs(again, str(tmp_path / "two"), "one")
    assert S.read_logs(spark, str(tmp_path / "two/modules")).count() == S.read_logs(spark, str(tmp_path / "two/queries")).count() == 1


def messages(rng, n):
    return [(f"2024-01-0{rng.randint(1, 3)} {rng.randint(0, 23):02d}:00:00", f"m{int(rng.paretovariate(0.7))}") for _ in range(n)] + [(None, "x"), ("2024-01-01 00:00:00", None)]


def check_bounds(rows, exact, counters):
    n = Counter()
    for (day, _), c in exact.items():
        n[day] += c
    seen = set()
    for day, m, least, most, total in rows:
        assert total == n[day] and least <= exact[(day, m)] <= most and most - least <= total / (counters + 1)
        seen.add((day, m))
    for key, c in exact.items():
        assert key in seen or c <= n[key[0]] / (counters + 1)


def test_sketches_of_tables_and_streams_keep_their_bounds(spark, tmp_path):
    rows = messages(random.Random(3), 4000)
    events = spark.createDataFrame(rows, "ts string, m string").withColumn("ts", F.to_timestamp("ts"))
    exact = Counter((t[:10], m) for t, m in rows if t and m)
    plain = lambda df: [(str(r["window_start"])[:10], r["message"], r["least"], r["most"], r["n"]) for r in H.merged(df).collect()]
    for counters in (3, 20, 10_000):
        check_bounds(plain(H.sketch_table(events.repartition(3), "ts", "m", counters=counters)), exact, counters)
    # as a stream of four files; the last one moves the watermark behind the third day, and brings late rows that are dropped
    for i, part in enumerate([(by_time := sorted(rows, key=lambda r: r[0] or ""))[:2000], by_time[2000:], [("2024-01-09 00:00:00", "end")], [("2024-01-01 00:00:00", "late")] * 50 + [("2024-01-19 00:00:00", "end")]]):
        spark.createDataFrame(part, "ts string, m string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = H.sketch_stream(source, "ts", "m", counters=20, shards=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(300)
    got = [r for r in plain(spark.read.schema(H.SKETCH).parquet(str(tmp_path / "out"))) if r[0] < "2024-01-09"]
    check_bounds(got, exact, 20)
    assert "late" not in {r[1] for r in got}


def test_frequent_is_exact_on_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(F.timestamp_seconds(F.col("conv_id") * 40_000).alias("ts"), F.explode(F.split("text", " ")).alias("m"))
    exact = Counter((str(r["day"]), r["m"]) for r in rows.select(F.to_date("ts").alias("day"), "m").collect())
    n = Counter()
    for (day, _), c in exact.items():
        n[day] += c
    got = {(str(r["window_start"])[:10], r["message"]): (r["count"], r["n"]) for r in H.frequent(rows, "ts", "m", 0.03).collect()}
    assert got == {k: (c, n[k[0]]) for k, c in exact.items() if c >= 0.03 * n[k[0]]} and got


def test_conversion_by_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.pdf", b"one")
    put("b.pdf", b"BAD")
    put("c.txt", b"other")
    runs = S.Conversion(spark, str(tmp_path / "in"), str(tmp_path / "out"))

    def parse(data):
        if data == b"BAD":
            raise ValueError("unreadable")
        return data.decode().upper()

    assert runs.run(parse) == {"converted": 1, "skipped": 0, "failed": 1}
    assert runs.run(parse) == {"converted": 0, "skipped": 1, "failed": 1}
    put("d.pdf", b"four")
    with pytest.raises(Exception, match="cannot even"):  # a crash of the run is no failure of a file
        S.Conversion(spark, str(tmp_path / "in"), str(tmp_path / "out")).run(lambda data: (_ for _ in ()).throw(SystemExit("cannot even")))
    assert runs.run(lambda data: data.decode().lower()) == {"converted": 2, "skipped": 1, "failed": 0}
    assert runs.run(parse) == {"converted": 0, "skipped": 3, "failed": 0}
    assert sorted((r["stem"], r["content"], r["status"]) for r in runs.latest().collect()) == [("a", "ONE", "converted"), ("b", "bad", "converted"), ("d", "four", "converted")]
    done = spark.createDataFrame([("a",)], "stem string")
    assert sorted((r["stem"], r["status"]) for r in S.convert_files(spark, str(tmp_path / "in"), parse, done).collect()) == [("b", "failed"), ("d", "converted")]


def test_chunk_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "content": "x", "metadata": {"article": "1", "page": 2, "doc_code": "code_13"}}]))
    row = S.read_chunks_json(spark, str(tmp_path / "c.json")).first()
    assert (row["id"], row["metadata"]["page"], row["metadata"]["doc_code"], row["metadata"]["citation"]) == ("a", 2, "code_13", None)
    spark.range(3).write.saveAsTable("some_index")
    S.drop_index(spark, "default.some_index")
    assert not spark.catalog.tableExists("some_index")


MARK = re.compile(r"---\s*PAGE\s*(\d+)\s*---", re.IGNORECASE)


def plain_segment(text, keep, most=550, enough=500):
    """The loops over a whole text: headings at line starts, then numbers anywhere."""
    tidy = lambda s: re.sub(r"\s+", " ", MARK.sub(" ", s)).strip()

    def value(tag):
        m = re.fullmatch(r"(\d+)([A-Z]?)", tag)
        return int(m[1]) * 100 + (ord(m[2]) - 64 if m[2] else 0)

    name = lambda tag: re.sub(r"^0+(?=\d)", "", tag)
    marks = [(m.start(), int(m[1])) for m in MARK.finditer(text)]
    page = lambda at: next((p for s, p in reversed(marks) if s <= at), marks[0][1] if marks else 1)
    out, top = [], 0
    heads = list(re.finditer(r"(?m)^[\t ]*([0-9]{1,4}[A-Z]?)[\t ]*\.(?=[ \t\n]|\Z)", text))
    for k, m in enumerate(heads):
        body = text[m.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)]
        if not keep:
            body = "\n".join(_until_mark(body.split("\n")))
        if top < value(m[1]) <= most * 100 and tidy(body):
            top = value(m[1])
            out.append((name(m[1]), tidy(body), page(m.start())))
    if len(out) < enough:
        found = list(re.finditer(r"([0-9]{1,4}[A-Z]?)\s*\.", text))
        for k, m in enumerate(found):
            if not top < value(m[1]) <= most * 100:
                continue
            end = next((n.start() for n in found[k + 1 :] if value(n[1]) > value(m[1])), len(text))
            if tidy(text[m.end() : end]):
                top = value(m[1])
                out.append((name(m[1]), tidy(text[m.end() : end]), page(m.start())))
    return out


def _until_mark(lines):
    for line in lines:
        if MARK.search(line):
            return
        yield line


@pytest.mark.parametrize("keep", [True, False])
def test_segment_is_the_plain_loop(spark, keep):
    rng = random.Random(8)
    parts = ["{n}. ", "{n}A. ", "\n{n}. w", "\n 0{n} .\n", "see {n}. it", "{n} .", "word ", "\n", " ", "\n--- PAGE {n} ---\n", "600. big ", "\n900.", "-- page 2 --", "0. zero"]
    texts = ["1. one. see 5. five 4. four 7. seven", "5. 999. x 4. four", "- 1. foo", "", "1. a\n5. 999. y\n3. b"]
    texts += ["".join(rng.choice(parts).replace("{n}", str(rng.randint(0, 30))) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, content string")
    got: dict = {i: [] for i in range(len(texts))}
    for r in D.segment(docs, "k", keep_after_markers=keep).orderBy("k", "position").collect():
        got[r["k"]].append((r["article"], r["content"], r["page"]))
    for i, text in enumerate(texts):
        assert got[i] == plain_segment(text, keep), text


def test_overviews_of_a_model_that_fails(spark):
    queries = spark.createDataFrame([(1, "a?", None), (2, "b?", None)], "query_id long, query string, intent string")
    hits = spark.createDataFrame([(q, 1, 0.9, "D", "Art. 1", "1", "2", "Text.") for q in (1, 2)], "query_id long, rank int, score double, document string, citation string, article string, page string, content string")

    def model(prompt):
        if "b?" in prompt:
            raise OSError("down")
        return "An answer."

    rows = {r["query_id"]: r for r in O.overviews(queries, hits, O.by_model(model)).collect()}
    assert (rows[1]["overview"], rows[1]["confidence"], len(rows[1]["citations"])) == ("An answer.", 0.9, 1)
    assert "down" in rows[2]["overview"] and (rows[2]["confidence"], rows[2]["citations"]) == (0.0, [])
