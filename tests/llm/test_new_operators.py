"""Sort-means, periodic runs and line dedup: plain versions, hard rows, and what a filter may and may not do."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, periodic_runs, sort_means


# -- sort-means
def plain_means(rows, k, rounds):
    """Every vector against every centroid, in whole numbers of Python."""
    kept = []
    for key, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and v - v == 0 for v in x):
            kept.append((key, [int(np.floor(256 * float(v))) for v in x]))
    by_hash = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[1])
    centroids = [list(v) for _, v in sorted(kept, key=by_hash)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    done = [(key, *near(v)[::-1]) for key, v in kept]
    inertia = [sum(d for _, c, d in done if c == i) for i in range(len(centroids))]
    return sorted(((key, c, d, inertia[c], sum(inertia)) for key, c, d in done), key=str), centroids


def vectors(rng, n, spread):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [v + rng.gauss(0, spread) for v in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "spread", "size"), [(150, 12, 0.3, 1), (60, 9, 0.02, 1), (40, 6, 1.0, 10_000), (5, 40, 1.0, 1)])
def test_sort_means_is_the_plain_loop(spark, n, k, spread, size):
    rows = [(i, [v * size for v in x]) for i, x in vectors(random.Random(n), n, spread)]
    hard = [(None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [1.0] * 63 + [None]), (904, [float("inf")] + [0.0] * 63), (905, []), (906, [0.0] * 64)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows + hard], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    out, centroids = sort_means.sort_means(frame, k=k)
    want, middle = plain_means(rows + hard, k, 5)
    assert sorted((tuple(r) for r in out.drop("v").collect()), key=str) == want
    assert centroids.tolist() == middle
    assert sort_means.centroid_digest(centroids)[0] == hashlib.sha256(",".join(map(str, middle[0])).encode()).hexdigest()


def test_sort_means_ties_and_no_rows(spark):
    x = np.array([[0, 0], [2, 0], [1, 0], [1, 5], [9, 9]])
    centroids = np.array([[0, 0], [2, 0], [0, 0]])
    order, apart = sort_means.neighbours(centroids)
    for start in range(3):  # whichever it starts from, the first of equally near ones
        assert sort_means.assign(x, np.full(5, start), centroids, order, apart)[0].tolist() == [0, 1, 0, 0, 1]
    out, centroids = sort_means.sort_means(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert out.columns == ["vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia"] and out.count() == 0 and len(centroids) == 0
    too_far, _ = sort_means.sort_means(spark.createDataFrame([(1, [1e300] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<double>"))
    assert [r["vec_id"] for r in too_far.collect()] == [2]


# -- periodic runs
def plain_runs(ids, exponent=4, least=6):
    n, out = len(ids), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(ids[x] == ids[x + p] for x in range(i, j + q - p)) for p in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looping(rng):
    ids = []
    for _ in range(rng.randint(0, 5)):
        part = [rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(1, 14))]
        times = rng.choice([1, 2, 3, 4, 5, 9])
        ids += (part * times)[: rng.randint(1, len(part) * times)]
    return ids


@pytest.mark.parametrize("exponent", [2, 3, 4, 5])
def test_runs_are_those_of_the_plain_search(exponent):
    rng = random.Random(exponent)
    for _ in range(700):
        ids = looping(rng)
        assert periodic_runs.find_runs(np.array(ids, dtype=np.int64), exponent) == plain_runs(ids, exponent), ids


def test_runs_in_long_texts():
    rng = random.Random(1)
    assert periodic_runs.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    noise = lambda n: [rng.randint(10, 10_000) for _ in range(n)]
    part = noise(4_321)
    ids = np.array([1, *noise(50_000), *part * 4, part[0], 2, *noise(60_000), *[3, 4] * 40, 5], dtype=np.int64)
    assert periodic_runs.find_runs(ids) == [(50_001, 4 * 4_321 + 1, 4_321), (127_287, 80, 2)]


def test_best_run_and_what_stays():
    assert periodic_runs.strongest([(0, 8, 2), (4, 16, 4), (9, 6, 1), (20, 12, 2)]) == (9, 6, 1)
    assert periodic_runs.strongest([]) is None
    words = b"x a b a b a b a b a y".split()
    assert b" ".join(periodic_runs.collapsed(words, periodic_runs.find_runs(periodic_runs.numbered(words)))) == b"x a b y"


def test_periodic_rows(spark):
    texts = [None, "", " \n", "w", "Ab\x0bab " * 4, "é é é é é é", "one two " * 6, "x y " * 5 + "z", "a b c " * 5, "no loop in here at all"]
    rows = [(i if i != 5 else None, t, 7, [1]) for i, t in enumerate(texts)] + [(8, "a b c " * 5, 7, [1])]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs array<int>")).collect()
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        runs = plain_runs([words.index(w) for w in words])
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        dropped = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i, len(words), runs, best, b" ".join(w for x, w in enumerate(words) if x not in dropped).decode()))
    as_tuple = lambda r: r and (r["start"], r["length"], r["period"])
    assert sorted(((r["doc_id"], r["n_words"], list(map(as_tuple, r["runs"])), as_tuple(r["strongest"]), r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_looped_tail():
    import zlib

    doc_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(doc_id).encode()) // 10
    words = [b"%d" % i for i in range(101)]
    a, p = g % 101, 1 + (101 - g % 101) // (3 + g % 8)
    assert periodic_runs.looped_tail(doc_id, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(101)]
    assert periodic_runs.looped_tail(doc_id, []) == [] and periodic_runs.looped_tail(None, words) == words


# -- lines
def plain_lines(rows, least=20, documents=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    of = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                of.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        last = lambda x: max(of[key(x)], key=lambda j: -1 if j is None else j)
        kept = [x for x in lines if len(key(x)) < least or len(of[key(x)]) < documents or last(x) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(5)
    pool = [f"line number {i} that some documents share {'é' * (i % 3)}" for i in range(25)] + ["short", "", "x" * 19, "é" * 20, "É" * 20, "A" * 20, " " + "b" * 20, "  "]
    change = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r", f"\x0b{x}\x0c"])
    rows = [(i, "\n".join(change(rng.choice(pool)) if rng.random() < 0.7 else f"own line of document {i} {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return rows + [(100 + i, "one very common line, held by all") for i in range(80)] + [(200, None), (201, ""), (3, rows[4][1]), (3, rows[4][1]), (5, rows[6][1] + "\n"), (None, rows[7][1]), (None, rows[8][1]), (202, "z" * 200_000 + "\n" + pool[0])]


def test_lines_are_dropped_as_in_the_plain_version(spark):
    rows = line_rows()
    frame = spark.createDataFrame([(*r, "c", "k") for r in rows], "doc_id long, text string, row string, key string").repartition(5)
    answer = lambda **options: sorted((tuple(r) for r in line_dedup.drop_repeated_lines(frame, **options).collect()), key=str)
    assert answer() == plain_lines(rows)
    assert answer(documents=2, least=5) == plain_lines(rows, 5, 2)
    assert line_dedup.drop_repeated_lines(frame.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that takes every line for a repeat costs a shuffle and no result."""
    rows = line_rows()
    monkeypatch.setattr(line_dedup.SeenTwice, "suspects", lambda self, hashes: np.ones(len(hashes), dtype=bool))
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines(rows)


def test_filters_miss_no_repeat_and_sift_the_rest(spark):
    rows = [(f"line that is held once, number {i}\n" + f"line that is held twice, number {i // 2}",) for i in range(20_000)]
    bits = 1 << 20
    found = line_dedup.twice_seen(spark.createDataFrame(rows, "t string").select(F.col("t").cast("binary")).repartition(4), bits, 20)
    hashes = lambda part, n: line_dedup._hashes([f"line that is held {part}, number {i}".encode() for i in range(n)])
    assert found.suspects(hashes("twice", 10_000)).all()
    assert found.suspects(hashes("once", 20_000)).mean() < 0.02
    piece = np.random.default_rng(1).integers(0, 256, line_dedup.PIECE // 8).astype(np.uint8)
    for p in (piece, piece * 0, piece & (np.arange(len(piece)) % 900 == 0)):
        assert np.array_equal(line_dedup._unpacked(line_dedup._packed(p.astype(np.uint8))), p)
