"""Near-duplicates: repeated ids, crowds and deep trees against brute force."""

import random

import numpy as np

from quillspark.llm import crosspoly, minhash_join


def brute_documents(rows, width, percent):
    """``(id, size, smallest id reachable)`` of each row, rows being vertices of their own."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least[find(a)] if i is not None else None) for a, (i, _) in enumerate(rows)]


def crowd_rows(rng, groups=10, crowd=90):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(crowd if g < 2 else rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(60)] = f"z{rng.randint(0, 9999)}"
            rows.append((rng.randint(0, 150), " ".join(w)))  # ids repeat
    return rows


def test_documents_with_repeated_ids_and_crowds(spark, monkeypatch):
    rng = random.Random(9)
    a, b = ("one two three four five six seven eight nine ten " * 3 + x for x in ("a", "b c d e f g h i j k l m"))
    rows = crowd_rows(rng) + [(1001, a), (1001, b), (1002, a + " "), (1003, b + " ."), (None, a), (None, a), (1004, None), (1005, ""), (1006, "word"), (1007, "WORD"), (1008, "long " + " ".join(f"v{k}" for k in range(30_000))), (1009, "longer " + " ".join(f"v{k}" for k in range(30_000)))]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, size int")
    want = sorted(brute_documents(rows, 2, 80), key=str)
    for more in ({}, {"first": 1, "trees": 24}):
        if more:  # nearly all nodes are large and lead on to deep ones; crowds are compared in many blocks
            monkeypatch.setattr(minhash_join, "LEAF", 6)
            monkeypatch.setattr(minhash_join, "BLOCK", 20)
        got = minhash_join.near_duplicates(frame, width=2, **more).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_chances_to_miss():
    # a tree of unbranched hashes would miss 1 - 0.8 ** depth
    assert abs(minhash_join.missed(0.8, 1) - 0.16) < 1e-9 and all(minhash_join.missed(0.8, d) < 1 - 0.8**d for d in range(2, 9))
    assert minhash_join.least_agreement(80) == 75 and minhash_join.least_agreement(100) == 128
    rng, met, agree = np.random.default_rng(5), 0, []
    for _ in range(400):  # pairs at exactly 0.8
        s = rng.integers(1, 1 << 63, 100, dtype=np.uint64)
        a, b = np.sort(s[:90]), np.sort(np.concatenate([s[:80], s[90:]]))
        tokens = np.stack([minhash_join.minwise(a), minhash_join.minwise(b)])
        agree.append((tokens[0] == tokens[1]).sum())
        doc, node, _ = minhash_join.paths(tokens, 1, 3)
        met += bool(set(node[doc == 0].tolist()) & set(node[doc == 1].tolist()))
    assert 0.57 < met / 400 < 0.72 and min(agree) >= 75 and abs(np.mean(agree) - 102.4) < 2


def brute_vectors(rows, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                near[a, b] = near[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    part = np.arange(len(rows))
    for _ in range(len(rows)):
        after = np.array([min([part[a], *part[near[a]]]) for a in range(len(rows))])
        if (after == part).all():
            break
        part = after
    least = {p: min(rows[a][0] for a in range(len(rows)) if part[a] == p and rows[a][0] is not None) for p in set(part.tolist()) if any(rows[a][0] is not None for a in range(len(rows)) if part[a] == p)}
    return [(i, int(near[a].sum()), None if i is None else least[part[a]] if ok[a] else i) for a, (i, _) in enumerate(rows)]


def test_vectors_with_repeated_ids_and_crowds(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(int(rng.integers(0, 60)), v.tolist()) for v in np.concatenate([base, base[:15] + 0.05 * rng.normal(size=(15, 16))])]
    rows += [(100 + k, (base[0] + 0.12 * rng.normal(size=16)).tolist()) for k in range(150)]  # more than a sifted bucket holds
    rows += [(700, base[20].tolist()), (700, base[21].tolist()), (701, (base[20] * 2).tolist()), (702, (base[21] * 3).tolist()), (None, base[22].tolist()), (703, None), (704, [0.0] * 16)]
    for kind in ("double", "float"):
        exact = [(i, None if v is None else [float(np.float32(x)) for x in v] if kind == "float" else v) for i, v in rows]
        frame = spark.createDataFrame([(i, v, 1) for i, v in exact], f"vec_id long, embedding array<{kind}>, slot int")
        got = crosspoly.near_duplicate_vectors(frame).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted(brute_vectors(exact, 0.95), key=str)


def test_shape_follows_the_number_of_vectors():
    shapes = [crosspoly.design(64, n, 0.95, 1e-6) for n in (2000, 50_000, 10**6, 10**8)]
    assert [s[1] for s in shapes] == [2, 3, 4, 5]
    for tables, hashes, probes in shapes[:2]:
        rng = np.random.default_rng(1)
        a = crosspoly._unit(rng.normal(size=(2000, 64)))
        b = rng.normal(size=(2000, 64))
        b = crosspoly._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
        family = crosspoly.hasher(64, tables, hashes, probes)
        x, y = family.buckets(a), family.buckets(b)
        assert ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2)).all()
        bits = np.unpackbits(crosspoly.sketches(a) ^ crosspoly.sketches(b), axis=1).sum(axis=1)
        assert bits.max() <= crosspoly.most_bits(0.95) and abs(bits.mean() - 25.9) < 1
