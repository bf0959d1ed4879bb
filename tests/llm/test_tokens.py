"""Token counts and packing."""

import random
import time

import numpy as np
import pytest

from quillspark.llm import bytebpe, packing, token_counts

PATH = bytebpe.byte_bpe_path()
ALPHABET = [" ", "  ", "\n", "\t", "\x85", "\x1c", "'s", "'ll", "'r", "it'", "a", " the", "é", "中", "1", "²", "!", "<|endoftext|>", "<|endo", "ing", "Hello", "\r\n", " ", " word", "\nThe"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_counts_and_cuts_of_random_texts(spark, library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7), (3, texts[3], 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    prefixes = {t: [len(library(t[:i])) for i in range(len(t) + 1)] for t in {r[1] or "" for r in rows}}
    for limit in (0, 2, 5):
        got = token_counts.token_counts(frame, PATH, limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            t = texts[r["doc_id"]] if r["doc_id"] is not None else ""
            assert (r["n_tokens"], r["cut_chars"]) == (prefixes[t][-1], max(i for i, n in enumerate(prefixes[t]) if n <= limit))
            assert r["over_limit"] == (r["n_tokens"] > limit)
    cut = {(r["doc_id"], r["text"], r["n_tokens"]) for r in token_counts.truncate_to_budget(frame, PATH, 2).collect()}
    for i, t, _ in rows:
        end = max(k for k, n in enumerate(prefixes[t or ""]) if n <= 2)
        assert (i, (t or "")[:end], prefixes[t or ""][end]) in cut
    table = {r["doc_id"]: r["prefix_tokens"] for r in token_counts.prefix_token_counts(frame.limit(40), PATH).collect()}
    assert all(table[i] == prefixes[texts[i]] for i in table)
    assert token_counts.truncate_to_budget(frame.limit(0), PATH, 2).count() == 0


def test_long_runs(library):
    coder, counter = bytebpe.IdCoder(PATH), bytebpe.PrefixCounter(PATH)
    assert coder.fast is not None
    for t in ("ab" * 3000, " " * 5000 + "x", "中文" * 2000 + " end", "a " * 4000, "-" * 3000):
        want = library(t)
        assert coder.ids(t).tolist() == want and counter.count(t) == len(want)
        n, cut = counter.count_and_cut(t, 500)
        assert n == len(want) and len(library(t[:cut])) <= 500


def replay(placed, examples, tokens, segments, loss_tokens):
    """Follow the placements and look at every example each time: the best that fits is taken, else the longest is cut."""
    left = {k: [0, n, loss] for k, n, loss in examples}
    rest = lambda k: left[k][1] - left[k][0]
    bear = lambda k, size: sum(left[k][2][left[k][0] : left[k][0] + size])
    free, bins = [0, 0, 0], -1
    best_cut = lambda k: max(s for s in range(min(free[0], rest(k)) + 1) if bear(k, s) <= free[2])
    fits = lambda: [k for k in left if rest(k) <= free[0] and bear(k, rest(k)) <= free[2]]
    for key, start, ids, n, b, offset, bearing in placed:
        if b != bins:
            assert b == bins + 1 and offset == 0
            assert not free[0] or not free[1] or not fits()
            waiting = sum(map(rest, left))
            bins, room = b, tokens if waiting >= tokens else 1 << (waiting.bit_length() - 1)
            free, at = [room, segments, loss_tokens], 0
        assert offset == at and start == left[key][0] and n == left[key][1] and free[1] > 0
        if some := fits():
            match = lambda k: rest(k) * free[0] / tokens**2 + bear(k, rest(k)) * free[2] / loss_tokens**2
            assert len(ids) == rest(key) and match(key) >= max(map(match, some)) - 1e-12
        else:
            assert rest(key) == max(map(rest, left)) and len(ids) == best_cut(key) > 0
        assert bearing == bear(key, len(ids))
        at += len(ids)
        free = [free[0] - len(ids), free[1] - 1, free[2] - bearing]
        left[key][0] += len(ids)
        if not rest(key):
            del left[key]
    assert not left


def bins_of(placed):
    bins = {}
    for r in placed:
        bins.setdefault(r[4], []).append(r)
    return list(bins.values())


def test_packing_takes_the_best_of_all_under_three_limits():
    rng, bound = random.Random(4), set()
    for _ in range(25):
        tokens, segments, loss_tokens = rng.randint(20, 60), rng.randint(2, 6), rng.randint(6, 30)
        examples = []
        for k in range(rng.randint(1, 40)):
            n, head = rng.randint(1, tokens - 1), rng.randint(0, 30)
            examples.append((k, n, [int(i >= head) for i in range(n)]))
        packer = packing.VectorPacker(tokens, segments, loss_tokens)
        out = []
        for k, n, loss in examples:
            out += packer.add(k, np.arange(n), np.array(loss))
        out += packer.pack()
        assert sorted(p for r in out for p in r[2].tolist()) == sorted(i for _, n, _ in examples for i in range(n))
        for b in bins_of(out):
            used = sum(len(r[2]) for r in b), len(b), sum(r[6] for r in b)
            assert used[0] <= tokens and used[1] <= segments and used[2] <= loss_tokens
            bound |= {i for i, (u, most) in enumerate(zip(used, (tokens, segments, loss_tokens), strict=True)) if u == most}
        replay(out, examples, tokens, segments, loss_tokens)
    assert bound == {0, 1, 2}  # each limit fills some bin


def test_many_short_examples_are_packed_fast_and_without_padding():
    packer, one, began = packing.VectorPacker(), np.zeros(1, dtype="<u4"), time.perf_counter()
    out = []
    for k in range(200_000):
        out += packer.add(k, one)
    out += packer.pack()
    assert time.perf_counter() - began < 20 and len(out) == 200_000
    lengths = [sum(len(r[2]) for r in b) for b in bins_of(out)]
    assert sum(packing.padded_length(n) - n for n in lengths) == 0


def test_pack_documents_with_nulls_repeats_clashes_and_prompts(spark, library):
    rows = [(None, None, "x"), (None, "a b", "x"), (1, "c d e", "x"), (1, "c d e", "x"), (2, "word " * 3000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(frame, PATH).collect()
    assert sum(r["length"] for r in got) == sum(len(library(t or "")) + 1 for _, t, _ in rows)
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] == 1) == [len(library("c d e")) + 1] * 2
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(packing.padded_length(n) - n for n in used.values()) == 0
    assert packing.pack_documents(frame.limit(0), PATH).count() == 0
    # instruction data: the prompt bears no loss, the answer and the end do
    chats = spark.createDataFrame([(k, "answer " * (k % 40), "prompt " * (k % 23)) for k in range(200)], "doc_id long, text string, ask string").coalesce(1)
    got = packing.pack_documents(chats, PATH, prompt_col="ask", max_tokens=128, max_segments=6, max_loss_tokens=90, with_ids=True).collect()
    assert sum(r["loss_tokens"] for r in got) == sum(len(library("answer " * (k % 40))) + 1 for k in range(200))
    bins = {}
    for r in got:
        assert len(r["ids"]) == r["length"]
        bins.setdefault(r["sequence_id"], []).append(r)
    used = [(sum(r["length"] for r in b), len(b), sum(r["loss_tokens"] for r in b)) for b in bins.values()]
    assert all(a <= 128 and b <= 6 and c <= 90 for a, b, c in used)
    assert {a == 128 for a, *_ in used} == {b == 6 for _, b, _ in used} == {c == 90 for *_, c in used} == {True, False}
