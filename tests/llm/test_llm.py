"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bytebpe, chat, crosspoly, exact_dedup, html_extract, langid, minhash_join, mixing, packing, token_counts, toxicity
from quillspark.llm.common import Scratch
from quillspark.llm.components import connected_components

PATH = bytebpe.byte_bpe_path()
ALPHABET = [" ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "'s", "'ll", "'r", "a", "the", "é", "中", "1", "²", "!", "...", "<|endoftext|>", "<|endo", "\U0001f600", "ing", "Hello", "\r\n", "_"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, rep string"


def text(rng, n=12):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_prefix_counts(library):
    rng, c, ids = random.Random(1), bytebpe.PrefixCounter(PATH), bytebpe.IdCoder(PATH)
    for _ in range(400):
        s = text(rng)
        assert c.count(s) == len(library(s)) and ids.ids(s).tolist() == library(s)
        assert [len(library(s[:i])) for i in range(len(s) + 1)] == c.prefix_counts(s).tolist()


def test_long_piece(library):
    s = "ab" * 3000
    assert bytebpe.PrefixCounter(PATH).count(s) == len(library(s))


def test_token_counts(spark, library):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "é" * 2000)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs(spark, rows), PATH).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 1024) for i, t in rows)
    assert token_counts.token_counts(docs(spark, rows).limit(0), PATH).count() == 0
    cut = token_counts.truncate_to_budget(docs(spark, [(1, "one two three four")]), PATH, 2).first()
    assert (cut["text"], cut["n_tokens"]) == ("one two", 2)


def test_packing(spark, library):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "b", "naïve", "123"]) for _ in range(rng.choice([0, 3, 50, 900, 5000])))) for i in range(120)] + [(500, None)]
    got = packing.pack_documents(docs(spark, rows), PATH, max_segments=20).collect()
    for i, t in rows:
        ids = np.array([*library(t or ""), 0], dtype="<u4")
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids) == parts[0]["doc_tokens"]
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and len(b) <= 20


def test_packing_limits():
    p, rng = packing.VectorPacker(100, 5, 30), np.random.default_rng(1)
    out = []
    for k in range(200):
        n = int(rng.integers(1, 250))
        out += p.add(k, np.arange(n), (rng.random(n) < 0.4).astype(np.int8))
    out += p.pack()
    bins = {}
    for r in out:
        bins.setdefault(r[4], []).append(r)
    assert all(sum(len(r[2]) for r in b) <= 100 and len(b) <= 5 and sum(r[6] for r in b) <= 30 for b in bins.values())


def test_exact_dedup_and_index(spark):
    rows = [(1, "a b"), (2, "a  b "), (3, None), (4, ""), (5, "c\n"), (6, "c\n"), (7, " c")]
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.absorb(docs(spark, rows)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.absorb(docs(spark, [(10, "ab"), (11, "new")])).collect()}
    assert again == {10: (2, False), 11: (11, True)} and index.table().count() == 5
    assert index.absorb(docs(spark, rows).limit(0)).count() == 0
    index.drop()


def test_digest_join_reads_index_without_shuffle(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.absorb(docs(spark, [(1, "a")]))
    plan = index.table().join(index.table().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    index.drop()


def test_chat_round_trip(spark):
    rng, template = random.Random(1), chat.compiled(chat.TEMPLATE)
    marks = [*chat.CONTROL, "\\", "<", "[", "s>", "INST]", "a", "é", "\n"]
    for _ in range(800):
        turns = [{"role": rng.choice(["user", "assistant", "", *marks]), "text": "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))} for _ in range(rng.randint(0, 4))]
        out, spans = template.render(turns)
        assert chat.turns_of(out) == [(m["role"], m["text"]) for m in turns]
        assert "".join(chat.unescape(out[a:b]) for a, b in spans) == "".join(m["text"] for m in turns if m["role"] == "assistant")
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part in (1, 4_000_000):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame, part_chars=part)).collect()}
        assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\n</s>\n").hexdigest() and got[1]["loss_chars"] == 4 and set(got) == {1, 2, None}


def test_templates():
    assert chat.fold(chat.parse("{% if 1 == 2 %}x{% else %}a{{ 'b' ~ 'c' | upper }}{% endif %}d")) == [chat.Text("abCd")]
    assert chat.Template("{% for m in messages %}{{ loop.index }}{% if not loop.first %},{% endif %}{{ m['text'] }}{% endfor %}").render([{"text": "x"}, {"text": "y"}])[0] == "1x2,y"
    for bad in ("{% for x in y %}", "{{ x | eval }}", "{{ x.y( }}", "{% import os %}", "{{ m.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    assert chat.Template("{{ m.role.upper }}").render([])[0] == ""


@pytest.mark.parametrize(("page", "want"), [
    ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One &amp; <b>two</b>\n three.<p>Four</article><footer>x y z</footer>", "T One & two three. Four"),
    ("<div class=ad>buy</div>", ""), ("", ""),
    ("<main><p>Words in the text here.</p><div class='comments'><p>first!</p></div></main>", "Words in the text here."),
    ("<article><p>a<script>var x = '</p>'</script>b</p></article>", "ab"),
])
def test_html(page, want):
    assert html_extract.extract(page, html_extract.learned_weights()) == want


@pytest.mark.parametrize(("markup", "want"), [
    ("<button>", "one two three four five"), ("<div><select><option>x</div>", "one two three four five"), ("<video-player src=a></video-player>", "one two three four five"),
    ("<title-bar>", "one two three four five"), ("<button>a <button>b</button>", "one two three four five"), ("<svg><g><text>no</text></g></svg>", "one two three four five"),
])
def test_html_unclosed_and_custom_elements_hold_nothing(markup, want):
    page = f"<body>{markup}<article><p>one two three</p><p>four five</p></article></body>"
    assert html_extract.extract(page, html_extract.learned_weights()).endswith(want)


def test_html_keeps_math_and_leaves_closed_controls_out():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<button>Copy <b>it</b></button> so<svg/> then<object><p>no</p></object>.</p></article>"
    assert html_extract.extract(page, html_extract.learned_weights()).replace(" ", "") == "Letx=1besothen."


def test_html_unseen_layouts():
    wrong = 0
    for page in html_extract.labelled_pages(80, 99):
        n = sum(s.count("w") for s, y in page if y)
        got = html_extract.extract("".join(s for s, _ in page), html_extract.learned_weights()).count("w")
        wrong += abs(got - n) > 0.3 * n + 40
    assert wrong <= 8


def test_langid(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "house", "with"], "bb": ["der", "und", "straße", "mit"]}
    some = [(k % 2, " ".join(rng.choice(words["aa" if k % 2 else "bb"]) for _ in range(60))) for k in range(200)]
    net = langid.fit_texts([t for _, t in some], ["aa" if y else "bb" for y, _ in some], epochs=6)
    rows = [(1, "the house and the house with the and"), (2, "der und mit straße und der"), (3, None), (4, "12 ..."), (5, "")]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows), net).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["aa", "bb", "und", "und", "und"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity(spark):
    rng = random.Random(4)
    fill = ["stone", "river", "green", "walk", "light", "seven", "paper"]
    rows = [(k, " ".join([*(rng.choice(fill) for _ in range(30)), *(["zorgling" + rng.choice(["", "s", "er"])] if k % 5 == 0 else [])])) for k in range(400)]
    model = toxicity.fit_texts([t for _, t in rows], [int(k % 5 == 0) for k, _ in rows])
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, [(1, "you are a zorglings. river"), (2, "a walk by the river"), (3, None), (4, "")]), model).collect()}
    assert [got[i]["predicted"] for i in range(1, 5)] == [1, 0, 0, 0] and got[3]["score"] == got[4]["score"]
    plain = toxicity.Model(words={"idiot": 4.0}, bias=-3, slope=3)
    s = toxicity.Scorer(plain)
    assert s.total("you are an idiot") > s.total("an idiot") > s.total("not an idiot") > s.total("the man said not an idiot") >= 0
    assert s.total("kill the lights") == 0 < s.total("i will kill you")
    assert toxicity.fit_texts(["a"], [0]).slope == 0


def brute(rows, width, percent):
    """Classes of documents by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in keys}


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(70 if g == 0 else rng.randint(1, 4)):  # one crowd over the size of a leaf
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(60)] = f"z{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "one", "ONE", "one  ", "x y", "É a", "é a", "   "])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_join.near_duplicates(docs(spark, rows), width=2).collect()}
    assert got == brute(rows, 2, 80)
    assert minhash_join.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.03 * rng.normal(size=(20, 16)), base[:1].repeat(5, axis=0), base[1:2] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in crosspoly.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert got[i] == (near[i].sum() - 1, label[i], label[i] == i)
    assert all(got[i] == (0, i, True) for i in range(900, 905))


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(40)] + [(7, 7)]
    with Scratch(spark, "test") as tmp:
        got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), tmp).collect())
    best = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    assert got == {k: v for k, v in best.items() if any(a != b and k in (a, b) for a, b in links)}


def test_schedule_stays_within_a_block():
    rng = random.Random(6)
    for _ in range(30):
        quota = mixing.quotas([rng.random() + 0.01 for _ in range(rng.randint(1, 30))], 512)
        had = [0] * len(quota)
        for slot, i in enumerate(mixing.schedule(quota), 1):
            had[i] += 1
            assert all(abs(h - q * slot / 512) < 1 for h, q in zip(had, quota, strict=True))
        assert had == quota


def test_mix_keeps_exact_weights_over_many_periods(spark):
    rng = random.Random(3)
    for weights in ([600**0.5, 400**0.5], [1, 1e-5], [rng.random() for _ in range(40)], [1.0] * 700 + [1e-3] * 700):
        total, slots, had = sum(weights), 6000, [0] * len(weights)
        for i, block, slot in mixing.plan(weights, [slots] * len(weights)):
            if slot >= slots:
                break
            assert block == had[i]
            had[i] += 1
            # the source that gets a slot is the one that could be ahead, and all are looked at now and then
            for k in range(len(weights)) if slot % 500 == 0 else (i,):
                assert abs(had[k] - weights[k] / total * (slot + 1)) < 1 + 1e-9
    assert sorted(mixing.plan([0, 1, 0], [2, 1, 1])) == [(0, 0, 2), (0, 1, 4), (1, 0, 0), (1, 1, 1), (2, 0, 3)]
    # a weight under 1/1024 through the whole operator
    frame = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "b").otherwise("a").alias("source"))
    got = mixing.mix(frame, {"a": 4999, "b": 1}, block_docs=1, bucket_docs=50).groupBy("slot_", "source").count().collect()
    where = sorted(r["slot_"] for r in got if r["source"] == "b")
    assert len(got) == 12_000 and all(5000 * k <= slot < 5000 * (k + 1) for k, slot in enumerate(where))


def test_mix(spark):
    rows = [(i, None if i % 7 == 0 else "abc"[min(2, i % 5)], "t") for i in range(900)]
    frame = spark.createDataFrame([(i, t, s, "clash") for i, s, t in rows], "doc_id long, text string, source string, slot_ string")
    got = mixing.mix(frame, {"a": 3, "b": 1, "c": 1, None: 1}, block_docs=4, bucket_docs=50).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    slots = {}
    for r in got:
        slots.setdefault(r["slot_"], set()).add((r["source"], r["block_"]))
        assert 0 <= r["place_"] < 4
    assert all(len(s) == 1 for s in slots.values())
    horizon = min([k for k in range(max(slots) + 2) if k not in slots])
    had = {}
    for slot in range(min(horizon, 60)):
        source = next(iter(slots[slot]))[0]
        had[source] = had.get(source, 0) + 1
        assert abs(had.get("a", 0) - (slot + 1) / 2) < 1
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.in_mixed_order(mixing.mix(frame.drop("slot_"))).columns == ["doc_id", "text", "source"]


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "packing"]
    rows = docs(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h "), (3, "other words in this one text here now"), (4, None)]).select(*P.COLUMNS)
    kept = P.drop_copies(spark, rows, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == list(P.COLUMNS)
    near = P.drop_near_copies(spark, kept, "")
    assert sorted(r["doc_id"] for r in near.collect()) == [2, 3, 4]
    assert sorted(r["doc_id"] for r in P.mix_sources(spark, near, "").collect()) == [2, 3, 4]


def test_pipeline_stages_keep_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    near = words[0] + " more"
    rows = docs(spark, [(None, words[0]), (7, words[0]), (None, words[1]), (None, words[2]), (None, words[2]), (3, words[3]), (3, words[4]), (2, words[4]), (3, words[5]), (3, words[5] + " "), (4, words[6]), (4, words[6])]).select(*P.COLUMNS)
    kept = [(None, words[0]), (None, words[1]), (None, words[2]), (3, words[3]), (2, words[4]), (3, words[5] + " "), (4, words[6])]
    order = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    assert order(P.drop_copies(spark, rows, "")) == sorted(kept, key=str)
    # near copies: of a null id, under one id, and of a text whose id another text shares
    rows = docs(spark, [(9, near), *kept, (3, words[5] + " more"), (1, words[3] + " more")]).select(*P.COLUMNS)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    five = min(words[5] + " ", words[5] + " more", key=digest)
    want = [(3, five) if t == words[5] + " " else (1, words[3] + " more") if t == words[3] else (i, t) for i, t in kept]
    near_free = P.drop_near_copies(spark, rows, "")
    assert order(near_free) == sorted(want, key=str) and near_free.columns == list(P.COLUMNS)
    repeated = docs(spark, [(5, words[0]), (5, words[0]), (None, words[1]), (None, words[1])]).select(*P.COLUMNS)
    assert order(P.drop_near_copies(spark, repeated, "")) == sorted([(5, words[0]), (None, words[1])], key=str)
    mixed = P.mix_sources(spark, near_free, "")
    assert order(mixed) == order(near_free)
    assert sorted((str(r["doc_id"]) for r in P.pack(spark, mixed, "").where("start = 0").select("doc_id").collect())) == sorted(str(i) for i, _ in want)


def test_vectors_with_nulls_lengths_repeats_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, key string, table int"
    vectors = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [None, 1.0]), (7, []),
        (8, [float("nan"), 1.0]), (9, [0.0, 0.0]), (None, [1.0, 0.0]), (10, [5.0]), (11, [7.0]), (12, [-7.0]), (13, [1e30, 0.0]),
    ]
    got = crosspoly.near_duplicate_vectors(spark.createDataFrame([(i, v, "a", 1) for i, v in vectors], schema)).collect()
    linked = {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 3), 10: (1, 10), 11: (1, 10), 13: (3, 3)}
    want = [(i, *linked.get(i, (0, i)), i is None or i == linked.get(i, (0, i))[1]) for i, _ in vectors]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert crosspoly.near_duplicate_vectors(spark.createDataFrame([], schema)).collect() == []
