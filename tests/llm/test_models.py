"""The learned operators: folds, bounds, held-out accuracy, contexts."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, toxicity

DATA = "/root/testdata"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_fit_keeps_to_its_fold_and_bounds(spark):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "house", "with"], "bb": ["der", "und", "straße", "mit"], "cc": ["le", "et", "maison", "où"]}
    rows = []
    for i in range(400):
        # held-out rows lie: were they learned, "zz" would be a language
        lang = "zz" if crc(i) % 5 == 0 else rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words.get(lang, ["aaa", "bbb"])) for _ in range(30)), lang))
    rows += [(None, "the and", "aa"), (7777, None, "aa"), (7778, "the and", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real, langid.fit_windows = langid.fit_windows, lambda windows, langs, *more: seen.append((windows, langs)) or real(windows, langs, epochs=4)
    try:
        net = langid.fit(frame, per_lang=40, most_docs=90)
    finally:
        langid.fit_windows = real
    [(windows, langs)] = seen
    assert set(langs) == set(words) and "zz" not in net.langs and max(langs.count(x) for x in set(langs)) <= 30 and all(len(w) <= 4 for w in windows)
    assert langid.fit(frame.where("lang = 'zz'")) is None
    texts = [(1, "the house and the house with the and", "x"), (None, "der und mit straße und der", "x"), (2, None, "x"), (3, "² ½ 12", "x"), (4, "", "x"), (1, "the " * 200_000, "x"), (1, "the " * 200_000, "x")]
    texts = spark.createDataFrame(texts, "doc_id long, text string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(texts, real(windows, langs, epochs=8)).collect()]
    assert [x for i, x in got if i in (2, 3, 4)] == ["und"] * 3 and len({x for i, x in got if i == 1}) == 1 and len(got) == 7
    assert langid.predict(texts.limit(0), net).count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    held = [r["lang"] == r["lang_pred"] for r in rows if crc(r["doc_id"]) % 5 == 0]
    assert len(held) > 100 and sum(held) >= 0.95 * len(held)


def test_languages_in_few_documents_with_many_rows(spark):
    rows = [(i, "aa bb cc dd " * 4, "aa") for i in range(300)] + [(1000 + i % 20, "xyz zyx yyz " * 4, "bb") for i in range(5000)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == ["aa", "bb"]
    got = langid.predict(spark.createDataFrame([(1, "bb dd aa cc bb"), (2, "zyx xyz xyz")], "doc_id long, text string"), net).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "aa", 2: "bb"}
    # as many languages as there are; the sample of each gets smaller
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text", f"l{i % 230}") for i in range(920)], "doc_id long, text string, lang string")
    assert len(langid.fit(many, most_docs=460).langs) == len({f"l{i % 230}" for i in range(920) if crc(i) % 5})


def test_features_are_a_plain_convolution():
    import numpy as np

    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(w, 256, 5)).astype(np.float32) for w in langid.WIDTHS]
    n = 5 * len(langid.WIDTHS)
    net = langid.ByteNet(tables, np.zeros(n), np.zeros((n, 2)), np.zeros(2), ["a", "b"])
    windows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    windows[3, 40:] = 0
    want = [[max(sum(t[j, row[at + j], f] for j in range(len(t))) for at in range(len(row) - len(t) + 1)) for t in tables for f in range(5)] for row in windows]
    assert np.allclose(net.features(windows), want, atol=1e-5)


def best_by_hand(model, words):
    """The best way to read a clause, over all choices of its match."""
    best = 0.0
    entry = lambda w: model.words.get(w) or next((x for s, x in model.stems.items() if w.startswith(s) and w != s and w not in model.plain), None)
    for k, w in enumerate(words):
        base = 0.0
        if any(x in toxicity.TARGETS for x in words):
            base = model.target
        options = []
        if entry(w) is not None:
            options.append(entry(w) + base)
        if w in model.threats_ and any(x in toxicity.TARGETS for x in words[k + 1 :]):
            options.append(model.threat + model.threats_[w])
        for z in options:
            z += model.negated * any(x in toxicity.NEGATIONS for x in words[:k]) + model.reported * any(x in toxicity.REPORTS for x in words)
            best = max(best, z)
    return best


def test_composed_transducers_read_clauses_as_by_hand():
    model = toxicity.Model(stems={"zorg": 3.0}, words={"idiot": 4.0, "fool": 2.5}, plain=["zorgs"], target=0.7, negated=-2.0, reported=-1.2, threat=1.5, threats_={"kill": 0.0, "snorf": 0.8})
    scorer, rng = toxicity.Scorer(model), random.Random(3)
    some = ["idiot", "fool", "zorg", "zorgs", "zorgling", "you", "not", "said", "kill", "snorf", "river", "a"]
    clauses = [list(c) for c in itertools.product(some, repeat=2)] + [[rng.choice(some) for _ in range(rng.randint(0, 9))] for _ in range(1500)]
    for words in clauses:
        assert scorer.clause(words) == pytest.approx(best_by_hand(model, words)), words
    assert len(model.grammar().arcs) > 10  # states of all five


def test_threats_are_learned_and_aim_at_somebody():
    rng = random.Random(2)
    some = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "ori", "une", "ip", "ost")]
    words = lambda n: " ".join(rng.choice(some) for _ in range(n))
    texts = [f"{words(9)}. i will snorf you {words(1)}. {words(6)}" for _ in range(60)] + [f"{words(9)}. you {words(2)}. {words(6)}, do they {words(1)}" for _ in range(400)]
    model = toxicity.fit_texts(texts, [1] * 60 + [0] * 400)
    assert "snorf" in {*model.threats_, *model.words} or any("snorf".startswith(s) for s in model.stems)
    model = toxicity.Model(threats_={"snorf": 1.0, "kill": 0.0})
    toxicity._learn_threats(model, texts, [1] * 60 + [0] * 400)
    assert set(model.threats_) == {"snorf", "kill"}
    scorer = toxicity.Scorer(model)
    learned = model.threats_["snorf"]  # log-odds of the text's label beyond a threat's own weight, in place of what was given
    assert learned > 3 and scorer.evidence("We will snorf you")[1] == pytest.approx(2.0 + learned) and scorer.evidence("I will kill you")[1] == 2.0
    for clean in ("They kill weeds in the garden", "you snorf", "They snorf. You go"):
        assert scorer.evidence(clean)[1] == 0.0
    assert toxicity.Scorer(toxicity.Model()).evidence("I will shoot you")[1] == 2.0


def test_clauses_are_read_to_their_ends():
    scorer = toxicity.Scorer(toxicity.Model(words={"idiot": 4.0}))
    for gap in ("", "a " * 100, "a " * 1000, "a " * 100_000):
        assert scorer.evidence(f"x. not {gap}an idiot. y")[1] == pytest.approx(2.5)
        assert scorer.evidence(f"x. an idiot {gap}you said. y")[1] == pytest.approx(3.5)
    assert [m[2] for m in scorer.matches("idiot. idiot; you idiot\nan idiot idiot")] == [4.0, 4.0, 4.5, 4.0]


def test_toxicity_held_out_by_language(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text", "lang"), model, keep=("lang",)).join(labels, "doc_id")
    caught, alarms, clean = {}, 0, 0
    for r in got.where(F.col("lang").isNotNull()).collect():
        if crc(r["doc_id"]) % 3 == 1:
            if r["toxic"] == 1:
                caught.setdefault(r["lang"], []).append(r["predicted"])
            else:
                alarms, clean = alarms + r["predicted"], clean + 1
    # some labels of 1 stand at texts without any such word
    assert set(caught) == {"en", "de", "fr", "es"} and all(sum(x) >= 0.8 * len(x) for x in caught.values()), {k: (sum(x), len(x)) for k, x in caught.items()}
    assert alarms <= 3 and clean > 1000


def test_toxicity_fit_keeps_to_its_fold_and_bounds(spark):
    rng = random.Random(2)
    fill = ["stone", "river", "green", "walk", "light", "seven", "paper"]
    prose = lambda: " ".join(rng.choice(fill) for _ in range(20))
    rows = [(i, prose() + (" zorgling. " if i % 3 == 0 and crc(i) % 3 != 1 else " blarg. " if i % 3 == 0 else ". ") + prose()) for i in range(300)]
    docs = spark.createDataFrame([*rows, (0, "zzz"), (None, "blarg"), (301, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (None, 1), (301, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any(w.startswith("zorg") for w in [*model.words, *model.stems]) and not any(w.startswith("blarg") for w in [*model.words, *model.stems])
    assert toxicity.fit(docs, labels.where("toxic = 0")).slope == 0
    assert toxicity.fit(docs.limit(0), labels).slope == 0
    texts = spark.createDataFrame([(None, "you zorgling", 1), (1, None, 1), (1, "", 1), (2, "you zorgling", 1), (2, "you zorgling", 1)], "doc_id long, text string, score int")
    got = sorted((str(r["doc_id"]), r["predicted"], r["n_matches"]) for r in toxicity.score(texts, model).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("2", 1, 1), ("2", 1, 1), ("None", 1, 1)]
    assert toxicity.score(texts.limit(0), model).count() == 0


def test_windows_of_long_texts():
    assert toxicity.windows_of("abcde", 2, 2) == "ab\nde" and toxicity.windows_of("abcd", 2, 2) == "abcd"
    assert len(toxicity.windows_of("x" * 10**6, 32, 1024)) == 32 * 1025 - 1
