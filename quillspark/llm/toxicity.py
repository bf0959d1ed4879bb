"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause one after the other: insults, threats, targets, negation and
reported speech. The insult transducer rewrites a learned entry into a mark with its weight, or leaves it a
plain word; threats, given verbs and learned ones, are rewritten likewise; the target transducer makes one of the marks the
clause's match, a threat only if somebody it is aimed at follows it; negation in front of the match and reported speech in the
clause take weight away. They are composed into one machine, and the best path through it is the clause's score:
words alone are never summed, a clause counts once.

Insult entries and all weights come from labelled rows (:func:`fit`); only small closed-class lists are
given, and context weights where label 0 has hardly any match to learn them from.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Closed classes in the corpus' languages.
TARGETS = "you your yours youre u he she they them these those du dich dir ihr euch sie tu te toi vous usted ustedes ti vosotros".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls quote quoted wrote writes reported reports sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()
#: Threats that are known without evidence; others are learned.
THREATS = "kill hurt destroy strangle murder stab shoot töten umbringen erschießen tuer frapper matar golpear".split()
NEAR = 3  # words behind a threat among which its target stands, when threats are learned

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n\r|]")
STEMS = range(3, 11)
NEVER = -math.inf


class Transducer:
    """A weighted transducer: ``arcs[state][symbol]`` lists ``(next state, output, weight)``. A symbol without an entry
    passes as it is, without weight, and the state stays. Weights add along a path; of several paths the best counts."""

    def __init__(self, arcs: dict, start, final: dict):
        self.arcs, self.start, self.final = arcs, start, final

    def step(self, state, symbol) -> list[tuple]:
        return self.arcs[state].get(symbol, [(state, symbol, 0.0)])

    def compose(self, other: Transducer) -> Transducer:
        """What reads the input of this one and gives the output of ``other`` on its output."""
        start, arcs, final = (self.start, other.start), {}, {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            a, b = state
            arcs[state] = {}
            final[state] = self.final.get(a, NEVER) + other.final.get(b, NEVER)
            for symbol in self.arcs[a].keys() | other.arcs[b].keys():
                row = [((a2, b2), out2, w + w2) for a2, out, w in self.step(a, symbol) for b2, out2, w2 in other.step(b, out)]
                arcs[state][symbol] = row
                todo.extend(r[0] for r in row)
        return Transducer(arcs, start, final)

    def run(self, symbols) -> float:
        """Weight of the best path for ``symbols``; minus infinity if none ends in a final state."""
        best = {self.start: 0.0}
        for s in symbols:
            after: dict = {}
            for state, weight in best.items():
                for to, _, w in self.step(state, s):
                    if weight + w > after.get(to, NEVER):
                        after[to] = weight + w
            best = after
        return max((w + self.final.get(state, NEVER) for state, w in best.items()), default=NEVER)


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)  # a beginning of insults, which are longer, and its weight
    words: dict[str, float] = field(default_factory=dict)  # whole words
    threats_: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 0.0))  # threats and what each adds to ``threat``
    plain: list[str] = field(default_factory=list)  # words that begin like an insult and aren't one
    #: what contexts add to the log-odds of a matched clause
    target: float = 0.5
    negated: float = -1.5
    reported: float = -1.0
    threat: float = 2.0
    #: the curve from the sum of matched clauses to a probability
    bias: float = -3.0
    slope: float = 1.0
    chance: float = 0.0  # weight that a word of a text brings by chance

    def insults(self) -> Transducer:
        """Entries become the mark ``<insult>`` with their weight, or stay plain."""
        arcs = {entry: [(0, "<insult>", w), (0, "<word>", 0.0)] for entry, w in [*(("^" + s, w) for s, w in self.stems.items()), *self.words.items()]}
        return Transducer({0: arcs}, 0, {0: 0.0})

    def threats(self) -> Transducer:
        return Transducer({0: {t: [(0, "<threat>", w), (0, "<word>", 0.0)] for t, w in self.threats_.items()}}, 0, {0: 0.0})

    def targets(self) -> Transducer:
        """One mark of the clause is its match; a state is (kind of match, target seen). The target of an insult may stand anywhere in
        the clause, that of a threat behind it: who threatens stands in front."""
        arcs, final = {}, {}
        for kind in ("", "insult", "threat"):
            for seen in (False, True):
                arcs[kind, seen] = {w: [((kind, True), "<target>", 0.0)] for w in TARGETS}
                for mark in ("insult", "threat"):
                    arcs[kind, seen][f"<{mark}>"] = [] if kind else [((mark, seen and mark == "insult"), "<match>", 0.0)]
                final[kind, seen] = NEVER if not kind else self.target * seen if kind == "insult" else self.threat if seen else NEVER
        return Transducer(arcs, ("", False), final)

    def negation(self) -> Transducer:
        """A state is (negated, matched): what comes behind the match doesn't negate it."""
        arcs = {(neg, False): {"<match>": [((neg, True), "<match>", 0.0)]} | {w: [((True, False), "<negation>", 0.0)] for w in NEGATIONS} for neg in (False, True)}
        arcs |= {(neg, True): {} for neg in (False, True)}
        return Transducer(arcs, (False, False), {(neg, matched): self.negated * (neg and matched) for neg, matched in arcs})

    def reports(self) -> Transducer:
        return Transducer({0: {w: [(1, "<report>", 0.0)] for w in REPORTS}, 1: {}}, 0, {0: 0.0, 1: self.reported})

    def grammar(self) -> Transducer:
        return functools.reduce(Transducer.compose, [self.insults(), self.threats(), self.targets(), self.negation(), self.reports()])


class Scorer:
    """Scores texts under a model. Candidates for matches are found in one pass of an Aho-Corasick
    automaton over the whole text; the composed transducer then reads their clauses only, each whole and once."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.machine = model.grammar()
        self.lengths = sorted({len(s) for s in model.stems}, reverse=True)
        self.seeds = ahocorasick.Automaton()
        for s in {*model.stems, *model.words, *model.threats_}:
            self.seeds.add_word(s, len(s))
        self.seeds.make_automaton()
        self.known = {*model.words, *TARGETS, *NEGATIONS, *REPORTS, *model.threats_}
        self.plain = frozenset(model.plain)

    def symbol(self, word: str) -> str | None:
        """What the machine reads for a word; None for one that no transducer knows."""
        if word in self.known:
            return word
        if word not in self.plain:
            for n in self.lengths:
                if n < len(word) and word[:n] in self.model.stems:
                    return "^" + word[:n]
        return None

    def clause(self, words: list[str]) -> float:
        """Weight of a clause: the best path, 0 if there is none."""
        return max(0.0, self.machine.run(s for s in map(self.symbol, words) if s))

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """Matched clauses as (begin, end, weight)."""
        low = text.lower()  # a few letters lower to two; spans are then those of the lowered text
        out, done, ends = [], -1, None
        for end, n in self.seeds.iter(low):
            at = end - n + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            if ends is None:
                ends = [m.start() for m in CLAUSE_END.finditer(low)]
            k = bisect.bisect_right(ends, at)
            begin, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(low)
            if (w := self.clause(WORD.findall(low, begin, done))) > 0:
                out.append((begin, done, w))
        return out

    def evidence(self, text: str) -> tuple[int, float, int]:
        """Number and weight of matched clauses, and the words of the text if there are any."""
        found = self.matches(text)
        return len(found), sum(w for *_, w in found), len(text.split()) if found else 0

    def total(self, text: str) -> float:
        return self.evidence(text)[1]

    def score(self, text: str) -> float:
        return self.probability(*self.evidence(text)[1:])

    def probability(self, total: float, words: int) -> float:
        m = self.model
        z = m.bias + m.slope * math.log1p(max(0.0, total - m.chance * words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _divergence(q: np.ndarray, p: float) -> np.ndarray:
    q = np.clip(q, 1e-9, 1 - 1e-9)
    return q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))


def fit_texts(texts: list[str], labels: list[int]) -> Model:
    """Learn entries and weights from labelled texts. Without both labels the model has no entries and gives
    the base rate."""
    if not 0 < sum(labels) < len(labels):
        return _fit_curve(Model(), [], [], labels)
    model = _learn_entries(texts, labels)
    _learn_threats(model, texts, labels)
    _fit_contexts(model, texts, labels)
    scorer = Scorer(model)
    found = [scorer.evidence(t) for t in texts]
    return _fit_curve(model, [f[1] for f in found], [len(t.split()) for t in texts], labels)


def _learn_entries(texts: list[str], labels: list[int]) -> Model:
    """Entries are words, or beginnings of words, that are surely more frequent in texts with label 1.

    Sure is what a Chernoff bound, corrected for the number of candidates, says of the texts that hold the
    entry, or of those that hold two different words with the beginning: evidence of inflections is pooled that
    way, though each may happen once in a clean text. The beginning alone and words that clean texts hold as
    often are plain. Entries are chosen greedily by the texts they add.
    """
    n1, n = sum(labels), len(labels)
    rate = (n1 + 0.5) / (n + 1)
    seen: set[int] = set()
    # texts with label 1 come first, as they name the candidates; of the others only these are counted
    order = sorted(range(n), key=lambda i: (-labels[i], i))
    bags = {i: _new_words(texts[i], seen) for i in order}
    words = (Counter(), Counter())  # texts that hold a word, by label
    for i in order:
        words[labels[i]].update(bags[i])
    # words as frequent in clean texts as elsewhere are no evidence for their beginnings
    plain = {w for w, c in words[0].items() if c >= 3 and words[1][w] <= 2 * rate / (1 - rate) * c}
    stems = lambda i: Counter(w[:k] for w in bags[i] if w not in plain for k in STEMS if len(w) > k)
    once, twice, all_ = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())

    def count(i: int, known: set[str] | None) -> None:
        y, held = labels[i], stems(i)
        held = {k: c for k, c in held.items() if known is None or k in known}
        for w in bags[i]:
            if known is None or w + "$" in known:
                held[w + "$"] = 1
        once[y].update(held.keys())
        all_[y].update(held)
        twice[y].update(k for k, c in held.items() if c > 1)

    for i in order[:n1]:
        count(i, None)
    candidates = len(once[1])
    known = {k for k, c in once[1].items() if c >= 4}
    for i in order[n1:]:
        count(i, known)
    keys = sorted(known)
    bound = math.log(candidates + 1) + 3

    def surely(counts) -> np.ndarray:
        c1 = np.array([counts[1][k] for k in keys], dtype=np.float64)
        c = c1 + np.array([counts[0][k] for k in keys])
        share = c1 / np.maximum(c, 1)
        return np.where((share > max(0.8, rate)) & (c > 0), c * _divergence(share, rate), 0.0)

    if not keys:
        return Model()
    sure = np.maximum(surely(once), surely(twice))
    ratio = lambda k: math.log((all_[1][k] + 0.5) / (n1 + 1)) - math.log((all_[0][k] + 0.5) / (n - n1 + 1))
    # how often a text of either label holds the entry, each of its words counted
    where = {keys[j]: (sure[j], ratio(keys[j])) for j in np.flatnonzero(sure > bound) if ratio(keys[j]) > 3}
    holders: dict[str, set[int]] = {k: set() for k in where}
    for i in order[:n1]:
        for k in {*stems(i), *(w + "$" for w in bags[i])} & holders.keys():
            holders[k].add(i)
    model, left = Model(), set(order[:n1])
    for k in sorted(where, key=lambda k: (-where[k][0], -len(k), k)):
        # a longer beginning that nearly all of them share and that clean texts hold no more
        longer = [x for x in where if x.startswith(k) and x != k and len(holders[x]) >= 0.85 * len(holders[k]) and where[x][1] >= where[k][1] - 0.1]
        k = max(longer, key=lambda x: (len(x), x), default=k)
        if len(holders[k] & left) < 2 and any(k.startswith(s) or s.startswith(k.removesuffix("$")) for s in (*model.stems, *model.words)):
            continue
        (model.words if k.endswith("$") else model.stems)[k.removesuffix("$")] = float(where[k][1])
        left -= holders[k]
    model.words = {w: x for w, x in model.words.items() if not any(w.startswith(s) and w != s for s in model.stems)}
    model.plain = sorted(w for w in plain if any(w.startswith(s) for s in model.stems) and w not in model.words)
    return model


def _learn_threats(model: Model, texts: list[str], labels: list[int]) -> None:
    """Threats are words with a target close behind them that are surely more frequent in texts with label 1, by the same bound as
    other entries. Words that stand more often without a target, and what is an insult already, are none. They are chosen
    greedily by the texts they add, of equal evidence the one that stands nearest to its targets."""
    scorer, targets = Scorer(model), frozenset(TARGETS)
    n1, n = sum(labels), len(labels)
    rate = (n1 + 0.5) / (n + 1)
    aimed, alone, gaps = (Counter(), Counter()), Counter(), Counter()
    holders: dict[str, set[int]] = {}
    order = sorted(range(n), key=lambda i: (-labels[i], i))
    closed = {*TARGETS, *NEGATIONS, *REPORTS}
    seen: set[tuple] = set()
    for i in order:
        held, bare = set(), set()
        for clause in CLAUSE_END.split(texts[i].lower()):
            words = WORD.findall(clause)
            for k, w in enumerate(words):
                if labels[i] and len(w) <= 2 or w in closed or not labels[i] and w not in aimed[1]:
                    continue
                behind = tuple(words[k + 1 : k + 1 + NEAR])
                if targets.isdisjoint(behind):
                    bare.add(w)
                elif (w, behind) not in seen:  # copies are evidence once
                    seen.add((w, behind))
                    held.add(w)
                    if labels[i]:
                        gaps[w] += next(j for j, x in enumerate(behind) if x in targets)
        aimed[labels[i]].update(held)
        if labels[i]:
            alone.update(bare)
            for w in held:
                holders.setdefault(w, set()).add(i)
    found = []
    for w, c1 in aimed[1].items():
        c0 = aimed[0][w]
        share = c1 / (c1 + c0)
        if c1 < 4 or share <= max(0.8, rate) or alone[w] > c1 or (symbol := scorer.symbol(w)) and (symbol in model.words or symbol[0] == "^"):
            continue
        sure = (c1 + c0) * float(_divergence(np.array([share]), rate)[0])
        ratio = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n - n1 + 1))
        if sure > math.log(len(aimed[1]) + 1) + 3 and ratio > 3:
            found.append((-sure, gaps[w] / c1, w, ratio))
    covered: set[int] = set()
    for *_, w, ratio in sorted(found):
        if len(holders[w] - covered) >= 2:
            model.threats_[w] = max(0.0, ratio - model.threat)
            covered |= holders[w]


def _new_words(text: str, seen: set[int]) -> set[str]:
    """The words of a text that stand between two neighbours as in no text before: words of copies and
    of shared passages are evidence once."""
    words = ["", *WORD.findall(text.lower()), ""]
    out = set()
    for k, w in enumerate(words[1:-1]):
        if len(w) > 2 and (context := hash((words[k], w, words[k + 2]))) not in seen:
            seen.add(context)
            out.add(w)
    return out


def _fit_contexts(model: Model, texts: list[str], labels: list[int]) -> None:
    """Log-odds that a target, a negation or a report in the clause of a match adds, and those of a threat, shrunk to the given values by
    ten clauses' worth of evidence of the rarer label: where clean texts have no match they stay as given."""
    scorer = Scorer(model)
    seen = {k: [0, 0] for k in ("target", "negated", "reported", "", "threat")}
    threats, targets = model.threats_.keys(), set(TARGETS)
    lists = {"target": set(TARGETS), "negated": set(NEGATIONS), "reported": set(REPORTS)}
    for text, y in zip(texts, labels, strict=True):
        low = text.lower()
        for begin, end, _ in scorer.matches(low):
            in_order = WORD.findall(low, begin, end)
            words = set(in_order)
            seen[""][y] += 1
            seen["threat"][y] += any(w in threats and not targets.isdisjoint(in_order[k + 1 :]) for k, w in enumerate(in_order))
            for k, known in lists.items():
                if words & known:
                    seen[k][y] += 1
    clean, toxic = seen[""]
    share = min(clean, toxic) / (min(clean, toxic) + 10)
    for k in lists:
        learned = math.log((seen[k][1] + 0.5) / (toxic + 1)) - math.log((seen[k][0] + 0.5) / (clean + 1))
        setattr(model, k, getattr(model, k) * (1 - share) + learned * share)
    threats = min(seen["threat"])  # a threat's own weight: how much likelier it is in texts with label 1
    share, n1 = threats / (threats + 10), sum(labels)
    learned = math.log((seen["threat"][1] + 0.5) / (n1 + 1)) - math.log((seen["threat"][0] + 0.5) / (len(labels) - n1 + 1))
    model.threat = model.threat * (1 - share) + learned * share


def _fit_curve(model: Model, totals: list[float], words: list[int], labels: list[int]) -> Model:
    """The curve from evidence to probability. What a word brings by chance is the weight of the matches in texts
    with label 0 over their words; a text's evidence is what it has beyond that."""
    n1, n = sum(labels), len(labels)
    rate = (n1 + 0.5) / (n + 1)
    if not 0 < n1 < n:
        model.bias, model.slope = math.log(rate / (1 - rate)), 0.0
        return model
    y, total, size = np.array(labels, dtype=np.float64), np.array(totals), np.array(words, dtype=np.float64)
    model.chance = float(total[y == 0].sum() / max(1.0, size[y == 0].sum())) if size.any() else 0.0
    x = np.log1p(np.maximum(0.0, total - model.chance * size))
    w = np.array([math.log(rate / (1 - rate)), 1.0])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        g = np.array([(p - y).sum() + 0.01 * w[0], ((p - y) * x).sum() + 0.01 * w[1]])
        v = p * (1 - p) + 1e-9
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    model.bias, model.slope = float(w[0]), float(w[1])
    return model


def windows_of(text: str, windows: int, width: int) -> str:
    """A text as it is, or evenly spread windows of one that is longer than they are together."""
    if len(text) <= windows * width:
        return text
    gap = (len(text) - width) / (windows - 1) if windows > 1 else 0.0
    return "\n".join(text[int(k * gap) : int(k * gap) + width] for k in range(windows))


def fit(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = (3000, 1000), fold: tuple[int, int] = (3, 1), windows: int = 32, width: int = 1024) -> Model:
    """Fit on a bounded sample of labelled rows: at most ``per_label[y]`` documents of label ``y``, those
    with the smallest hash of the id, from rows whose crc32 of the id modulo ``fold[0]`` isn't
    ``fold[1]``. Rows without an id or label are left out; a repeated id counts once, as toxic if
    any of its labels says so, with its smallest text. ``docs`` is read for the sampled ids only, whose number is
    bounded, so that they can be broadcast. Entries and contexts are learned from at most ``windows`` windows of
    ``width`` characters of a text, which are cut out where the text is; the curve is fitted to whole texts."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0]
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y_")).where("doc_id is not null and y_ in (0, 1)").where(rest != fold[1]).groupBy("doc_id").agg(F.max("y_").alias("y_"))
    mixed = F.xxhash64(F.col("doc_id").cast("string"))
    sample = None
    for y, most in enumerate(per_label):
        part = known.where(F.col("y_") == y).orderBy(mixed, "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    spark = docs.sparkSession
    few = spark.createDataFrame([(r[0], r[1]) for r in sample.collect()], "doc_id long, y_ int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    with Scratch(spark, "toxicity-sample") as tmp:
        taken = tmp(rows.groupBy("doc_id", "y_").agg(F.min("text").alias("text")), "texts")

        def cut(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([windows_of(t, windows, width) for t in b.column(2).to_pylist()], pa.string())], names=["doc_id", "y_", "text"])

        parts = sorted(taken.mapInArrow(cut, "doc_id long, y_ int, text string").collect())
        if len({r[1] for r in parts}) < 2:
            return _fit_curve(Model(), [], [], [r[1] for r in parts])
        model = _learn_entries([r[2] for r in parts], [r[1] for r in parts])
        _learn_threats(model, [r[2] for r in parts], [r[1] for r in parts])
        _fit_contexts(model, [r[2] for r in parts], [r[1] for r in parts])
        del parts
        key = json.dumps(model.__dict__)

        def weigh(batches):
            scorer = _scorer(key)
            for b in batches:
                texts = b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([scorer.evidence(t)[1] for t in texts], pa.float64()), pa.array([len(t.split()) for t in texts], pa.int64())], names=["doc_id", "y_", "total", "words"])

        found = sorted(taken.mapInArrow(weigh, "doc_id long, y_ int, total double, words long").collect())
    return _fit_curve(model, [r[2] for r in found], [r[3] for r in found], [r[1] for r in found])


@functools.lru_cache(maxsize=2)
def _scorer(key: str) -> Scorer:
    return Scorer(Model(**json.loads(key)))


def score(df: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, score, predicted, n_matches)`` and the columns ``keep`` for every whole text, without a shuffle.

    A null text counts as empty and gets the score of a text without matches; null and repeated ids
    are returned as they are; columns not named are ignored; an empty table gives no rows. A clause is read to its
    ends, however long.
    """
    key = json.dumps(model.__dict__)
    names = [id_col, *keep]

    def run(batches):
        scorer = _scorer(key)
        for b in batches:
            found = [scorer.evidence(t) if t else (0, 0.0, 0) for t in b.column(b.num_columns - 1).to_pylist()]
            scores = [scorer.probability(total, words) for _, total, words in found]
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for n, *_ in found], pa.int32())], names=[*names, "score", "predicted", "n_matches"])

    rows = df.select(*[F.col(c).alias(c) for c in names], F.col(text_col).cast("string").alias("text_to_score_"))
    schema = T.StructType([*rows.schema[: len(names)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.IntegerType())])
    return rows.mapInArrow(run, schema)
