"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of text nodes and tags. Words score by the elements around them, positive in
content and negative in boilerplate; tags score negative. One linear scan finds the contiguous region
with the largest sum, and inside it the words with a positive score are the text. The weights are a
logistic regression on labelled pages, which :func:`labelled_pages` writes from a grammar of page
layouts with a fixed seed.
"""

from __future__ import annotations

import bisect
import functools
import html as _html
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</[^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NO_TEXT = re.compile(r"<(?:noscript|template|svg|iframe|object|select|button|canvas|audio|video)(?=[\s/>])", re.I)
_NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose contents are left out, if they are closed. An unclosed one holds nothing.
NO_TEXT = frozenset("noscript template svg iframe object select button canvas audio video".split())
#: What may stand in a head; anything else closes it.
HEAD = frozenset("head base link meta title style script noscript template".split())
LANDMARKS = frozenset("article main section body".split())
#: An element of the key is closed when one of the others opens in it.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}


@functools.lru_cache(maxsize=20_000)
def features(tag: str, attrs: str, parent: str) -> tuple[str, ...]:
    out = {"tag:" + tag}
    if tag in ("header", "footer"):
        out.add(f"{parent}>{tag}")
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "aria-label"):
            out.update("name:" + w for w in _NAME.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add("hidden")
    return tuple(out)


def closed_no_text(page: str) -> set[int]:
    """Where the elements of ``NO_TEXT`` begin that have a closing tag of their own."""
    opened: dict[str, list[int]] = {}
    closed: set[int] = set()
    for m in _TOKEN.finditer(page):
        if (name := m[3] or m[6]) and (tag := name.lower()) in NO_TEXT:
            if ((m[4] if m[3] else m[7]) or "").endswith("/"):
                continue
            if not (m[2] or m[5]):
                opened.setdefault(tag, []).append(m.start())
            elif opened.get(tag):
                closed.add(opened[tag].pop())
    return closed


class _Open:
    """An open element. What is asked of all elements around a word is carried along, so that no word looks
    through the stack: ``z`` is the sum of the weights of their features, each counted once, ``block`` the place
    of the innermost one that isn't inline, ``skip`` the place of the outermost one whose contents are left out
    (0: none), ``inside`` whether it is boilerplate that stands in the middle of content."""

    __slots__ = ("block", "features", "head", "inside", "landmark", "skip", "tag", "z")

    def __init__(self, tag, features, z, block, landmark, head, skip, inside):
        self.tag, self.features, self.z, self.block, self.landmark, self.head, self.skip, self.inside = tag, features, z, block, landmark, head, skip, inside


def scan(page: str, weight: dict[str, float] | None = None, base: float = 0.0):
    """The page's items in order, in time linear in its length: ``(tag, None, open elements, place)`` for tags,
    ``(None, text, open elements, place)`` for text nodes. Scripts, styles, comments and the like are left out.
    ``weight`` gives the weights of features, and ``base`` that of a word without any.

    Boilerplate stands in the middle of content if it is in an article or a main element, or if its parent also holds the last
    block of content before it: then what is behind it belongs to what is in front of it, however long it is."""
    stack = [_Open("", (), 0.0, 0, "body", False, 0, False)]
    holder = None  # the parent of the last block with words of content
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    holders: dict[str, int] = {}  # how many open elements have a feature
    weight = weight or {}

    def cut(k: int) -> None:
        while len(stack) > k:
            e = stack.pop()
            opened[e.tag].pop()
            for f in e.features:
                holders[f] -= 1

    def push(tag: str, feats: tuple[str, ...]) -> None:
        up, k = stack[-1], len(stack)
        skip, z = up.skip or (k if tag in NO_TEXT else 0), up.z
        for f in feats:
            n = holders.get(f, 0)
            if not n:
                z += weight.get(f, 0.0)
            holders[f] = n + 1
        middle = up.landmark in ("article", "main") and up.z + base > 0 or up is holder and up.tag not in ("", "html", "body")
        inside = up.inside or middle and z + base <= 0
        stack.append(_Open(tag, feats, z, up.block if tag in INLINE else k, tag if tag in LANDMARKS else up.landmark, up.head or tag == "head", skip, inside))
        opened.setdefault(tag, []).append(k)

    closed = closed_no_text(page) if _NO_TEXT.search(page) else ()
    for m in _TOKEN.finditer(page):
        top = stack[-1]
        if m[8] is not None:
            if not top.skip:
                if top.head and not m[8].isspace():
                    cut(opened["head"][0])
                top = stack[-1]
                if top.block and top.z + base > 0 and not m[8].isspace():
                    holder = stack[top.block - 1]
                yield None, m[8], stack, m.start()
            continue
        name = m[3] or m[6]
        if not name:
            continue
        tag, closing, attrs = name.lower(), m[2] or m[5], (m[4] if m[3] else m[7]) or ""
        if tag in NO_TEXT and not closing:
            if m.start() in closed and not attrs.endswith("/"):
                push(tag, ())
            continue
        if closing:
            if not top.skip and tag not in NO_TEXT:
                yield tag, None, stack, m.start()
            places = opened.get(tag)
            if places and places[-1] >= top.skip:  # inside what is left out, only what opened there is closed
                cut(places[-1])
            continue
        if top.skip:
            if tag not in VOID and not attrs.endswith("/"):
                push(tag, ())
            continue
        if top.head and tag not in HEAD:
            cut(opened["head"][0])
        k = stack[-1].block
        while k:
            e = stack[k]
            if tag in CLOSED_BY.get(e.tag, ()):
                cut(k)
                break
            if e.tag != "p":
                break
            k = stack[k - 1].block
        if tag not in VOID and not attrs.endswith("/"):
            push(tag, features(tag, attrs, stack[-1].landmark))
        yield tag, None, stack, m.start()


class Weights:
    """``base`` + the weights of the features of the open elements is the log-odds that a word is content."""

    def __init__(self, base: float, weight: dict[str, float], tags: dict[str, float]):
        self.base, self.weight, self.tags = base, weight, tags

    def word(self, z: float) -> float:
        """Score of a word from the sum of the weights around it, between -0.25 and 1: content words outweigh the
        boilerplate that stands between them."""
        z += self.base
        return min(1.0, z / 2) if z > 0 else max(-0.25, z / 8)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous region with the largest sum: of equal ones the first to end, of those that
    the one that begins last; empty if no sum is positive."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best:
            best, span = run, (begin, i + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    """The main text of a page: white space in a block is one space, blocks are joined by one space."""
    scores, parts = [], []
    for tag, text, stack, _ in scan(page, weights.weight, weights.base):
        inside = stack[-1].inside
        if tag is None:
            if text.isspace():
                parts.append(" ")
                scores.append(0.0)
                continue
            w = weights.word(stack[-1].z)
            scores.append(0.0 if inside and w <= 0 else w * len(text.split()))
            parts.append(_html.unescape(text) if w > 0 else "")
        else:
            scores.append(0.0 if inside else weights.tags.get(tag, weights.tags["other"]))
            parts.append("" if tag in INLINE else " ")
    begin, end = best_region(scores)
    return " ".join("".join(parts[begin:end]).split())


# -- labelled pages

#: What elements of boilerplate and of content are called in the layouts.
BOILERPLATE = """nav navbar navigation menu submenu header masthead topbar toolbar footer bottom sidebar aside widget ad ads adv advert
advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
signup social share sharing related recommended breadcrumb breadcrumbs pagination pager comments comment reply respond disqus login search form
legal copyright skip offcanvas tagcloud complementary contentinfo dialog""".split()
CONTENT = "article content post entry story body main text page column prose markdown container wrapper".split()


def labelled_pages(n: int = 400, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (markup, is content), written from random layouts."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(a, b)))
    pages = []
    for _ in range(n):
        out: list[tuple[str, bool]] = []
        put = lambda s, y=False: out.append((s, y))  # noqa: E731, B023

        def attr(names):
            return rng.choice([' class="{}"', ' id="{}"', ' class="x {}"', ' class="{}-box"']).format(rng.choice(names))  # noqa: B023

        def boiler(out=out, put=put, attr=attr):
            tag = rng.choice(["nav", "header", "footer", "aside", "form", "div", "div", "div", "div", "section", "ul"])
            put(f"<{tag}{attr(BOILERPLATE) if tag in ('div', 'section', 'ul') or rng.random() < 0.3 else ''}>")
            for _ in range(rng.randint(1, 6)):
                kind = rng.random()
                inner = words(1, 12)
                put(f"<ul><li><a href='#'>{inner}</a></li></ul>" if kind < 0.4 else f"<p>{words(3, 40)}</p>" if kind < 0.7 else f"<h3>{inner}</h3>" if kind < 0.8 else f"<span>{inner}</span> <b>{inner}</b>" if kind < 0.9 else inner)
            put(f"</{tag}>")

        def block(put=put, attr=attr):
            kind = rng.random()
            put(f"<p>{words(1, 80)}</p>" if kind < 0.55 else f"<p>{words(1, 30)} <a href='#'>{words(1, 4)}</a> <em>{words(1, 3)}</em> <span>{words(1, 9)}</span></p>" if kind < 0.65
                else f"<p><b>{words(1, 40)}<br><p>{words(1, 30)}" if kind < 0.7 else f"<h2>{words(1, 8)}</h2>" if kind < 0.78 else f"<ul><li>{words(1, 20)}</li><li>{words(1, 20)}</li></ul>" if kind < 0.84
                else f"<blockquote>{words(3, 30)}</blockquote>" if kind < 0.88 else f"<table><tr><td>{words(1, 8)}</td><td>{words(1, 8)}</td></tr></table>" if kind < 0.91
                else f"<div{attr(CONTENT)}>{words(3, 30)}</div>" if kind < 0.95 else f"<section><h3>{words(1, 6)}</h3><p>{words(3, 50)}</p></section>", True)

        put(f"<html><head><title>{words(1, 8)}</title></head><body>")
        for _ in range(rng.randint(1, 4)):
            boiler()
        outer = rng.choice(["article", "article", "main", "div", "div", "section"])
        put(f"<{outer}{attr(CONTENT) if outer in ('div', 'section') or rng.random() < 0.3 else ''}>")
        put(f"<header><h1>{words(1, 12)}</h1></header>" if outer == "article" and rng.random() < 0.3 else f"<h1>{words(1, 12)}</h1>", True)
        for _ in range(rng.randint(1, 25)):
            block()
            if rng.random() < 0.05:
                boiler()
        put(f"</{outer}>")
        for _ in range(rng.randint(1, 4)):
            boiler()
        put("</body></html>")
        pages.append(out)
    return pages


@functools.lru_cache(maxsize=1)
def learned_weights() -> Weights:
    """Weights of words by logistic regression over the features of their elements, of tags by how often
    they stand outside content; the same in every process."""
    rows: list[tuple[set[str], bool, int]] = []
    tags: dict[str, list[int]] = {}
    for page in labelled_pages():
        ends = list(itertools.accumulate(len(s) for s, _ in page))
        for tag, node, stack, place in scan("".join(s for s, _ in page)):
            content = page[bisect.bisect_right(ends, place)][1]
            if tag is not None:
                tags.setdefault(tag, [0, 0])[content] += 1
            elif not stack[-1].head:
                rows.append(({f for e in stack for f in e.features}, content, len(node.split())))
    names = sorted({f for fs, *_ in rows for f in fs})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (fs, *_) in enumerate(rows):
        x[i, [index[f] for f in fs]] = 1
    y = np.array([r[1] for r in rows], dtype=np.float64)
    w = np.zeros(len(names) + 1)
    ridge = np.full(len(w), 0.3)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    outside = {t: (a + 1) / (a + b + 2) for t, (a, b) in tags.items()}
    return Weights(float(w[-1]), {f: float(w[i]) for f, i in index.items()}, {t: -0.02 - 0.2 * s for t, s in outside.items()} | {"other": -0.1})


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``(id, keep..., text, n_chars)`` of every whole page, without a shuffle.

    Boilerplate inside the article, of any length, separates nothing (:func:`scan`). Where none of the rules sees that two stretches of
    content belong together, the one with the larger sum counts if what is between them costs more than the other is worth.
    A null or empty page, or one without content, gives the empty text. Null and repeated ids are
    returned as they are; other columns are ignored; no rows give no rows.
    """
    names = [id_col, *keep]

    def run(batches):
        weights = learned_weights()
        for b in batches:
            texts = [extract(h, weights) if h else "" for h in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    rows = df.select(*[F.col(c).alias(c) for c in names], F.col(html_col).cast("string").alias("html_to_read_"))
    return rows.mapInArrow(run, T.StructType([*rows.schema[: len(names)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
