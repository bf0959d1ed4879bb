"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python
closures that write text. ``{% generation %}`` marks what the model is trained on. Templates are
sandboxed: they see the values given to them, fields of mappings and the filters listed here; nothing
can be called and no attribute of a Python object is reached.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The control strings of :data:`TEMPLATE`.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)

_CONTROL = "|".join(re.escape(c) for c in CONTROL)
_TO_ESCAPE = re.compile(rf"\\|(?={_CONTROL})")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Put a backslash before each backslash and each control string, so that none is left."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


# -- syntax tree
@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    key: object


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Output:
    expr: object


@dataclass
class For:
    var: str
    of: object
    body: list


@dataclass
class If:
    branches: list  # (condition or None, body)


@dataclass
class Generation:
    body: list


_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))")
#: Output, statement or comment; a minus inside the braces removes the white space on its side.
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.S)


class _Expression:
    """Recursive descent: or, and, not, comparison, + and ~, filters, fields."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else ""

    def take(self, *known: str) -> str:
        if self.peek() in known and known:
            self.at += 1
            return self.tokens[self.at - 1][0].strip()
        return ""

    def parse(self):
        out = self.binary(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">="), ("+", "~"))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[level] == ("not",):
            return Op("not", [self.binary(level)]) if self.take("not") else self.binary(level + 1)
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = Op(op, [left, self.binary(level + 1)])
        return left

    def filtered(self):
        out = self.primary()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = Filter(name, out)
        return out

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        m = self.tokens[self.at]
        self.at += 1
        if m[1]:
            out = Const(ast.literal_eval(m[1]))
        elif m[2]:
            out = Const(int(m[2]))
        elif m[3]:
            out = Const({"true": True, "false": False, "none": None}[m[3]]) if m[3] in ("true", "false", "none") else Name(m[3])
        elif m[4] == "(":
            out = self.binary(0)
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
        else:
            raise TemplateError(f"unexpected {m[4]!r}")
        while True:
            if self.take("."):
                out = Field(out, Const(self.peek()))
                self.at += 1
            elif self.take("["):
                out = Field(out, self.binary(0))
                if not self.take("]"):
                    raise TemplateError("a bracket isn't closed")
            else:
                return out


def parse(source: str) -> list:
    """Syntax tree of a template."""
    stack: list[tuple[object, list]] = [(None, [])]
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        if m[0][2] == "-":
            text = text.rstrip()
        if text:
            stack[-1][1].append(Text(text))
        at, strip = m.end(), m[0][-3] == "-" and len(m[0]) > 5
        if m[1] is not None:
            stack[-1][1].append(Output(_Expression(m[1]).parse()))
        elif m[2] is not None:
            word, _, rest = m[2].partition(" ")
            if word == "for":
                var, _, of = rest.partition(" in ")
                node = For(var.strip(), _Expression(of).parse(), [])
                stack[-1][1].append(node)
                stack.append((node, node.body))
            elif word == "if":
                node = If([(_Expression(rest).parse(), [])])
                stack[-1][1].append(node)
                stack.append((node, node.branches[0][1]))
            elif word in ("elif", "else"):
                node, _ = stack.pop()
                if not isinstance(node, If):
                    raise TemplateError(f"{word} without if")
                node.branches.append((_Expression(rest).parse() if word == "elif" else None, []))
                stack.append((node, node.branches[-1][1]))
            elif word == "generation":
                node = Generation([])
                stack[-1][1].append(node)
                stack.append((node, node.body))
            elif word in ("endfor", "endif", "endgeneration"):
                node, _ = stack.pop()
                if not isinstance(node, {"endfor": For, "endif": If, "endgeneration": Generation}[word]):
                    raise TemplateError(f"unexpected {word}")
            else:
                raise TemplateError(f"no statement {word!r}")
    if text := source[at:].lstrip() if strip else source[at:]:
        stack[-1][1].append(Text(text))
    if len(stack) > 1:
        raise TemplateError("a block isn't closed")
    return stack[0][1]


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "~": lambda a, b: _str(a) + _str(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
}


def _str(value) -> str:
    return "" if value is None else str(value)


def _constant(node, parts: list):
    """The value of a node whose parts are constants, by the closure that would run: folding changes no result. What
    fails is left to fail where it is run, if ever."""
    if not all(isinstance(p, Const) for p in parts):
        return node
    try:
        return Const(_expr(node)({}))
    except TypeError:
        return node


def fold(node):
    """Replace what depends on constants only; drop branches that can't be taken; join neighbouring texts."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return out
    if isinstance(node, Op):
        args = list(map(fold, node.args))
        return _constant(Op(node.op, args), args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return _constant(Filter(node.name, of), [of])
    if isinstance(node, Field):
        return Field(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        expr = fold(node.expr)
        return Text(_str(expr.value)) if isinstance(expr, Const) else Output(expr)
    if isinstance(node, For):
        return For(node.var, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition) if condition is not None else Const(True)
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        if branches and isinstance(branches[0][0], Const):
            return branches[0][1]
        return If(branches) if branches else []
    return node


def _expr(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Field):
        of, key = _expr(node.of), _expr(node.key)

        def field(env):
            value = of(env)
            return value.get(key(env)) if isinstance(value, dict) else None

        return field
    if isinstance(node, Filter):
        of, f = _expr(node.of), FILTERS[node.name]
        return lambda env: f(_str(of(env)))
    if node.op == "and":
        a, b = map(_expr, node.args)
        return lambda env: a(env) and b(env)
    if node.op == "or":
        a, b = map(_expr, node.args)
        return lambda env: a(env) or b(env)
    f, args = _OPS[node.op], list(map(_expr, node.args))
    return lambda env: f(*(a(env) for a in args))


def _closure(nodes: list) -> Callable[[dict, Writer], None]:
    steps = [_node(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for s in steps:
            s(env, out)

    return run


def _node(node) -> Callable[[dict, Writer], None]:
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.write(t)
    if isinstance(node, Output):
        value = _expr(node.expr)
        return lambda env, out: out.write(_str(value(env)))
    if isinstance(node, Generation):
        body = _closure(node.body)

        def generation(env, out):
            begin = out.length
            body(env, out)
            out.spans.append((begin, out.length))

        return generation
    if isinstance(node, For):
        of, body, var = _expr(node.of), _closure(node.body), node.var

        def loop(env, out):
            inner, items = dict(env), list(of(env) or ())
            for k, x in enumerate(items):
                inner[var] = x
                inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k + 1 == len(items), "length": len(items)}
                body(inner, out)

        return loop
    branches = [(_expr(c), _closure(b)) for c, b in node.branches]

    def choose(env, out):
        for c, b in branches:
            if c(env):
                b(env, out)
                return

    return choose


class Writer:
    """Takes the text of a conversation and where generated text stands in it."""

    def __init__(self):
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.length = 0

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = _closure(self.tree)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and its spans under the loss mask. What a template asks of values of the wrong kind
        is a :class:`TemplateError`."""
        out = Writer()
        try:
            self.run({"messages": messages}, out)
        except TypeError as e:
            raise TemplateError(str(e)) from e
        return "".join(out.pieces), out.spans


@functools.lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    return Template(source)


# -- reading back what TEMPLATE writes
_MARK = re.compile(rf"\\.|({_CONTROL})", re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, role, begin = [], None, 0
    for m in _MARK.finditer(formatted):
        mark = m[1]
        if mark in ("[ROLE]", "[INST]"):
            begin = m.end()
        elif mark == "[/ROLE]":
            role, begin = unescape(formatted[begin : m.start()]), m.end()
        elif mark == "[/INST]":
            out.append((role, unescape(formatted[begin : m.start()])))
            role = None
        elif mark == "</s>":
            if role is not None:
                out.append((role, unescape(formatted[begin : m.start()])))
            role = None
    return out


FORMATTED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def format_conversations(df: DataFrame, template: str = TEMPLATE, part_chars: int = 4_000_000) -> DataFrame:
    """``(conv_id, part, formatted, loss_spans)`` of each conversation, turns in order.

    One shuffle by conversation; rows stream through, sorted, so a task holds one part of about
    ``part_chars`` characters (at least one turn) and not a conversation; nearly all have one part.
    A part is rendered by itself, so templates that look beyond a turn need
    ``part_chars`` above their conversations' size. Spans are ``[begin, end)`` in their part. Null roles and texts count as
    empty; turns with equal numbers, and null ones first, are ordered by role and text; repeated
    rows are repeated turns; rows with a null conv_id are one conversation; other columns are ignored.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compiled(template)
        ready: list[tuple] = []

        def stream():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

        def out():
            cols = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.list_(pa.int32())))], names=["conv_id", "part", "formatted", "loss_spans"])

        chars = 0
        conv, held, part = None, [], 0
        size, begun = 0, False

        def finish():
            nonlocal held, size, part, chars
            text, spans = render.render(held)
            ready.append((conv, part, text, [list(s) for s in spans]))
            chars += len(text)
            part += 1
            held, size = [], 0

        for key, role, text in stream():
            if begun and key != conv:
                finish()
                part = 0
            elif begun and size >= part_chars:
                finish()
            if chars >= part_chars:
                yield out()
                chars = 0
            conv, begun = key, True
            held.append({"role": role, "text": text})
            size += len(text)
        if begun:
            finish()
            yield out()

    return rows.mapInArrow(run, T.StructType([T.StructField("conv_id", T.LongType()), *FORMATTED]))


READ_BACK = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted text alone.

    The parts of a conversation must follow each other, as :func:`format_conversations` gives them.
    """

    def run(batches):
        rows, conv, begun = [], None, False
        turns = loss = None
        n = chars = total = 0

        def close():
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for key, _, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or key != conv:
                    if begun:
                        close()
                    conv, begun, turns, loss, n, chars, total = key, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for begin, end in spans:
                    said = unescape(text[begin:end])
                    loss.update(said.encode())
                    chars += len(said)
                total += len(text)
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if begun:
            close()
        if rows:
            yield _batch(rows)

    return formatted.mapInArrow(run, T.StructType([T.StructField("conv_id", T.LongType()), *(T.StructField(n, t) for n, t in READ_BACK)]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *(n for n, _ in READ_BACK)])
