"""Byte-level BPE: exact token counts at every prefix by dynamic programming, and fast ids.

A byte-level BPE splits a text into pieces with a fixed pattern and merges bytes inside each
piece. Inside a piece the encoding of a prefix ends in exactly one token ``t`` such that ``t``
follows the last token of the shorter prefix in front of it: the pair must be its own encoding.
So the last token and the count of every prefix follow from those of shorter prefixes
(:class:`PrefixCounter`), and nothing is encoded twice. Prefixes are kept by their bytes, hence
pieces that begin alike share their tables.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
from array import array

import numpy as np
import regex

#: The split pattern and the special string of the public vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

_SPLIT = regex.compile(PATTERN)
#: White space after which or in front of which a piece need not begin: runs, and a space at the end.
_ODD = re.compile(r"\s[\s]| \Z")
#: White space as the pattern means it (Python's isspace() knows more).
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
_CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
#: Runs that are too long for a coder whose time grows with the square of a piece.
_LONG_RUN = re.compile(r"\S{2048}|\s{2048}")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _model(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Tokens with their ids, and the merges in order, of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    as_bytes = lambda s: bytes(to_byte[c] for c in s)
    ids = {as_bytes(token): i for token, i in model["vocab"].items() if token != SPECIAL}
    return ids, [tuple(map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)) for pair in model["merges"]]


def pieces(text: str) -> list[str]:
    return _SPLIT.findall(text)


def unit_pieces(u: str) -> list[str]:
    """Pieces of a space followed by ``u``, which holds no space and begins with none; a line end in front
    of ``u`` stands in the text itself, without a space."""
    if u.isalpha():
        return [" " + u]
    if u[-1:] in ".,;:!?" and u[:-1].isalpha():
        return [" " + u[:-1], u[-1]]
    return pieces(u) if u[:1] == "\n" else pieces(" " + u)


def _units(text: str) -> list[str] | None:
    """``text`` cut where a space or a line end surely begins a piece: the first unit is what stands in front,
    further ones follow a space each or begin with their line end. None if it has white space that isn't single."""
    if _ODD.search(text):
        return None
    if "\n" in text:
        text = text.replace("\n", " \n")
    return text.split(" ")


class PrefixCounter:
    """Exact token counts of prefixes under a byte-level BPE vocabulary file.

    Counts of prefixes and of what stands between spaces are remembered, at most ``keep`` of each; when
    that is reached the memory starts anew, which costs time and changes no result.
    """

    #: Prefixes of longer pieces aren't remembered.
    LONG = 64

    def __init__(self, path: str, keep: int = 600_000):
        self.ids, merges = _model(path)
        self.token = {i: t for t, i in self.ids.items()}
        #: the two tokens that a token was merged from (a byte: itself), and the reverse
        self.halves: dict[int, tuple[int, int]] = {i: (i, i) for i in self.token}
        self.merged: dict[int, int] = {}
        self.order: dict[int, int] = dict.fromkeys(self.token, -1)
        for r, (left, right) in enumerate(merges):
            a, b, t = self.ids[left], self.ids[right], self.ids[left + right]
            self.halves[t], self.merged[a << 20 | b], self.order[t] = (a, b), t, r
        self.keep = keep
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._units: dict[str, int] = {}
        self._prefixes: dict[bytes, int] = {}  # last token and count
        self._ends: dict = {}
        for token, i in self.ids.items():
            node = self._ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i

    def _stands_alone(self, t: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        if (ok := self._own.get(t)) is None:
            a, b = self.halves[t]
            ok = self._own[t] = a == t or self._stands_alone(a) and self._stands_alone(b) and self._follows(a, b, self.order[t])
        return ok

    def _follows(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether the bytes of ``a`` and ``b`` in a row are encoded as these two tokens.

        The merges are undone latest first on the two sides of the border; the pair fails if at some
        point two neighbours at the border would have merged earlier than what was undone.
        ``before``: only merges that rank before it count.
        """
        key, order, halves, ok = a << 20 | b, self.order, self.halves, True
        limit = before
        while True:
            t = self.merged.get(a << 20 | b)
            if t is not None and order[t] < limit:
                ok = False
                break
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal merges the left one comes first, so the right one is undone first
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]
        if before == 1 << 60:
            if len(self._pairs) > 4 * self.keep:
                self._pairs.clear()
            self._pairs[key] = ok
        return ok

    def _last_token(self, data: bytes, end: int, last_at) -> tuple[int, int]:
        """(last token, where it begins) of ``data[:end]``; ``last_at(i)`` is the last token of ``data[:i]``.

        The tokens that end here are met by walking back through the trie of reversed tokens."""
        node, begin, pairs = self._ends, end, self._pairs
        while begin:
            begin -= 1
            if (node := node.get(data[begin])) is None:
                break
            if (t := node.get(-1)) is not None:
                if not begin:
                    ok = self._stands_alone(t)
                elif (ok := pairs.get((a := last_at(begin)) << 20 | t)) is None:
                    ok = self._follows(a, t)
                if ok:
                    return t, begin
        raise ValueError("the vocabulary doesn't cover every byte")

    def piece_table(self, data: bytes) -> list[int]:
        """Token counts of ``data[:0], data[:1], ...`` for the bytes of a piece."""
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            last[end], begin = self._last_token(data, end, last.__getitem__)
            count[end] = count[begin] + 1
        return count

    def piece_count(self, p: str) -> int:
        """Token count of a piece. Its prefixes are remembered: pieces that begin alike share them."""
        data = p.encode()
        if len(data) > self.LONG:
            return self.piece_table(data)[-1]
        seen = self._prefixes
        if (known := seen.get(data)) is not None:
            return known & 255
        if len(seen) > self.keep:
            seen.clear()
        n = len(data) - 1
        while n and data[:n] not in seen:
            n -= 1
        for end in range(n + 1, len(data) + 1):
            t, begin = self._last_token(data, end, lambda i: seen[data[:i]] >> 8)
            known = seen[data[:end]] = t << 8 | (seen[data[:begin]] & 255 if begin else 0) + 1
        return known & 255

    # -- whole texts
    def _counts(self, units: list[str]) -> list[int]:
        """Token counts of the units of a text."""
        known = self._units
        first, rest = sum(map(self.piece_count, pieces(units[0]))), units[1:]
        try:
            return [first, *map(known.__getitem__, rest)]
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for u in rest:
                if u not in known:
                    known[u] = sum(map(self.piece_count, unit_pieces(u)))
            return [first, *map(known.__getitem__, rest)]

    def _plain_count(self, text: str) -> int:
        if not text:
            return 0
        if (units := _units(text)) is None:
            return sum(map(self.piece_count, pieces(text)))
        return sum(self._counts(units))

    def count(self, text: str) -> int:
        """Token count of a whole text; the special string counts as one token."""
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(map(self._plain_count, parts))

    def prefix_counts(self, text: str) -> np.ndarray:
        """``out[i]`` is the exact token count of ``text[:i]`` for every ``i`` from 0 to its length."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base, at, tail, before = 0, 0, "", 0
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                # an unfinished special string is ordinary text: only the last piece in front of it may change
                for j in range(1, len(SPECIAL)):
                    out[at + j] = before + self._plain_count(tail + SPECIAL[:j])
                base = int(out[at]) + 1
                at += len(SPECIAL)
                out[at] = base
            begin, before = self._fill(part, out, at, base)
            tail = part[begin:]
            at += len(part)
        return out

    def _fill(self, part: str, out: np.ndarray, at: int, base: int) -> tuple[int, int]:
        """Counts of the prefixes of ``part``, which stands at ``at`` behind ``base`` tokens. Returns where
        its last piece begins (the last run of white space, if it ends in one) and the count up to there.

        A prefix splits like the whole up to its last piece, but for two cases: a contraction that
        isn't finished splits anew, and white space at the end of a prefix is one piece.
        """
        begin, total, run_end, run_table, last = 0, base, 0, {}, (0, base)
        for p in pieces(part):
            table = self.piece_table(p.encode())
            if begin + 1 > run_end and p[0] in _SPACES:  # a run of white space begins here
                run_end = begin
                while run_end < len(part) and part[run_end] in _SPACES:
                    run_end += 1
                counts, used, run_table = self.piece_table(part[begin:run_end].encode()), 0, {}
                for i in range(begin, run_end):
                    used += len(part[i].encode())
                    run_table[i + 1] = total + counts[used]
                last = (begin, total)
            elif begin >= run_end:
                last = (begin, total)
            used = 0
            for i, ch in enumerate(p, 1):
                used += len(ch.encode())
                end = begin + i
                if end <= run_end:
                    out[at + end] = run_table[end]
                elif i < len(p) and _CONTRACTION.fullmatch(p):
                    out[at + end] = total + sum(map(self.piece_count, pieces(p[:i])))
                else:
                    out[at + end] = total + table[used]
            total += table[-1]
            begin += len(p)
        return last

    def truncate(self, text: str, budget: int, counts: np.ndarray | None = None) -> str:
        """The longest prefix of at most ``budget`` tokens (counts need not grow with the prefix)."""
        counts = self.prefix_counts(text) if counts is None else counts
        return text[: int(np.flatnonzero(counts <= budget)[-1])]

    def count_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """Token count of a text, and the length of its longest prefix of at most ``budget`` tokens, without
        the counts of all prefixes: a prefix that holds pieces of more than ``budget`` tokens has more itself,
        so only the place where the sum passes the budget is looked at."""
        if SPECIAL in text:
            counts = self.prefix_counts(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
        units = _units(text) if text else []
        if units is None:
            units = pieces(text)
            counts = list(map(self.piece_count, units))
            lengths = list(map(len, units))
        elif units:
            counts = self._counts(units)
            # a unit's own space is its first character, a line end is there already
            lengths = None
        else:
            return 0, 0
        if (n := sum(counts)) <= budget:
            return n, len(text)
        sums = list(itertools.accumulate(counts))
        k = bisect.bisect_right(sums, budget)  # the first unit that passes the budget
        if lengths is None:
            lengths = [len(units[0]), *(len(u) + (u[:1] != "\n") for u in units[1 : k + 1])]
            begin = sum(lengths[:k])
        else:  # begin in front of white space and of a contraction that pieces behind it may change
            k0 = max(0, k - 3)
            while k0 and (units[k0][0] in _SPACES or units[k0 - 1][-1] in _SPACES):
                k0 -= 1
            begin = sum(lengths[:k0])
            k, base = k, sums[k0 - 1] if k0 else 0
            end = sum(lengths[: k + 1])
            return n, self._last_fit(text, begin, end, base, budget)
        return n, self._last_fit(text, begin, begin + lengths[k], sums[k - 1] if k else 0, budget)

    def _last_fit(self, text: str, begin: int, end: int, base: int, budget: int) -> int:
        """The largest ``i`` from ``begin`` to ``end`` so that ``text[:i]`` has at most ``budget`` tokens; a piece
        begins at ``begin`` behind ``base`` tokens."""
        out = np.full(end - begin + 1, base, dtype=np.int64)
        self._fill(text[begin:end], out, 0, base)
        return begin + int(np.flatnonzero(out <= budget)[-1])


class IdCoder:
    """Ids of texts: ``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A faster coder is built from the same vocabulary file where that is sure to be the same: ids must
    follow the order of the merges, and the library must encode the bytes of each token as that token.
    Otherwise, and in texts with very long runs, pieces go to the library's own model one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.special = tokenizer.token_to_id(SPECIAL)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.fast = self._fast_coder(path)

    def _fast_coder(self, path: str):
        import tiktoken

        ids, merges = _model(path)
        order = [ids[a + b] for a, b in merges]
        if any(x >= y for x, y in itertools.pairwise(order)) or set(order) & {ids[bytes([b])] for b in range(256)} or len(order) + 256 != len(ids):
            return None
        if any(len(self.model.tokenize(t.decode("latin-1").translate(self.letters))) != 1 for t in ids):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})

    def _piece(self, p: str) -> bytes:
        letters = p.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or len(text) > 2048 and _LONG_RUN.search(text):
            return b"".join(map(self._piece, pieces(text)))
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()

    def ids(self, text: str) -> np.ndarray:
        mark = np.array([self.special], dtype="<u4").tobytes()
        return np.frombuffer(mark.join(map(self._plain, text.split(SPECIAL))), dtype="<u4")


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and file."""
    return PrefixCounter(path)


@functools.lru_cache(maxsize=2)
def id_coder(path: str) -> IdCoder:
    return IdCoder(path)


def byte_bpe_path() -> str:
    """The public vocabulary file; it is read where it is installed and never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
