"""Text clean-up and identifiers as column expressions. Patterns are Unicode-aware; lines end in \\n only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the clean-up, in order, each with what replaces it.
CLEANING = [
    ("\r\n?", "\n"),
    (r"(?dmU)^\s*##\s+.*$", ""),
    (r"(?dmU)^\s*[A-Z][A-Z\s\[\]\.\-]*CAP\.?\s*\d+\]?\s*\d+\s*$", ""),
    (r"(?dmU)^\s*Cap\.\s*\d+\.?\s*$", ""),
    (r"(?dmU)^\s*\d+\s*$", ""),
    (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
    (r"\n{2,}", "\n\n"),
]
# Fixed value: a page marker and its number.
PAGE_MARKER = r"(?iU)---\s*PAGE\s*(\d+)\s*---"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_document(c: Column) -> Column:
    """Line ends, headings, running headers, page numbers, hyphenation and blank lines of a scanned text."""
    for pattern, to in CLEANING:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_article(c: Column) -> Column:
    """One line of text: page markers and runs of white space become a space."""
    return strip(F.regexp_replace(F.regexp_replace(c, PAGE_MARKER, " "), r"(?U)\s+", " "))


def article_id(c: Column) -> Column:
    """``007A`` to ``7A``; what isn't a number with at most one letter stays."""
    number = F.regexp_extract(c, r"^(\d+)([A-Z]?)$", 1)
    return F.when(number == "", c).otherwise(F.concat(F.regexp_replace(number, r"^0+(?=\d)", ""), F.regexp_extract(c, r"^(\d+)([A-Z]?)$", 2)))


def article_value(c: Column, step: int = 100) -> Column:
    """An article's place in numeric order: its number times ``step`` plus the letter's place, -1 if it has no number.

    ``step=10`` gives tenths as values, under which 26J and 27 are equal."""
    number, letter = (F.regexp_extract(c, r"^(\d+)([A-Z]?)$", k) for k in (1, 2))
    return F.when(number == "", F.lit(-1)).otherwise(F.expr("0") + number.try_cast("int") * step + F.when(letter == "", 0).otherwise(F.ascii(letter) - 64))


def words(c: Column) -> Column:
    """What stands between ASCII blanks."""
    return F.filter(F.split(c, "[ \t\r\n]+"), lambda w: w != "")


def pieces(c: Column) -> Column:
    """The words of a text, each with the ASCII blanks behind it and the first with those in front: joined they are the text.
    A text of blanks only is one piece, an empty one has none."""
    parts = F.split(c, "(?<=[ \\t\\r\\n])(?=[^ \\t\\r\\n])")
    leads = c.rlike("^[ \\t\\r\\n]") & (F.size(parts) > 1)
    joined = F.concat(F.array(F.concat(parts[0], F.get(parts, F.lit(1)))), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))
    return F.when(leads, joined).otherwise(F.filter(parts, lambda p: p != ""))


def terms(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def is_url(c: Column) -> Column:
    """Whether a place is an address and not a path."""
    return c.rlike("^(?:http|https|file)://")


def file_name_of_url(url: Column) -> Column:
    """Last part of the path, ``document.pdf`` if there is none, with ``.pdf`` added if it lacks an ending."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.when(name == "", "document.pdf").otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
