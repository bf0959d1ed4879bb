"""From files to chunks: classification, segmentation into articles, token windows, first-wins dedup."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry as R
from ..functions.text import PAGE_MARKER, article_id, article_value, clean_article, pieces


def classify(files: DataFrame, stem: str = "stem", chapters: DataFrame | None = None, overviews: DataFrame | None = None) -> DataFrame:
    """Adds citation_prefix, citation_label, id_label, doc_code, doc_overview and is_fallback to file stems.

    A leading chapter number is looked up in the registry (itself, else the part before the dot), then
    come the name rules, then the Commercial Code. The registries are small fixed tables."""
    spark = files.sparkSession
    chapters = chapters or spark.createDataFrame(R.CHAPTERS, "chap string, title string, code string")
    overviews = overviews or spark.createDataFrame(R.OVERVIEWS, "doc_code string, overview_ string")
    s, up = F.col(stem), F.upper(F.col(stem))
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*[-.]?\s*(.+)", 1)
    named = F.regexp_extract(up, r"SUBSIDIARY\s+LEGISLATION\s+(\d+)\s+(\d+)", 1)
    part = F.regexp_extract(up, r"SUBSIDIARY\s+LEGISLATION\s+(\d+)\s+(\d+)", 2)
    out = files.withColumns({"number_": number, "base_": F.split_part(number, F.lit("."), F.lit(1))})
    exact = chapters.select(F.col("chap").alias("number_"), F.col("title").alias("t1_"), F.col("code").alias("c1_"))
    above = chapters.where("chap not like '%.%'").select(F.col("chap").alias("base_"), F.col("title").alias("t2_"), F.col("code").alias("c2_"))
    out = out.join(F.broadcast(exact), "number_", "left").join(F.broadcast(above), "base_", "left")
    code, title = F.coalesce("c1_", "c2_"), F.coalesce("t1_", "t2_")
    eu = up.contains("EU") | s.contains("650.2012")
    act = up.contains("COMPANIES ACT")
    two = F.format_string("%02d", part.try_cast("int"))
    cap = named.try_cast("int").cast("string")
    regulation = F.when(code.isNotNull(), number.contains(".")).when(eu | act, False).otherwise(named != "")
    rule = lambda known, a, b, c, d: F.when(code.isNotNull(), known).when(eu, a).when(act, b).when(named != "", c).otherwise(d)
    out = out.withColumns({
        "citation_prefix": rule(title, "EU Succession Regulation (650/2012)", "Companies Act (Cap. 386)", F.concat(F.lit("S.L. "), cap, F.lit("."), two), "Commercial Code (Cap. 13)"),
        "doc_code": rule(code, "eu_succession", "companies_act", F.concat(F.lit("sl_"), cap, F.lit("_"), two), "code_13"),
        "citation_label": F.when(regulation, "Reg.").otherwise("Art."), "id_label": F.when(regulation, "regulation").otherwise("article"),
        "is_fallback": code.isNull() & ~eu & ~act & (named == ""),
    })
    out = out.join(F.broadcast(overviews), "doc_code", "left").withColumn("doc_overview", F.coalesce("overview_", F.lit("")))
    return out.drop("number_", "base_", "t1_", "c1_", "t2_", "c2_", "overview_")


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line_no from 1, line)``."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def page_of_line(rows: DataFrame, key: str, page: Column, order: str = "line_no") -> DataFrame:
    """Adds ``page``: the last marker's page at or before a line; before the first marker that one's; else 1."""
    w = Window.partitionBy(key)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("marker_", page)
    first = F.min(F.when(F.col("marker_").isNotNull(), F.struct(order, "marker_"))).over(w)
    return rows.withColumn("page", F.coalesce(F.last("marker_", True).over(before), first["marker_"], F.lit(1))).drop("marker_")


def rising(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value is larger than that of all rows before them."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("max_", F.max(value).over(before)).where(F.col("max_").isNull() | (F.col(value) > F.col("max_"))).drop("max_")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def next_greater(values: pd.Series) -> pd.Series:
    """For each element of an array the place (from 1) of the next larger one, null if there is none."""

    def one(a):
        out, open_ = [None] * len(a), []
        for i, v in enumerate(a):
            while open_ and a[open_[-1]] < v:
                out[open_.pop()] = i + 1
            open_.append(i)
        return out

    return values.map(one)


HEADING = r"^[\t  ]*([0-9]{1,4}[A-Z]?)\s*\.(?:\s|$)"


# Fixed value: a number with a dot anywhere in a text.
INLINE = r"([0-9]{1,4}[A-Z]?)\s*\."


def _segment_rows(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """What :func:`segment` makes of headings at the beginnings of lines, each text in its row, so that nothing is shuffled."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("lines_"))
    rows = rows.withColumn("heads_", F.transform("lines_", lambda line: F.regexp_extract(line, HEADING, 1)))
    marks = F.transform("lines_", lambda line, i: F.struct((i + 1).alias("at"), F.regexp_extract(line, PAGE_MARKER, 1).try_cast("int").alias("page")))
    rows = rows.withColumn("marks_", F.filter(marks, lambda m: m["page"].isNotNull()))
    rows = rows.withColumn("begins_", F.filter(F.transform("heads_", lambda h, i: F.when(h != "", i + 1)), lambda i: i.isNotNull()))

    def article(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("begins_", i + 1), F.size("lines_") + 1)
        first = F.regexp_replace(F.element_at("lines_", begin), HEADING, "")
        content = clean_article(F.array_join(F.concat(F.array(first), F.slice("lines_", begin + 1, end - begin - 1)), "\n"))
        return F.struct(article_id(F.element_at("heads_", begin)).alias("article"), content.alias("content"), begin.alias("begin"))

    rows = rows.select(key, "marks_", F.transform("begins_", article).alias("articles_"))
    valued = F.transform("articles_", lambda a: F.struct(*(a[c].alias(c) for c in ("article", "content", "begin")), article_value(a["article"]).alias("value")))
    rows = rows.select(key, "marks_", valued.alias("articles_"))
    valid = lambda a: (a["value"] > 0) & (a["value"] <= most * 100) & (a["content"] != "")
    rows = rows.select(key, "marks_", F.filter("articles_", valid).alias("articles_"))
    # rising values, of which there are no more than valid numbers
    none = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("kept"))
    more = lambda so_far, x: F.struct(x["value"].alias("top"), F.concat(so_far["kept"], F.array(x["at"])).alias("kept"))
    numbered = F.transform("articles_", lambda a, i: F.struct(a["value"].alias("value"), (i + 1).alias("at")))
    rows = rows.withColumn("kept_", F.aggregate(numbered, none, lambda so_far, x: F.when(x["value"] > so_far["top"], more(so_far, x)).otherwise(so_far))["kept"])

    def placed(i: Column) -> Column:
        a = F.element_at("articles_", i)
        before = F.filter("marks_", lambda m: m["at"] <= a["begin"])
        page = F.coalesce(F.get(before, F.size(before) - 1)["page"], F.get("marks_", F.lit(0))["page"], F.lit(1))
        return F.struct(*(a[c].alias(c) for c in ("article", "content", "value")), page.alias("page"))

    # outer: else Spark filters texts by the size of the whole expression, which it then works out for each element
    rows = rows.select(key, F.posexplode_outer(F.transform("kept_", placed)).alias("position", "a")).where("a is not null")
    return rows.select(key, "a.article", "a.content", "a.page", (F.col("position") + 1).alias("position"), F.col("a.value").alias("article_order"))


def segment(docs: DataFrame, key: str = "doc_code", text: str = "content", most: int = 550, keep_after_markers: bool = True, inline_headings: bool = True, enough: int = 500, unique: bool = False) -> DataFrame:
    """``(key, article, content, page, position, article_order)``: articles of cleaned texts, headings being lines that
    begin with a number and a dot. Numbers must rise and be at most ``most``, bodies not be empty.

    ``keep_after_markers=False`` ends a body at a page marker. ``inline_headings`` adds numbers with a
    dot anywhere in the text that are larger than the last heading's, in documents with fewer than ``enough``
    articles; their bodies end at the next larger number (:func:`inline_articles`). ``unique`` says that no key is there twice:
    without inline headings and ends at markers a text is then segmented in its row and isn't shuffled."""
    if unique and keep_after_markers and not inline_headings:
        return _segment_rows(docs, key, text, most)
    rows = lines(docs, key, text)
    rows = rows.withColumns({"marker": F.regexp_extract("line", PAGE_MARKER, 1).try_cast("int"), "head": F.regexp_extract("line", HEADING, 1)})
    rows = page_of_line(rows, key, F.col("marker"))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum((F.col("head") != "").cast("int")).over(so_far)).where("block > 0")
    if not keep_after_markers:
        inside = Window.partitionBy(key, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("cut_", F.sum(F.col("marker").isNotNull().cast("int")).over(inside)).where("cut_ = 0")
    body = F.when(F.col("head") != "", F.regexp_replace("line", HEADING, "")).otherwise(F.col("line"))
    blocks = rows.groupBy(key, "block").agg(F.max("head").alias("head"), F.min(F.struct("line_no", "page"))["page"].alias("page"), F.array_sort(F.collect_list(F.struct("line_no", body.alias("body")))).alias("parts"))
    blocks = blocks.select(key, F.col("block").alias("order_"), article_id(F.col("head")).alias("article"), clean_article(F.array_join(F.transform("parts", lambda p: p["body"]), "\n")).alias("content"), "page")
    blocks = blocks.withColumn("value_", article_value(F.col("article"))).where((F.col("value_") > 0) & (F.col("value_") <= most * 100) & (F.col("content") != ""))
    out = rising(blocks, key, "value_", "order_").withColumn("tier_", F.lit(0))
    if inline_headings:
        last = out.groupBy(key).agg(F.max("value_").alias("last_"), F.count(F.lit(1)).alias("n_"))
        out = out.unionByName(inline_articles(docs, last, key, text, most, enough).withColumn("tier_", F.lit(1)))
    place = Window.partitionBy(key).orderBy("tier_", "order_")
    return out.select(key, "article", "content", "page", F.row_number().over(place).alias("position"), F.col("value_").alias("article_order"))


def inline_articles(docs: DataFrame, last: DataFrame, key: str, text: str, most: int = 550, enough: int = 500) -> DataFrame:
    """``(key, order_, article, content, page, value_)``: numbers with a dot anywhere in the text that are larger than the
    last article's and all accepted before; a body ends where the next larger number stands, whether that is accepted or not.
    ``last``: (key, last_, n_) of documents that have articles; those with ``enough`` get none.

    Only numbers larger than all valid ones since the last number beyond ``most`` can be accepted, and the next larger number of
    such a one is the next of them or the next number beyond ``most``. So they cut the text into pieces, each of which is in one body."""
    pieces = F.regexp_replace(F.regexp_replace(F.col(text), PAGE_MARKER, "\u0001p$1\u0002$0\u0003"), INLINE, "\u0001$1\u0002$0\u0003")
    rows = docs.select(key, F.posexplode(F.split(pieces, "\u0001")).alias("order_", "piece")).where("order_ > 0")
    part = lambda c, mark, n: F.split_part(c, F.lit(mark), F.lit(n))
    rows = rows.select(key, "order_", part(F.col("piece"), "\u0002", 1).alias("tag"), part(part(F.col("piece"), "\u0002", 2), "\u0003", 1).alias("own"), part(F.col("piece"), "\u0003", 2).alias("rest"))
    rows = rows.withColumns({"article": article_id(F.col("tag")), "page_": F.when(F.col("tag").startswith("p"), F.substring("tag", 2, 12).try_cast("int"))})
    rows = page_of_line(rows.withColumn("value_", article_value(F.col("article"))), key, F.col("page_"), "order_").join(last, key, "left")
    up_to = Window.partitionBy(key).orderBy("order_").rowsBetween(Window.unboundedPreceding, 0)
    beyond = F.col("value_") > most * 100
    valid = (F.col("value_") > F.greatest(F.lit(0), F.coalesce("last_", F.lit(0)))) & ~beyond & (F.coalesce("n_", F.lit(0)) < enough)
    rows = rows.withColumn("stretch_", F.sum(beyond.cast("int")).over(up_to)).withColumn("v_", F.when(valid, F.col("value_")))
    before = Window.partitionBy(key, "stretch_").orderBy("order_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begins", valid & (F.col("v_") > F.coalesce(F.max("v_").over(before), F.lit(0))))
    rows = rows.withColumn("block", F.sum((F.col("begins") | beyond).cast("int")).over(up_to)).where("block > 0")
    # a block's first piece comes without its number, the others as they stand
    words_ = F.when(F.col("begins"), F.col("rest")).otherwise(F.concat("own", "rest"))
    blocks = rows.groupBy(key, "block").agg(F.min(F.struct("order_", "begins", "article", "page", "value_")).alias("f"), F.array_sort(F.collect_list(F.struct("order_", words_.alias("w")))).alias("parts"))
    raw = F.array_join(F.transform("parts", lambda p: p["w"]), "")
    some = blocks.where("f.begins").select(key, "f.order_", "f.article", clean_article(raw).alias("content"), "f.page", "f.value_").where("content <> ''")
    return rising(some, key, "value_", "order_")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """How many windows ``n`` tokens have."""
    return F.when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)).cast("int") + 1)


def token_windows(docs: DataFrame, keys: list[str], tokens: Column, size: int = 3000, overlap: int = 200) -> DataFrame:
    """Adds ``chunk_index`` (from 0), ``chunk_tokens``, ``total_chunks`` and ``total_chunks_ref``: windows of ``size``
    tokens that overlap, up to the one that reaches the end. ``total_chunks_ref`` leaves the overlap out of account."""
    step = size - overlap
    n = F.size("tokens_")
    rows = docs.withColumn("tokens_", tokens).withColumns({"total_chunks": window_count(n, size, overlap), "total_chunks_ref": F.greatest(F.ceil(n / size).cast("int"), F.lit(1))})
    # the windows are cut inside the row, so that no window carries the whole text
    windows = F.transform(F.sequence(F.lit(0), F.col("total_chunks") - 1), lambda i: F.slice("tokens_", i * step + 1, F.lit(size)))
    return rows.select(*keys, F.posexplode(windows).alias("chunk_index", "chunk_tokens"), "total_chunks", "total_chunks_ref")


def text_windows(docs: DataFrame, keys: list[str], text: str, size: int = 3000, overlap: int = 200, tokens: Callable[[Column], Column] = pieces) -> DataFrame:
    """Windows like those of :func:`token_windows` that keep the text: adds ``chunk_index``, ``total_chunks``, ``tokens``, ``content``,
    which is what stands from ``char_start`` (from 0) up to ``char_end`` in the text, and ``own_end``, where the next
    window begins: texts up to ``own_end`` joined are the whole text. ``tokens`` makes an array that joined gives the text.
    A null text is empty; an empty text has one empty window."""
    step = size - overlap
    n = F.size("pieces_")
    rows = docs.withColumn("pieces_", tokens(F.coalesce(F.col(text), F.lit("")))).withColumn("total_chunks", window_count(n, size, overlap))
    places = F.sequence(F.lit(0), F.col("total_chunks") - 1)
    cut = lambda i, n: F.array_join(F.slice("pieces_", i * step + 1, n), "")
    own = F.transform(places, lambda i: F.length(cut(i, F.when(i + 1 < F.col("total_chunks"), step).otherwise(size))))
    rows = rows.withColumn("edges_", F.aggregate(own, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    windows = F.transform(places, lambda i: F.struct(
        i.alias("chunk_index"), F.size(F.slice("pieces_", i * step + 1, F.lit(size))).alias("tokens"), cut(i, F.lit(size)).alias("content"),
        F.get("edges_", i).alias("char_start"), F.get("edges_", i + 1).alias("own_end")))
    out = rows.select(*keys, "total_chunks", F.inline(windows))
    return out.withColumn("char_end", F.col("char_start") + F.length("content"))


def id_code(rows: DataFrame) -> Column:
    """What the ids of a classified file's chunks begin with. Files of one chapter share code and article: the chapter's number, in stems
    behind the dot, keeps their ids apart."""
    chapter = F.nullif(F.regexp_extract("stem", r"^\d+\.(\d+)", 1), F.lit("")) if "stem" in rows.columns else F.lit(None).cast("string")
    return F.concat_ws("#", "doc_code", chapter)


def chunk_id(rows: DataFrame, index: Column) -> Column:
    """The id of a chunk of a classified article. What stands behind :func:`id_code` holds six underscores, so ids with different codes differ."""
    return F.format_string("%s_%s_%s_p%d_pos%d_chunk_%d", id_code(rows), "id_label", "article", "page", "position", index + 1)


def chunk_documents(articles: DataFrame, size: int = 3000, overlap: int = 200, tokens: Callable[[Column], Column] = pieces, joined: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of classified articles, with id and citation. ``tokens`` makes an array of tokens of a text and ``joined``
    a text of tokens; a tokenizer's encode and decode fit there as vectorised functions. The ones given here are words
    with the blanks behind them, so a chunk is a part of its article as it stands."""
    rows = token_windows(articles, [c for c in articles.columns if c != "content"], tokens(F.col("content")), size, overlap)
    joined = joined or (lambda c: F.array_join(c, ""))
    return rows.select(
        chunk_id(rows, F.col("chunk_index")).alias("id"),
        joined(F.col("chunk_tokens")).alias("content"), "article", "page", "position", "chunk_index", "total_chunks", F.size("chunk_tokens").alias("tokens"),
        F.concat_ws(" ", "citation_prefix", "citation_label", "article").alias("citation"), F.col("citation_prefix").alias("document"), "id_label", "doc_code", "doc_overview")


def first_wins(rows: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """Of rows with an equal key the first in ``order``, with the number of rows; groups are reduced to a minimum before the shuffle."""
    names = list(dict.fromkeys([*order, *keep]))
    best = rows.groupBy(key.alias("key_")).agg(F.min(F.struct(*names)).alias("best_"), F.count(F.lit(1)).alias("copies"))
    return best.select("key_", *[F.col(f"best_.{c}").alias(c) for c in names], "copies")
