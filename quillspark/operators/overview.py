"""Overviews: what an answer is built from, and a generator that may be exchanged.

A generator is a function of a table with the columns query, context, sources and prompt that adds ``text``; :func:`extracts` is
the one that needs no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry as R
from .retrieval import citations, confidence, context_heading, contexts

NOTHING_FOUND = "Nothing was found that an overview could be made of."


def instruction(intent: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.INSTRUCTIONS.items() for x in kv]), intent), F.lit(R.INSTRUCTION))


def prompt(query: Column, intent: Column, context: Column) -> Column:
    """The request to a model: question, intent, sources and what to heed."""
    return F.concat_ws(
        "\n\n", F.lit("Answer from the sources below and from nothing else. If they don't answer the question, say so."),
        F.concat(F.lit("Question: "), query), F.concat(F.lit("Intent: "), F.coalesce(intent, F.lit("general information"))), F.concat(F.lit("Sources:\n"), context),
        F.concat(instruction(intent), F.lit(" Name document, article and page of each source you use.")))


def wanted(kind: Column, hits: Column, enabled: bool = True, requested: bool = True) -> Column:
    """Whether a query gets an overview: not a lookup, something found, and neither switched off nor declined."""
    return F.lit(enabled and requested) & (kind != "article_lookup") & (hits > 0)


def extracts(rows: DataFrame, sources: int = 3) -> DataFrame:
    """The first sentence of each of the first sources, with its heading."""

    def line(x: Column) -> Column:
        text = F.trim(F.regexp_replace(x["content"], r"\s+", " "))
        first = F.regexp_extract(text, r"^(.*?[.!?])(?: |$)", 1)
        return F.concat(F.when(first != "", first).otherwise(text), F.lit(" "), x["heading"])

    return rows.withColumn("text", F.array_join(F.transform(F.slice("sources", 1, sources), line), "\n"))


def by_model(complete: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A generator that calls ``complete(prompt)`` on the executors; where that raises, ``failed`` is true and the text says why."""

    def generate(rows: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]):
            for b in batches:
                texts, failed = [], []
                for p in b.column(b.schema.get_field_index("prompt")).to_pylist():
                    try:
                        texts.append(complete(p))
                        failed.append(False)
                    except Exception as e:  # noqa: BLE001  any failure of a service is that row's answer
                        texts.append(f"No overview could be written: {e}")
                        failed.append(True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(failed, pa.bool_())], names=[*b.schema.names, "text", "failed"])

        return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("text", T.StringType()), T.StructField("failed", T.BooleanType())]))

    return generate


def overviews(queries: DataFrame, hits: DataFrame, generate: Callable[[DataFrame], DataFrame] = extracts) -> DataFrame:
    """``(query_id, overview, citations, confidence, articles_analyzed)`` of each query.

    ``queries``: (query_id, query, intent); ``hits``: (query_id, rank, score, document, citation, article, page, content). A query
    without hits gets :data:`NOTHING_FOUND` with confidence 0. Where the generator adds ``failed``, such rows have confidence 0 and no
    citations."""
    listed = citations(hits).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_rank", "document", "citation", "article", "page"))), lambda c: F.struct(*[c[n].alias(n) for n in ("document", "citation", "article", "page")])).alias("citations"))
    # the first three of the hits given, whatever ranks they had among others
    placed = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    source = F.struct("rank", context_heading(*map(F.col, ("document", "citation", "article", "page"))).alias("heading"), F.coalesce("content", F.lit("")).alias("content"))
    listed = listed.join(hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources")), "query_id")
    rows = queries.select("query_id", "query", "intent").join(contexts(hits).join(listed, "query_id").join(confidence(placed), "query_id"), "query_id", "left")
    found = generate(rows.where("context is not null").withColumn("prompt", prompt(F.col("query"), F.col("intent"), F.col("context"))))
    names = ["query_id", "overview", "citations", "confidence", "articles_analyzed"]
    no_citations = F.array().cast(listed.schema["citations"].dataType)
    if "failed" in found.columns:
        found = found.withColumns({"confidence": F.when(F.col("failed"), 0.0).otherwise(F.col("confidence")), "citations": F.when(F.col("failed"), no_citations).otherwise(F.col("citations"))})
    nothing = rows.where("context is null").select("query_id", F.lit(NOTHING_FOUND).alias("overview"), F.coalesce("citations", no_citations).alias("citations"), F.lit(0.0).alias("confidence"), F.lit(0).alias("articles_analyzed"))
    return found.withColumnRenamed("text", "overview").select(*names).unionByName(nothing)
