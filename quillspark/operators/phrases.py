"""Phrase synonyms from a user's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms


def phrase_matches(queries: DataFrame, phrases: DataFrame, query_col: str = "query") -> DataFrame:
    """``(query_id, start, n, phrase, synonyms)``: where queries (query_id, query) hold phrases of the table (phrase, synonym), from left
    to right, the longest at each place, none overlapping one before.

    Both are compared as their terms. A query's stretches of up to the longest phrase's length meet the table by a join on
    equal terms, so the table may be of any size. Null and empty phrases match nothing; the synonyms of a phrase given in
    several rows are one sorted list."""
    known = phrases.select(terms(F.col("phrase")).alias("words"), F.array_join(terms(F.col("synonym")), " ").alias("synonym")).where("size(words) > 0")
    known = known.groupBy(F.array_join("words", " ").alias("phrase")).agg(F.max(F.size("words")).alias("n"), F.sort_array(F.collect_set(F.nullif("synonym", F.lit("")))).alias("synonyms"))
    lengths = [r["n"] for r in known.select("n").distinct().orderBy("n").collect()]  # as many as there are lengths of phrases
    if not lengths:
        return queries.select("query_id", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("phrase"), F.array().cast("array<string>").alias("synonyms")).limit(0)
    words = queries.select("query_id", terms(F.col(query_col)).alias("w"))
    grams = words.select("query_id", "w", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("size(w) >= n")
    grams = grams.select("query_id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("start", "phrase"))
    met = grams.join(known.drop("n"), "phrase")
    longest = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "start").orderBy(F.desc("n")))).where("r = 1").drop("r")
    # from left to right: a match counts if it begins where the last one that counts has ended, or later
    listed = longest.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "n", "phrase", "synonyms"))).alias("all"))
    empty = F.slice("all", 1, 0)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    free = lambda a, m: F.coalesce(m["start"] >= last(a)["start"] + last(a)["n"], F.lit(True))
    taken = F.aggregate("all", empty, lambda a, m: F.when(free(a, m), F.concat(a, F.array(m))).otherwise(a))
    return listed.select("query_id", F.inline(taken))


def with_synonyms(queries: DataFrame, phrases: DataFrame, query_col: str = "query") -> DataFrame:
    """``queries`` with ``terms``: their own and those of the synonyms of phrases that they hold, each once, in order, and
    ``phrases_found``, the phrases in the order of their places."""
    found = phrase_matches(queries, phrases, query_col).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "phrase", "synonyms"))).alias("found"))
    rows = queries.join(found, "query_id", "left")
    more = F.flatten(F.transform(F.flatten(F.transform("found", lambda m: m["synonyms"])), lambda s: F.split(s, " ")))
    out = rows.withColumn("terms", F.array_distinct(F.concat(terms(F.col(query_col)), F.coalesce(more, F.array().cast("array<string>")))))
    return out.withColumn("phrases_found", F.coalesce(F.transform("found", lambda m: m["phrase"]), F.array().cast("array<string>"))).drop("found")
