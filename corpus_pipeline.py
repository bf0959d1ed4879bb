"""From raw documents to packed sequences: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, minhash_join, mixing, packing, toxicity
from quillspark.llm.bytebpe import byte_bpe_path
from quillspark.llm.common import Scratch, load, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones, doesn't reject. A null text is empty and stays; rows
    with null or repeated ids are judged each by its own text; an empty table gives no rows."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def _row_key(digest: Column) -> Column:
    """One string for an id, which may be null, and a digest of the text, whose length is fixed."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))


def _rows_of(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows whose key is in ``kept``, one for each key: the longest text, then the smallest row in the order
    of ``COLUMNS``. Rows are reduced before they move, so a key that many rows share is no large task."""
    row = F.struct((-F.length(text_or_empty())).alias("n_"), *COLUMNS[1:], "doc_id")
    rows = docs.select(key.alias("key_"), row.alias("row_")).groupBy("key_").agg(F.min("row_").alias("row_"))
    return rows.join(kept.select("key_").distinct(), "key_", "left_semi").select("row_.*").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text: the longest, then the one with the smallest id. Rows are told apart by id and
    text: a null id may be the one that stays, of different texts under one id each stays, and rows that repeat id and
    text are one. A null text is empty; an empty table gives no rows."""
    index = exact_dedup.DigestIndex(spark)
    try:
        kept = index.absorb(docs).where("kept").select(_row_key(F.col("text_sha256")).alias("key_"))
    finally:
        index.drop()  # this run's own; what is kept doesn't read it
    return _rows_of(docs, _row_key(exact_dedup.text_digest(text_or_empty())), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): the one with the smallest
    id, a null id first, then the smallest digest of the text. Rows are told apart by id and text and compared
    under numbers made of both, so null and repeated ids take part. Texts without words are near nothing and stay,
    one of each id and text; an empty table gives no rows."""
    key = _row_key(F.sha2(text_or_empty().cast("binary"), 256))
    with Scratch(spark, "near-copies") as tmp:
        keys = tmp(docs.select("doc_id", key.alias("key_")).distinct(), "row-keys")
        number = lambda seed: F.xxhash64(F.lit(seed), "key_")
        seed = 0  # of the numbers no two may be equal: about one seed in 100,000 gives a clash at 15 million rows
        while keys.groupBy(number(seed)).count().where("count > 1").limit(1).count():
            seed += 1
        numbered = docs.select(key.alias("key_"), "text").select(number(seed).alias("number_"), "text")
        found = minhash_join.near_duplicates(numbered, id_col="number_", width=5).select("number_", "component_id").distinct()
        groups = keys.withColumn("number_", number(seed)).join(found, "number_").groupBy("component_id")
        kept = tmp(groups.agg(F.min(F.struct("doc_id", "key_")).alias("best_")).select(F.col("best_.key_").alias("key_")), "kept", keep=True)
    return _rows_of(docs, key, kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule: files and rows follow each other in it. A null source is a source;
    null and repeated ids are rows like others; an empty table gives no rows."""
    return mixing.in_mixed_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; files are packed in their order, so each sequence is mixed as its stretch of the
    schedule. A null or empty text is one id; null and repeated ids are packed like others; an empty table gives no rows."""
    return packing.pack_documents(docs, byte_bpe_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The stages fit models, hash and tokenize: SQL can't express them. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's table is deleted when the next one is written; the last one's when the driver ends."""
    docs = load(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as tmp:
        for k, (name, stage) in enumerate(STAGES):
            after = tmp(stage(spark, docs, sf_dir), name, keep=k + 1 == len(STAGES))
            tmp.drop(docs)
            docs = after
    return docs
