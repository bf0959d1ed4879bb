"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crosspoly, exact_dedup, html_extract, langid, line_dedup, minhash_join, mixing, packing, periodic_runs, sort_means, token_counts, toxicity
from .bytebpe import byte_bpe_path
from .common import crc_mod, load


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), byte_bpe_path())


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    try:
        return index.absorb(load(spark, sf_dir, "documents"))
    finally:
        index.drop()  # the result doesn't read it


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    # formatted by itself: a conversation of the table that has this number stays its own
    return chat.read_back(chat.format_conversations(rows)).unionByName(chat.read_back(chat.format_conversations(extra)))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(load(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(load(spark, sf_dir, "documents"), width=2)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")  # tells rows apart without reading texts
    mixed = mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "source", place.alias("row")), tie=F.col("row"))
    return mixed.select("doc_id", "source", F.col("slot_").alias("slot"), F.col("place_").alias("place"), F.col("block_").alias("block"), F.col("in_horizon_").alias("in_horizon"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_matches")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), byte_bpe_path())


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = sort_means.sort_means(load(spark, sf_dir, "embeddings"))
    digests = spark.createDataFrame(list(enumerate(sort_means.centroid_digest(centroids))), "cluster int, centroid_sha256 string")  # 40 at most
    return out.join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_KEPT = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _sort_means_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds: every vector against every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_KEPT})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    near = "SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {}) GROUP BY vec_id"
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})",
            f"s{r} AS (SELECT cluster, i, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL)",
            f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM c{r} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS n FROM s{r} GROUP BY 1) ON c = cluster)",
        ]
    return f"""WITH {', '.join(parts)}, z AS ({near.format(f'c{rounds}')})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON c = cluster"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(load(spark, sf_dir, "documents"), before=periodic_runs.looped_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, i, line, coalesce(k.doc_id <> last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_langid, op2_packing, op3_vector_near_dedup, op4_exact_dedup, op5_chat_format, op6_html_text, op7_minhash_near_dedup, op8_mixing, op9_toxicity, op10_token_counts, op11_sort_means, op12_periodic_runs, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_sort_means": _sort_means_sql(), "op13_line_dedup": OP13_SQL}
