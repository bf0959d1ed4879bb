"""Reports over chunks, evaluation runs and query logs."""

from __future__ import annotations

import bisect
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def corpus_report(chunks: DataFrame, document: str) -> DataFrame:
    """Chunks and share of each document, with a warning above one half."""
    counts = chunks.groupBy(F.coalesce(F.col(document).cast("string"), F.lit("Unknown")).alias("document")).agg(F.count(F.lit(1)).alias("chunks"))
    total = counts.agg(F.sum("chunks").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("document", "chunks", F.round(F.col("chunks") / F.col("total"), 6).alias("share"), (F.col("chunks") * 2 > F.col("total")).alias("dominates"))


def totals(chunks: DataFrame, document: str, present: Column) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct(document).alias("documents"), F.count_if(present).alias("present"))


def evaluation(results: DataFrame) -> DataFrame:
    """Counts and means of an evaluation run; the mean confidence is over those that aren't 0."""
    return results.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("chunks_retrieved") > 0).alias("answered"), F.avg("chunks_retrieved").alias("mean_chunks"),
        F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))).alias("mean_confidence"), F.count_if("adaptive_retrieval_used").alias("adaptive"))


def query_kind(message: Column) -> Column:
    return F.when(F.lower(message).rlike(r"\barticle\s*\d+"), "article_lookup").when(message.contains("?"), "question").otherwise("keyword_search")


KINDS = ("article_lookup", "question", "keyword_search")


def query_kinds(logs: DataFrame, message: str = "message") -> DataFrame:
    """``(kind, n, n_unique)`` of logged queries, kinds without any included."""
    rows = logs.select(query_kind(F.col(message)).alias("kind"), F.col(message).alias("m"))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("n_unique"))
    every = logs.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return every.join(counts, "kind", "left").na.fill(0)


def frequent_queries(logs: DataFrame, message: str, order: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent messages, ties by first occurrence."""
    return logs.groupBy(F.col(message).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")).orderBy(F.desc("n"), "first_at", "message").limit(n)


def recent(logs: DataFrame, module: str, time: str, tie: str, per_module: int, n: int) -> DataFrame:
    """The last ``per_module`` entries of each module, of these the last ``n``."""
    w = Window.partitionBy(module).orderBy(F.desc(time), F.desc(tie))
    return logs.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= per_module).drop("r_").orderBy(F.desc(time), F.desc(tie)).limit(n)


def matching_lines(docs: DataFrame, part: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that contain ``part``, upper and lower case alike."""
    rows = docs.where(F.lower(F.col(text)).contains(part.lower())).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.where(F.lower("line").contains(part.lower())).withColumn("line_no", F.col("line_no") + 1)


def _lines_found(parts: list[str]):
    """A function of a text: ``(number, line, places of the parts that it contains)`` of its lines that contain some."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, part in enumerate(parts):
        machine.add_word(part, i)
    machine.make_automaton()

    def found(whole: str):
        for no, (line, low) in enumerate(zip(whole.split("\n"), whole.lower().split("\n"), strict=True) if parts else (), 1):
            if at := dict.fromkeys(i for _, i in machine.iter(low)):
                yield no, line, list(at)

    return found


def lines_with(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", most_queries: int = 100_000, piece: int = 1 << 22) -> DataFrame:
    """``(query_id, key, line_no, line)``: lines that contain a query (query_id, query), upper and lower case alike, each once for each
    query. Null and empty queries are in no line.

    The queries go to the tasks as an automaton that reads each line once, whatever their number; beyond ``most_queries`` in
    blocks of about half as many, each with a pass of its own. A task holds one text and about ``piece`` characters of what it found."""
    asks = queries.select("query_id", F.lower("query").alias("part")).where("part <> ''")
    some = asks.limit(most_queries + 1).collect()
    if len(some) > most_queries:
        n = -(-2 * asks.count() // most_queries)
        block = lambda i: queries.where(F.pmod(F.xxhash64("query_id", "query"), F.lit(n)) == i)
        return functools.reduce(DataFrame.union, (lines_with(block(i), docs, key, text, most_queries, piece) for i in range(n)))
    wanted: dict[str, dict] = {}
    for r in some:
        wanted.setdefault(r["part"], {})[r["query_id"]] = True
    kinds = queries.schema["query_id"].dataType, docs.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        found, asked = _lines_found(list(wanted)), [list(ids) for ids in wanted.values()]
        ids, own, nos, lines, at, held = [], [], [], [], [], 0  # at: each row's line

        def rows():
            cut = [pa.array(v, t) for v, t in zip((own, nos, lines), types[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, types[0]), *(c.take(pa.array(at, pa.int32())) for c in cut)], names=schema.names)

        for b in batches:
            for i in range(b.num_rows):
                for no, line, parts in found(b.column(1)[i].as_py()):
                    mine = asked[parts[0]] if len(parts) == 1 else list(dict.fromkeys(q for p in parts for q in asked[p]))
                    step = max(1, piece // (len(line) + 32))
                    for begin in range(0, len(mine), step):
                        some = mine[begin : begin + step]
                        own.append(b.column(0)[i].as_py())
                        nos.append(no)
                        lines.append(line)
                        ids += some
                        at += [len(own) - 1] * len(some)
                        held += len(some) * (len(line) + 32)
                        if held >= piece:
                            yield rows()
                            ids, own, nos, lines, at, held = [], [], [], [], [], 0
        if at:
            yield rows()

    return docs.where(F.col(text).isNotNull()).select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def first_lines(queries: DataFrame, docs: DataFrame, k: int, key: str = "id", text: str = "content", most_queries: int = 20_000) -> DataFrame:
    """``(query, key, line_no, held)``: of each query (query, parts) the first ``k`` lines that contain one of its parts, upper and lower case
    alike: those that hold the query as it is first (``held``), then by key and number.

    A task keeps ``k`` lines of each query, without their text. Queries go to the tasks, in blocks of about half ``most_queries``; equal
    ones are looked for once. Keys that aren't whole numbers or strings are ranked by Spark alone."""
    asks = queries.where("query is not null").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("parts", F.lower)))).alias("parts"))
    some = asks.limit(most_queries + 1).collect()
    if len(some) > most_queries:
        n = -(-2 * asks.count() // most_queries)
        return functools.reduce(DataFrame.union, (first_lines(queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i), docs, k, key, text, most_queries) for i in range(n)))
    asked = [r["query"] for r in some]
    of: dict[str, list[int]] = {}
    for i, r in enumerate(some):
        for part in filter(None, r["parts"]):
            of.setdefault(part, []).append(i)
    kind = docs.schema[key].dataType
    sorts = isinstance(kind, (T.IntegralType, T.StringType))
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField(key, kind), T.StructField("line_no", T.IntegerType()), T.StructField("held", T.BooleanType())])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        found, mine = _lines_found(list(of)), list(of.values())
        best: dict[int, list[tuple]] = {}

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)

        for b in batches:
            for i in range(b.num_rows):
                own, out = b.column(0)[i].as_py(), []
                for no, line, parts in found(b.column(1)[i].as_py()):
                    for q in mine[parts[0]] if len(parts) == 1 else dict.fromkeys(q for p in parts for q in mine[p]):
                        if not sorts:
                            out.append((asked[q], own, no, asked[q] in line))
                            continue
                        kept = best.setdefault(q, [])
                        if len(kept) == k and (False, own, no) >= kept[-1]:
                            continue
                        bisect.insort(kept, (asked[q] not in line, own, no))
                        del kept[k:]
                if out:
                    yield rows(out)
        yield rows([(asked[q], own, no, not without) for q, kept in best.items() for without, own, no in kept])

    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).cast("string")).mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("held"), key, "line_no"))
    return rows.withColumn("place_", place).where(F.col("place_") <= k).drop("place_")


def log_totals(logs: DataFrame, message: str = "message") -> DataFrame:
    """Logged queries and different ones."""
    return logs.agg(F.count(message).alias("total"), F.count_distinct(message).alias("n_unique"))


def build_report(articles: DataFrame, chunks: DataFrame, file: str = "stem", files: DataFrame | None = None) -> DataFrame:
    """``(file, document, articles, chunks, article_list, total_documents, total_articles, total_chunks)``: a row for each
    file with its articles in order and its chunks before equal ids are merged, and the totals, chunks after that.

    ``articles``: (file, document or citation_prefix, article, article_order, position); ``chunks``: (file, id). ``files``: (file, document)
    lists all files; those without articles have a row with zeros then, and count as documents."""
    document = "document" if "document" in articles.columns else "citation_prefix"
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_order", "position", "article"))), lambda x: x["article"]), ",")
    per_file = articles.groupBy(F.col(file).alias("file")).agg(F.min(document).alias("document"), F.count(F.lit(1)).alias("articles"), listed.alias("article_list"))
    if files is not None:
        per_file = files.select(F.col(file).alias("file"), "document").join(per_file.drop("document"), "file", "left").na.fill(0, ["articles"]).na.fill("", ["article_list"])
    per_file = per_file.join(chunks.groupBy(F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("chunks")), "file", "left").na.fill(0, ["chunks"])
    totals = per_file.agg(F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum("articles"), F.lit(0)).alias("total_articles")).crossJoin(chunks.agg(F.count_distinct("id").alias("total_chunks")))
    return per_file.select("file", "document", "articles", "chunks", "article_list").crossJoin(F.broadcast(totals))
