"""Okapi BM25 over postings in DataFrames.

An index is written once, to a path of the caller's or to the shared folder, and then read by column: postings hold one row a
term and document, so that a search reads no text. Scores of a search are written as well, since the best documents, the
queries short of matches and their fillers all come from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import word_tokens
from granary.operators.stored import shared_folder, stored
from granary.operators.vectors import top_k

K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_TERMS = 200_000  # distinct query terms that are broadcast, of some 50 bytes each
TEXT_A_TASK = 8 << 20  # bytes of texts whose terms a task counts
SCORES_A_TASK = 1_000_000  # that a task sums, of some 100 bytes each


@dataclass
class Index:
    """postings (term, id, tf, len), terms (term, df), the numbers of documents and mean length in one row, and all ids."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    ids: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build_index`` wrote."""
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "totals", "ids")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """The index of ``docs``, written to ``path`` or else to the shared folder.

    Texts are measured, then dealt by id to tasks of a bounded size, so that the terms that a task counts do not grow with the input.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "bm25")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0] or 0
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(max(-(-size // TEXT_A_TASK), spark.sparkContext.defaultParallelism), "id")
    tokens = dealt.select("id", word_tokens(F.col("text")).alias("_t"))
    each = tokens.select("id", F.size("_t").alias("len"), F.explode("_t").alias("term"))
    postings = each.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    ids = docs.select(F.col(id_col).alias("id"))
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    n = F.lit(spark.read.parquet(f"{path}/ids").count())
    mean = F.when(n > 0, F.coalesce(F.sum("tf"), F.lit(0)) / F.nullif(n, F.lit(0)))
    postings.agg(n.cast("bigint").alias("docs"), mean.alias("avg_len")).write.mode("overwrite").parquet(f"{path}/totals")
    return open_index(spark, path)


def term_weights(index: Index) -> DataFrame:
    """(term, idf): negative weights are replaced by a share of the mean weight over all terms."""
    raw = index.terms.crossJoin(F.broadcast(index.totals.select("docs"))).select(
        "term", (F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf")
    )
    mean = raw.agg((F.avg("idf") * EPSILON).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))


def bm25_topk(index: Index, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``query_id, id, bm25_score, bm25_rank``; ``queries`` has query_id and text. Documents without a common term fill up with 0.

    Fillers are the first documents in order of id. Terms of the queries, if few, meet the postings without an exchange of these.
    """
    spark = queries.sparkSession
    wanted = queries.select("query_id", F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = stored(wanted.join(term_weights(index), "term"), "bm25-terms")
    few = weighed.count() <= MAX_TERMS
    tf = F.col("tf").cast("double")
    share = F.col("len") / F.nullif(F.col("avg_len"), F.lit(0.0))
    gain = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))
    postings = index.postings
    if few:
        # Postings of wanted terms are dealt by document, so that a task sums a bounded number of scores, however many there are.
        asked, pairs = F.broadcast(weighed.select("term").distinct()), weighed.join(index.terms, "term").agg(F.sum("df")).first()[0]
        tasks = max(-(-(pairs or 0) // SCORES_A_TASK), spark.sparkContext.defaultParallelism)
        postings = postings.join(asked, "term", "left_semi").repartition(tasks, "id")
    scores = (
        postings.join(F.broadcast(weighed) if few else weighed, "term")
        .crossJoin(F.broadcast(index.totals.select("avg_len")))
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(gain), digits).alias("bm25_score"))
    )
    scores = stored(scores, "bm25-scores")
    best = top_k(scores, "query_id", k, "bm25_rank", F.desc("bm25_score"), F.col("id"))
    # Only queries with fewer than k good matches need fillers, of which k are among the first k + their matches ids.
    found = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bm25_score") > 0).alias("good"))
    short = queries.select("query_id").distinct().join(found, "query_id", "left").where(F.coalesce("good", F.lit(0)) < k)
    short = stored(short.select("query_id", F.coalesce("n", F.lit(0)).alias("n")), "bm25-short")
    most = short.agg(F.max("n")).first()[0]
    if most is None:
        return best
    first = index.ids.orderBy("id").limit(k + most)
    first = first.withColumn("place", F.row_number().over(Window.orderBy("id")))  # k ids and the matches of one short query at most
    places = short.select("query_id", F.explode(F.sequence(F.lit(1), (k + F.col("n")).cast("int"))).alias("place"))
    filler = places.join(first, "place").join(scores.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = best.drop("bm25_rank").unionByName(filler.select("query_id", "id").withColumn("bm25_score", F.lit(0.0)))
    return top_k(both, "query_id", k, "bm25_rank", F.desc("bm25_score"), F.col("id"))
