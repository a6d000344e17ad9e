"""Retrieval, answering and grading of many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import metrics, models
from granary.functions.replies import JUDGE_REPLY, answer_prompt, json_object
from granary.operators.bm25 import Index, bm25_topk
from granary.operators import reports
from granary.operators.fusion import reciprocal_rank_fusion, rerank
from granary.operators.stored import stored
from granary.operators.vectors import dense_topk

CANDIDATES, FUSED, FINAL = 30, 30, 10


def hybrid_topk(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column] = models.lexical_reranker, final_k: int = FINAL) -> DataFrame:
    """Two candidate lists fused and reranked. Only fused candidates get their texts and meet the reranker."""
    fused = reciprocal_rank_fusion(dense, sparse, "id", FUSED)
    texts = fused.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id").join(
        queries.select("query_id", F.col("text").alias("_question")), "query_id"
    )
    return rerank(texts, score(F.col("_question"), F.col("text")), final_k).drop("_question")


def hybrid_retrieve(index: Index, collection: DataFrame, chunks: DataFrame, queries: DataFrame, digits: int | None = None, **more) -> DataFrame:
    """30 dense and 30 sparse candidates, 30 fused, 10 final. ``queries`` has query_id, text and embedding; distances are rounded to ``digits``."""
    dense = dense_topk(collection, queries, CANDIDATES, "id", digits).select("query_id", "id", "distance", "dense_rank")
    return hybrid_topk(dense, bm25_topk(index, queries, CANDIDATES), chunks, queries, **more)


def with_hits(questions: DataFrame, ranked: DataFrame, rank: str, id_col: str = "id") -> DataFrame:
    """Questions with ``hits``: their ranked passages (title, text, id) as an array; at most k of each, so it is small."""
    title = F.col("title") if "title" in ranked.columns else F.lit(None).cast("string")
    item = F.struct(F.col(rank).alias("rank"), F.col(id_col).cast("string").alias("id"), title.alias("title"), F.col("text"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))
    return questions.join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


def rag(questions: DataFrame, ranked: DataFrame, rank: str, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Questions with hits, prompt and answer."""
    rows = with_hits(questions, ranked, rank).withColumn("prompt", answer_prompt(F.col("text"), F.col("hits")))
    generate = generate or (lambda prompt, hits: models.first_sentence(hits))
    return rows.withColumn("generated_answer", generate(F.col("prompt"), F.col("hits")))


def graded(answers: DataFrame, judge: Callable[[Column, Column, Column], Column] = models.rule_judge) -> DataFrame:
    """Answers with metrics and ``judge_scores``, null where the reply cannot be read. Needs key_facts and relevant_chunk_ids."""
    got = F.transform("hits", lambda h: h["id"])
    rows = answers.withColumn("retrieved_chunk_ids", got)
    pair = (F.col("retrieved_chunk_ids"), F.col("relevant_chunk_ids"))
    rows = rows.withColumns(
        {
            "hit": metrics.hit(*pair), "full_hit": metrics.full_hit(*pair), "reciprocal_rank": metrics.reciprocal_rank(*pair),
            "recall_at_k": metrics.recall(*pair), "average_precision": metrics.average_precision(*pair),
        }
    )
    reply = judge(F.col("generated_answer"), F.col("key_facts"), F.col("hits"))
    return rows.withColumn("judge_scores", json_object(reply, JUDGE_REPLY))


def evaluation(
    questions: DataFrame,
    ranked: DataFrame,
    rank: str,
    generate: Callable[[Column, Column], Column] | None = None,
    judge: Callable[[Column, Column, Column], Column] = models.rule_judge,
) -> dict[str, DataFrame]:
    """A whole run over retrieved passages: 'results' by question, 'metrics' in total and by type, 'errors' by type.

    ``questions`` has query_id, type, text, key_facts and relevant_chunk_ids. Results are stored, so that models are called once.
    """
    rows = graded(rag(questions, ranked, rank, generate), judge).withColumn("latency_seconds", F.lit(None).cast("double"))
    results = stored(rows.withColumnRenamed("query_id", "id"), "evaluation")
    return {
        "results": results,
        "metrics": reports.metrics_by_type(results, ["hit", "full_hit", "reciprocal_rank", "recall_at_k", "average_precision"], judged_only=True),
        "errors": reports.error_distribution(results),
    }
