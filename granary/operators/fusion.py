"""Merging and reranking of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.vectors import top_k

RRF_K = 60


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, id_col: str, k: int = 30, rrf_k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Joins lists with ``query_id``, the id, and dense_rank or bm25_rank; fields of the dense list win.

    Ties go to the better dense rank, then to the better bm25 rank, missing ones last.
    """
    a, b = dense.withColumn("_in_dense", F.lit(True)), sparse
    shared = [c for c in a.columns if c in b.columns and c not in ("query_id", id_col)]
    b = b.select(*[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns])
    both = a.join(b, ["query_id", id_col], "full")
    for c in shared:
        both = both.withColumn(c, F.coalesce(c, f"_b_{c}")).drop(f"_b_{c}")
    part = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), digits))
    both = both.withColumn("retrieval_source", F.when(F.col("_in_dense"), "dense").otherwise("bm25")).drop("_in_dense")
    order = (F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.col(id_col))
    return top_k(both, "query_id", k, "fused_rank", *order)


def rerank(candidates: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of each query by a score column; ties keep the fused order."""
    return top_k(candidates.withColumn("rerank_score", score), "query_id", k, "final_rank", F.desc("rerank_score"), F.col("fused_rank"))
