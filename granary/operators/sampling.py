"""Seeded samples by hash order; the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, id_col: str) -> list[Column]:
    """Sort keys of a seeded order that ends in the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]


def sample_per_group(rows: DataFrame, by: str, n: int, seed: int, id_col: str) -> DataFrame:
    """At most ``n`` rows of each group."""
    w = Window.partitionBy(by).orderBy(*shuffled(seed, id_col))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sample_stratified(rows: DataFrame, n: int, seed: int, id_col: str, by: str) -> DataFrame:
    """``n`` rows with an even share of each category, topped up from the rest in the same order.

    With more categories than rows some categories get none; fewer rows than ``n`` give all of them.
    """
    if n <= 0:
        return rows.limit(0)
    categories = rows.select(by).distinct().count()
    if not categories:
        return rows.limit(0)
    quota = max(1, n // categories)
    w = Window.partitionBy(by).orderBy(*shuffled(seed, id_col))
    # No category gives more than n rows, so n of each are enough for the quota and the top-up.
    ranked = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return ranked.orderBy(F.when(F.col("_rn") <= quota, 0).otherwise(1), *shuffled(seed, id_col)).limit(n).drop("_rn")


def _pairs(rows: DataFrame, seed: int, id_col: str, doc_col: str, by: str) -> DataFrame:
    """Two rows each of documents that have at least two: ``by, doc, first_id, second_id``."""
    w = Window.partitionBy(doc_col).orderBy(*shuffled(seed, id_col))
    two = rows.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    pairs = two.groupBy(by, doc_col).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(id_col))).alias("first_id"), F.max(F.when(F.col("_rn") == 2, F.col(id_col))).alias("second_id")
    )
    return pairs.where("second_id IS NOT NULL")


def sample_pairs(rows: DataFrame, n_pairs: int, seed: int, id_col: str, doc_col: str, by: str, minimum: int = 0) -> DataFrame:
    """Pairs of an even share of the documents of each category; no top-up. ``by, doc, first_id, second_id``.

    With ``minimum``, each category gives that many documents and an even share of what then remains, as far as it has them.
    More pairs than ``n_pairs`` are cut in the seeded order.
    """
    pairs = _pairs(rows, seed, id_col, doc_col, by)
    categories = pairs.select(by).distinct().count()
    if not categories or n_pairs <= 0:
        return pairs.limit(0)
    quota = minimum + max(0, n_pairs - minimum * categories) // categories if minimum else max(1, n_pairs // categories)
    chosen = sample_per_group(pairs, by, quota, seed, doc_col)
    return chosen.orderBy(*shuffled(seed, doc_col)).limit(n_pairs)
