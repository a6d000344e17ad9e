"""Retrieval metrics of one question as functions of two arrays: retrieved ids in rank order and relevant ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, n: Column) -> Column:
    return F.when(n > 0, a / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))


def hit(retrieved: Column, relevant: Column) -> Column:
    """1 if any relevant id is retrieved; 0 without relevant ids."""
    return F.size(F.array_intersect(retrieved, relevant)).cast("boolean").cast("double")


def full_hit(retrieved: Column, relevant: Column) -> Column:
    """1 if every relevant id is retrieved; 1 without relevant ids."""
    return (F.size(F.array_except(relevant, retrieved)) == 0).cast("double")


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(F.array_intersect(retrieved, relevant), lambda x: F.array_position(retrieved, x)), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.lit(1.0) / F.array_min(places)).otherwise(F.lit(0.0))


def recall(retrieved: Column, relevant: Column) -> Column:
    """Repeated relevant ids count on both sides."""
    return _ratio(F.size(F.filter(relevant, lambda x: F.array_contains(retrieved, x))), F.size(relevant))


def average_precision(retrieved: Column, relevant: Column) -> Column:
    """Precision at each hit over the distinct relevant ids; a repeated retrieved id counts again, so it can exceed 1."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("h"), F.lit(0.0).alias("p"))

    def step(a: Column, x: Column) -> Column:
        found = F.coalesce(F.array_contains(relevant, x), F.lit(False)).cast("int")
        gain = F.when(found == 1, (a["h"] + 1) / (a["k"] + 1)).otherwise(F.lit(0.0))
        return F.struct((a["k"] + 1).alias("k"), (a["h"] + found).alias("h"), (a["p"] + gain).alias("p"))

    return _ratio(F.aggregate(retrieved, start, step, lambda a: a["p"]), F.size(F.array_distinct(relevant)))
