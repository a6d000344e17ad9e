"""Joins by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the last in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def looked_up(rows: DataFrame, key: str, ids: str, store: DataFrame, id_col: str, value: str, default: Column | None = None, drop: bool = False) -> DataFrame:
    """``key, values``: the values of an array of ids in its order. A missing id gives ``default`` (which may use ``_id``), or nothing if ``drop``."""
    each = rows.select(key, F.posexplode_outer(ids).alias("_pos", "_id"))
    s = store.select(F.col(id_col).alias("_id"), F.col(value).alias("_v"))
    found = each.join(s, "_id", "left")
    v = F.col("_v") if drop or default is None else F.coalesce("_v", default)
    item = F.when(F.col("_pos").isNotNull() & v.isNotNull(), F.struct(F.col("_pos"), v.alias("v")))
    return found.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_l")).select(key, F.transform("_l", lambda x: x["v"]).alias("values"))


def missing_ids(rows: DataFrame, key: str, ids: str, store: DataFrame, id_col: str) -> DataFrame:
    """The ids that the store lacks."""
    each = rows.select(key, F.explode(ids).alias("_id"))
    return each.join(store.select(F.col(id_col).alias("_id")), "_id", "left_anti").select(key, F.col("_id").alias("missing_id"))


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def spot_lookup(ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Each wanted id with the stored row and whether it was found."""
    marked = store.withColumn("_found", F.lit(True))
    return ids.join(marked, key, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def groups_of_at_least(rows: DataFrame, key: str, n: int = 2) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def last_index(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """Largest number behind the last underscore of ids with a prefix; 0 if there is none."""
    number = F.element_at(F.split(column, "_"), -1).try_cast("int")
    return ids.where(F.startswith(F.col(column), F.lit(prefix))).agg(F.coalesce(F.max(number), F.lit(0)).alias("last_index"))
