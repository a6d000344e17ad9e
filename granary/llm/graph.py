"""Connected components by hooking to the smallest neighbour and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch


def relabelled(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its parent where it has one."""
    p = parents.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
    return rows.join(p, rows[column] == F.col("_u"), "left").withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")


def contract(labels: DataFrame, edges: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """``labels`` (nid, label, ...) after joining the labels that ``edges`` (u, v), two labels, connect.

    Each round every label takes the smallest label next to it as its parent, parents are followed two steps, and edges are
    rewritten; the rounds end when no edge is left. The surviving label of a component is its smallest. A table of labels that is
    replaced is removed. ``size`` is the number of labels or more; the tables of a round are written in files by their sizes.
    """
    edges = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 4 * size)
    while n := edges.count():
        parents = edges.groupBy("u").agg(F.min("v").alias("p"))
        for _ in range(2):
            parents = relabelled(parents, "p", parents)
        parents = scratch.write(parents, n)
        old = labels, edges, parents
        labels = scratch.write(relabelled(labels, "label", parents), size)
        both = relabelled(relabelled(edges, "u", parents), "v", parents).where("u <> v")
        edges = scratch.write(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n)
        scratch.drop(*old)
    scratch.drop(edges)
    return labels
