"""Exact duplicate removal by 128-bit content hash with byte comparison inside the groups.

Rows are grouped by the MD5 of their normalised text. Only (hash, salt, count, best id) is aggregated, with map-side
combine, so a text that a third of the table repeats costs one row per task and salt. Rows without company are answered where
they are read; only the texts of groups of two rows or more are exchanged, once, by (hash, salt). The salt spreads a hot group
over many tasks, and the text of the row that stays is sent once to each salt that its group really uses. Every member is
compared with it byte by byte. Members that differ (hash collisions) are grouped again by the text itself, which is exact.

The hashes of groups with company are broadcast up to ``BROADCAST_GROUPS`` of them, which are counted; beyond, rows meet them
in a join by (hash, salt).

Edge cases: a null text counts as empty; a null id ranks below every other id; rows that repeat an id and a text are
members of one group and are all annotated alike (``dedup`` keeps one of them); an empty table gives an empty result.
Other columns of any name pass through ``dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ascii_lower, table

SALTS = 32
BROADCAST_GROUPS = 500_000  # of some 40 bytes each


def _same_rank(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_of: Callable[[Column], Column], carry: bool, scratch: Scratch):
    """(lone rows, rows of groups): (_id, _n, _keep, _sha, _p) each; the groups' rows also have the verdict of the comparison.

    ``_p`` is the whole row if ``carry``. Lone rows take no part in any exchange where the groups are few enough to broadcast.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    payload = F.struct("*") if carry else F.lit(True)
    keyed = docs.select(payload.alias("_p"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), hash_of(norm).alias("_h"))
    keyed = keyed.withColumn("_salt", salt)
    if carry:
        keyed = keyed.drop("_text")
    parts = keyed.select("_id", "_h", "_salt").groupBy("_h", "_salt").agg(F.count(F.lit(1)).alias("_c"), best("_id").alias("_best"))
    groups = parts.groupBy("_h").agg(F.sum("_c").alias("_n"), best("_best").alias("_keep"), F.sort_array(F.collect_list("_salt")).alias("_salts"))
    groups = scratch.write(groups.where("_n > 1"))
    text = F.col("_p").getField(text_col) if carry else F.col("_text")
    norm = ascii_lower(F.coalesce(text, F.lit("")))
    if groups.count() <= BROADCAST_GROUPS:
        known = keyed.join(F.broadcast(groups.select("_h", "_n", "_keep")), "_h", "left")
    else:
        known = keyed.join(groups.select("_h", "_n", "_keep", F.explode("_salts").alias("_salt")), ["_h", "_salt"], "left")
    sha = F.sha2(norm, 256).alias("_sha")
    lone = known.where("_n IS NULL").select("_id", F.lit(1).cast("bigint").alias("_n"), F.col("_id").alias("_keep"), sha, "_p")
    rows = known.where("_n IS NOT NULL")
    # One row of each group; a repeated (id, text) may give several, of which the smallest text is taken.
    stays = rows.where(_same_rank("_id", "_keep")).select("_h", norm.alias("_kept_norm")).groupBy("_h").agg(F.min("_kept_norm").alias("_kept_norm"))
    stays = stays.join(groups.select("_h", "_salts"), "_h").select("_h", "_kept_norm", F.explode("_salts").alias("_salt"))
    met = rows.join(stays, ["_h", "_salt"], "left").withColumn("_norm", norm)
    same = F.coalesce(F.col("_norm") == F.col("_kept_norm"), F.lit(False))
    met = met.select("_id", "_n", "_keep", F.sha2("_norm", 256).alias("_sha"), "_p", "_h", same.alias("_same"), F.when(~same, F.col("_norm")).alias("_odd"))
    return lone, met


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the stable id that stays in each group, 'smallest' or 'largest'. ``hash_of`` is the content hash.
    """
    return _settled(docs.select(id_col, text_col), id_col, text_col, keep, hash_of, False)


def _settled(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_of: Callable[[Column], Column], carry: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    lone, met = _grouped(docs, id_col, text_col, keep, hash_of, carry, scratch)
    seen = scratch.write(met)
    odd = seen.where(~F.col("_same"))
    cols = ["_id", "_n", "_keep", "_sha", "_p"]
    if odd.isEmpty():
        whole = lone.unionByName(seen.select(cols))
    else:
        best = {"smallest": F.min, "largest": F.max}[keep]
        fewer = odd.groupBy("_h").agg(F.count(F.lit(1)).alias("_less"))
        regrouped = odd.groupBy("_odd").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        rest = seen.where("_same").join(fewer, "_h", "left").withColumn("_n", F.col("_n") - F.coalesce("_less", F.lit(0)))
        whole = lone.unionByName(rest.select(cols)).unionByName(odd.drop("_n", "_keep").join(regrouped, "_odd").select(cols))
    return whole.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        _same_rank("_id", "_keep").alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_p").alias("row")] if carry else []),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with exactly the columns of ``docs``."""
    groups = _settled(docs, id_col, text_col, keep, hash_of, True).where("kept")
    lone = groups.where(F.col("group_size") == 1).select("row.*")
    shared = groups.where(F.col("group_size") > 1).dropDuplicates(["text_sha256"]).select("row.*")
    return lone.unionByName(shared)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group: the largest doc_id."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
