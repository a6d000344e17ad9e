"""Summaries of results, grades and corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.replies import DIMENSIONS, ERROR_TYPES
from granary.operators.stored import stored

TYPE_ORDER = ["single_chunk", "multi_chunk", "complex"]


def mean(c: Column) -> Column:
    """0 for no values."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def fixed_then_name(c: Column, order: list[str]) -> list[Column]:
    """Sort keys: the given names first in their order, others by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))
    return [F.when(place > 0, place).otherwise(len(order) + 1), c]


def metrics_by_type(
    results: DataFrame,
    values: list[str],
    dimensions: list[str] = DIMENSIONS,
    judged_only: bool = False,
    missing_latency_is_zero: bool = False,
) -> DataFrame:
    """One row for all results (``type`` null) and one for each type, in one pass.

    ``values`` are averaged over all rows; with ``judged_only`` over judged rows in the rows by type, as two of the reports want.
    Dimensions are averaged over judged rows, a missing dimension counting as 0.
    """
    judged = F.col("judge_scores").isNotNull()
    total = F.grouping("type") == 1
    latency = F.coalesce("latency_seconds", F.lit(0.0)) if missing_latency_is_zero else F.col("latency_seconds")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(~judged).alias("n_skipped")]
    for v in values:
        over_all, over_judged = mean(F.col(v)), mean(F.when(judged, F.col(v)))
        aggs.append((F.when(total, over_all).otherwise(over_judged) if judged_only else over_all).alias(v))
    for d in dimensions:
        aggs.append(mean(F.when(judged, F.coalesce(F.col("judge_scores").getField(d), F.lit(0.0)))).alias(d))
    aggs.append(mean(latency).alias("avg_latency_seconds"))
    return results.rollup("type").agg(*aggs)


def error_distribution(results: DataFrame, default: str = "NONE", by: list[str] | None = None) -> DataFrame:
    """Counts of error types over judged rows; fixed order first where it is sorted."""
    kind = F.coalesce(F.col("judge_scores.error_type"), F.lit(default)).alias("error_type")
    rows = results.where(F.col("judge_scores").isNotNull()).select(*(by or []), kind)
    counts = rows.groupBy(*(by or []), "error_type").agg(F.count(F.lit(1)).alias("n"))
    order = fixed_then_name(F.col("error_type"), ERROR_TYPES)
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def with_skip_reason(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """Results with their mapped ids, or the reason why they cannot be evaluated."""
    m = mapping.select("id", "mapped_relevant_chunk_ids").withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "not in mapping").when(
        F.coalesce(F.size("mapped_relevant_chunk_ids"), F.lit(0)) <= 0, "no mapped chunks"
    )
    return results.join(m, "id", "left").withColumn("skip_reason", reason).drop("_known")


def grader_agreement(rows: DataFrame, dimensions: list[str] = DIMENSIONS, name: str = "name") -> DataFrame:
    """``name, type, dim, manual, judge, diff_judge_minus_manual, n``, by type and (type null) in total.

    Rows without one of the two gradings are left out.
    """
    both = rows.where(F.col("manual_scores").isNotNull() & F.col("judge_scores").isNotNull())
    each = both.select(
        name,
        "type",
        F.explode(
            F.array(*[
                F.struct(F.lit(d).alias("dim"), F.col("manual_scores").getField(d).alias("m"), F.col("judge_scores").getField(d).alias("j"))
                for d in dimensions
            ])
        ).alias("x"),
    ).select(name, "type", "x.*")
    grouped = each.groupingSets([[name, "dim"], [name, "type", "dim"]], name, "type", "dim").agg(
        mean(F.col("m")).alias("manual"), mean(F.col("j")).alias("judge"), F.count(F.lit(1)).alias("n")
    )
    return grouped.withColumn("diff_judge_minus_manual", F.col("judge") - F.col("manual"))


OPTIONAL_METRICS = ["recall_at_k", "average_precision", "hit", "reciprocal_rank"]


def manual_rows(results: DataFrame, grades: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Results of a run with what a reviewer gave them: ``grades`` has id, the dimensions, error_type and notes.

    Results without grades are left out; metrics that the run lacks are null, and missing lists of ids are empty.
    """
    given = F.struct(*[F.col(f"_g.{c}").alias(c) for c in [*dimensions, "error_type", "notes"]]).alias("manual_scores")
    g = grades.select(F.col("id").alias("_id"), F.struct(*dimensions, "error_type", "notes").alias("_g"))
    have = set(results.columns)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in have else F.array().cast("array<string>").alias(c) for c in ("relevant_chunk_ids", "retrieved_chunk_ids")]
    metrics = [F.col(c).cast("double").alias(c) if c in have else none(c, "double") for c in OPTIONAL_METRICS]
    texts = [F.col(c) if c in have else none(c, "array<string>" if c == "key_facts" else "string") for c in ("question", "generated_answer", "reference_answer", "key_facts")]
    return results.join(g, F.col("id") == F.col("_id")).select("id", "type", *texts, *lists, *metrics, "judge_scores", given)


def manual_summary(rows: DataFrame, dimensions: list[str] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Means of the manual grades in total (``type`` null) and by type, and the counts of error types."""
    rows = rows.where(F.col("manual_scores").isNotNull())
    means = rows.rollup("type").agg(F.count(F.lit(1)).alias("n"), *[mean(F.col("manual_scores").getField(d)).alias(d) for d in dimensions])
    errors = counts_by(rows, F.col("manual_scores.error_type").alias("error_type"))
    return means, errors


def missing_gradings(rows: DataFrame) -> DataFrame:
    """Ids that lack a grading, with which one."""
    kind = F.when(F.col("manual_scores").isNull(), "manual").when(F.col("judge_scores").isNull(), "judge")
    return rows.select("id", kind.alias("missing")).where("missing IS NOT NULL")


def config_ranking(agreement: DataFrame, name: str = "name") -> DataFrame:
    """Configurations by the mean of their manual dimension means."""
    total = agreement.where("type IS NULL").groupBy(name).agg(
        F.avg("manual").alias("manual_avg"), F.avg("judge").alias("judge_avg"), F.avg("diff_judge_minus_manual").alias("diff_avg")
    )
    w = Window.orderBy(F.desc(F.round("manual_avg", 9)), name)  # one row a configuration
    return total.withColumn("rank", F.row_number().over(w))


def run_all(experiments: dict[str, DataFrame]) -> DataFrame:
    """The results of several experiments as one table with an ``experiment`` column."""
    out = None
    for label, rows in experiments.items():
        one = rows.withColumn("experiment", F.lit(label))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def run_paths(read: Callable[[str], DataFrame], paths: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """``run_all`` over stored results, and the experiments whose file is missing; any other failure is raised."""
    found, missing = {}, []
    for label, path in paths.items():
        try:
            found[label] = read(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(label)
    return (run_all(found) if found else None), missing


def counts_by(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] = []) -> DataFrame:
    """``_g`` (a struct of 0 and ``by``), and ``q0``, ``q1``, ...: exact quantiles, between neighbours by their distance.

    Values are counted, put in order over all tasks by range, and numbered from the sums of the ranges before, so that no task
    holds all values of a group. Nulls are left out.
    """
    group = F.struct(F.lit(0).alias("_0"), *by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = stored(counts.repartitionByRange("_g", "_v").withColumn("_p", F.spark_partition_id()), "quantiles")
    sums = ranged.groupBy("_g", "_p").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy("_g")
    sums = sums.select("_g", "_p", (F.sum("_s").over(w.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(w).alias("_n"))
    seen = F.sum("_c").over(Window.partitionBy("_g", "_p").orderBy("_v")) + F.col("_before")
    placed = ranged.join(sums, ["_g", "_p"]).withColumn("_seen", seen)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_seen") > place) & (F.col("_seen") - F.col("_c") <= place), F.col("_v").cast("double")))

    place = [F.lit(p) * (F.col("_n") - 1) for p in shares]
    ends = placed.groupBy("_g", "_n").agg(*[at(f(p)).alias(f"{x}{k}") for k, p in enumerate(place) for x, f in (("a", F.floor), ("b", F.ceil))])
    between = [F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (p - F.floor(p)) for k, p in enumerate(place)]
    return ends.select("_g", *[q.alias(f"q{k}") for k, q in enumerate(between)])


def group_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    stats = rows.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    median = quantiles(rows, value, [0.5], [by]).select(F.col("_g").getField(by).alias("_by"), F.col("q0").alias("median"))
    return stats.join(median, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "median", "min", "max")


def describe(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    stats = rows.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(rows, value, [0.25, 0.5, 0.75]).select(F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return stats.join(q, how="left").select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def extremes(rows: DataFrame, id_col: str, value: str, n: int = 10) -> DataFrame:
    """The ``n`` smallest and the ``n`` largest rows."""
    pick = lambda end, *order: rows.select(id_col, value).orderBy(*order).limit(n).withColumn("end", F.lit(end))
    return pick("shortest", F.col(value), F.col(id_col)).unionByName(pick("longest", F.desc(value), F.col(id_col)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for nothing."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
