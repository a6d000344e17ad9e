"""The corpus pipeline over documents: each stage works on all that the one before kept.

Stages: language identification drops documents without a language; exact duplicates keep the row with the largest id; of near
duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays; documents with a window of any benchmark item
go; mixing gives the rest their rates and numbers of copies and drops those with no copy. Its targets are raised alike where
good or poor text would otherwise have to be thinned, so that what it drops are documents that resemble the toxic ones. A
document stays one row; a reader who wants the target weights takes it ``copies`` times.

Edge cases: a null or empty text, or one without letters, goes in the first stage; null ids, languages, sources and sizes are no
reason to go, and a null id ranks below every other in exact dedup and last among near duplicates; of rows that repeat an id and
a text one stays; ties of language go to the first name; labels of unknown ids or without a class are not learned from; empty
tables give an empty result. Extra columns of documents pass through all stages, whatever their names; only those named as the
columns that mixing adds (``n_tokens``, ``posteriors``, ``rate``, ``copies``) are replaced, in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from granary.llm.common import Scratch, table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; the profiles come from the labelled ones among them."""
    profiles = language_id.train_profiles(docs)
    return docs.where(language_id.language_of(F.col("text"), profiles, spark)["lang"] != language_id.UNKNOWN)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup(docs, keep="largest")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return near_dedup.dedup(docs, shingle=5, percent=80)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one copy at their rate, with the columns of the mixing."""
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, domains, mixing.TARGETS, whole=["good", "poor"]).where("copies > 0")


STAGES = [
    ("language ID", stage_language),
    ("exact dedup", stage_exact),
    ("MinHash near-dedup", stage_near),
    ("benchmark decontamination", stage_decontaminate),
    ("mixing", stage_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.write(docs)
            scratch.drop(before)
    return docs
