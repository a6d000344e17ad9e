"""From articles to a stored collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import models
from granary.functions.replies import json_object_raw_first, question_id, question_prompt
from granary.functions.text import strip
from granary.operators import lookup, quality, sampling
from granary.operators.chunking import fixed_chunks
from granary.sources.json_tables import write_collection


def load_corpus(articles: DataFrame, categories: list[str], per_category: int = 100, total: int = 1000) -> DataFrame:
    """Good articles, each title once (the first category wins), limited by category and in all.

    ``articles`` has position, the place in its category.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("source_category"))
    listed = quality.capped(articles.where(place > 0).withColumn("_place", place), "source_category", per_category, F.col("position"), F.col("id"))
    good = listed.where(quality.passes_quality(F.col("title"), F.col("text")))
    once = quality.first_wins(good, F.lower(strip(F.col("title"))), F.col("_place"), F.col("position"), F.col("id"))
    return once.orderBy("_place", "position", "id").limit(total).drop("_place")


def filter_corpus(articles: DataFrame) -> DataFrame:
    return articles.where(quality.category_kept(F.col("source_category")) & quality.passes_corpus_filter(F.col("title"), F.col("text")))


def ingest(articles: DataFrame, path: str, embed: Callable[[Column], Column] | None = None, size: int = 512, overlap: int = 50) -> None:
    """Filters, chunks, embeds and stores."""
    embed = embed or models.embedder(models.hashed_client())
    chunks = fixed_chunks(filter_corpus(articles), size, overlap, id_col="id", carry=["title", "url", "source_category"])
    write_collection(quality.validated(chunks).withColumn("embedding", embed(F.col("text"))), path)


QUESTION_REPLY = "question string, reference_answer string, key_facts array<string>"


def questions(samples: DataFrame, kind: str, prefix: str, generate: Callable[[Column], Column], order: str, after: int = 0) -> DataFrame:
    """Questions that a model writes over sampled passages. Ids count all samples, from ``after`` on; replies that cannot be read leave gaps."""
    from pyspark.sql import Window

    numbered = samples.withColumn("_n", F.row_number().over(Window.orderBy(order)) + after)  # samples number some hundreds
    reply = json_object_raw_first(generate(question_prompt(kind, F.col("passages"))), QUESTION_REPLY)
    rows = numbered.withColumn("_q", reply).where("_q IS NOT NULL")
    filled = [F.coalesce(f"_q.{c}", F.lit("")).alias(c) for c in ("question", "reference_answer")]
    facts = F.coalesce("_q.key_facts", F.array().cast("array<string>")).alias("key_facts")
    about = [c for c in ("source_titles", "source_categories") if c in samples.columns]
    return rows.select(question_id(F.lit(prefix), F.col("_n")).alias("id"), F.lit(kind).alias("type"), *filled, facts, "relevant_chunk_ids", *about)


def _of_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", F.array("text").alias("passages"), F.array("chunk_id").alias("relevant_chunk_ids"), F.array("title").alias("source_titles"),
        F.array("source_category").alias("source_categories"),
    )


def single_questions(chunks: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """A question over each sampled chunk (chunk_id, text, title, source_category)."""
    return questions(_of_chunks(chunks), "single_chunk", "single", generate, "chunk_id")


def complex_questions(chunks: DataFrame, generate: Callable[[Column], Column], after: int = 0) -> DataFrame:
    """A question of inference over each sampled chunk; ``after`` is the last number given before."""
    return questions(_of_chunks(chunks), "complex", "complex", generate, "chunk_id", after)


def multi_questions(pairs: DataFrame, chunks: DataFrame, generate: Callable[[Column], Column], after: int = 0) -> DataFrame:
    """A question over each sampled pair (first_id, second_id) of chunks."""
    pairs = pairs.select(F.col("first_id").cast("string"), F.col("second_id").cast("string"))
    one = lambda end: chunks.select(F.col("chunk_id").cast("string").alias(f"{end}_id"), F.struct("text", "title", "source_category").alias(f"_{end}"))
    both = pairs.join(one("first"), "first_id").join(one("second"), "second_id")
    two = lambda c: F.array(f"_first.{c}", f"_second.{c}")
    samples = both.select(
        "first_id", two("text").alias("passages"), F.array("first_id", "second_id").alias("relevant_chunk_ids"), two("title").alias("source_titles"),
        two("source_category").alias("source_categories"),
    )
    return questions(samples, "multi_chunk", "multi", generate, "first_id", after)


def additional_questions(chunks: DataFrame, used: DataFrame, asked: DataFrame, n: int, seed: int, kind: str, generate: Callable[[Column], Column]) -> DataFrame:
    """``n`` more questions over chunks that none uses yet; numbers run on from those of ``asked`` (id)."""
    free = lookup.resumed(chunks, used, "chunk_id")
    prefix = {"complex": "complex", "multi_chunk": "multi"}[kind]
    last = lookup.last_index(asked, "id", f"q_{prefix}").first().last_index
    if kind == "complex":
        return complex_questions(sampling.sample_stratified(free, n, seed, "chunk_id", "source_category"), generate, last)
    pairs = sampling.sample_pairs(free, n, seed, "chunk_id", "doc_id", "source_category", minimum=2)
    return multi_questions(pairs, chunks, generate, last)
