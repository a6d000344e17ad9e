"""Documents to overlapping chunks of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.replies import chunk_id
from granary.functions.text import normalize, space_tokens, strip
from granary.operators.quality import SKIPPED_SECTIONS, is_skipped_section

#: Fixed value: a heading line of wiki text, its text in the second group.
HEADING = r"(?Umd)^(={2,})\s*(.+?)\s*\1\s*$"


def join_with_space(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _windows(tokens: Column, size: Column, step: Column) -> Column:
    """(start, tokens) of each window."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, size).alias("part")))


def fixed_chunks(
    docs: DataFrame,
    size: int = 256,
    overlap: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
    encode: Callable[[Column], Column] = space_tokens,
    decode: Callable[[Column], Column] = join_with_space,
    carry: list[str] | None = None,
    decode_all: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``chunk_id, doc_id, chunk_index, text, token_count`` and the columns ``carry``. Windows that decode to blanks take no index.

    The index is made inside the row, so that nothing is exchanged. ``decode_all``, from an array of windows to their texts,
    replaces ``decode`` where decoding needs a Python function.
    """
    carry = carry or []
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), *carry, encode(normalize(F.col(text_col))).alias("_t"))
    if decode_all is not None:
        rows = rows.withColumn("_w", F.transform(_steps(F.col("_t"), size, overlap), lambda w: w["part"])).withColumn("_d", decode_all(F.col("_w")))
        kept = _chunks(F.zip_with("_w", "_d", lambda w, d: F.struct(strip(d).alias("text"), F.size(w).alias("token_count"))))
    else:
        kept = chunk_array(F.col("_t"), size, overlap, decode)
    out = rows.select("doc_id", *carry, F.posexplode(kept).alias("chunk_index", "_c"))
    return out.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", *carry, "chunk_index", "_c.text", "_c.token_count")


def _steps(tokens: Column, size: int, overlap: int) -> Column:
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    return _windows(tokens, F.lit(size), F.lit(size - overlap))


def _chunks(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.char_length(p["text"]) > 0)


def chunk_array(tokens: Column, size: int, overlap: int, decode: Callable[[Column], Column] = join_with_space) -> Column:
    """The chunks of one document as an array of (text, token_count); their places are their indices."""
    windows = _steps(tokens, size, overlap)
    return _chunks(F.transform(windows, lambda w: F.struct(strip(decode(w["part"])).alias("text"), F.size(w["part"]).alias("token_count"))))


def sections(text: Column) -> Column:
    """Array of (heading, body); what precedes the first heading is 'Introduction', empty bodies are dropped."""
    bodies = F.split(text, HEADING, -1)
    heads = F.concat(F.array(F.lit("Introduction")), F.regexp_extract_all(text, F.lit(HEADING), F.lit(2)))
    pairs = F.zip_with(heads, bodies, lambda h, b: F.struct(strip(h).alias("heading"), strip(b).alias("body")))
    return F.filter(pairs, lambda p: F.char_length(F.coalesce(p["body"], F.lit(""))) > 0)


def section_chunks(
    docs: DataFrame,
    size: int = 512,
    overlap: int = 50,
    id_col: str = "doc_id",
    title_col: str = "title",
    text_col: str = "text",
    skip: list[str] = SKIPPED_SECTIONS,
    encode: Callable[[Column], Column] = space_tokens,
    decode: Callable[[Column], Column] = join_with_space,
) -> DataFrame:
    """Chunks that stay in one section and carry '[title > heading]'; the index runs on over the sections of a document.

    Sections, windows and the index are made inside the row, so that nothing is exchanged; ``encode`` and ``decode`` are built of
    engine functions.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(title_col), F.lit("")).alias("title"), normalize(F.col(text_col)).alias("_n")
    )
    prefix = lambda s: F.concat(F.lit("["), F.col("title"), F.lit(" > "), s["heading"], F.lit("]\n\n"))
    wanted = F.filter(sections(F.col("_n")), lambda s: ~is_skipped_section(s["heading"], skip))
    parts = F.transform(wanted, lambda s: F.struct(s["heading"].alias("h"), prefix(s).alias("p"), F.size(encode(prefix(s))).alias("np"), encode(s["body"]).alias("t")))
    rows = rows.withColumn("_s", F.filter(parts, lambda s: s["np"] < size))

    def chunks(s: Column) -> Column:
        room = F.lit(size) - s["np"]
        return F.transform(
            _windows(s["t"], room, F.greatest(room - overlap, F.lit(1))),
            lambda w: F.struct(s["h"].alias("h"), F.concat(s["p"], strip(decode(w["part"]))).alias("text"), (s["np"] + F.size(w["part"])).alias("n")),
        )

    each = rows.select("doc_id", "title", F.posexplode(F.flatten(F.transform("_s", chunks))).alias("chunk_index", "_c"))
    return each.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "title", F.col("_c.h").alias("section_heading"), "chunk_index",
        "_c.text", F.col("_c.n").alias("token_count"),
    )


def skipped_sections(docs: DataFrame, text_col: str = "text", skip: list[str] = SKIPPED_SECTIONS) -> Column | int:
    """The number of sections that ``section_chunks`` leaves out by their headings."""
    each = docs.select(F.explode(sections(normalize(F.col(text_col)))).alias("s"))
    return each.where(is_skipped_section(F.col("s.heading"), skip)).count()
