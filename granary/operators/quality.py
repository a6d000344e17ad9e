"""Article filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import LINE_BREAK, strip, text_or_empty

# The corpus definition of the retrieval experiment.
TITLE_BLOCKLIST = [
    "bibliography", "historiography", "list of", "timeline of", "outline of", "index of", "glossary", "disambiguation", " births", " deaths",
    "in history", "category:", "portal:", "template:", "file:", "wikipedia:", "help:",
]
# Fixed values.
HISTORY_KEYWORDS = [
    "empire", "dynasty", "war", "battle", "king", "queen", "pharaoh", "republic", "army", "treaty", "conquest", "revolt", "civilization",
    "century", "ancient", "medieval", "reign", "throne", "kingdom", "emperor", "general", "colony", "trade", "religion", "temple",
    "aristocracy", "senate", "parliament", "revolution", "crusade", "nazi", "fascist", "holocaust", "occupation", "resistance", "allied",
    "axis", "infantry", "offensive", "armistice", "blitzkrieg", "liberation", "deportation", "propaganda", "luftwaffe", "wehrmacht", "reich",
    "congress", "president", "constitution", "confederation", "colonial", "independence", "slavery", "plantation", "reconstruction",
    "founding fathers", "amendment", "union", "confederacy", "abolitionist", "feudal", "papal", "monastery", "knight", "plague", "cathedral",
    "serfdom", "bishop", "excommunication", "vassal", "crusader", "pilgrimage", "inquisition", "byzantine", "constantinople", "orthodox",
    "patriarch", "themata", "basileus", "iconoclasm",
]
# Titles that the second filter refuses besides the above.
MORE_TITLES = [
    "age of revolution", "batavian revolution", "allied sovereigns", "calendar", "coin", "coinage", "daric", "danake", "siglos", "postal", "chiliarch",
]
# Fixed values.
TOPIC_BLOCKLIST = ["divination", "etymology", "philology", "dance", "linguistics", "grammar", "comedy"]
# Fixed values.
CORE_KEYWORDS = ["war", "battle", "army", "empire", "king", "conquest", "reign", "dynasty", "military", "campaign", "treaty"]
# Fixed values.
REMOVED_CATEGORIES = ["Byzantine Empire", "Middle Ages", "History of the United States", "World War II by country"]
# Parts of headings of sections that are not prose.
SKIPPED_SECTIONS = [
    "see also", "bibliography", "references", "further reading", "external links", "notes", "sources", "citations", "notes and references",
    "footnotes", "works cited",
]
MIN_LENGTH = 3000


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur, as substrings."""
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def passes_quality(
    title: Column,
    text: Column,
    keywords: list[str] = HISTORY_KEYWORDS,
    min_hits: int = 5,
    min_length: int = MIN_LENGTH,
    titles: list[str] = TITLE_BLOCKLIST,
    max_list_share: float = 0.40,
    min_sentences: int = 10,
) -> Column:
    """The first filter; cheap tests come first, and later ones are not evaluated where one fails."""
    title, text = text_or_empty(title), text_or_empty(text)
    low = F.lower(title)
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, -1)
    listed = F.size(F.filter(lines, lambda x: strip(x).rlike(r"\A[*#|!]")))
    sentences = F.size(F.filter(F.split(text, r"\."), lambda s: F.char_length(strip(s)) > 40))
    return (
        (F.char_length(title) > 0)
        & (F.char_length(text) >= max(min_length, 1))
        & ~contains_any(low, titles)
        & ~low.rlike(r"(?U)\A\p{Nd}+\z")
        & ~low.rlike(r"\A\d{3,4} in ")
        & (count_of(F.lower(text), keywords) >= min_hits)
        & (listed / F.size(lines) <= max_list_share)
        & (sentences >= min_sentences)
    )


def passes_corpus_filter(
    title: Column,
    text: Column,
    keywords: list[str] = CORE_KEYWORDS,
    min_hits: int = 3,
    min_length: int = MIN_LENGTH,
    titles: list[str] | None = None,
    topics: list[str] = TOPIC_BLOCKLIST,
) -> Column:
    """The second filter."""
    title, text = F.lower(text_or_empty(title)), F.lower(text_or_empty(text))
    titles = [*TITLE_BLOCKLIST, *MORE_TITLES] if titles is None else titles
    return (
        (F.char_length(title) > 0)
        & (F.char_length(text) >= max(min_length, 1))
        & ~contains_any(title, titles)
        & ~contains_any(text, topics)
        & (count_of(text, keywords) >= min_hits)
    )


def category_kept(category: Column, removed: list[str] = REMOVED_CATEGORIES) -> Column:
    """A null category stays."""
    return ~F.coalesce(category.isin(removed), F.lit(False))


def is_skipped_section(heading: Column, phrases: list[str] = SKIPPED_SECTIONS) -> Column:
    return contains_any(F.lower(F.coalesce(heading, F.lit(""))), phrases)


def first_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order must end in a unique column."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def capped(rows: DataFrame, by: str, limit: int, *order: Column) -> DataFrame:
    """At most ``limit`` rows of each group, in order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def violations(chunks: DataFrame) -> DataFrame:
    """Chunks without id or text, with the reason."""
    reason = F.when(F.length(text_or_empty(F.col("chunk_id"))) == 0, "missing chunk_id").when(
        F.length(text_or_empty(F.col("text"))) == 0, "missing text"
    )
    return chunks.withColumn("reason", reason).where("reason IS NOT NULL")


def validated(chunks: DataFrame) -> DataFrame:
    """The chunks; a run fails at the first that has no id or text."""
    bad = (F.length(text_or_empty(F.col("chunk_id"))) == 0) | (F.length(text_or_empty(F.col("text"))) == 0)
    return chunks.withColumn("text", F.when(bad, F.raise_error(F.lit("chunk without id or text"))).otherwise(F.col("text")))
