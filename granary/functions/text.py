"""Text columns with Python's notion of white space and word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` and ``\s`` see it, for Java's regular expressions with (?U).
SPACE = r"[\s\x1c-\x1f]"
#: The same without the line feed.
SPACE_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"
WORD = r"[\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def text_or_empty(c: Column) -> Column:
    """Stripped text, '' for null."""
    return strip(F.coalesce(c, F.lit("")))


def normalize(c: Column) -> Column:
    """Line feeds only, no space around lines, single blank lines, single blanks, stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"(?U){SPACE_IN_LINE}*\n{SPACE_IN_LINE}*", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(strip(c), r"[ \t]+", " ")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def space_tokens(c: Column) -> Column:
    """Pieces between white space; the offline tokenizer."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+"), "")


def normalize_words(c: Column) -> Column:
    """Lower case with everything but word characters turned into single blanks."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.trim(c)


def overlap_ratio(source: Column, target: Column) -> Column:
    """Share of the distinct source tokens found in the target; 0 for an empty source."""
    n = F.size(F.array_distinct(source))
    return F.when(n > 0, F.size(F.array_intersect(source, target)) / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))


def snippet(c: Column, n: int) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def percent_encode(c: Column) -> Column:
    """URL path form of a title: blanks as underscores, '/' and unreserved characters kept."""
    e = F.url_encode(F.replace(c, F.lit(" "), F.lit("_")))
    for a, b in (("%2F", "/"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def occurrences(text: Column, keyword: str, context: int = 150) -> Column:
    """Contexts of all occurrences of a keyword, overlapping ones too, whatever their case.

    The text is split before each occurrence. A piece is not empty, so that the ``context`` pieces on either side hold the
    context, and the work grows with the text and not with its square.
    """
    quoted = "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in keyword.lower())
    here = f"(?iu)(?={quoted})"
    pieces = F.filter(F.split(text, here), lambda p: F.char_length(p) > 0)
    before = lambda i: F.array_join(F.slice(pieces, F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context))), "")
    after = lambda i: F.array_join(F.slice(pieces, i + 1, F.lit(context)), "")
    # Each piece but perhaps the first starts at an occurrence.
    marked = F.transform(pieces, lambda p, i: F.struct(((i > 0) | p.rlike(rf"(?iu)\A{quoted}")).alias("here"), i.alias("i")))
    found = F.filter(marked, lambda m: m["here"])
    return F.transform(found, lambda m: F.concat(F.right(before(m["i"]), F.lit(context)), F.substring(after(m["i"]), 1, context)))
