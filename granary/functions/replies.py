"""Reading what models and reviewers reply, and writing what models are asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import strip

#: The error names and grading dimensions that result files hold.
ERROR_TYPES = ["NONE", "HALLUCINATION", "MISATTRIBUTION", "OMISSION", "RETRIEVAL_FAIL"]
DIMENSIONS = ["accuracy", "groundedness", "relevance", "completeness"]
JUDGE_REPLY = "accuracy double, groundedness double, relevance double, completeness double, error_type string, reasoning string"


def unfenced(reply: Column) -> Column:
    """The reply without code fences."""
    return strip(F.regexp_replace(reply, "```(?:json)?", ""))


def json_object(reply: Column, schema: str, strict: bool = True) -> Column:
    """A JSON object as a struct; null for malformed or empty text and for other kinds of JSON (and, if strict, for text behind it)."""
    s = unfenced(reply)
    good = F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT")
    if strict:
        good = good & s.endswith("}")
    return F.when(good, F.from_json(s, schema))


def json_object_raw_first(reply: Column, schema: str) -> Column:
    """The reply as it is if that is a JSON object, else without code fences."""
    s = strip(reply)
    raw = F.when(F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT") & s.endswith("}"), F.from_json(s, schema))
    return F.coalesce(raw, json_object(reply, schema))


def score_or(scores: Column, dimension: str, default: float = 0.0) -> Column:
    """A dimension of a judged row, ``default`` where the judge left it out; null for rows without a judgement."""
    return F.when(scores.isNotNull(), F.coalesce(scores.getField(dimension), F.lit(default)))


def parse_score(entry: Column) -> Column:
    """A number from 1 to 5, with a comma or a point; null for anything else."""
    x = F.replace(strip(entry), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x.between(1.0, 5.0), x)


def error_name(code: Column) -> Column:
    """Name of an error code from 0 on; null outside."""
    return F.get(F.array(*[F.lit(e) for e in ERROR_TYPES]), code)


def question_id(prefix: Column, index: Column) -> Column:
    return F.format_string("q_%s_%03d", prefix, index)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", doc_id.cast("string"), index)


def prompt_context(hits: Column) -> Column:
    """Ranked hits (structs with title and text) as numbered paragraphs."""
    parts = F.transform(
        hits,
        lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h["title"], F.lit("Unknown")), F.lit("\n"), h["text"]),
    )
    return F.array_join(parts, "\n\n")


def judge_context(hits: Column) -> Column:
    """Hits as numbered passages between rules."""
    part = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(h["title"], F.lit("")), F.lit("\n"), h["text"])
    return F.array_join(F.transform(hits, part), "\n\n---\n\n")


def fact_list(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")


def answer_prompt(question: Column, hits: Column) -> Column:
    head = F.lit("Answer the question from the numbered passages alone. Say so if they do not hold the answer.\n\n")
    return F.concat(head, prompt_context(hits), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def judge_prompt(question: Column, answer: Column, reference: Column, facts: Column, hits: Column) -> Column:
    head = (
        "Grade the answer from 1 to 5 for accuracy, groundedness, relevance and completeness and name its main error "
        f"({', '.join(ERROR_TYPES)}). Reply with one JSON object with the keys {', '.join(DIMENSIONS)}, error_type and reasoning.\n\n"
    )
    return F.concat(
        F.lit(head + "Question: "), question, F.lit("\nAnswer: "), answer, F.lit("\nReference: "), reference,
        F.lit("\nKey facts:\n"), fact_list(facts), F.lit("\nPassages:\n"), judge_context(hits),
    )


def question_prompt(kind: str, passages: Column) -> Column:
    """What a model is asked for a question over one passage, two passages or a whole topic."""
    asks = {
        "single_chunk": "Write one question that this passage answers.",
        "multi_chunk": "Write one question that needs both passages.",
        "complex": "Write one question that asks for reasoning over these passages.",
    }
    tail = '\n\nReply with one JSON object with the keys question, reference_answer and key_facts (a list).'
    return F.concat(F.lit(asks[kind] + "\n\n"), F.array_join(passages, "\n\n"), F.lit(tail))
