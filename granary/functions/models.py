"""Places where models plug in, with offline stand-ins that give the same result on every run."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.replies import DIMENSIONS
from granary.functions.text import overlap_ratio, word_tokens

BATCH, TRIES, LONGEST_WAIT = 100, 6, 30.0
RERANK_BATCH, JUDGE_TRIES = 8, 3


def with_retries(call: Callable[[], object], tries: int = TRIES, wait: Callable[[float], None] = time.sleep):
    """The call's result; waits 1, 2, 4, ... seconds, at most half a minute, between failures."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            wait(min(2.0**n, LONGEST_WAIT))


def embedder(open_client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH, pause: float = 0.0):
    """A column function from text to vector. The client is opened once a task and called with ``batch`` texts at a time."""

    @F.pandas_udf("array<double>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = open_client()
        for texts in series:
            out: list = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch].tolist()
                vectors = with_retries(lambda part=part: client(part))
                if len(vectors) != len(part):
                    raise ValueError("the model returned another number of vectors than texts")
                out.extend(vectors)
                if pause:
                    time.sleep(pause)
            yield pd.Series(out)

    return embed


def hashed_client(dimensions: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """Stand-in embedder: unit vectors of hashed words."""

    def opened():
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dimensions)
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                    v[h % dimensions] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            return out

        return embed

    return opened


def reranker(open_model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = RERANK_BATCH):
    """A column function from (query, text) to a score. The model is opened once a task and called with ``batch`` pairs at a time."""

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = open_model()
        for queries, texts in columns:
            pairs = [(q or "", t or "") for q, t in zip(queries, texts)]
            out: list = []
            for i in range(0, len(pairs), batch):
                part = pairs[i : i + batch]
                scores = list(model(part))
                if len(scores) != len(part):
                    raise ValueError("the model returned another number of scores than pairs")
                out.extend(map(float, scores))
            yield pd.Series(out, dtype="float64")

    return score


def word_overlap_model() -> Callable[[list[tuple[str, str]]], list[float]]:
    """Stand-in pair model: share of the query's distinct words found in the text."""
    words = re.compile(r"\w+")

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(words.findall(q.lower())), set(words.findall(t.lower()))) for q, t in pairs]
        return [len(q & t) / len(q) if q else 0.0 for q, t in sets]

    return score


def retried_judge(open_client: Callable[[], Callable[[str], str]], tries: int = JUDGE_TRIES, pause: float = 1.0):
    """A column function from prompt to a reply that is a JSON object, bare or in a code fence; null after ``tries`` failures.

    A failure is an error of the client or a reply that cannot be read; ``pause`` seconds pass between tries.
    """

    @F.pandas_udf("string")
    def judge(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = open_client()

        def ask(prompt: str) -> str:
            reply = client(prompt).replace("```json", "").replace("```", "").strip()
            if not isinstance(json.loads(reply), dict):
                raise ValueError("the reply is no JSON object")
            return reply

        def one(prompt: str) -> str | None:
            try:
                return with_retries(lambda: ask(prompt), tries, lambda _: time.sleep(pause))
            except Exception:
                return None

        for prompts in series:
            yield pd.Series([one(p or "") for p in prompts], dtype="object")

    return judge


def lexical_reranker(query: Column, text: Column) -> Column:
    """Stand-in reranker: share of the query's words found in the text."""
    return overlap_ratio(word_tokens(query), word_tokens(text))


def first_sentence(hits: Column) -> Column:
    """Stand-in generator: the first sentence of the best hit."""
    return F.coalesce(F.regexp_extract(F.get(hits, F.lit(0))["text"], r"(?s)\A(.*?[.!?])(?:\s|\z)", 1), F.lit(""))


def rule_judge(answer: Column, facts: Column, hits: Column) -> Column:
    """Stand-in judge: a JSON reply with grades from word overlaps of the answer with facts and passages."""
    words = word_tokens(answer)
    facts_words = word_tokens(F.array_join(facts, " "))
    seen = word_tokens(F.array_join(F.transform(hits, lambda h: h["text"]), " "))
    complete = F.round(1 + 4 * overlap_ratio(facts_words, words), 1)
    grounded = F.round(1 + 4 * overlap_ratio(words, seen), 1)
    grades = dict(zip(DIMENSIONS, (complete, grounded, complete, complete)))
    error = F.when(grounded < 3, "HALLUCINATION").when(complete < 3, "OMISSION").otherwise("NONE")
    return F.to_json(F.struct(*[grades[d].alias(d) for d in DIMENSIONS], error.alias("error_type"), F.lit("word overlap").alias("reasoning")))
