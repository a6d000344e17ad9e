"""Column functions against short Python versions."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import metrics, models, replies, text

MIXED = st.text(alphabet="ab é\n\r\t \x1c\x85  =.", max_size=25)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def py_normal(t):
    lines = [x.strip() for x in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    return re.sub(r"[ \t]+", " ", "\n".join(out).strip())


@FEW
@given(st.lists(MIXED, min_size=20, max_size=20))
def test_normalize(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize(F.col("t")).alias("n"), text.strip(F.col("t")).alias("s"))
    for r in rows.collect():
        assert r.n == py_normal(r.t)
        assert r.s == r.t.strip()


def test_null_text(spark):
    r = spark.sql("SELECT CAST(NULL AS STRING) t").select(
        text.normalize(F.col("t")).alias("n"), F.size(text.word_tokens(F.col("t"))).alias("w"), F.size(text.space_tokens(F.col("t"))).alias("s")
    ).first()
    assert (r.n, r.w, r.s) == ("", 0, 0)


def test_words_and_overlap(spark):
    r = spark.sql("SELECT 'Éa_b, 12 x² — x' a, 'x é' b").select(
        text.word_tokens(F.col("a")).alias("w"),
        text.overlap_ratio(text.word_tokens(F.col("b")), text.word_tokens(F.col("a"))).alias("o"),
        text.overlap_ratio(text.word_tokens(F.lit("!")), text.word_tokens(F.col("a"))).alias("none"),
        text.normalize_words(F.col("a")).alias("n"),
    ).first()
    assert r.w == ["éa_b", "12", "x²", "x"]
    assert (r.o, r.none) == (0.5, 0.0)
    assert r.n == "éa_b 12 x² x"


def test_occurrences_overlap_and_clip(spark):
    r = spark.sql("SELECT 'bANAna' t, 'none' u").select(text.occurrences(F.col("t"), "ana", 2).alias("o"), text.occurrences(F.col("u"), "ana").alias("e")).first()
    assert r.o == ["bAN", "ANAn"]
    assert r.e == []


def test_percent_encode(spark):
    import urllib.parse

    titles = ["A b/c~d", "é*+&?", "plain", "50% (x)'!"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.percent_encode(F.col("t")).alias("e"))
    for r in rows.collect():
        assert r.e == urllib.parse.quote(r.t.replace(" ", "_")).replace("%2A", "%2A")


def py_ap(ret, rel):
    hits, total = 0, 0.0
    for i, x in enumerate(ret, 1):
        if x in rel:
            hits += 1
            total += hits / i
    return total / len(set(rel)) if rel else 0.0


def test_metrics(spark):
    r = random.Random(3)
    data = [([r.randrange(6) for _ in range(r.randrange(7))], [r.randrange(6) for _ in range(r.randrange(5))]) for _ in range(300)]
    pair = (F.col("a"), F.col("b"))
    rows = spark.createDataFrame(data, "a array<int>, b array<int>").select(
        "a", "b", metrics.hit(*pair).alias("h"), metrics.full_hit(*pair).alias("f"), metrics.reciprocal_rank(*pair).alias("rr"),
        metrics.recall(*pair).alias("rc"), metrics.average_precision(*pair).alias("ap"),
    )
    for x in rows.collect():
        assert x.h == float(any(i in x.a for i in x.b))
        assert x.f == float(all(i in x.a for i in x.b))
        assert x.rr == next((1 / (k + 1) for k, i in enumerate(x.a) if i in x.b), 0.0)
        assert x.rc == pytest.approx(sum(i in x.a for i in x.b) / len(x.b) if x.b else 0.0)
        assert x.ap == pytest.approx(py_ap(x.a, x.b))


def test_json_replies(spark):
    cases = {
        '{"accuracy": 4}': 4.0, '```json\n{"accuracy": 3.5}\n```': 3.5, '{"accuracy": 4': None, "[1]": None, "": None, '{"accuracy": 4} tail': None, "{}": math.inf,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", replies.json_object(F.col("t"), replies.JUDGE_REPLY).alias("s"))
    for r in rows.collect():
        want = cases[r.t]
        if want is None:
            assert r.s is None
        else:
            assert r.s is not None and r.s.accuracy == (None if want == math.inf else want)


def test_scores_and_ids(spark):
    rows = spark.createDataFrame([("4,5",), ("0",), ("x",), (" 1 ",)], "t string").select(replies.parse_score(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == [4.5, None, None, 1.0]
    r = spark.range(1).select(
        replies.chunk_id(F.lit("d"), F.lit(12345)).alias("c"), replies.question_id(F.lit("multi"), F.lit(7)).alias("q"),
        replies.error_name(F.lit(9)).alias("none"), replies.error_name(F.lit(1)).alias("one"),
    ).first()
    assert (r.c, r.q, r.none, r.one) == ("d_12345", "q_multi_007", None, "HALLUCINATION")


def test_embedder_and_retries(spark):
    embed = models.embedder(models.hashed_client(8), batch=2)
    rows = spark.createDataFrame([("a b",), ("a b",), ("",), ("c",)], "t string").select("t", embed("t").alias("v")).collect()
    by = {}
    for r in rows:
        assert by.setdefault(r.t, r.v) == r.v and len(r.v) == 8
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert models.with_retries(flaky, wait=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
