"""Operators on edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import bm25, chunking, fusion, lookup, overlap, quality, reports, sampling, vectors


def test_fixed_chunks_edges(spark):
    rows = [("a", None), ("b", ""), ("c", "w0"), ("d", " ".join(f"w{i}" for i in range(10))), ("e", " ".join(f"w{i}" for i in range(11)))]
    out = chunking.fixed_chunks(spark.createDataFrame(rows, "doc_id string, text string"), 10, 3).orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk_id, r.token_count) for r in out] == [("c_0000", 1), ("d_0000", 10), ("d_0001", 3), ("e_0000", 10), ("e_0001", 4)]
    with pytest.raises(ValueError):
        chunking.fixed_chunks(spark.createDataFrame(rows, "doc_id string, text string"), 3, 3)


def test_chunk_count_is_ceiling(spark):
    rows = [(str(n), " ".join("x" * n)) for n in (1, 7, 8, 15, 40)]
    out = chunking.fixed_chunks(spark.createDataFrame(rows, "doc_id string, text string"), 10, 3).groupBy("doc_id").count().collect()
    assert {int(r.doc_id): r["count"] for r in out} == {n: math.ceil(n / 7) for n in (1, 7, 8, 15, 40)}


def test_sections(spark):
    t = "lead\n== One ==\nbody one\n=== Two ===\n\n== References ==\nr\n== Banknotes ==\nb\n== bad ===\nlast"
    rows = spark.createDataFrame([(1, "T", t), (2, "T", None)], "doc_id int, title string, text string")
    got = rows.select(chunking.sections(F.coalesce("text", F.lit(""))).alias("s")).first().s
    assert [(x.heading, x.body) for x in got] == [("Introduction", "lead"), ("One", "body one"), ("References", "r"), ("Banknotes", "b"), ("bad =", "last")]
    out = chunking.section_chunks(rows, 20, 5).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.section_heading, r.text) for r in out] == [
        ("1_0000", "Introduction", "[T > Introduction]\n\nlead"), ("1_0001", "One", "[T > One]\n\nbody one"),
        ("1_0002", "bad =", "[T > bad =]\n\nlast"),
    ]
    assert chunking.section_chunks(rows, 3, 1).count() == 0  # no room beside the prefix
    assert chunking.skipped_sections(rows) == 2


def test_quality_filter_edges(spark):
    sentence = "The war and the battle of the king and the empire army went on and on."
    good = " ".join([sentence] * 12).ljust(3000, "x")
    cases = [
        ("Rome", good, True), ("Rome", good[:2999], False), ("", good, False), ("1914", good, False), ("1914 in art", good, False),
        ("List of kings", good, False), ("Rome", None, False), ("Rome", "\n".join(["* a"] * 41 + [good] + ["b"] * 58), False),
        ("Rome", "\n".join(["* a"] * 40 + [good] + ["b"] * 59), True), ("Rome", good.replace(".", ","), False),
    ]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(cases)], "i int, t string, x string")
    got = {r.i: r.g for r in rows.select("i", F.coalesce(quality.passes_quality(F.col("t"), F.col("x")), F.lit(False)).alias("g")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_corpus_filter_substrings(spark):
    good = "the war of the king and his army " * 100
    rows = spark.createDataFrame([("T", good), ("T", good + "abundance"), ("Old COIN", good)], "t string, x string")
    assert [r.g for r in rows.select(quality.passes_corpus_filter(F.col("t"), F.col("x")).alias("g")).collect()] == [True, False, False]
    c = spark.createDataFrame([(None,), ("Middle Ages",), ("x",)], "c string").select(quality.category_kept(F.col("c")).alias("k"))
    assert [r.k for r in c.collect()] == [True, False, True]


def test_validation(spark):
    rows = spark.createDataFrame([("a", "x"), ("", "y"), ("b", " ")], "chunk_id string, text string")
    assert sorted(r.reason for r in quality.violations(rows).collect()) == ["missing chunk_id", "missing text"]
    with pytest.raises(Exception, match="without id or text"):
        quality.validated(rows).collect()


def test_dense_edges_and_blocks(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0])], "query_id int, embedding array<float>")
    got = vectors.dense_topk(c, q, 9).orderBy("query_id", "dense_rank").collect()
    assert [(r.vec_id, r.distance) for r in got if r.query_id == 0] == [(1, 0.0), (4, 0.0), (5, 1.0), (2, 2.0), (3, None)]
    blocks = vectors.dense_topk(c, q, 9, max_broadcast=1).orderBy("query_id", "dense_rank").collect()
    assert blocks == got


def test_dense_plan_has_no_cartesian_product(spark):
    c = spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<float>")
    plan = vectors.dense_topk(c, c.select(F.col("vec_id").alias("query_id"), "embedding"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def py_bm25(docs, query):
    toks = {i: t.lower().split() for i, t in docs}
    n, al = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    score = {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / al)) for w in query.lower().split()) for i, t in toks.items()}
    return sorted(((round(s, 6), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))


def test_bm25_matches_formula_and_fills_up(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("the a b c d e f".split()) for _ in range(r.randrange(1, 12)))) for i in range(30)]
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id int, text string"))
    queries = [(1, "a a the"), (2, "zzz"), (3, ""), (4, "f")]
    got = bm25.bm25_topk(index, spark.createDataFrame(queries, "query_id int, text string"), 12).orderBy("query_id", "bm25_rank").collect()
    for q, t in queries:
        mine = [(x.bm25_score, x.id) for x in got if x.query_id == q]
        want = py_bm25(docs, t)[:12]
        assert [i for _, i in mine] == [i for _, i in want]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=2e-6)
    plan = bm25.bm25_topk(index, spark.createDataFrame(queries, "query_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fusion_ties_and_rerank(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, dense_rank int")
    s = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (2, "z", 1)], "query_id int, id string, bm25_rank int")
    f = fusion.reciprocal_rank_fusion(d, s, "id").orderBy("query_id", "fused_rank").collect()
    assert [(r.query_id, r.id, r.retrieval_source) for r in f] == [(1, "b", "dense"), (1, "a", "dense"), (1, "c", "bm25"), (2, "z", "bm25")]
    again = fusion.rerank(fusion.reciprocal_rank_fusion(d, s, "id"), F.when(F.col("id") == "c", 1.0).otherwise(0.5), 2).where("query_id = 1").orderBy("final_rank").collect()
    assert [r.id for r in again] == ["c", "b"]


def test_mapping_and_overlay(spark):
    a = spark.createDataFrame([("d", "d_0", 0, "a b c d"), ("e", "e_0", 0, "x")], "doc_id string, chunk_id string, chunk_index int, text string")
    b = spark.createDataFrame([("d", "d_0", 0, "a b c"), ("d", "d_1", 1, "a b c d e"), ("e", "e_0", 0, "y")], "doc_id string, chunk_id string, chunk_index int, text string")
    m = overlap.overlap_mapping(a, b, 0.75)
    q = spark.createDataFrame([(1, ["e_0", "d_0"]), (2, ["e_0"]), (3, [])], "id int, relevant_chunk_ids array<string>")
    got = overlap.mapping_of_questions(q, m)
    assert {r.id: r.mapped_relevant_chunk_ids for r in got.collect()} == {1: ["d_1", "d_0"], 2: [], 3: []}
    over = overlap.overlaid(q, got.where("id = 1")).orderBy("id").collect()
    assert over[0].relevant_chunk_ids == ["d_1", "d_0"] and over[0].original_relevant_chunk_ids == ["e_0", "d_0"] and over[1].relevant_chunk_ids == ["e_0"]


def test_claims(spark):
    chunks = spark.createDataFrame([("c1", "x" * 300 + " The Term " + "y" * 300), ("c2", None)], "chunk_id string, text string")
    claims = spark.createDataFrame([("yes", ["term", "nope"]), ("no", ["zzz"])], "claim string, evidence_terms array<string>")
    found = overlap.claim_evidence(chunks, claims).collect()
    assert len(found) == 1 and len(found[0].snippet) == 220 + 4 + 220
    assert {r.claim: r.status for r in overlap.claim_status(chunks, claims).collect()} == {"yes": "evidence found", "no": "likely not grounded"}


def test_lookups(spark):
    store = spark.createDataFrame([("a", 1, "old"), ("a", 2, "A"), ("b", 1, "B")], "id string, v int, text string")
    one = lookup.last_wins(store, "id", F.desc("v"))
    rows = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, []), (3, None)], "k int, ids array<string>")
    got = {r.k: r["values"] for r in lookup.looked_up(rows, "k", "ids", one, "id", "text", F.format_string("[chunk not found: %s]", "_id")).collect()}
    assert got == {1: ["B", "A", "B", "[chunk not found: x]"], 2: [], 3: []}
    assert {r.k: r["values"] for r in lookup.looked_up(rows, "k", "ids", one, "id", "text", drop=True).collect()}[1] == ["B", "A", "B"]
    assert [r.missing_id for r in lookup.missing_ids(rows, "k", "ids", one, "id").collect()] == ["x"]
    ids = spark.createDataFrame([("q_a_003",), ("q_a_x",), ("q_b_9",)], "id string")
    assert lookup.last_index(ids, "id", "q_a").first()[0] == 3 and lookup.last_index(ids, "id", "zz").first()[0] == 0


RESULTS = "id string, type string, v double, latency_seconds double, judge_scores struct<accuracy:double,error_type:string>"


def test_reports(spark):
    rows = spark.createDataFrame(
        [("1", "complex", 1.0, 2.0, (4.0, "NONE")), ("2", "complex", 0.0, None, None), ("3", "odd", 0.5, 1.0, (None, None))], RESULTS
    )
    m = {r.type: r for r in reports.metrics_by_type(rows, ["v"], ["accuracy"]).collect()}
    assert (m[None].n, m[None].n_skipped, m[None].v, m[None].accuracy, m[None].avg_latency_seconds) == (3, 1, 0.5, 2.0, 1.5)
    j = {r.type: r for r in reports.metrics_by_type(rows, ["v"], ["accuracy"], judged_only=True, missing_latency_is_zero=True).collect()}
    assert (j["complex"].v, j[None].v, j[None].avg_latency_seconds) == (1.0, 0.5, 1.0)
    assert [(r.error_type, r.n) for r in reports.error_distribution(rows, "UNKNOWN").orderBy("place").collect()] == [("NONE", 1), ("UNKNOWN", 1)]
    empty = reports.metrics_by_type(rows.limit(0), ["v"], ["accuracy"]).collect()
    assert all(r.v == 0.0 for r in empty)


def test_agreement(spark):
    rows = spark.createDataFrame(
        [("1", "n", "t", (5.0,), (4.0,)), ("2", "n", "t", None, (1.0,)), ("3", "n", "u", (3.0,), None)],
        "id string, name string, type string, manual_scores struct<accuracy:double>, judge_scores struct<accuracy:double>",
    )
    a = {r.type: r for r in reports.grader_agreement(rows, ["accuracy"]).collect()}
    assert a[None].n == 1 and a[None].diff_judge_minus_manual == -1.0
    assert {(r.id, r.missing) for r in reports.missing_gradings(rows).collect()} == {("2", "manual"), ("3", "judge")}
    assert reports.config_ranking(reports.grader_agreement(rows, ["accuracy"])).first()["rank"] == 1


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i else "d") for i in range(50)], "id int, c string")
    for n in (0, 2, 4, 20, 100):
        got = sampling.sample_stratified(rows, n, 1, "id", "c").collect()
        assert len(got) == min(n, 50) and got == sampling.sample_stratified(rows.repartition(5), n, 1, "id", "c").collect()
        counts = {c: sum(r.c == c for r in got) for c in "abcd"}
        if 4 <= n < 50:
            assert counts["d"] == 1 and min(counts.values()) >= min(1, n // 4)
    assert sampling.sample_stratified(rows.limit(0), 5, 1, "id", "c").count() == 0
    pairs = sampling.sample_pairs(rows.withColumn("doc", F.floor(F.col("id") / 3)).withColumn("c", F.col("doc") % 2), 5, 1, "id", "doc", "c").collect()
    assert len(pairs) == 4 and all(p.first_id != p.second_id for p in pairs)


def test_first_wins_and_cap(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "id int, t string")
    assert sorted(r.id for r in quality.first_wins(rows, F.lower("t"), F.col("id")).collect()) == [1, 3]
    assert quality.capped(rows.withColumn("g", F.lit(1)), "g", 2, F.col("id")).count() == 2

def test_nearest_vectors_against_plain_distances(spark, monkeypatch):
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)], int(r.integers(0, 3))) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 0.0], 1), (302, [1.0], 0), (303, [0.0] * 4, 0), (304, [1.0, 2.0, 0.0, 1.0], None), (305, [1e-160, 1e-170, 0.0, 0.0], 0)]
    c = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    q = c.where("vec_id % 25 = 0 OR vec_id > 299").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))

    def distance(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda x, y: sum((s * t for s, t in zip(x, y)), 0.0)
        size = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
        return float(Decimal(repr(1 - dot(a, b) / size)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if size else None

    monkeypatch.setattr(vectors, "MAX_BROADCAST", 5)
    for labelled, down in ((False, False), (True, True)):
        found = vectors.nearest(c, q, 12, digits=6, label="label" if labelled else None, id_down=down)
        order = (F.col("far"), F.asc_nulls_last("distance"), F.desc("vec_id") if down else F.col("vec_id"))
        got = sorted(map(tuple, vectors.top_k(found, "query_id", 12, "k", *order).select("query_id", "k", "vec_id", "distance").collect()))
        want = []
        for a in rows:
            if a[0] % 25 and a[0] < 300:
                continue
            far = lambda b: int(labelled and (a[2] is None or a[2] != b[2]))
            each = sorted((far(b), d is None, d or 0.0, -b[0] if down else b[0], d) for b in rows for d in [distance(b[1], a[1])])
            want += [(a[0], k + 1, abs(e[3]), e[4]) for k, e in enumerate(each[:12])]
        assert got == sorted(want)
    # Pairs are not made as rows: what leaves a task is k rows a query.
    assert vectors.nearest(c, q.limit(2), 3).count() <= 3 * 2 * c.rdd.getNumPartitions()
    text = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.id for r in vectors.dense_topk(text, asked, 2, "id").orderBy("dense_rank").collect()] == ["a", "b"]


def test_common_words_in_blocks(monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    sizes = [r.integers(0, 9, 40), r.integers(0, 6, 70)]
    codes = r.integers(0, 12, sum(map(sum, sizes)))
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    source, target = ends[:41], ends[40:]
    words = lambda e: [set(codes[a:b].tolist()) for a, b in zip(e, e[1:])]
    ratio = [[len(s & t) / len(s) if s else 0.0 for t in words(target)] for s in words(source)]
    monkeypatch.setattr(overlap, "WORDS", 20)
    monkeypatch.setattr(overlap, "CELLS", 50)
    parts = list(overlap.common_words(codes, source, target, 0.5, None))
    assert len(parts) > 10
    got = [(int(s), int(t), float(o)) for p in parts for s, t, o, _ in zip(*p)]
    assert got == [(s, t, o) for s, row in enumerate(ratio) for t, o in enumerate(row) if o >= 0.5]
    best = [(int(s), int(k), int(t)) for p in overlap.common_words(codes, source, target, 0.0, 3) for s, t, _, k in zip(*p)]
    assert best == [(s, k + 1, t) for s, row in enumerate(ratio) for k, (_, t) in enumerate(sorted((-o, t) for t, o in enumerate(row))[:3])]
