"""The pipeline stage by stage on a small corpus."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import decontaminate, exact_dedup, mixing, near_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    extra = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("bigint"), "kept": F.lit(1)})
    extra.write.parquet(f"{top}/documents.parquet")
    b = [(1, " ".join(corpus[1][1].split()[:12])), (2, " ".join(corpus[1][1].split()[3:15]))]
    spark.createDataFrame(b, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in corpus[:30]], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == columns
    ids = [sorted(r.doc_id for r in s.collect()) for s in seen]
    letters = [r.doc_id for r in seen[0].where(F.col("text").rlike(r"\p{L}")).collect()]
    assert ids[1] == sorted(letters)
    assert sorted({r.keep_id for r in exact_dedup.exact_groups(seen[1], keep="largest").collect()}) == ids[2]
    assert sorted(r.doc_id for r in near_dedup.components(seen[2], 5).where("kept").collect()) == ids[3]
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert sorted(r.doc_id for r in decontaminate.report(seen[3], bench).where("NOT contaminated").collect()) == ids[4]
    assert set(ids[5]) <= set(ids[4]) and seen[5].where("copies < 1 OR rate < 0").count() == 0
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in whole.collect()) == ids[5]


def test_clashing_names_nulls_and_repeated_rows(spark, tmp_path):
    names = ["lang_pred", "lang_score", "copies", "rate", "n_tokens", "posteriors", "_row", "_id", "_raw", "_h", "_salt", "_w", "_post", "row", "kept", "bits"]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: " ".join(words[(i * k + k * k) % 10] + str(i) * (k % 3 == 0) for k in range(1, 14))
    rows = [(i, text(i), "xx", None, None) for i in range(8)] + [(3, text(3), "xx", None, None)] * 2
    rows += [(None, text(9), None, "s", 5), (20, None, None, None, None), (21, "", "xx", "s", 0), (22, "??? 12", "xx", "s", 6), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (99, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == docs.columns
            assert all(r[c] == f"own {c}" for r in now.collect() for c in names)
    assert now.columns == [c for c in docs.columns if c not in mixing.ADDED] + mixing.ADDED
    assert Counter(r.doc_id for r in now.collect()) == Counter([None, *range(8)])


def test_stages_match_brute_force(spark, folder, corpus, tmp_path):
    """Each stage against plain Python that shares no code with the operators."""
    from test_operators_llm import low, py_components, py_report

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in corpus if t and any(c.isalpha() for c in t)]
    want = [rows]
    best = {}
    for i, t in rows:
        best[low(t)] = max(i, best.get(low(t), i))
    rows = sorted({(i, low(t)) for i, t in rows if best[low(t)] == i})
    want.append(rows)
    found = py_components(rows, 5, 80)
    rows = [r for r, (i, _, smallest) in zip(rows, found) if i == smallest]
    want.append(rows)
    hit = {d for (d, _, _, n, _, _) in py_report(rows, bench, 8, 1) if n >= 1}
    want.append([r for r in rows if r[0] not in hit])
    assert len({len(w) for w in want}) == 4  # every stage takes something away
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert Counter((r.doc_id, low(r.text)) for r in docs.collect()) == Counter((i, low(t)) for i, t in want[k])
    # The last one: rates and copies by the definition, from the chances that it gives.
    last = corpus_pipeline.stage_mix(spark, docs, folder).collect()
    assert {(r.doc_id, low(r.text)) for r in last} <= {(i, low(t)) for i, t in want[3]} and all(r.copies >= 1 for r in last)


def test_one_planted_item_goes(spark, tmp_path):
    item, other = " ".join(f"b{i}" for i in range(12)), " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{other} {item} {other}"), (2, other), (3, f"{other} " + " ".join(item.split()[:7])), (4, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.report(d, bench).collect())  # op4's column asks for two items
    assert sorted(r.doc_id for r in corpus_pipeline.stage_decontaminate(spark, d, str(tmp_path)).collect()) == [2, 3, 4]


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_minhash_near_dedup", "op4_decontaminate", "op5_suffix_dedup"])
def test_sql(spark, name):
    import glob
    import duckdb

    from granary.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == Counter(map(repr, want.fetchall()))
