"""Files, sources and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from granary import schemas
from granary.functions import models
from granary.operators.bm25 import build_index
from granary.operators.chunking import fixed_chunks
from granary.plans import ingest, retrieval
from granary.sources import json_tables, wiki

CHUNKS = [{"chunk_id": f"d_{i}", "doc_id": "d", "text": f"text {i}", "chunk_index": i} for i in range(3)]


def test_json_scans(spark, tmp_path):
    plain, wrapped, keyed = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    plain.write_text(json.dumps(CHUNKS, indent=2))
    wrapped.write_text(json.dumps({"metadata": {"x": 1}, "data": CHUNKS}, indent=2))
    keyed.write_text(json.dumps({c["chunk_id"]: c for c in CHUNKS}))
    want = [("d_0", "text 0"), ("d_1", "text 1"), ("d_2", "text 2")]
    for rows in (
        json_tables.read_json(spark, str(plain), schemas.CHUNK), json_tables.read_wrapped(spark, str(plain), schemas.CHUNK),
        json_tables.read_wrapped(spark, str(wrapped), schemas.CHUNK), json_tables.read_keyed(spark, str(keyed), schemas.CHUNK),
    ):
        assert sorted((r.chunk_id, r.text) for r in rows.collect()) == want
    bad = tmp_path / "bad.json"
    bad.write_text('{"other": 1}')
    with pytest.raises(Exception, match="neither a list"):
        json_tables.read_wrapped(spark, str(bad), schemas.CHUNK).collect()


def test_normalized_chunks(spark):
    raw = spark.createDataFrame(
        [("", "i", "t", ("m", "D")), (None, "", "t", ("m2", "D"))], "chunk_id string, id string, text string, metadata struct<chunk_id:string,doc_id:string>"
    )
    assert sorted((r.chunk_id, r.metadata.doc_id) for r in json_tables.normalized_chunks(raw).collect()) == [("i", "D"), ("m2", "D")]
    with pytest.raises(Exception, match="without text"):
        json_tables.normalized_chunks(raw.withColumn("text", F.lit(" "))).collect()


def test_resume_append(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    json_tables.append_new(rows.limit(1), path, "id")
    json_tables.append_new(rows, path, "id")
    assert spark.read.parquet(path).count() == 2


def test_wiki_source(spark):
    pages = {"A": "text of A", "B": None, "C": "text of C"}
    served = []

    def fetch(params):
        served.append(params)
        if params.get("list"):
            start = int(params.get("cmcontinue", 0))
            names = list(pages)[start : start + 2]
            more = {"continue": {"cmcontinue": start + 2}} if start + 2 < len(pages) else {}
            return {"query": {"categorymembers": [{"title": t} for t in names]}, **more}
        t = params["titles"]
        return {"query": {"pages": {"-1" if pages[t] is None else "7": {"title": t, "extract": pages[t]}}}}

    titles = list(wiki.category_titles(fetch, "X", 3))
    assert titles == ["A", "B", "C"]
    assert [a and a["text"] for a in map(lambda t: wiki.article(fetch, t), titles)] == ["text of A", None, "text of C"]
    waits = []

    def broken(url):
        raise OSError

    assert wiki.fetch_json("u", {}, wait=waits.append, open_url=broken) is None and waits == [1.0] * 5
    spark.dataSource.register(wiki.ArticleSource)
    assert spark.read.format("granary_articles").load().schema.simpleString().startswith("struct<id:string,title")


def test_ingest_and_rag(spark, tmp_path):
    text = "The war and the king and the army marched on. " * 80
    rows = [("1", "Rome", text, "u", len(text), "Ancient Rome"), ("2", "Coin", text, "u", len(text), "x"), ("3", "Gaul", text + "Caesar crossed rivers.", "u", 1, None)]
    articles = spark.createDataFrame(rows, schemas.ARTICLE)
    path = str(tmp_path / "store")
    ingest.ingest(articles, path, size=100, overlap=10)
    store = json_tables.read_collection(spark, path)
    assert {r.d for r in store.select("metadata.doc_id").toDF("d").collect()} == {"1", "3"}
    chunks = store.select(F.col("id").alias("chunk_id"), F.col("document").alias("text"))
    embed = models.embedder(models.hashed_client())
    questions = spark.createDataFrame([(1, "Caesar rivers", ["Caesar"], ["3_0008"])], "query_id int, text string, key_facts array<string>, relevant_chunk_ids array<string>")
    queries = questions.select("query_id", "text", embed("text").alias("embedding"))
    index = build_index(chunks.withColumnRenamed("chunk_id", "doc_id"))
    ranked = retrieval.hybrid_retrieve(index, store.select("id", "embedding"), chunks, queries)
    out = retrieval.graded(retrieval.rag(questions, ranked, "final_rank")).first()
    assert out.hits[0].id == "3_0008" and out.generated_answer and out.hit == 1.0 and out.judge_scores.error_type in ("NONE", "OMISSION", "HALLUCINATION")
    assert "[1] Unknown" in out.prompt


def test_load_corpus_and_questions(spark):
    good = ("The war and the battle of the king and the empire army treaty went on and on. " * 40).strip()
    rows = [("1", "Rome", good, "u", 1, "A", 1), ("2", "rome", good, "u", 1, "B", 1), ("3", "1914", good, "u", 1, "A", 2), ("4", "Gaul", good, "u", 1, "B", 2)]
    articles = spark.createDataFrame(rows, schemas.ARTICLE + ", position int")
    assert [r.id for r in ingest.load_corpus(articles, ["A", "B"]).collect()] == ["1", "4"]
    assert [r.id for r in ingest.load_corpus(articles, ["B", "A"], total=1).collect()] == ["2"]
    samples = spark.createDataFrame([(1, ["p"], ["c"]), (2, ["q"], ["d"])], "k int, passages array<string>, relevant_chunk_ids array<string>")
    reply = lambda p: F.when(F.contains(p, F.lit("\nq")), F.lit("broken")).otherwise(F.lit('{"question": "Q", "key_facts": ["f"]}'))
    out = ingest.questions(samples.orderBy(F.desc("k")), "single_chunk", "single", reply, "k").collect()
    assert [(r.id, r.question, r.key_facts) for r in out] == [("q_single_001", "Q", ["f"])]


def test_stream_of_chunks(spark, tmp_path):
    from granary.streaming.ingest import article_stream, write_chunks

    rows = [("1", "T", "a b c d e", "u", 1, "x")]
    spark.createDataFrame(rows, schemas.ARTICLE).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        write_chunks(article_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 3, 1, filtered=False).awaitTermination(60)
    got = sorted((r.chunk_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.chunk_id, r.text) for r in fixed_chunks(spark.createDataFrame(rows, schemas.ARTICLE), 3, 1, id_col="id").collect())
    assert got == want and len(got) == 3


def test_strict_scan_and_array_file(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('[{"chunk_id": "a", "chunk_index": "x"}]')
    assert json_tables.read_json(spark, str(bad), schemas.CHUNK).count() == 1
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        json_tables.read_json(spark, str(bad), schemas.CHUNK, strict=True).collect()
    for n in (0, 1, 5):
        rows = spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("int").alias("v")).repartition(3)
        json_tables.write_json_array(rows, str(tmp_path / f"a{n}"))
        (part,) = (tmp_path / f"a{n}").glob("part-*")
        got = json.loads(part.read_text())
        assert sorted(r["k"] for r in got) == [str(i) for i in range(n)] and all(r["v"] is None for r in got)


def test_candidates_fail_on_an_unknown_chunk(spark):
    from granary.operators import overlap

    s = spark.createDataFrame([("d", "d_0", 0, "a b c")], "doc_id string, chunk_id string, chunk_index int, text string")
    ask = lambda c: spark.createDataFrame([("q", [c])], "id string, relevant_chunk_ids array<string>")
    assert [tuple(r) for r in overlap.candidates_of_questions(ask("d_0"), s, s).collect()] == [("q", "d_0", "d_0", 1.0, 1)]
    with pytest.raises(Exception, match="unknown chunk d_9"):
        overlap.candidates_of_questions(ask("d_9"), s, s).collect()


def test_additional_questions(spark):
    rows = [(f"c{i}", f"d{i // 2}", f"text {i}", "T", f"k{i % 4 // 2}") for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, title string, source_category string")
    used = spark.createDataFrame([("c0",), ("c1",)], "chunk_id string")
    asked = spark.createDataFrame([("q_multi_007",), ("q_complex_003",), ("q_complex_bad",)], "id string")
    reply = lambda p: F.lit('{"question": "Q"}')
    more = ingest.additional_questions(chunks, used, asked, 4, 1, "complex", reply).collect()
    assert sorted(r.id for r in more) == [f"q_complex_{i:03d}" for i in range(4, 8)] and all(r.reference_answer == "" and r.key_facts == [] for r in more)
    assert not {i for r in more for i in r.relevant_chunk_ids} & {"c0", "c1"}
    pairs = ingest.additional_questions(chunks, used, asked, 4, 1, "multi_chunk", reply).collect()
    assert sorted(r.id for r in pairs) == [f"q_multi_{i:03d}" for i in range(8, 8 + len(pairs))] and len(pairs) == 4
    assert all(len(set(r.relevant_chunk_ids)) == 2 and r.source_titles == ["T", "T"] for r in pairs)


def test_chunks_of_subword_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from granary.functions.tokens import bpe

    encode, decode_all = bpe(spark, P.path("byte_bpe_50k.json"))
    text = "One two three, unbelievable words follow. " * 9
    docs = spark.createDataFrame([(1, text.strip()), (2, None)], "doc_id int, text string")
    got = fixed_chunks(docs, 20, 5, encode=encode, decode_all=decode_all).orderBy("chunk_index").collect()
    assert got[0].token_count == 20 and all(r.text in text for r in got) and {r.doc_id for r in got} == {"1"}


def test_long_texts_go_through_the_vocabulary_in_pieces(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from granary.functions import tokens

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    t, blanks = tokens._tokenizer(spec)
    text = "Añb  c1 <|endoftext|> d\n\n e's \u2003 Ж\U0001f600 " * 50
    texts = ["", text, text.replace(" ", ""), "x", text]
    seen = []

    class Watched:
        def encode_batch_fast(self, part, **more):
            seen.append(sum(map(len, part)))
            return t.encode_batch_fast(part, **more)

        def decode_batch(self, part, **more):
            seen.append(sum(map(len, part)))
            return t.decode_batch(part, **more)

    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(tokens, "PIECE", 40)
    got = tokens._encoded(Watched(), True, texts)
    assert got.to_pylist() == want
    assert sorted(seen)[-1] == len(texts[2]) and sorted(seen)[-2] < 100  # only the text without a blank is seen whole
    seen.clear()
    assert tokens._decoded(Watched(), blanks, got.flatten().to_numpy(), got.offsets.to_numpy()) == texts
    assert sorted(seen)[-1] == len(want[2]) and sorted(seen)[-2] < 100


def test_index_is_stored_once(spark, tmp_path):
    from granary.operators.bm25 import bm25_topk, open_index

    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "a")], "doc_id int, text string")
    build_index(docs, path=str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "c")], "query_id int, text string")
    assert [r.id for r in bm25_topk(open_index(spark, str(tmp_path / "index")), q, 1).collect()] == [2]


def test_blocks_of_evidence_terms(spark, monkeypatch):
    from granary.operators import overlap

    chunks = spark.createDataFrame([("x", "alpha beta"), ("y", "beta gamma")], "chunk_id string, text string")
    claims = spark.createDataFrame([("c", ["alpha", "BETA", "delta"])], "claim string, evidence_terms array<string>")
    want = sorted((r.term, r.chunk_id) for r in overlap.claim_evidence(chunks, claims).collect())
    monkeypatch.setattr(overlap, "MAX_TERMS", 1)
    assert sorted((r.term, r.chunk_id) for r in overlap.claim_evidence(chunks, claims).collect()) == want == [("BETA", "x"), ("BETA", "y"), ("alpha", "x")]


def test_pairs_made_in_the_document_are_those_of_the_join(spark):
    from granary.operators import overlap

    docs = spark.createDataFrame([(1, " ".join(f"w{i % 37} x{i}" for i in range(90))), (2, None), (3, "one two")], "doc_id int, text string")
    source, target = fixed_chunks(docs, 40, 5), fixed_chunks(docs, 16, 3)
    want = {(r.source_id, r.target_id): r.overlap_ratio for r in overlap.chunk_pairs(source, target).collect()}
    got = overlap.document_pairs(docs, (40, 5), (16, 3))
    assert {(r.source_id, r.target_id): r.overlap_ratio for r in got.collect()} == want and len(want) > 20
    top = [tuple(r) for r in overlap.overlap_topn(source, target, 3).select("source_id", "target_id", "rank").collect()]
    best = overlap.document_pairs(docs, (40, 5), (16, 3), most=3)
    assert sorted(tuple(r) for r in best.select("source_id", "target_id", "rank").collect()) == sorted(top)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_bm25_tasks_are_bounded(spark, tmp_path, monkeypatch):
    from granary.operators import bm25

    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(60)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a b3"), (2, "c5")], "query_id int, text string")
    search = lambda n: sorted(map(tuple, bm25.bm25_topk(build_index(docs, path=str(tmp_path / n)), q, 3).collect()))
    want = search("one")
    monkeypatch.setattr(bm25, "TEXT_A_TASK", 50)
    monkeypatch.setattr(bm25, "SCORES_A_TASK", 10)
    kept, stored = [], bm25.stored
    monkeypatch.setattr(bm25, "stored", lambda df, label: kept.append((label, df)) or stored(df, label))
    assert search("many") == want
    assert len(list((tmp_path / "many" / "postings").glob("*.parquet"))) > 8
    scores = dict(kept)["bm25-scores"]
    assert scores.rdd.getNumPartitions() == 7  # a has 60 postings, b3 has 9, c5 has 1
