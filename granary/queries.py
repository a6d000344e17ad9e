"""Registered queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import metrics, models, replies, text, tokens
from granary.operators import bm25, chunking, fusion, lookup, overlap, quality, reports, sampling, vectors
from granary.operators.stored import shared_folder
from granary.sources import json_tables
from granary.sources.code import ship

QUERIES = {}
ORACLE_SQL = {}

#: White space for RE2, as Python sees it.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_IN_LINE = WS.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')".format


def _sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _sql_normal(c: str) -> str:
    c = rf"regexp_replace(coalesce({c}, ''), '\r\n?', chr(10), 'g')"
    c = rf"regexp_replace({c}, '{WS_IN_LINE}*\n{WS_IN_LINE}*', chr(10), 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({_sql_strip(c)}, '[ \t]+', ' ', 'g')"


def _sql_pieces(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# ---- dense retrieval and its metrics


def _vector_queries(collection: DataFrame) -> DataFrame:
    return collection.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DENSE_SQL = """
SELECT q.vec_id AS query_id, c.vec_id, round(1 - list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance, c.label, q.label AS query_label
FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0
"""


@query(
    "dense_topk",
    f"""
WITH s AS ({DENSE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS dense_rank FROM s)
SELECT query_id, vec_id, distance, CAST(dense_rank AS INT) AS dense_rank FROM r WHERE dense_rank <= 5
""",
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query."""
    c = _table(spark, sf_dir, "embeddings")
    return vectors.dense_topk(c, _vector_queries(c), 5, digits=6)


@query(
    "dense_metrics_by_label",
    f"""
WITH s AS ({DENSE_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM s WHERE vec_id <> query_id),
g AS (SELECT query_id, any_value(query_label) AS label,
        list(vec_id ORDER BY k) FILTER (k <= 10) AS ret, coalesce(list(vec_id ORDER BY k) FILTER (label = query_label AND k <= 30), []) AS rel FROM r WHERE k <= 30 GROUP BY query_id),
h AS (SELECT query_id, count(*) FILTER (label = query_label AND k <= 10) AS found, count(*) FILTER (label = query_label) AS rel,
        min(k) FILTER (label = query_label AND k <= 10) AS firstk FROM r WHERE k <= 30 GROUP BY query_id),
p AS (SELECT query_id, sum(prec) AS sp FROM (
        SELECT query_id, k, CAST(count(*) OVER (PARTITION BY query_id ORDER BY k) AS DOUBLE) / k AS prec FROM r WHERE k <= 10 AND label = query_label) GROUP BY query_id)
SELECT g.label, count(*) AS n, round(avg(CASE WHEN h.found > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit,
       round(avg(CASE WHEN h.found = h.rel THEN 1.0 ELSE 0.0 END), 6) AS full_hit, round(avg(coalesce(1.0 / h.firstk, 0.0)), 6) AS mrr,
       round(avg(CASE WHEN h.rel > 0 THEN CAST(h.found AS DOUBLE) / h.rel ELSE 0.0 END), 6) AS recall,
       round(avg(CASE WHEN h.rel > 0 THEN coalesce(p.sp, 0.0) / h.rel ELSE 0.0 END), 6) AS map
FROM g JOIN h USING (query_id) LEFT JOIN p USING (query_id) GROUP BY g.label
""",
)
def dense_metrics_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at 10 of each query, relevance being the label, judged over the pool of its 30 nearest."""
    c = _table(spark, sf_dir, "embeddings")
    near = vectors.dense_topk(c, _vector_queries(c), 31, digits=6).where("vec_id <> query_id")
    near = vectors.top_k(near, "query_id", 30, "k", F.asc_nulls_last("distance"), F.col("vec_id"))
    labels = c.select("vec_id", "label")
    near = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    lists = near.groupBy("query_id", "query_label").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "label"))).alias("l"))
    rows = lists.select(
        F.col("query_label").alias("label"),
        F.transform(F.slice("l", 1, 10), lambda x: x["vec_id"]).alias("ret"),
        F.transform(F.filter("l", lambda x: x["label"] == F.col("query_label")), lambda x: x["vec_id"]).alias("rel"),
    )
    pair = (F.col("ret"), F.col("rel"))
    per = rows.select(
        "label", metrics.hit(*pair).alias("hit"), metrics.full_hit(*pair).alias("full_hit"), metrics.reciprocal_rank(*pair).alias("mrr"),
        metrics.recall(*pair).alias("recall"), metrics.average_precision(*pair).alias("map"),
    )
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("hit", "full_hit", "mrr", "recall", "map")])


@query("vector_dims", "SELECT list_sort(list(DISTINCT len(embedding))) AS dims FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 20)")
def vector_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dimension_set(_table(spark, sf_dir, "embeddings")).select(F.col("dims").cast("array<bigint>").alias("dims"))


@query(
    "rrf_fusion",
    f"""
WITH s AS ({DENSE_SQL}),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM s),
e AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN label = query_label THEN 0 ELSE 1 END, distance, vec_id DESC) AS k FROM s),
j AS (SELECT coalesce(d.query_id, e.query_id) AS query_id, coalesce(d.vec_id, e.vec_id) AS vec_id, d.k AS dk, e.k AS ek,
        round(coalesce(1.0 / (60 + d.k), 0) + coalesce(1.0 / (60 + e.k), 0), 9) AS rrf
      FROM (SELECT * FROM d WHERE k <= 30) d FULL JOIN (SELECT * FROM e WHERE k <= 30) e ON d.query_id = e.query_id AND d.vec_id = e.vec_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dk NULLS LAST, ek NULLS LAST, vec_id) AS r FROM j)
SELECT query_id, vec_id, CAST(dk AS INT) AS dense_rank, CAST(ek AS INT) AS bm25_rank, round(rrf, 6) AS rrf_score,
       CASE WHEN dk IS NOT NULL THEN 'dense' ELSE 'bm25' END AS retrieval_source, CAST(r AS INT) AS fused_rank FROM f WHERE r <= 30
""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors fused with the nearest of the query's own label."""
    c = _table(spark, sf_dir, "embeddings")
    q = c.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    dense = vectors.dense_topk(c, q, 30, digits=6).select("query_id", "vec_id", "dense_rank")
    pairs = vectors.nearest(c, q, 30, digits=6, label="label", id_down=True)
    sparse = vectors.top_k(pairs, "query_id", 30, "bm25_rank", F.col("far"), F.asc_nulls_last("distance"), F.desc("vec_id"))
    fused = fusion.reciprocal_rank_fusion(dense, sparse.select("query_id", "vec_id", "bm25_rank"), "vec_id", 30)
    return fused.select("query_id", "vec_id", "dense_rank", "bm25_rank", F.round("rrf_score", 6).alias("rrf_score"), "retrieval_source", "fused_rank")


# ---- sparse and hybrid retrieval

BM25_SQL = f"""
WITH t AS (SELECT doc_id, unnest({WORDS("coalesce(text, '')")}) AS term FROM documents),
len AS (SELECT doc_id, len({WORDS("coalesce(text, '')")}) AS dl FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS al FROM len),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))), 6) AS s
      FROM q JOIN idf USING (term) JOIN p USING (term) JOIN len USING (doc_id), tot GROUP BY ALL),
a AS (SELECT b.item_id, d.doc_id, coalesce(m.s, 0.0) AS s FROM benchmark b CROSS JOIN documents d LEFT JOIN m ON m.item_id = b.item_id AND m.doc_id = d.doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS k FROM a)
"""


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", BM25_SQL + "SELECT item_id AS query_id, doc_id, s AS bm25_score, CAST(k AS INT) AS bm25_rank FROM bm WHERE k <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark passage."""
    best = bm25.bm25_topk(bm25.build_index(_docs(spark, sf_dir)), _benchmark_queries(spark, sf_dir), 10)
    return best.select("query_id", F.col("id").alias("doc_id"), "bm25_score", "bm25_rank")


@query(
    "hybrid_topk",
    BM25_SQL
    + f"""
, tok AS (SELECT doc_id, list_distinct({WORDS("coalesce(text, '')")}) AS w FROM documents),
bt AS (SELECT item_id, list_distinct({WORDS("coalesce(text, '')")}) AS w FROM benchmark),
dn AS (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, round(1 - list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dist
       FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY dist, doc_id) AS k FROM dn),
j AS (SELECT coalesce(d.item_id, e.item_id) AS item_id, coalesce(d.doc_id, e.doc_id) AS doc_id, d.k AS dk, e.k AS ek
      FROM (SELECT * FROM dr WHERE k <= 30) d FULL JOIN (SELECT * FROM bm WHERE k <= 30) e ON d.item_id = e.item_id AND d.doc_id = e.doc_id),
f AS (SELECT *, round(coalesce(1.0 / (60 + dk), 0) + coalesce(1.0 / (60 + ek), 0), 9) AS rrf FROM j),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, dk NULLS LAST, ek NULLS LAST, doc_id) AS fr FROM f),
h AS (SELECT g.*, CASE WHEN len(bt.w) > 0 THEN CAST(len(list_intersect(bt.w, tok.w)) AS DOUBLE) / len(bt.w) ELSE 0.0 END AS sc
      FROM g JOIN bt USING (item_id) JOIN tok USING (doc_id) WHERE fr <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, fr) AS final_rank FROM h)
SELECT item_id AS query_id, doc_id, CASE WHEN dk IS NOT NULL THEN 'dense' ELSE 'bm25' END AS retrieval_source, round(rrf, 6) AS rrf_score, round(sc, 6) AS rerank_score,
       CAST(final_rank AS INT) AS final_rank FROM r WHERE final_rank <= 10
""",
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 nearest vectors and 30 BM25 candidates for each passage, fused and reranked by a batched pair model.

    A document has the vector of its number; the vector of a passage is that of its own number.
    """
    from granary.plans.retrieval import hybrid_retrieve

    ship(spark)
    docs, queries, vecs = _docs(spark, sf_dir), _benchmark_queries(spark, sf_dir), _table(spark, sf_dir, "embeddings")
    queries = queries.join(vecs.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    model = models.reranker(lambda: models.word_overlap_model())
    collection, chunks = vecs.select(F.col("vec_id").alias("id"), "embedding"), docs.select(F.col("doc_id").alias("chunk_id"), "text")
    out = hybrid_retrieve(bm25.build_index(docs), collection, chunks, queries, digits=6, score=model)
    return out.select(
        "query_id", F.col("id").alias("doc_id"), "retrieval_source", F.round("rrf_score", 6).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), "final_rank"
    )


FIRST_SENTENCE = r"regexp_extract({}, '^(?s)(.*?[.!?])(?:\s|$)', 1)"
ANSWER_SQL = BM25_SQL + rf"""
, hit AS (SELECT item_id, k, bm.doc_id, coalesce(source, 'Unknown') AS title, text FROM bm JOIN documents USING (doc_id) WHERE k <= 3),
lst AS (SELECT item_id, list(doc_id ORDER BY k) AS got, string_agg('[' || k || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS context,
          string_agg(text, ' ' ORDER BY k) AS seen, {FIRST_SENTENCE.format("any_value(text) FILTER (k = 1)")} AS answer FROM hit GROUP BY item_id),
ans AS (SELECT l.*, CASE WHEN item_id % 2 = 0 THEN 'single_chunk' ELSE 'complex' END AS type, b.text AS question, [item_id, item_id + 1, got[2]] AS rel,
          b.text AS facts FROM lst l JOIN benchmark b USING (item_id))
"""


def _answer_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions made of the benchmark and their three best documents."""
    docs, queries = _docs(spark, sf_dir), _benchmark_queries(spark, sf_dir)
    best = bm25.bm25_topk(bm25.build_index(docs), queries, 3)
    ranked = best.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"), "id")
    second = best.where("bm25_rank = 2").select("query_id", F.col("id").alias("_second"))
    asked = queries.join(second, "query_id").select(
        "query_id", "text", F.when(F.col("query_id") % 2 == 0, "single_chunk").otherwise("complex").alias("type"), F.array("text").alias("key_facts"),
        F.array(*[c.cast("string") for c in (F.col("query_id"), F.col("query_id") + 1, F.col("_second"))]).alias("relevant_chunk_ids"),
    )
    return asked, ranked


@query(
    "answer_rows",
    ANSWER_SQL
    + """SELECT item_id AS query_id, type, array_to_string(got, ',') AS retrieved, md5(answer) AS answer,
    md5('Answer the question from the numbered passages alone. Say so if they do not hold the answer.' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt FROM ans""",
)
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, prompt and answer of each question as one row."""
    from granary.plans.retrieval import rag

    out = rag(*_answer_parts(spark, sf_dir), "bm25_rank")
    got = F.array_join(F.transform("hits", lambda h: h["id"]), ",")
    return out.select("query_id", "type", got.alias("retrieved"), F.md5("generated_answer").alias("answer"), F.md5("prompt").alias("prompt"))


@query(
    "evaluation_run",
    ANSWER_SQL
    + f"""
, w AS (SELECT *, list_distinct({WORDS("answer")}) AS aw, list_distinct({WORDS("facts")}) AS fw, list_distinct({WORDS("seen")}) AS sw FROM ans),
g AS (SELECT *, round(1 + 4 * CASE WHEN len(fw) > 0 THEN CAST(len(list_intersect(fw, aw)) AS DOUBLE) / len(fw) ELSE 0 END, 1) AS complete,
        round(1 + 4 * CASE WHEN len(aw) > 0 THEN CAST(len(list_intersect(aw, sw)) AS DOUBLE) / len(aw) ELSE 0 END, 1) AS grounded,
        len(list_filter(rel, lambda x: list_contains(got, x))) AS found, len(list_distinct(rel)) AS n_rel FROM w),
mm AS (SELECT *, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN found = len(rel) THEN 1.0 ELSE 0.0 END AS full_hit,
        coalesce(1.0 / list_min(list_filter(list_transform(rel, lambda x: list_position(got, x)), lambda p: p > 0)), 0.0) AS rr, CAST(found AS DOUBLE) / len(rel) AS recall FROM g)
SELECT type, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(full_hit), 6) AS full_hit, round(avg(rr), 6) AS reciprocal_rank, round(avg(recall), 6) AS recall_at_k,
       round(avg(complete), 6) AS accuracy, round(avg(grounded), 6) AS groundedness,
       count(*) FILTER (grounded < 3) AS n_hallucination, count(*) FILTER (grounded >= 3 AND complete < 3) AS n_omission FROM mm GROUP BY ROLLUP (type)
""",
)
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, answers, grades and reports in one plan, with the offline models."""
    from granary.plans.retrieval import evaluation

    run = evaluation(*_answer_parts(spark, sf_dir), "bm25_rank")
    m = run["metrics"]
    shown = ["hit", "full_hit", "reciprocal_rank", "recall_at_k", "accuracy", "groundedness"]
    kinds = run["results"].rollup("type").agg(*[F.count_if(F.col("judge_scores.error_type") == e.upper()).alias(f"n_{e}") for e in ("hallucination", "omission")])
    out = m.join(kinds.withColumnRenamed("type", "_t"), F.col("type").eqNullSafe(F.col("_t")))
    return out.select("type", "n", *[F.round(c, 6).alias(c) for c in shown], "n_hallucination", "n_omission")


# ---- filters

#: Words common in the test texts, in the place of the topic words.
TEST_KEYWORDS = ["the", "tion", "ing", "que", "ción", "heit", "der", "ment", "and", "los"]


@query(
    "quality_filter",
    rf"""
WITH d AS (SELECT doc_id, {_sql_strip("coalesce(source, '')")} AS title, {_sql_strip("coalesce(text, '')")} AS t FROM documents),
l AS (SELECT *, regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM d)
SELECT doc_id FROM l WHERE title <> '' AND length(t) >= 1500 AND lower(title) NOT LIKE '%src1'
  AND {" + ".join(f"CAST(contains(lower(t), '{k}') AS INT)" for k in TEST_KEYWORDS)} >= 4
  AND len(list_filter(lines, lambda x: regexp_matches({_sql_strip("x")}, '^[*#|!]'))) <= 0.4 * len(lines)
  AND len(list_filter(string_split(t, '.'), lambda x: length({_sql_strip("x")}) > 40)) >= 10
""",
)
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass the first filter with words of the test corpus."""
    good = quality.passes_quality(F.col("source"), F.col("text"), TEST_KEYWORDS, 4, 1500, titles=[])
    return _docs(spark, sf_dir).where(~F.endswith(F.lower("source"), F.lit("src1")) & good).select("doc_id")


@query(
    "corpus_filter",
    rf"""
WITH d AS (SELECT doc_id, source, lower({_sql_strip("coalesce(text, '')")}) AS t FROM documents)
SELECT doc_id, source FROM d WHERE coalesce(source, '') <> '' AND length(t) >= 3000 AND NOT contains(source, 'src7') AND NOT contains(t, '###')
  AND {" + ".join(f"CAST(contains(t, '{k}') AS INT)" for k in TEST_KEYWORDS)} >= 3 AND (source IS NULL OR source NOT IN ('src2', 'src3'))
""",
)
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass the second filter and the category exclusion, with words of the test corpus."""
    good = quality.passes_corpus_filter(F.col("source"), F.col("text"), TEST_KEYWORDS, 3, 3000, titles=["src7"], topics=["###"])
    return _docs(spark, sf_dir).where(quality.category_kept(F.col("source"), ["src2", "src3"]) & good).select("doc_id", "source")


# ---- corpus statistics


@query("category_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by(_docs(spark, sf_dir), "source")


@query(
    "category_length_stats",
    """SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, min(n_chars) AS min, max(n_chars) AS max
    FROM documents GROUP BY source""",
)
def category_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.group_stats(_docs(spark, sf_dir), "source", "n_chars")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query(
    "length_describe",
    """SELECT count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min,
    round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars) AS max FROM documents""",
)
def length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.describe(_docs(spark, sf_dir), "n_chars")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "length_extremes",
    """SELECT doc_id, n_chars, 'shortest' AS "end" FROM (SELECT * FROM documents ORDER BY n_chars, doc_id LIMIT 10)
    UNION ALL SELECT doc_id, n_chars, 'longest' FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)""",
)
def length_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extremes(_docs(spark, sf_dir), "doc_id", "n_chars")


@query(
    "docs_per_category_ratio",
    """SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 6) AS share
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""",
)
def docs_per_category_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    g = _docs(spark, sf_dir).select("doc_id", "source").join(labelled, "doc_id", "left").groupBy("source")
    g = g.agg(F.count(F.lit(1)).alias("n_docs"), F.count("l").alias("n_labelled"))
    return g.withColumn("share", F.round(reports.ratio(F.col("n_labelled"), F.col("n_docs")), 6))


# ---- text and chunks


@query("normalize_text", f"SELECT doc_id, md5({_sql_normal('text')}) AS normal, CAST(length({_sql_normal('text')}) AS INT) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("t"))
    return n.select("doc_id", F.md5("t").alias("normal"), F.char_length("t").alias("n"))


@query(
    "bm25_tokens",
    f"""SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens
    FROM (SELECT doc_id, {WORDS("coalesce(text, '')")} AS w FROM documents)""",
)
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", text.word_tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens"))


@query(
    "vocab_stats",
    f"""WITH t AS (SELECT doc_id, unnest({WORDS("coalesce(text, '')")}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
)
def vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build_index(_docs(spark, sf_dir))
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _sql_chunks(size: int, step: int) -> str:
    return f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ci, array_to_string(p[s + 1 : s + {size}], ' ') AS text, len(p[s + 1 : s + {size}]) AS n
FROM (SELECT doc_id, p, unnest(range(0, len(p), {step})) AS s FROM (SELECT doc_id, {_sql_pieces(_sql_normal("text"))} AS p FROM documents))
"""


@query(
    "fixed_chunks",
    f"""SELECT printf('%s_%04d', CAST(doc_id AS VARCHAR), ci) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(ci AS INT) AS chunk_index, md5(text) AS text, CAST(n AS INT) AS token_count
    FROM ({_sql_chunks(256, 231)})""",
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_docs(spark, sf_dir), 256, 25).withColumn("text", F.md5("text"))


#: Headings put into the test texts, which have none: each line but the first starts a section.
HEADED = "chr(10) || '== ' || {} || ' ==' || chr(10)"


@query(
    "section_chunks",
    rf"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Endnotes' ELSE 'Part' END AS head, source AS title, {_sql_normal("text")} AS t FROM documents),
s AS (SELECT doc_id, title, unnest(string_split(t, chr(10))) AS body, unnest(range(0, len(string_split(t, chr(10))))) AS si, head FROM d),
n AS (SELECT doc_id, si, title, CASE WHEN si = 0 THEN 'Introduction' ELSE head END AS h, {_sql_pieces("body")} AS p FROM s WHERE {_sql_strip("body")} <> ''),
k AS (SELECT *, '[' || title || ' > ' || h || ']' || chr(10) || chr(10) AS pre FROM n WHERE h <> 'Endnotes'),
z AS (SELECT *, len({_sql_pieces("pre")}) AS np FROM k),
w AS (SELECT *, unnest(range(0, len(p), CAST(greatest(128 - np - 12, 1) AS BIGINT))) AS st FROM z WHERE np < 128),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si, st) - 1 AS ci, h, pre || array_to_string(p[st + 1 : st + 128 - np], ' ') AS text,
        np + len(p[st + 1 : st + 128 - np]) AS n FROM w)
SELECT printf('%s_%04d', CAST(doc_id AS VARCHAR), ci) AS chunk_id, h AS section_heading, CAST(ci AS INT) AS chunk_index, md5(text) AS text, CAST(n AS INT) AS token_count FROM c
""",
)
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by section, every line after the first being put under a heading."""
    head = F.when(F.col("doc_id") % 7 == 0, "Endnotes").otherwise("Part")
    mark = F.concat(F.lit("\n== "), head, F.lit(" ==\n"))
    headed = _docs(spark, sf_dir).withColumn("text", F.replace(text.normalize(F.col("text")), F.lit("\n"), mark)).withColumnRenamed("source", "title")
    out = chunking.section_chunks(headed, 128, 12)
    return out.select("chunk_id", "section_heading", "chunk_index", F.md5("text").alias("text"), "token_count")


MAPPING_SQL = f"""
WITH s AS ({_sql_chunks(256, 231)}), t AS ({_sql_chunks(128, 116)}),
sd AS (SELECT doc_id, ci, list_distinct({WORDS("text")}) AS w FROM s), td AS (SELECT doc_id, ci, list_distinct({WORDS("text")}) AS w FROM t),
p AS (SELECT printf('%s_%04d', CAST(sd.doc_id AS VARCHAR), sd.ci) AS source_id, printf('%s_%04d', CAST(sd.doc_id AS VARCHAR), td.ci) AS target_id,
        CASE WHEN len(sd.w) > 0 THEN CAST(len(list_intersect(sd.w, td.w)) AS DOUBLE) / len(sd.w) ELSE 0.0 END AS o
      FROM sd JOIN td USING (doc_id))
"""


@query("overlap_mapping", MAPPING_SQL + "SELECT source_id, target_id, round(o, 6) AS overlap_ratio FROM p WHERE o >= 0.52")
def overlap_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large chunks and the small ones of the same document that hold enough of their words."""
    m = overlap.document_pairs(_docs(spark, sf_dir), (256, 25), (128, 12), least=overlap.THRESHOLD)
    return m.select("source_id", "target_id", F.round("overlap_ratio", 6).alias("overlap_ratio"))


@query(
    "overlap_topn",
    MAPPING_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY o DESC, target_id) AS k FROM p)
SELECT source_id, target_id, round(o, 6) AS overlap_ratio, CAST(k AS INT) AS rank FROM r WHERE k <= 3""",
)
def overlap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = overlap.document_pairs(_docs(spark, sf_dir), (256, 25), (128, 12), most=3)
    return t.select("source_id", "target_id", F.round("overlap_ratio", 6).alias("overlap_ratio"), "rank")


@query("snippets", "SELECT doc_id, replace(text[1:80], chr(10), ' ') AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.snippet(F.col("text"), 80).alias("snippet"))


@query("encoded_titles", "SELECT p_partkey, 'https://en.wikipedia.org/wiki/' || url_encode(replace(p_name, ' ', '_')) AS url FROM part")
def encoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), text.percent_encode(F.col("p_name")))
    return _table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


@query(
    "keyword_occurrences",
    """WITH h AS (SELECT doc_id, text, list_filter(range(0, length(text)), lambda p: lower(text)[p + 1 : p + 4] = 'an a') AS ps FROM documents)
    SELECT doc_id, len(ps) AS n, md5(array_to_string(list_transform(ps, lambda p: text[greatest(p - 150, 0) + 1 : least(p + 150, length(text))]), '|')) AS contexts
    FROM h WHERE len(ps) > 0""",
)
def keyword_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of a phrase with what stands around them."""
    o = _docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("an a"))).select("doc_id", text.occurrences(F.col("text"), "an a").alias("o"))
    return o.select("doc_id", F.size("o").cast("bigint").alias("n"), F.md5(F.array_join("o", "|")).alias("contexts"))


CLAIMS = [("licence", ["Apache License", "Public License"]), ("insult", ["idiot", "Clown"]), ("never", ["qqqqq"])]


@query(
    "claim_evidence",
    f"""WITH c(claim, term) AS (VALUES {", ".join(f"('{c}', '{t}')" for c, ts in CLAIMS for t in ts)}),
    f AS (SELECT claim, term, doc_id, position(lower(term) IN lower(text)) AS p1, text FROM c, documents WHERE contains(lower(text), lower(term)))
    SELECT claim, term, doc_id, md5(text[greatest(p1 - 1 - 220, 0) + 1 : least(p1 - 1 + length(term) + 220, length(text))]) AS snippet FROM f""",
)
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame(CLAIMS, "claim string, evidence_terms array<string>")
    found = overlap.claim_evidence(_docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), claims)
    return found.select("claim", "term", F.col("chunk_id").alias("doc_id"), F.md5("snippet").alias("snippet"))


@query(
    "claim_status",
    f"""WITH c(claim, term) AS (VALUES {", ".join(f"('{c}', '{t}')" for c, ts in CLAIMS for t in ts)}),
    f AS (SELECT claim, term, doc_id FROM c, documents WHERE contains(lower(text), lower(term)))
    SELECT c.claim, count(DISTINCT f.term) AS n_terms_found, count(DISTINCT f.doc_id) AS n_chunks,
      CASE WHEN count(f.term) = 0 THEN 'likely not grounded' ELSE 'evidence found' END AS status
    FROM (SELECT DISTINCT claim FROM c) c LEFT JOIN f USING (claim) GROUP BY c.claim""",
)
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame(CLAIMS, "claim string, evidence_terms array<string>")
    return overlap.claim_status(_docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), claims)


# ---- questions, lookups and mappings made from labels

QUESTION_SQL = "q AS (SELECT doc_id AS id, [doc_id + 1, doc_id, doc_id + 5000000] AS ids, toxic, quality FROM labels)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("doc_id") + 1, F.col("doc_id"), F.col("doc_id") + 5_000_000)
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ids.alias("ids"), "toxic", "quality")


@query(
    "enrich_default",
    f"""WITH {QUESTION_SQL}, e AS (SELECT id, unnest(ids) AS c, unnest([1, 2, 3]) AS pos FROM q)
    SELECT id, md5(string_agg(coalesce(d.text, 'CHUNK NOT FOUND'), '|' ORDER BY pos)) AS texts FROM e LEFT JOIN documents d ON d.doc_id = e.c GROUP BY id""",
)
def enrich_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.looked_up(_questions(spark, sf_dir), "id", "ids", _docs(spark, sf_dir), "doc_id", "text", F.lit("CHUNK NOT FOUND"))
    return found.select("id", F.md5(F.array_join("values", "|")).alias("texts"))


@query(
    "lookup_drop_missing",
    f"""WITH {QUESTION_SQL}, e AS (SELECT id, unnest(ids) AS c, unnest([1, 2, 3]) AS pos FROM q)
    SELECT id, count(d.doc_id) AS n_found, string_agg(d.source, ',' ORDER BY pos) AS sources FROM e LEFT JOIN documents d ON d.doc_id = e.c GROUP BY id""",
)
def lookup_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.looked_up(_questions(spark, sf_dir), "id", "ids", _docs(spark, sf_dir), "doc_id", "source", drop=True)
    return found.select("id", F.size("values").cast("bigint").alias("n_found"), F.array_join("values", ",").alias("sources"))


@query(
    "missing_chunks",
    f"WITH {QUESTION_SQL}, e AS (SELECT id, unnest(ids) AS c FROM q) SELECT id, c AS missing_id FROM e WHERE c NOT IN (SELECT doc_id FROM documents)",
)
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.missing_ids(_questions(spark, sf_dir), "id", "ids", _docs(spark, sf_dir), "doc_id")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("doc_id"), F.col("doc_id") + 2))
    return _docs(spark, sf_dir).where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), ids.alias("mapped_relevant_chunk_ids"))


SKIP_SQL = f"""WITH {QUESTION_SQL}, r AS (SELECT q.*, d.doc_id AS known FROM q LEFT JOIN documents d ON d.doc_id = q.id AND d.doc_id % 5 <> 0),
s AS (SELECT *, CASE WHEN known IS NULL THEN 'not in mapping' WHEN id % 3 = 0 THEN 'no mapped chunks' END AS skip_reason FROM r)"""


@query("mapping_skip_report", SKIP_SQL + " SELECT coalesce(skip_reason, 'evaluated') AS outcome, count(*) AS n FROM s GROUP BY 1")
def mapping_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.with_skip_reason(_questions(spark, sf_dir), _mapping(spark, sf_dir))
    return rows.groupBy(F.coalesce("skip_reason", F.lit("evaluated")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mapping_overlay",
    SKIP_SQL
    + """ SELECT id, array_to_string(CASE WHEN known IS NULL THEN ids WHEN id % 3 = 0 THEN [] ELSE [id, id + 2] END, ',') AS relevant, array_to_string(ids, ',') AS original FROM s""",
)
def mapping_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlap.overlaid(_questions(spark, sf_dir).withColumnRenamed("ids", "relevant_chunk_ids"), _mapping(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("id", joined("relevant_chunk_ids").alias("relevant"), joined("original_relevant_chunk_ids").alias("original"))


@query(
    "unmapped_rows",
    MAPPING_SQL + ", m AS (SELECT DISTINCT source_id FROM p WHERE o >= 0.52) SELECT DISTINCT source_id AS id FROM p WHERE source_id NOT IN (SELECT source_id FROM m)",
)
def unmapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large chunks that no small chunk of their document stands for."""
    docs = _docs(spark, sf_dir)
    questions = chunking.fixed_chunks(docs, 256, 25).select(F.col("chunk_id").alias("id"), F.array("chunk_id").alias("relevant_chunk_ids"))
    mapped = overlap.mapping_of_questions(questions, overlap.document_pairs(docs, (256, 25), (128, 12), least=overlap.THRESHOLD))
    return mapped.where(F.size("mapped_relevant_chunk_ids") == 0).select("id")


@query("used_ids", f"WITH {QUESTION_SQL} SELECT DISTINCT unnest(ids) AS chunk_id FROM q")
def used_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select(F.explode("ids").alias("chunk_id")).distinct()


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resumed(_docs(spark, sf_dir).select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


WANTED = [3, 70, 123456789]


@query("id_lookup", f"SELECT w.doc_id, d.source, d.doc_id IS NOT NULL AS found FROM (SELECT unnest({WANTED})::BIGINT AS doc_id) w LEFT JOIN documents d USING (doc_id)")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in WANTED], "doc_id bigint")
    return lookup.spot_lookup(ids, _docs(spark, sf_dir).select("doc_id", "source"), "doc_id")


@query(
    "max_index_by_prefix",
    """WITH i AS (SELECT 'q_' || coalesce(lang, 'x') || '_' || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE printf('%03d', doc_id) END AS id FROM documents)
    SELECT 'q_en' AS prefix, coalesce(max(try_cast(string_split(id, '_')[-1] AS INT)), 0) AS last_index FROM i WHERE id LIKE 'q\\_en%' ESCAPE '\\'
    UNION ALL SELECT 'q_zz', coalesce(max(try_cast(string_split(id, '_')[-1] AS INT)), 0) FROM i WHERE id LIKE 'q\\_zz%' ESCAPE '\\'""",
)
def max_index_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = replies.question_id(F.coalesce("lang", F.lit("x")), F.col("doc_id"))
    odd = F.concat(F.lit("q_"), F.coalesce("lang", F.lit("x")), F.lit("_x"))
    ids = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 11 == 0, odd).otherwise(made).alias("id"))
    one = lambda p: lookup.last_index(ids, "id", p).select(F.lit(p).alias("prefix"), "last_index")
    return one("q_en").unionByName(one("q_zz"))


@query("multi_row_groups", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def multi_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.groups_of_at_least(_table(spark, sf_dir, "conversations"), "conv_id")


@query(
    "set_ops",
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'only_documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'bag', (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels)
    UNION ALL SELECT 'set', count(*) FROM (SELECT lang FROM documents UNION SELECT role FROM conversations)
    UNION ALL SELECT 'docs_per_category', count(*) FROM (SELECT DISTINCT lang, doc_id FROM documents)""",
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = _docs(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    ids = d.select("doc_id")
    c = _table(spark, sf_dir, "conversations")
    sets = {
        "both": ids.intersect(l),
        "only_documents": ids.subtract(l),
        "bag": ids.unionByName(l),
        "set": d.select("lang").union(c.select("role")).distinct(),
        "docs_per_category": d.select("lang", "doc_id").distinct(),
    }
    out = None
    for kind, rows in sets.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- samples


def _sql_order(seed: int, c: str) -> str:
    return f"md5('{seed}:' || CAST({c} AS VARCHAR)), {c}"


@query(
    "stratified_sample",
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_sql_order(42, "doc_id")}) AS k FROM documents),
    c AS (SELECT greatest(1, 70 // count(DISTINCT source)) AS quota FROM documents)
    SELECT doc_id, source FROM (SELECT r.* FROM r, c ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END, {_sql_order(42, "doc_id")} LIMIT 70)""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 documents with an even share of each source, as the evaluation set takes them."""
    return sampling.sample_stratified(_docs(spark, sf_dir).select("doc_id", "source"), 70, 42, "doc_id", "source")


@query(
    "stratified_sample_exclude",
    f"""WITH d AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_sql_order(7, "doc_id")}) AS k FROM d),
    c AS (SELECT greatest(1, 25 // count(DISTINCT source)) AS quota FROM d)
    SELECT doc_id, source FROM (SELECT r.* FROM r, c ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END, {_sql_order(7, "doc_id")} LIMIT 25)""",
)
def stratified_sample_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = lookup.resumed(_docs(spark, sf_dir).select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")
    return sampling.sample_stratified(rest, 25, 7, "doc_id", "source")


@query(
    "pair_sample",
    f"""WITH t AS (SELECT role AS first_role, conv_id, turn FROM conversations WHERE turn IS NOT NULL),
    r AS (SELECT conv_id, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY {_sql_order(42, "(conv_id * 1000 + turn)")}) AS k FROM t),
    p AS (SELECT conv_id % 4 AS category, conv_id, max(CASE WHEN k = 1 THEN id END) AS first_id, max(CASE WHEN k = 2 THEN id END) AS second_id FROM r WHERE k <= 2 GROUP BY ALL),
    g AS (SELECT * FROM p WHERE second_id IS NOT NULL),
    c AS (SELECT greatest(1, 25 // count(DISTINCT category)) AS quota FROM g),
    n AS (SELECT g.*, row_number() OVER (PARTITION BY category ORDER BY {_sql_order(42, "conv_id")}) AS k FROM g)
    SELECT category, conv_id, first_id, second_id FROM (SELECT n.* FROM n, c WHERE k <= quota ORDER BY {_sql_order(42, "conv_id")} LIMIT 25)""",
)
def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns each of conversations with at least two, an even share of each category."""
    t = _table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    rows = t.select((F.col("conv_id") % 4).alias("category"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return sampling.sample_pairs(rows, 25, 42, "id", "conv_id", "category")


@query(
    "sample_per_type",
    f"""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_sql_order(42, "event_id")}) AS k FROM events) WHERE k <= 15""",
)
def sample_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 results of each type for manual review."""
    return sampling.sample_per_group(_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 15, 42, "event_id")


@query(
    "dedupe_first_wins",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(lower({_sql_strip("coalesce(text, '')")})) ORDER BY source, doc_id) AS k FROM documents) WHERE k = 1""",
)
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text, the first by category."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.md5(F.lower(text.text_or_empty(F.col("text")))).alias("t"))
    return quality.first_wins(rows, F.col("t"), F.col("source"), F.col("doc_id")).select("doc_id", "source")


@query("category_cap", "SELECT page_id, host FROM (SELECT page_id, split_part(url, '/', 3) AS host, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS k FROM pages) WHERE k <= 3")
def category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three pages of each host."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return quality.capped(p, "host", 3, F.col("page_id"))


# ---- reports over a log of results (events) and graded documents

ERRORS = ["NONE", "HALLUCINATION", "OMISSION"]
RESULT_SQL = f"""e AS (SELECT event_id, event_type AS type, value AS recall_at_k, value * value AS ap, CASE WHEN event_id % 5 <> 0 THEN value / 7 END AS lat,
  event_id % 7 <> 0 AS judged, CASE WHEN event_id % 4 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS acc, CAST(1 + user_id % 5 AS DOUBLE) AS rel,
  CASE WHEN event_id % 13 <> 0 THEN CASE event_id % 3 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ERRORS))} END END AS err FROM events)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    error = F.when(i % 13 != 0, F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (i % 3 + 1).cast("int")))
    scores = F.struct(
        F.when(i % 4 != 0, (1 + i % 5).cast("double")).alias("accuracy"), (1 + F.col("user_id") % 5).cast("double").alias("relevance"), error.alias("error_type")
    )
    return _table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("event_type").alias("type"), F.col("value").alias("recall_at_k"), (F.col("value") * F.col("value")).alias("ap"),
        F.when(i % 5 != 0, F.col("value") / 7).alias("latency_seconds"), F.when(i % 7 != 0, scores).alias("judge_scores"),
    )


def _metrics_sql(judged_only: bool, zero: bool) -> str:
    lat = "coalesce(avg(coalesce(lat, 0)), 0)" if zero else "coalesce(avg(lat), 0)"
    of = lambda c: f"coalesce(CASE WHEN grouping(type) = 1 OR NOT {judged_only} THEN avg({c}) ELSE avg(CASE WHEN judged THEN {c} END) END, 0)"
    return f"""WITH {RESULT_SQL} SELECT type, count(*) AS n, count(*) FILTER (NOT judged) AS n_skipped, round({of("recall_at_k")}, 6) AS recall_at_k, round({of("ap")}, 6) AS ap,
    round(coalesce(avg(CASE WHEN judged THEN coalesce(acc, 0) END), 0), 6) AS accuracy, round(coalesce(avg(CASE WHEN judged THEN rel END), 0), 6) AS relevance,
    round({lat}, 6) AS avg_latency_seconds FROM e GROUP BY ROLLUP (type)"""


def _metrics(rows: DataFrame, **more) -> DataFrame:
    out = reports.metrics_by_type(rows, ["recall_at_k", "ap"], ["accuracy", "relevance"], **more)
    return out.withColumns({c: F.round(c, 6) for c in ("recall_at_k", "ap", "accuracy", "relevance", "avg_latency_seconds")})


@query("metrics_overall_by_type", _metrics_sql(False, False))
def metrics_overall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(_results(spark, sf_dir))


@query("metrics_judged_only", _metrics_sql(True, True))
def metrics_judged_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(_results(spark, sf_dir), judged_only=True, missing_latency_is_zero=True)


@query(
    "error_distribution",
    f"""WITH {RESULT_SQL}, c AS (SELECT coalesce(err, 'UNKNOWN') AS error_type, count(*) AS n FROM e WHERE judged GROUP BY 1)
    SELECT error_type, n, CAST(row_number() OVER (ORDER BY CASE error_type {" ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(replies.ERROR_TYPES))} ELSE 99 END, error_type) AS INT) AS place FROM c""",
)
def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_distribution(_results(spark, sf_dir), "UNKNOWN")


@query(
    "type_summary",
    f"WITH {RESULT_SQL} SELECT type, count(*) AS n, round(avg(recall_at_k), 6) AS recall_at_k, round(coalesce(avg(CASE WHEN judged THEN rel END), 0), 6) AS relevance FROM e GROUP BY type",
)
def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir).groupBy("type")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(reports.mean(F.col("recall_at_k")), 6).alias("recall_at_k"), F.round(reports.mean(F.col("judge_scores.relevance")), 6).alias("relevance"))


GRADED_SQL = """g AS (SELECT d.doc_id, source AS name, lang AS type, CAST(quality AS DOUBLE) AS mq, CAST(1 - toxic AS DOUBLE) AS mt,
  CAST(d.n_chars % 2 AS DOUBLE) AS jq, CAST((d.n_chars // 2) % 2 AS DOUBLE) AS jt, l.doc_id IS NOT NULL AS man, d.doc_id % 9 <> 0 AS jud FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
AGREEMENT_SQL = f"""WITH {GRADED_SQL}, x AS (SELECT name, type, 'accuracy' AS dim, mq AS m, jq AS j FROM g WHERE man AND jud UNION ALL SELECT name, type, 'relevance', mt, jt FROM g WHERE man AND jud),
a AS (SELECT name, type, dim, avg(m) AS manual, avg(j) AS judge, count(*) AS n FROM x GROUP BY GROUPING SETS ((name, dim), (name, type, dim)))"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    manual = F.struct(F.col("quality").cast("double").alias("accuracy"), (1 - F.col("toxic")).cast("double").alias("relevance"))
    judge = F.struct((F.col("n_chars") % 2).cast("double").alias("accuracy"), (F.floor(F.col("n_chars") / 2) % 2).cast("double").alias("relevance"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("type"),
        F.when(F.col("quality").isNotNull(), manual).alias("manual_scores"), F.when(F.col("doc_id") % 9 != 0, judge).alias("judge_scores"),
    )


@query("grader_agreement", AGREEMENT_SQL + " SELECT name, type, dim, round(manual, 6) AS manual, round(judge, 6) AS judge, round(judge - manual, 6) AS diff_judge_minus_manual, n FROM a")
def grader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports.grader_agreement(_graded(spark, sf_dir), ["accuracy", "relevance"])
    return a.withColumns({c: F.round(c, 6) for c in ("manual", "judge", "diff_judge_minus_manual")})


@query(
    "config_ranking",
    AGREEMENT_SQL
    + """, t AS (SELECT name, avg(manual) AS manual_avg, avg(judge) AS judge_avg FROM a WHERE type IS NULL GROUP BY name)
    SELECT name, round(manual_avg, 6) AS manual_avg, round(judge_avg, 6) AS judge_avg, CAST(row_number() OVER (ORDER BY round(manual_avg, 9) DESC, name) AS INT) AS rank FROM t""",
)
def config_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.config_ranking(reports.grader_agreement(_graded(spark, sf_dir), ["accuracy", "relevance"]))
    return r.select("name", F.round("manual_avg", 6).alias("manual_avg"), F.round("judge_avg", 6).alias("judge_avg"), "rank")


@query(
    "counts_by_type_category",
    """SELECT coalesce(role, 'unknown') AS type, conv_id % 3 AS category, count(*) AS n FROM conversations GROUP BY ALL""",
)
def counts_by_type_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").withColumn("categories", F.array("role"))
    first = F.coalesce(F.get("categories", F.lit(0)), F.lit("unknown"))
    return reports.counts_by(c, first.alias("type"), (F.col("conv_id") % 3).alias("category"))


# ---- prompts and replies


@query(
    "prompt_context",
    """SELECT conv_id, md5(string_agg('[' || k || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS context, count(*) AS n
    FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) GROUP BY conv_id""",
)
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as numbered passages."""
    item = F.struct("turn", F.col("role").alias("title"), "text")
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))
    return c.select("conv_id", F.md5(replies.prompt_context(F.col("hits"))).alias("context"), F.size("hits").cast("bigint").alias("n"))


@query(
    "parse_judge_json",
    """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN TRY_CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 IN (0, 1) AS parsed FROM events""",
)
def parse_judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are bare or fenced JSON, cut short, or a list."""
    p, i = F.col("props"), F.col("event_id") % 4
    reply = (
        F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(F.concat(F.lit("["), p, F.lit("]")))
    )
    e = _table(spark, sf_dir, "events").select("event_id", replies.json_object(reply, "k bigint").alias("s"))
    return e.select("event_id", "s.k", F.col("s").isNotNull().alias("parsed"))


ENTRIES = ["3", "4,5", " 2.5 ", "0", "6", "x", "5"]


@query(
    "score_parse",
    f"""WITH v(entry) AS (SELECT unnest({ENTRIES})), n AS (SELECT entry, TRY_CAST(replace(trim(entry), ',', '.') AS DOUBLE) AS x FROM v)
    SELECT entry, CASE WHEN x BETWEEN 1 AND 5 THEN x END AS score, t.event_type, t.n,
      CASE t.c WHEN 0 THEN 'NONE' WHEN 1 THEN 'HALLUCINATION' WHEN 2 THEN 'MISATTRIBUTION' WHEN 3 THEN 'OMISSION' WHEN 4 THEN 'RETRIEVAL_FAIL' END AS error_name
    FROM n, (SELECT event_type, count(*) AS n, CAST(count(*) % 7 AS INT) AS c FROM events GROUP BY event_type) t""",
)
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed scores and error codes of a reviewer."""
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    types = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    code = replies.error_name((F.col("n") % 7).cast("int"))
    return types.crossJoin(F.broadcast(entries)).select("entry", replies.parse_score(F.col("entry")).alias("score"), "event_type", "n", code.alias("error_name"))


# ---- files, stores and models

#: The stand-in embedder: +1 or -1 for each word at one of 64 places, brought to length 1.
EMBED_SQL = """{id} AS (SELECT id, w, CAST(('0x' || substr(md5(w), 1, 16)) AS UBIGINT) AS h FROM
    (SELECT {key} AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\\s+'), lambda x: x <> '')) AS w FROM {table})),
{id}_v AS (SELECT id, h % 64 AS at, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END) AS x FROM {id} GROUP BY ALL),
{id}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {id}_v GROUP BY id),
{id}_e AS (SELECT t.{key} AS id, string_agg(CAST(CAST(round(coalesce(x / nullif(n, 0), 0) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY p.at) AS vec
  FROM {table} t CROSS JOIN (SELECT unnest(range(0, 64)) AS at) p LEFT JOIN {id}_v v ON v.id = t.{key} AND v.at = p.at LEFT JOIN {id}_n n ON n.id = t.{key} GROUP BY t.{key})"""


def _vector_text(c: str):
    return F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string")), ",")


@query("embed_queries", "WITH " + EMBED_SQL.format(id="q", key="item_id", text="text", table="benchmark") + " SELECT id AS item_id, md5(vec) AS vec FROM q_e")
def embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each query, in batches through a model client, beside its own row."""
    ship(spark)
    embed = models.embedder(models.hashed_client())
    return _table(spark, sf_dir, "benchmark").withColumn("v", embed(F.col("text"))).select("item_id", F.md5(_vector_text("v")).alias("vec"))


@query(
    "collection_roundtrip",
    "WITH "
    + EMBED_SQL.format(id="p", key="p_partkey", text="p_name", table="part")
    + """ SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS document, coalesce(p_brand, '') AS title, 0 AS chunk_index, '' AS url, md5(vec) AS vec FROM part JOIN p_e ON p_e.id = p_partkey""",
)
def collection_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts embedded, stored as a collection with its default values, and read back."""
    ship(spark)
    embed = models.embedder(models.hashed_client())
    nothing = [F.lit(None).cast("string").alias(c) for c in ("url", "source_category")]
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("title"),
        *nothing, F.lit(None).cast("int").alias("chunk_index"), F.lit(3).alias("token_count"),
    )
    path = shared_folder(spark, "collection")
    json_tables.write_collection(rows.withColumn("embedding", embed(F.col("text"))), path)
    c = json_tables.read_collection(spark, path)
    return c.select("id", "document", "metadata.title", "metadata.chunk_index", "metadata.url", F.md5(_vector_text("embedding")).alias("vec"))


@query("embedding_run", "SELECT 'labels' AS input_path, 'hashed' AS embedding_model, 64 AS embedding_dimensions_actual, 100 AS batch_size, CAST(count(*) AS INT) AS total_chunks FROM part")
def embedding_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored run of the embedder says of itself."""
    ship(spark)
    embed = models.embedder(models.hashed_client())
    path = shared_folder(spark, "embedding-run")
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")).withColumn("embedding", embed(F.col("text")))
    json_tables.write_embedding_run(rows, path, "labels", "hashed", 100, 0.0)
    return spark.read.parquet(f"{path}/run").select("input_path", "embedding_model", "embedding_dimensions_actual", "batch_size", "total_chunks")


LABEL_ROW = "doc_id bigint, quality int, toxic int"


@query(
    "json_scans",
    " UNION ALL ".join(
        f"SELECT '{k}' AS form, count(*) AS n, sum(doc_id) AS ids, sum(quality) AS quality, sum(toxic) AS toxic FROM labels" for k in ("array", "strict", "lines", "wrapped", "bare", "keyed", "normalized")
    ),
)
def json_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels written in all JSON forms and read back by each of the scans."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    top = shared_folder(spark, "json")
    json_tables.write_json_array(labels, f"{top}/array")
    json_tables.write_json(labels, f"{top}/lines")
    json_tables.write_wrapped(labels, f"{top}/wrapped")
    json_tables.write_keyed(labels, f"{top}/keyed", "doc_id")
    forms = {
        "array": json_tables.read_json(spark, f"{top}/array", LABEL_ROW),
        "strict": json_tables.read_json(spark, f"{top}/array", LABEL_ROW, strict=True),
        "lines": spark.read.schema(LABEL_ROW).json(f"{top}/lines"),
        "wrapped": json_tables.read_wrapped(spark, f"{top}/wrapped", LABEL_ROW),
        "bare": json_tables.read_wrapped(spark, f"{top}/array", LABEL_ROW),
        "keyed": json_tables.read_keyed(spark, f"{top}/keyed", LABEL_ROW),
    }
    raw = labels.select(F.lit("").alias("chunk_id"), F.col("doc_id").alias("id"), F.lit("x").alias("text"), F.struct("doc_id", F.col("quality").alias("title"), F.col("toxic").alias("url")).alias("metadata"))
    n = json_tables.normalized_chunks(raw)
    forms["normalized"] = n.select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.col("metadata.title").alias("quality"), F.col("metadata.url").alias("toxic"))
    out = None
    for form, rows in forms.items():
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
        one = one.select(F.lit(form).alias("form"), "n", "ids", "quality", "toxic")
        out = one if out is None else out.unionByName(one)
    return out


@query("id_texts", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, md5(text) AS text FROM documents")
def id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))
    return json_tables.id_to_text(chunks).select("chunk_id", F.md5("text").alias("text"))


@query(
    "validation_report",
    rf"""WITH d AS (SELECT doc_id % 17 = 0 AS a, {_sql_strip("coalesce(text, '')")} = '' OR doc_id % 19 = 0 AS b FROM documents)
    SELECT CASE WHEN a THEN 'missing chunk_id' WHEN b THEN 'missing text' ELSE 'valid' END AS reason, count(*) AS n FROM d GROUP BY 1""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what is wrong with them; the good ones pass the check that stops a run."""
    chunks = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 17 != 0, F.col("doc_id").cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 19 == 0, " ").otherwise(F.col("text")).alias("text"))
    bad = quality.violations(chunks).select("reason")
    blank = lambda c: F.length(text.text_or_empty(F.col(c))) == 0
    good = quality.validated(chunks.where(~(blank("chunk_id") | blank("text")))).select(F.when(F.length("text") > 0, "valid").alias("reason"))
    return reports.counts_by(bad.unionByName(good), "reason")


PAGES = {"Rome": ["Rome wasn't built in a day.", "Gaul", None], "Coins": ["A coin / with art"]}


def _stub_reply(params: dict) -> dict:
    """A tiny encyclopedia in two categories: two pages a reply, one without text."""
    if params.get("list"):
        name = params["cmtitle"].removeprefix("Category:")
        start, titles = int(params.get("cmcontinue", 0)), [f"{name} {i}/x" for i in range(len(PAGES[name]))]
        more = {"continue": {"cmcontinue": start + 2}} if start + 2 < len(titles) else {}
        return {"query": {"categorymembers": [{"title": t} for t in titles[start : start + 2]]}, **more}
    name, i = params["titles"].removesuffix("/x").rsplit(" ", 1)
    text_ = PAGES[name][int(i)]
    return {"query": {"pages": {"-1" if text_ is None else f"{name}{i}": {"title": params["titles"], "extract": text_}}}}


@query(
    "article_scan",
    """SELECT * FROM (VALUES ('Rome0', 'Rome 0/x', 'Rome wasn''t built in a day.', 'https://en.wikipedia.org/wiki/Rome_0/x', 27, 'Rome'),
    ('Rome1', 'Rome 1/x', 'Gaul', 'https://en.wikipedia.org/wiki/Rome_1/x', 4, 'Rome'),
    ('Coins0', 'Coins 0/x', 'A coin / with art', 'https://en.wikipedia.org/wiki/Coins_0/x', 17, 'Coins')) v(id, title, text, url, text_length, source_category)""",
)
def article_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by category, page by page, from a server's stand-in that fails once."""
    from granary.sources import wiki

    ship(spark)
    spark.dataSource.register(wiki.stub_source(_stub_reply))
    return spark.read.format("granary_stub_articles").option("categories", "|".join(PAGES)).option("pause", "0").load()


@query("bpe_roundtrip", "SELECT doc_id, true AS same, true AS counted FROM documents")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through a public vocabulary and back."""
    import public_tokenizers

    ship(spark)
    encode, decode_all = tokens.bpe(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = _docs(spark, sf_dir).select("doc_id", "text", encode(F.col("text")).alias("ids"))
    back = rows.withColumn("back", decode_all(F.array("ids")))
    counted = F.size("ids").between(F.sign(F.octet_length(F.coalesce("text", F.lit("")))), F.octet_length(F.coalesce("text", F.lit(""))))
    return back.select("doc_id", (F.col("back")[0] == F.coalesce("text", F.lit(""))).alias("same"), counted.alias("counted"))


@query("overlap_normal", f"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS normal FROM documents")
def overlap_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.normalize_words(F.col("text"))).alias("normal"))


@query(
    "string_basics",
    rf"""SELECT doc_id, length({_sql_strip("coalesce(text, '')")}) AS n, md5(lower({_sql_strip("coalesce(text, '')")})) AS low, starts_with(coalesce(source, ''), 'src1') AS pre,
    len(string_split(coalesce(text, ''), '.')) AS sentences FROM documents""",
)
def string_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.text_or_empty(F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id", F.char_length(t).cast("bigint").alias("n"), F.md5(F.lower(t)).alias("low"), F.startswith(F.coalesce("source", F.lit("")), F.lit("src1")).alias("pre"),
        F.size(F.split(F.coalesce("text", F.lit("")), r"\.", -1)).cast("bigint").alias("sentences"),
    )


# ---- prompts, judges and question writers

TURNS_SQL = "t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)"


@query(
    "judge_context",
    f"""WITH {TURNS_SQL} SELECT conv_id, md5(string_agg('[' || k || '] ' || role || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k)) AS context,
    md5(string_agg('- ' || role, chr(10) ORDER BY k)) AS facts FROM t GROUP BY conv_id""",
)
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages and facts that a judge is shown."""
    item = F.struct("turn", F.col("role").alias("title"), "text")
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))
    facts = replies.fact_list(F.transform("hits", lambda h: h["title"]))
    return c.select("conv_id", F.md5(replies.judge_context(F.col("hits"))).alias("context"), F.md5(facts).alias("facts"))


@query(
    "question_prompts",
    """SELECT item_id, md5(CASE item_id % 3 WHEN 0 THEN 'Write one question that this passage answers.' WHEN 1 THEN 'Write one question that needs both passages.'
      ELSE 'Write one question that asks for reasoning over these passages.' END || chr(10) || chr(10) || text || chr(10) || chr(10) || text || chr(10) || chr(10) ||
      'Reply with one JSON object with the keys question, reference_answer and key_facts (a list).') AS prompt FROM benchmark""",
)
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [replies.question_prompt(k, F.array("text", "text")) for k in ("single_chunk", "multi_chunk", "complex")]
    return _table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.element_at(F.array(*kinds), (F.col("item_id") % 3 + 1).cast("int"))).alias("prompt"))


@query(
    "question_replies",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS question, CASE WHEN event_id % 4 < 2 THEN coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0.0) END AS accuracy FROM events""",
)
def question_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies read as they are, or without code fences; a grade that is left out counts as 0 where there is a reply at all."""
    i = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("question"), F.when(i % 3 > 0, F.col("value")).alias("accuracy")))
    reply = F.when(i % 4 == 0, body).when(i % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 4 == 2, F.lit("no JSON")).otherwise(F.concat(body, F.lit("]")))
    s = replies.json_object_raw_first(reply, "question string, accuracy double")
    return _table(spark, sf_dir, "events").withColumn("s", s).select("event_id", "s.question", replies.score_or(F.col("s"), "accuracy").alias("accuracy"))


@query(
    "judge_retries",
    "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_type END AS error_type, CASE WHEN event_id % 5 < 3 THEN 1 + event_id % 5 END AS tries FROM events",
)
def judge_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge whose replies can be read after some tries, three at most."""

    def opened():
        seen: dict[str, int] = {}

        def ask(prompt: str) -> str:
            kind, bad = prompt.rsplit(" ", 1)
            seen[prompt] = n = seen.get(prompt, 0) + 1
            if n <= int(bad):
                if n == 3:
                    seen.pop(prompt)  # asked in vain; the next row with this prompt begins anew
                return "no verdict"
            seen.pop(prompt)
            return f'```json\n{{"error_type": "{kind}", "tries": {n}}}\n```'

        return ask

    ship(spark)
    prompt = F.concat_ws(" ", "event_type", (F.col("event_id") % 5).cast("string"))
    judge = models.retried_judge(opened, pause=0.0)
    e = _table(spark, sf_dir, "events").withColumn("s", replies.json_object(judge(prompt), "error_type string, tries bigint"))
    return e.select("event_id", "s.error_type", "s.tries")


def _stub_writer(prompt):
    """A model's reply: the digest of what it was asked; every prompt whose digest starts with 0 gets no answer."""
    digest = F.md5(prompt)
    good = F.to_json(F.struct(digest.alias("question"), F.lit("r").alias("reference_answer"), F.array(F.lit("f")).alias("key_facts")))
    return F.when(~F.startswith(digest, F.lit("0")), good).otherwise(F.lit("none"))


TAIL_SQL = "chr(10) || chr(10) || 'Reply with one JSON object with the keys question, reference_answer and key_facts (a list).'"


@query(
    "question_writers",
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS cid, coalesce(text, '') AS text, source, row_number() OVER (PARTITION BY source ORDER BY {_sql_order(5, "doc_id")}) AS k FROM documents),
    s AS (SELECT cid, text, source, row_number() OVER (ORDER BY cid) AS n FROM d WHERE k <= 2),
    p AS (SELECT cid, n, source, md5('Write one question that this passage answers.' || chr(10) || chr(10) || text || {TAIL_SQL}) AS q1,
            md5('Write one question that asks for reasoning over these passages.' || chr(10) || chr(10) || text || {TAIL_SQL}) AS q2 FROM s)
    SELECT printf('q_single_%03d', n) AS id, 'single_chunk' AS type, q1 AS question, cid AS relevant, source AS category FROM p WHERE q1 NOT LIKE '0%'
    UNION ALL SELECT printf('q_complex_%03d', n + 25), 'complex', q2, cid, source FROM p WHERE q2 NOT LIKE '0%'
    UNION ALL SELECT printf('q_multi_%03d', row_number() OVER (ORDER BY a.cid)), 'multi_chunk', md5('Write one question that needs both passages.' || chr(10) || chr(10) || a.text || chr(10) || chr(10) || b.text || {TAIL_SQL}),
      a.cid || ',' || b.cid, a.source || ',' || b.source FROM d a JOIN d b ON a.source = b.source AND a.k = 1 AND b.k = 2
      QUALIFY md5('Write one question that needs both passages.' || chr(10) || chr(10) || a.text || chr(10) || chr(10) || b.text || {TAIL_SQL}) NOT LIKE '0%' OR false""",
)
def question_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of three kinds over two documents of each source."""
    from granary.plans import ingest

    chunks = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("title"), F.col("source").alias("source_category"))
    few = sampling.sample_per_group(chunks, "source_category", 2, 5, "chunk_id")
    order = sampling.shuffled(5, "chunk_id")
    ends = few.groupBy("source_category").agg(F.sort_array(F.collect_list(F.struct(order[0].alias("o"), "chunk_id"))).alias("l")).where(F.col("source_category").isNotNull() & (F.size("l") == 2))
    pairs = ends.select(F.col("l")[0]["chunk_id"].alias("first_id"), F.col("l")[1]["chunk_id"].alias("second_id"))
    made = [ingest.single_questions(few, _stub_writer), ingest.complex_questions(few, _stub_writer, after=25), ingest.multi_questions(pairs, few, _stub_writer)]
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    rows = [m.select("id", "type", "question", joined("relevant_chunk_ids").alias("relevant"), F.when(F.col("source_categories")[0].isNotNull(), joined("source_categories")).alias("category")) for m in made]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- manual review and runs


@query(
    "pair_sample_minimum",
    f"""WITH r AS (SELECT conv_id, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY {_sql_order(42, "(conv_id * 1000 + turn)")}) AS k FROM conversations WHERE turn IS NOT NULL),
    p AS (SELECT conv_id % 4 AS category, conv_id, max(CASE WHEN k = 1 THEN id END) AS first_id, max(CASE WHEN k = 2 THEN id END) AS second_id FROM r WHERE k <= 2 GROUP BY ALL),
    g AS (SELECT * FROM p WHERE second_id IS NOT NULL),
    c AS (SELECT 2 + greatest(0, 25 - 2 * count(DISTINCT category)) // count(DISTINCT category) AS quota FROM g),
    n AS (SELECT g.*, row_number() OVER (PARTITION BY category ORDER BY {_sql_order(42, "conv_id")}) AS k FROM g)
    SELECT category, conv_id, first_id, second_id FROM (SELECT n.* FROM n, c WHERE k <= quota ORDER BY {_sql_order(42, "conv_id")} LIMIT 25)""",
)
def pair_sample_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with at least two of each category."""
    t = _table(spark, sf_dir, "conversations").where("turn IS NOT NULL")
    rows = t.select((F.col("conv_id") % 4).alias("category"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return sampling.sample_pairs(rows, 25, 42, "id", "conv_id", "category", minimum=2)


@query(
    "manual_rows",
    f"""WITH {RESULT_SQL} SELECT event_id AS id, type, recall_at_k, CAST(NULL AS DOUBLE) AS hit, CAST(quality + 1 AS DOUBLE) AS accuracy, CAST(5 - toxic AS DOUBLE) AS relevance,
    CASE WHEN toxic > 0 THEN 'HALLUCINATION' ELSE 'NONE' END AS error_type, 0 AS n_retrieved, judged FROM e JOIN labels ON doc_id = event_id""",
)
def manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside what a reviewer gave them; metrics that the run lacks are null."""
    l = _table(spark, sf_dir, "labels")  # noqa: E741
    grades = l.select(
        F.col("doc_id").alias("id"), (F.col("quality") + 1).cast("double").alias("accuracy"), (5 - F.col("toxic")).cast("double").alias("relevance"),
        F.when(F.col("toxic") > 0, "HALLUCINATION").otherwise("NONE").alias("error_type"), F.lit("").alias("notes"),
    )
    m = reports.manual_rows(_results(spark, sf_dir), grades, ["accuracy", "relevance"])
    return m.select("id", "type", "recall_at_k", "hit", "manual_scores.accuracy", "manual_scores.relevance", "manual_scores.error_type", F.size("retrieved_chunk_ids").alias("n_retrieved"), F.col("judge_scores").isNotNull().alias("judged"))


@query(
    "manual_summary",
    f"""WITH {GRADED_SQL} SELECT 'mean' AS what, type, count(*) AS n, round(coalesce(avg(mq), 0), 6) AS accuracy, round(coalesce(avg(mt), 0), 6) AS relevance FROM g WHERE man GROUP BY ROLLUP (type)
    UNION ALL SELECT 'error', CASE WHEN mt > 0 THEN 'NONE' ELSE 'HALLUCINATION' END, count(*), NULL, NULL FROM g WHERE man GROUP BY 2""",
)
def manual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the manual grades and counts of their error types, without a judge."""
    g = _graded(spark, sf_dir)
    error = F.when(F.col("manual_scores.relevance") > 0, "NONE").otherwise("HALLUCINATION")
    g = g.withColumn("manual_scores", F.when(F.col("manual_scores").isNotNull(), F.col("manual_scores").withField("error_type", error)))
    means, errors = reports.manual_summary(g, ["accuracy", "relevance"])
    rounded = [F.round(c, 6).alias(c) for c in ("accuracy", "relevance")]
    none = [F.lit(None).cast("double").alias(c) for c in ("accuracy", "relevance")]
    return means.select(F.lit("mean").alias("what"), "type", "n", *rounded).unionByName(errors.select(F.lit("error").alias("what"), F.col("error_type").alias("type"), "n", *none))


@query(
    "runs_skipping_missing",
    f"""WITH {RESULT_SQL} SELECT 'all' AS experiment, count(*) AS n, round(avg(recall_at_k), 6) AS recall_at_k FROM e UNION ALL SELECT 'click', count(*), round(avg(recall_at_k), 6) FROM e WHERE type = 'click'
    UNION ALL SELECT 'gone', 0, NULL""",
)
def runs_skipping_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of several experiments in one report, of which one has no file."""
    top, rows = shared_folder(spark, "runs"), _results(spark, sf_dir).select("id", "type", "recall_at_k")
    json_tables.write_table(rows, f"{top}/all")
    json_tables.write_table(rows.where("type = 'click'"), f"{top}/click")
    found, missing = reports.run_paths(spark.read.parquet, {k: f"{top}/{k}" for k in ("all", "click", "gone")})
    out = found.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_at_k"), 6).alias("recall_at_k"))
    return out.unionByName(spark.createDataFrame([(m, 0, None) for m in missing], "experiment string, n bigint, recall_at_k double"))
