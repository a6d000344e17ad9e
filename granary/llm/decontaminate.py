"""Benchmark decontamination with DataFrame operations only.

Every benchmark item becomes windows of ``size`` consecutive normalised words (an item of fewer words is one window). The
windows are keyed by a 64-bit hash built by doubling: hashes of 1, 2, 4 and 8 words are made of two hashes of half the
length. Document words are hashed the same way in one pass; a broadcast hash join finds candidate positions; the words
themselves are then compared. Only verified hits, and one marker row a document, are shuffled.

The benchmark windows are broadcast only up to ``MAX_BROADCAST`` bytes, which are summed first; beyond, (document, position, hash)
rows meet them in a shuffle, salted since one window may stand in a third of the documents, and the words are compared after a
join back.

Edge cases: null, empty or wordless texts have no words, no hits and the digest of the empty string; null item ids count as
the empty string; repeated rows give repeated results; an item id with several rows is one item; an empty benchmark hits
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ascii_lower, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 8
MAX_BROADCAST = 48 << 20  # bytes of windows, with what arrays of them take
SALTS = 16
MARK = -4611686018427387904  # stands for "the document itself" among the hashes; verified apart from them


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _later(hashes: str, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(hashes, by + 1, F.greatest(F.size(hashes) - by, F.lit(0)))


def _hashed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (with ``_w``) plus ``_h{n}`` for each wanted length: the hash of the n words from each position on.

    Positions with fewer than n words left hold hashes of other things, which the comparison of words refuses.
    """
    both = lambda a, b: F.xxhash64(a, b)
    rows = rows.withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    have = 1
    while have * 2 <= max(lengths, default=1):
        rows = rows.withColumn(f"_h{have * 2}", F.zip_with(f"_h{have}", _later(f"_h{have}", have), both))
        have *= 2
    for n in lengths:
        parts = [b for b in (1 << k for k in reversed(range(n.bit_length()))) if n & b]
        at = parts[0]
        name = f"_h{parts[0]}"
        for b in parts[1:]:
            rows = rows.withColumn(f"_h{at + b}", F.zip_with(name, _later(f"_h{b}", at), both))
            at += b
            name = f"_h{at}"
    return rows


def benchmark_windows(bench: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``_n, _win, _items``: each distinct window with its length and the ids of the items that have it."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"), words_of(F.col(text_col)).alias("_w"))
    items = items.where(F.size("_w") > 0).withColumn("_n", F.least(F.size("_w"), F.lit(size)))
    each = items.select("_item", "_w", "_n", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1)).alias("_at"))
    return (
        each.select("_item", "_n", F.slice("_w", F.col("_at"), F.col("_n")).alias("_win"))
        .groupBy("_n", "_win")
        .agg(F.collect_set("_item").alias("_items"))
    )


def hits(
    docs: DataFrame, bench: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """One row per document: ``_id, _key, _words`` (their number), ``_spans`` (merged hit positions and ends), ``_items``.

    ``_key`` is a digest of the text, so that rows which share an id are kept apart.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.write(benchmark_windows(bench, size))
    size_of = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 16)
    counts = windows.groupBy("_n").agg(F.sum(size_of("_win") + size_of("_items") + 64).alias("b")).collect()  # at most ``size`` rows
    lengths = sorted(r._n for r in counts)
    few = sum(r.b for r in counts) <= max_broadcast
    hashed = None
    for n in lengths:
        one = _hashed(windows.where(F.col("_n") == n).withColumnRenamed("_win", "_w"), [n])
        one = one.select(F.element_at(f"_h{n}", 1).alias("_h"), "_n", F.col("_w").alias("_win"), "_items")
        hashed = one if hashed is None else hashed.unionByName(one)

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_key"), words_of(F.col(text_col)).alias("_w"))
    if not lengths:
        none = F.array().cast("array<string>").alias("_items"), F.array().cast("array<struct<s:int,e:int>>").alias("_spans")
        return base.select("_id", "_key", F.size("_w").alias("_words"), *none)
    rows = _hashed(base, lengths)
    every = F.concat(*[F.col(f"_h{n}") for n in lengths])
    number = F.size("_w")
    at = F.when(F.col("_words") > 0, F.col("_p") % F.when(F.col("_words") > 0, F.col("_words"))).otherwise(0)
    true = (F.col("_n") > 0) & (F.slice("_w", F.col("_at") + 1, F.col("_n")) == F.col("_win"))
    span = F.struct(F.col("_at").alias("s"), (F.col("_at") + F.col("_n")).alias("e"))
    if few:
        # One row a document stands among its hashes for the document itself, so that documents without a hit come out too.
        mark = docs.sparkSession.range(1).select(
            F.lit(MARK).cast("bigint").alias("_h"), F.lit(0).alias("_n"), F.array().cast("array<string>").alias("_win"), F.array().cast("array<string>").alias("_items")
        )
        every = F.concat(every, F.array(F.lit(MARK).cast("bigint")))
        found = rows.select("_id", "_key", "_w", number.alias("_words"), F.posexplode(every).alias("_p", "_h"))
        found = found.join(F.broadcast(hashed.unionByName(mark)), "_h")
        whole = F.col("_p") >= F.col("_words") * len(lengths)
        found = found.withColumns({"_whole": whole, "_at": at}).where(F.when(F.col("_whole"), F.col("_n") == 0).otherwise(true))
        per_doc = found.groupBy("_id", "_key", "_words").agg(
            F.count_if("_whole").alias("_times"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
            F.sort_array(F.collect_set(F.when(~F.col("_whole"), span))).alias("_found"),
        )
        per_doc = per_doc.select(F.inline(F.expr("array_repeat(struct(_id, _key, _words, _items, _found), int(_times))")))
    else:
        salt = F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int")
        known = hashed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.select("_id", "_key", salt.alias("_s"), number.alias("_words"), F.posexplode(every).alias("_p", "_h"))
        found = found.join(known, ["_h", "_s"]).withColumn("_at", at).drop("_h", "_s", "_p", "_words")
        again = base.dropDuplicates(["_id", "_key"]).select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "_w")
        hit = found.join(again, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2"))).drop("_id2", "_key2").where(true)
        hit = hit.groupBy(F.col("_id").alias("_id2"), F.col("_key").alias("_key2")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_i"), F.sort_array(F.collect_set(span)).alias("_f")
        )
        per_doc = base.select("_id", "_key", number.alias("_words")).join(hit, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left")
        none = F.array().cast("array<string>"), F.array().cast("array<struct<s:int,e:int>>")
        per_doc = per_doc.select("_id", "_key", "_words", F.coalesce("_i", none[0]).alias("_items"), F.coalesce("_f", none[1]).alias("_found"))
    merged = F.aggregate(
        "_found",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return per_doc.withColumn("_spans", merged).drop("_found")


def report(docs: DataFrame, bench: DataFrame, size: int = SIZE, min_items: int = 2, **more) -> DataFrame:
    """The hit figures of every document."""
    covered = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return hits(docs, bench, size, **more).select(
        F.col("_id").alias("doc_id"),
        F.col("_words").cast("bigint").alias("n_words"),
        covered.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_items") >= min_items).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, bench: DataFrame, mode: str = "documents", size: int = SIZE, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated rows ('documents'), or with the hit words cut out of their texts ('spans').

    A row is contaminated when windows of at least ``min_items`` items occur in it. A cut takes the words and what separates
    them inside a span. The columns are those of ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "decontaminated")
    bad = hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bench, size)
    bad = bad.where(F.size("_items") >= min_items).select("_id", "_key", "_spans").dropDuplicates(["_id", "_key"])
    bad = scratch.write(bad)
    same = docs[id_col].eqNullSafe(bad["_id"]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == bad["_key"])
    if mode == "documents":
        return docs.join(bad, same, "left_anti")
    words, between = F.array_remove(F.split(docs[text_col], SEPARATORS), ""), F.split(docs[text_col], WORDS)
    inside = lambda i: F.exists(bad["_spans"], lambda s: (s["s"] <= i) & (i < s["e"]))
    joined = lambda i: F.exists(bad["_spans"], lambda s: (s["s"] < i) & (i < s["e"]))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(words)),
        lambda i: F.concat(
            F.when(joined(i), "").otherwise(F.coalesce(F.get(between, i), F.lit(""))),
            F.when(inside(i), "").otherwise(F.coalesce(F.get(words, i), F.lit(""))),
        ),
    )
    cut = F.when(bad["_id"].isNotNull() | bad["_key"].isNotNull(), F.array_join(kept, "")).otherwise(docs[text_col])
    return docs.join(bad, same, "left").select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS ix, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[ix : ix + n - 1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM win),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dp AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS ix, w FROM d, lens WHERE len(w) >= n),
dw AS (SELECT rid, n, ix, array_to_string(w[ix : ix + n - 1], ' ') AS s FROM dp),
hit AS (SELECT rid, dw.n, ix, item FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(ix, ix + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
