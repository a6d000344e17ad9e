"""Near-duplicate components by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the 64-bit hashes of its distinct word shingles. One permutation places each hash among 2^20 slots;
a second one, read from every slot on and so shifted circularly by one more place for each coordinate, gives all signature
coordinates: coordinate k is the least value at (slot + k). Coordinates are grouped into ``BANDS`` bands of ``ROWS``; at a
similarity of 0.8 a pair misses every band with probability 7e-6.

Only the components of the graph of verified links are wanted, so pairs inside one component need no check. Copies of one
word sequence are one node. Rounds of few pairs come first: each node with the smallest node of all its buckets, then, in
buckets that still span several components, with a pivot of the bucket. Buckets that still span several components after
these rounds have every remaining pair across their components looked at in blocks, by bitmaps whose common bits bound the
common shingles from above; pairs within the bound are verified, so that no link between different texts is lost to the order
of the rounds. Every link rests on the full sets of both texts. Texts travel only for documents that share a
bucket; the pairs of one pivot are spread over ``SALTS`` tasks, to each of which its text goes once.

Edge cases: null, empty and wordless texts have an empty set and no links; texts of fewer words than a shingle are one
shingle; a null id ranks last, and a component of null ids alone has a null id; rows that repeat an id are linked by their
texts and annotated alike; texts of any length are hashed whole.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ship, table
from granary.llm.graph import contract

SLOTS = 1 << 20
ROWS, BANDS = 5, 30
SALTS = 16
PIVOTS = 2
BLOCK = 512
STREAM = 1024
CACHE = 500_000


@functools.lru_cache(maxsize=2)
def second_permutation(coordinates: int) -> np.ndarray:
    """The second permutation, continued circularly, as one window of all coordinates for each slot."""
    p = np.random.Generator(np.random.PCG64(20)).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((p, p[: coordinates - 1])), coordinates)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the first permutation, before slots are taken)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Word sequences and shingle sets of texts; remembers the hashes of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def words(self, text: bytes | str | None) -> list[bytes]:
        """Words in UTF-8. Lower-casing and splitting bytes concern ASCII letters and white space alone, which is what is wanted."""
        if not text:
            return []
        return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = _mixed(out) + h[k : len(h) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15)
        out = np.sort(out)
        return out[np.concatenate(([True], out[1:] != out[:-1]))]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        windows = second_permutation(ROWS * BANDS)
        slots = (_mixed(shingles) >> np.uint64(44)).astype(np.int64)
        out = np.full(ROWS * BANDS, SLOTS, dtype=np.uint32)
        for i in range(0, len(slots), 4096):
            np.minimum(out, windows[slots[i : i + 4096]].min(axis=0), out=out)
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if len(a) * 100 < percent * len(b) or len(b) * 100 < percent * len(a) or not len(a):
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _profiled(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, raw, seq, n, bands) of each row: digest of the text and of its word sequence, set size, band keys."""

    def run(batches):
        s = Shingler(size)
        for batch in batches:
            seqs, sizes, bands = [], [], []
            for text in batch.column(2).to_pylist():
                words = s.words(text)
                shingles = s.shingles(words)
                sizes.append(len(shingles))
                seqs.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                bands.append(s.bands(shingles) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seqs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "raw", "seq", "n", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("raw"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, raw binary, seq binary, n bigint, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Pairs are grouped by b, whose text is sent once to each salt."""

    def run(batches):
        s, pivot, pivot_set = Shingler(size), None, None
        for batch in batches:
            found_a, found_b = [], []
            for b, a, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a is None:
                    pivot, pivot_set = b, s.shingles(s.words(text))
                elif b == pivot and similar(s.shingles(s.words(text)), pivot_set, percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    salted = pairs.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    members = salted.join(texts.select(F.col("nid").alias("a"), "text"), "a").select("b", "s", "a", "text")
    pivots = salted.select("b", "s").distinct().join(texts.select(F.col("nid").alias("b"), "text"), "b")
    rows = members.unionByName(pivots.select("b", "s", F.lit(None).cast("bigint").alias("a"), "text"))
    ordered = rows.repartition("b", "s").sortWithinPartitions("b", "s", F.col("a").asc_nulls_first())
    return ordered.select("b", "a", "text").mapInArrow(run, "a bigint, b bigint")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the set, 16 or more a shingle and a power of two in all, as 64-bit words."""
    size = max(64, 1 << (16 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(_mixed(shingles) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps brought down to ``width`` words; bit positions are taken modulo the size."""
    while words.shape[1] > width:
        words = words[:, : words.shape[1] // 2] | words[:, words.shape[1] // 2 :]
    return words


def may_be_similar(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: int, percent: int) -> np.ndarray:
    """Rows of bitmaps ``a`` that can reach the similarity with ``b``; refuses none that does.

    Common elements are at most the common bits plus the smaller number of elements without a bit of their own.
    """
    width = min(a.shape[1], len(b))
    a, b = _folded(a, width), _folded(b[None, :], width)
    rest_a = n_a - np.bitwise_count(a).sum(axis=1, dtype=np.int64)
    rest_b = n_b - int(np.bitwise_count(b).sum(dtype=np.int64))
    most = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) + np.minimum(rest_a, rest_b)
    most = np.minimum(most, np.minimum(n_a, n_b))
    return 100 * most >= percent * (n_a + n_b - most)


def _across(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that bitmaps of their sets do not refuse.

    Every node outside a bucket's largest component meets all nodes of the bucket. Such nodes are dealt in blocks of about
    ``BLOCK`` and all nodes in streams of about ``STREAM``; a task lets one stream pass by one block, whatever the bucket's size.
    With c nodes of which m are in the largest component, c (c - m) / BLOCK + (c - m) c / STREAM rows travel.
    """

    def mapped(batches):
        s = Shingler(size)
        for batch in batches:
            bits = [bitmap(s.shingles(s.words(t))).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["nid", "bits"])

    def meet(batches):
        at, held, blocks = None, [], None
        for batch in batches:
            found_a, found_b = [], []
            for bkt, s, t, minor, nid, n, label, bits in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if at != (bkt, s, t):
                    at, held, blocks = (bkt, s, t), [], None
                words = np.frombuffer(bits, np.uint64)
                if minor:
                    held.append((nid, n, label, words))
                    continue
                if blocks is None:
                    by_width: dict[int, list] = {}
                    for h in held:
                        by_width.setdefault(len(h[3]), []).append(h)
                    blocks = [
                        (np.array([h[0] for h in hs]), np.array([h[1] for h in hs]), np.array([h[2] for h in hs]), np.stack([h[3] for h in hs]))
                        for hs in by_width.values()
                    ]
                for ids, sizes, theirs, maps in blocks:
                    fits = np.flatnonzero((theirs != label) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                    if len(fits):
                        fits = fits[may_be_similar(maps[fits], sizes[fits], words, n, percent)]
                        found_b.extend(ids[fits].tolist())
                        found_a.extend([nid] * len(fits))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    sizes = members.groupBy("bkt", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("bkt").agg(F.max(F.struct("c", "label"))["label"].alias("top"), F.sum("c").alias("c"), F.max("c").alias("m"))
    blocks = F.ceil((F.col("c") - F.col("m")) / F.lit(BLOCK)).cast("int")
    streams = F.ceil(F.col("c") / F.lit(STREAM)).cast("int")
    known = members.join(largest.select("bkt", "top", blocks.alias("k"), streams.alias("l")), "bkt").join(texts.select("nid", "text").mapInArrow(mapped, "nid bigint, bits binary"), "nid")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda seed, n: F.pmod(F.xxhash64("nid", F.lit(seed)), n).cast("int")
    minor = known.where("label <> top").select("bkt", own(0, "k").alias("s"), each("l").alias("t"), F.lit(True).alias("minor"), "nid", "n", "label", "bits")
    all_ = known.select("bkt", each("k").alias("s"), own(1, "l").alias("t"), F.lit(False).alias("minor"), "nid", "n", "label", "bits")
    rows = minor.unionByName(all_).repartition("bkt", "s", "t").sortWithinPartitions("bkt", "s", "t", F.desc("minor"))
    pairs = rows.select("bkt", "s", "t", "minor", "nid", "n", "label", "bits").mapInArrow(meet, "a bigint, b bigint")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept`` and ``raw``, the MD5 of the text."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.write(_profiled(docs, shingle))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "raw", "n", "bands"))
    nodes = rows.where(F.col("seq").isNotNull()).groupBy("seq").agg(first.alias("f"))
    # A node is named by its smallest document id; where that is null or belongs to another node too, by a hash below all ids.
    own = F.xxhash64("seq").bitwiseAND(F.lit((1 << 61) - 1)) - F.lit(1 << 62)
    taken = nodes.groupBy("f.doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("twice"))
    nodes = nodes.join(taken, F.col("f.doc_id") == F.col("twice"), "left").select(
        "seq",
        F.when(F.col("f.doc_id").isNull() | F.col("twice").isNotNull(), own).otherwise(F.col("f.doc_id")).alias("nid"),
        F.col("f.doc_id").alias("doc_id"), F.col("f.raw").alias("raw"), F.col("f.n").alias("n"), F.col("f.bands").alias("bands"),
    )
    n_rows = rows.count()
    nodes = scratch.write(nodes, n_rows)

    each = nodes.select("nid", "n", F.explode("bands").alias("bkt"))
    shared = each.groupBy("bkt").agg(F.min("nid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    buckets = scratch.write(each.join(shared, "bkt"), BANDS * n_rows)
    labels = scratch.write(buckets.select("nid", F.col("nid").alias("label")).distinct(), n_rows)
    wanted = nodes.join(labels.select("nid"), "nid").select("nid", "doc_id", "raw")
    texts = docs.withColumn("raw", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["raw"] == wanted["raw"]))
    texts = scratch.write(texts.select("nid", F.col("text").cast("binary").alias("text")).dropDuplicates(["nid"]), BANDS * n_rows)

    def link(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        links = _verified(pairs.distinct(), texts, shingle, percent)
        a, b = labels.select(F.col("nid").alias("a"), F.col("label").alias("u")), labels.select(F.col("nid").alias("b"), F.col("label").alias("v"))
        return contract(labels, links.join(a, "a").join(b, "b").select("u", "v"), scratch, n_rows)

    done = [texts, buckets]
    nearest = buckets.groupBy("nid").agg(F.min("rep").alias("b")).where("nid <> b").select(F.col("nid").alias("a"), "b")
    labels = link(nearest, labels)
    buckets = buckets.select("bkt", "nid", "n")
    compatible = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    for turn in range(PIVOTS + 1):
        inside = buckets.join(labels, "nid")
        mixed = inside.groupBy("bkt").agg(
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
            (F.min_by(F.struct("nid", "n", "label"), F.xxhash64("nid", "bkt", F.lit(turn))) if turn else F.min(F.struct("nid", "n", "label"))).alias("p"),
        ).where("lo <> hi")
        open_ = scratch.write(inside.join(mixed.select("bkt", F.col("p.nid").alias("b"), F.col("p.n").alias("m"), F.col("p.label").alias("l2")), "bkt"), BANDS * n_rows)
        buckets = open_.select("bkt", "nid", "n")
        done.append(open_)
        if open_.isEmpty():
            break
        if turn < PIVOTS:
            pairs = open_.where(F.col("label") != F.col("l2")).where(compatible).select(F.col("nid").alias("a"), "b")
            labels = link(pairs, labels)
            continue
        labels = link(_across(open_.select("bkt", "nid", "n", "label"), texts, shingle, percent), labels)

    scratch.drop(*done)
    labelled = nodes.select("seq", "nid", "doc_id").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(smallest, "label").select("seq", "component_id")
    out = rows.select("doc_id", "raw", "seq", "n").join(named, "seq", "left")
    component = F.when(F.col("seq").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "raw",
    )


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that a document with a smaller id of the same component represents."""
    found = components(docs, shingle, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"))
    gone = Scratch(docs.sparkSession, "near-dropped").write(found.distinct())
    raw = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (raw == gone["_raw"]), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over sets of two-word shingles."""
    return components(table(spark, sf_dir, "documents"), shingle=2).drop("raw")


#: All pairs that share a shingle, then components by the smallest id that can be reached.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
