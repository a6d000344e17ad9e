"""Language identification by rank-order n-gram profiles.

Training counts the letter 1- to 4-grams of every labelled text (words padded with a border mark), sums the counts of all
partitions and keeps the ``size`` most frequent n-grams of each language in rank order. A document's own most frequent
n-grams are compared with each profile by out-of-place distance: the sum over its n-grams of the difference of ranks, or
``size`` for an n-gram that the profile lacks. The nearest profile names the language. ``score`` is one minus the distance
over the largest possible distance.

Edge cases: a text that is null, empty or without a letter gets ``und`` and score 0, and so does every text when no
labelled row exists; ties go to the n-gram with the lower code and to the language whose name sorts first; null ids count
as empty when folds are made; repeated rows give repeated results; long texts are counted whole, in slices that share no
n-gram; letters beyond 16 bits are told apart by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from granary.llm.common import ship, table

PROFILE = 300
PARTS = 16
SLICE = 1 << 21  # letters counted at a time
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    is_letter = np.zeros(0x110000, dtype=bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        is_letter[low:high] = np.fromiter((chr(c).isalpha() for c in range(low, high)), bool, high - low)
    return is_letter


def _letters_of(text: str) -> np.ndarray:
    """The letters of the text, with one 0 between words and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.zeros(len(points) + 2, dtype=np.uint32)
    np.multiply(points, _letters()[points], out=c[1:-1])
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def _scattered(*letters: np.ndarray) -> np.ndarray:
    h = np.full(len(letters[0]), len(letters) << 40, np.uint64)
    for x in letters:
        h = (h ^ (h >> np.uint64(29)) ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


def _grams_of(letters: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Codes of the n-grams that start at ``begin`` up to ``end``: 16 bits a letter, or 64 hashed bits where a letter needs more."""
    c, n = letters[begin : end + 3].astype(np.uint64), end - begin
    inner = c != 0
    two = c[:-1] | (c[1:] << np.uint64(16))
    three = two[:-1] | (c[2:] << np.uint64(32))
    four = three[:-1] | (c[3:] << np.uint64(48))
    # The top slot of shorter grams holds a mark that no letter has.
    out = [
        (c | np.uint64(0xFFFF << 48), inner, (c,)),
        (two | np.uint64(0xFFFE << 48), inner[:-1] | inner[1:], (c[:-1], c[1:])),
        (three | np.uint64(0xFFFD << 48), inner[1:-1], (c[:-2], c[1:-1], c[2:])),
        (four, inner[1:-2] & inner[2:-1], (c[:-3], c[1:-2], c[2:-1], c[3:])),
    ]
    if (c >> np.uint64(16)).any():
        far = [np.logical_or.reduce([p > np.uint64(0xFFFF) for p in parts]) for _, _, parts in out]
        out = [(np.where(f, _scattered(*parts), codes), whole, parts) for f, (codes, whole, parts) in zip(far, out)]
    return np.concatenate([codes[:n][whole[:n]] for codes, whole, _ in out])


def _merge(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their summed counts."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    if counts is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of the whole text and their counts."""
    letters = _letters_of(text)
    if len(letters) <= SLICE:
        return _merge(_grams_of(letters, 0, len(letters)))
    parts = []
    for at in range(0, len(letters), SLICE):
        parts.append(_merge(_grams_of(letters, at, min(at + SLICE, len(letters)))))
        if len(parts) > 16:
            parts = [_merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
    return _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes by falling count, then by code; at most ``size``."""
    key = counts.max(initial=0) - counts
    key = key.astype(np.uint16) if len(key) == 0 or key.max() < 65536 else key
    return codes[np.argsort(key, kind="stable")[:size]]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, ranks: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(ranks), size
        self.codes = np.unique(np.array([c for r in ranks.values() for c in r], dtype=np.uint64))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            codes = np.array(ranks[lang], dtype=np.uint64)
            self.rank[i, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(*gram_counts(text), self.size)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at[self.codes[at] != top] = len(self.codes)
        rank = self.rank[:, at]
        out = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best] / (len(top) * self.size))


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all labelled rows. What reaches the driver is ``size`` rows a language."""
    ship(labelled.sparkSession)

    def count(batches):
        held: dict[str, list] = defaultdict(list)
        weight: dict[str, int] = defaultdict(int)

        def shrink(lang: str) -> None:
            held[lang] = [_merge(np.concatenate([p[0] for p in held[lang]]), np.concatenate([p[1] for p in held[lang]]))]
            weight[lang] = 0

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = gram_counts(text)
                held[lang].append(part)
                weight[lang] += len(part[0])
                if weight[lang] > 1_000_000:
                    shrink(lang)
        for lang in list(held):
            shrink(lang)
            codes, counts = held.pop(lang)[0]
            for i in range(0, len(codes), 50_000):
                part = codes[i : i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(counts[i : i + 50_000], pa.int64())],
                    names=["lang", "gram", "n"],
                )

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Codes are unsigned; the tie order follows them as such.
    order = F.desc("n"), F.shiftrightunsigned("gram", 1), F.col("gram").bitwiseAND(1)
    # Languages are few: the first n-grams of each are sought in parts, of which the last step sees ``size`` rows each.
    part = W.Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(*order)
    first = counted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size)
    top = first.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    ranks: dict[str, list] = defaultdict(list)
    for r in top.collect():
        ranks[r.lang].append((r.r, r.gram % (1 << 64)))
    return Profiles({lang: [c for _, c in sorted(v)] for lang, v in ranks.items()}, size)


def language_of(text: Column, profiles: Profiles, spark: SparkSession) -> Column:
    """The struct (lang, score) of a whole text. Only the text goes to Python; the rest of the row stays in the engine."""
    ship(spark)
    shared = spark.sparkContext.broadcast(profiles)  # size x languages ranks

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        p = shared.value
        found = [p.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "score"]
        )

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, of the whole text of each row; columns of these names are replaced."""
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")], language_of(F.col(text_col), profiles, docs.sparkSession).alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in found.columns[:-1]], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("lang_score"))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = train_profiles(docs.where(fold("doc_id", 3) != 1))
    folded = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return identify(folded, profiles).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
