"""Quality selection by ordinal regression with cumulative links on graded ratings.

A text is the set of its hashed features: lower-case letter runs, marks, and levels of repetition. All grades share one weight
a feature; ordered thresholds turn the weighted sum into the chance of each grade, P(grade >= k) = logistic(score - b_k). The
fit is on at most ``SAMPLE`` labelled rows with at most ``BUDGET`` features together, those with the smallest hashes of their ids;
features seen in fewer than
``MIN_DOCS`` of them, or whose documents' mean grade is within ``SIGNAL`` standard errors of the mean, get no weight. Scoring reads every whole text and needs no exchange.

Edge cases: null and empty texts have no features and get the thresholds' own grade; labelled rows without a grade, an id or a
text are not learned from; several labels of one id count once each; without labelled rows every grade is equally likely;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ship, table

BUCKETS = 1 << 20
SAMPLE = 20_000
BUDGET = 12_000_000  # 4 bytes each
MIN_DOCS = 5
SIGNAL = 5.0
KNOWN = 400_000
PIECES = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+|_+")


class Features:
    """Hashed features of texts; remembers hashed pieces."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            key = "0" if piece[0].isdigit() else piece
            found = self.known[piece] = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) % BUCKETS
        return found

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = PIECES.findall(text.lower())
        if not pieces:
            return []
        counts = Counter(pieces)
        out = set(map(self.bucket, counts))
        marks = sum(n for p, n in counts.items() if not p[0].isalnum())
        upper = sum(map(str.isupper, text))
        top = counts.most_common(1)[0][1]
        for name, level in (
            ("distinct", 10 * len(counts) // len(pieces)),
            ("marks", 10 * marks // len(pieces)),
            ("upper", 10 * upper // len(text)),
            ("top", 10 * top // len(pieces) if len(pieces) > 20 else -1),
            ("length", len(pieces).bit_length()),
        ):
            out.add(xxhash.xxh3_64_intdigest(f"\n{name} {level}".encode()) % BUCKETS)
        return sorted(out)


class OrdinalModel:
    """Weights by bucket and ascending thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: float | np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on."""
        return 1.0 / (1.0 + np.exp(-(np.asarray(score)[..., None] - self.thresholds)))

    @classmethod
    def fit(cls, rows: list[tuple[int, list[int]]], grades: int, l2: float = 2.0, steps: int = 300, rate: float = 0.05):
        """Maximum likelihood with a penalty on weights, by Adam over all rows at once."""
        even = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
        if not rows:
            return cls({}, even)
        every = np.array([g for g, _ in rows], float)
        mean, spread = every.mean(), max(every.std(), 1e-9)
        flat = np.concatenate([np.asarray(f, np.int64) for _, f in rows])
        owner = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
        n = np.bincount(flat, minlength=BUCKETS)
        total = np.bincount(flat, every[owner], BUCKETS)
        means = total / np.maximum(n, 1)
        used = np.flatnonzero((n >= MIN_DOCS) & (np.abs(means - mean) * np.sqrt(n) >= SIGNAL * spread))
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(len(used))
        feature = place[flat]
        owner, feature = owner[feature >= 0], feature[feature >= 0]
        grade = np.array([g for g, _ in rows], np.int64)
        share = np.clip([(grade >= k).mean() for k in range(1, grades)], 0.01, 0.99)
        # Thresholds as a first one and positive gaps keep their order.
        start = np.maximum.accumulate(-np.log(share / (1 - share)))
        theta = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 0.05)), np.zeros(len(used))))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            b = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1 : grades - 1]))))
            score = np.bincount(owner, theta[grades - 1 :][feature], len(rows))
            tail = 1.0 / (1.0 + np.exp(-(score[:, None] - b)))
            edge = np.hstack((np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))))
            here = np.arange(len(rows))
            high, low = edge[here, grade], edge[here, grade + 1]
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            d_b = np.zeros(grades + 1)
            np.add.at(d_b, grade, d_high)
            np.add.at(d_b, grade + 1, -d_low)
            d_b = d_b[1:-1]
            later = np.cumsum(d_b[::-1])[::-1]
            slope = np.concatenate(([later[0]], later[1:] * np.exp(theta[1 : grades - 1]), -np.bincount(feature, (d_high - d_low)[owner], len(used))))
            slope[grades - 1 :] += l2 * theta[grades - 1 :]
            slope /= len(rows)
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        b = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1 : grades - 1]))))
        return cls(dict(zip(used.tolist(), theta[grades - 1 :].tolist())), b)


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, budget: int = BUDGET) -> OrdinalModel:
    """A model of ``ratings`` (doc_id, grade) over ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    good = F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()
    chosen = ratings.where(good).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # At most ``sample`` pairs of numbers are broadcast.
    rated = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id", "grade")), "doc_id").select("grade", "text", "doc_id")

    def featured(batches):
        f = Features()
        for batch in batches:
            found = [np.array(f.of(t), np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(x) // 4 for x in found], pa.int32()), pa.array(found, pa.binary())],
                names=["grade", "doc_id", "n", "features"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rated.withColumn("grade", F.col("grade").cast("int")).mapInArrow(featured, f"grade int, doc_id {kind}, n int, features binary")
    scratch = Scratch(spark, "rated")
    written = rows = scratch.write(rows.withColumn("h", F.xxhash64("doc_id")))
    # An id may stand for several texts: rows are counted again, in hash order, and their features too.
    order = rows.orderBy("h", "doc_id", "grade", "n").select("h", "n").limit(sample + 1).collect()
    last, held = None, 0
    for k, r in enumerate(order):
        held += r.n
        if k >= sample or held > budget:
            break
        last = r.h
    # Rows of the last id that were cut go with it, unless it is the only one.
    whole = len(order) <= sample and held <= budget
    rows = rows if whole else rows.where(F.col("h") < order[k].h) if last is not None and order[k].h > order[0].h else rows.orderBy("h", "grade", "n").limit(max(1, k))
    rows = rows.select("doc_id", "grade", "features").collect()
    scratch.drop(written)
    # In a fixed order, so that sums do not depend on which task came first.
    rows.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.features)))
    return OrdinalModel.fit([(r.grade, np.frombuffer(r.features, np.int32)) for r in rows], grades)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", tail_grade: int | None = None, keep_at: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_prob, kept``: the chance of ``tail_grade`` or better decides."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights
    tail_grade = len(model.thresholds) if tail_grade is None else tail_grade

    def run(batches):
        model, f = shared.value, Features()
        get = model.weights.get
        for batch in batches:
            score = np.array([sum(get(b, 0.0) for b in f.of(t)) for t in batch.column(1).to_pylist()])
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, tail_grade - 1])], names=["doc_id", "expected_grade", "tail_prob"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double")
    return done.withColumn("kept", F.col("tail_prob") >= keep_at)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and chance of the best one; grades are 0 toxic, 1 poor, 2 good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    ratings = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade")
    )
    return grade(docs, train(docs, ratings, 3))
