"""Mixing to target weights with soft domain membership, in DataFrame operations only.

1. A labelled table gives domains. From at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids) the
   words (and levels of letters, shouting and repetition) whose presence departs from a domain's share by ``SIGNAL`` standard
   errors are taken; their presence gives every document a posterior chance of each domain (naive Bayes).
2. Document rates r >= 0 minimise half the squared distance between the expected domain totals sum(r * tokens * posterior) and
   the targets (both as shares of all tokens), plus ``PULL`` / 2 times the token-weighted squared distance of the rates from 1,
   which of all rates that meet the targets takes those nearest to 1. The solver is a lazy projected gradient: rates are the
   projection max(0, 1 - z . posterior), where z sums the gradients taken so far, each scaled by the inverse Gram matrix of the
   documents with a positive rate; of several lengths the best is taken. So the state is one number a domain. Documents are
   summed by their posteriors first, and a round is one sum over that table, of which some dozens of numbers reach the driver.
   Rounds end when the gradient is below ``TOLERANCE``; after ``ROUNDS`` without that there is an error.

Edge cases: null and empty texts have no words, the prior as posterior, and rate as any other; labelled rows without id or
domain are not learned from; without labelled rows all domains are equally likely; a domain that no document can supply keeps
its gap; repeated rows get the same rate; an empty table gives an empty result. The columns that ``mix`` adds replace columns
of these names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ascii_lower, table

SAMPLE = 20_000
BINS = 61
MIN_DOCS = 5
SIGNAL = 5.0
LIFT = 2.0
SHRINK = 5.0  # documents without opinion that each word's counts are joined by
ROUNDS = 100
PULL = 1e-8
TOLERANCE = 1e-9
LENGTHS = [1.0, 0.5, 0.25, 0.0625, 2.0**-6, 2.0**-10]
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Domains by label class and the shares of tokens that the query and the pipeline aim at.
TARGETS = {"good": 0.88, "poor": 0.05, "toxic": 0.01}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_LETTERS), "")


def features_of(text: Column, words: str, distinct: str) -> Column:
    """The distinct words and three that no text has as words, for the share of letters, shouting and repetition."""
    size = F.greatest(F.char_length(F.coalesce(text, F.lit(""))), F.lit(1))
    letters = F.floor(10 * F.char_length(F.array_join(words, "")) / size)
    varied = F.floor(10 * F.size(distinct) / F.greatest(F.size(words), F.lit(1)))
    shouts = F.coalesce(text, F.lit("")).rlike("[A-Z]{4}").cast("string")
    return F.concat(F.col(distinct), F.array(F.concat(F.lit("1 "), letters), F.concat(F.lit("2 "), shouts), F.concat(F.lit("3 "), varied)))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w``, ``_d`` and ``_f``: words, distinct words and features of the text."""
    rows = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_d", F.array_distinct("_w"))
    return rows.withColumn("_f", features_of(F.col("text"), "_w", "_d"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table."""
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL")
    return known.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor").alias("domain"))


def train_domains(docs: DataFrame, domains: DataFrame, names: list[str], sample: int = SAMPLE) -> tuple[list[float], dict[str, list[float]]]:
    """Log chances of texts without any chosen word and, for each such word, how it moves them (shrunk to nothing)."""
    chosen = domains.where(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    # Written, or the engine would look for features in all documents before it joins.
    scratch = Scratch(docs.sparkSession, "domains")
    found = scratch.write(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text"))
    labelled = with_features(found).select("domain", F.col("_f").alias("w"))
    sizes = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sizes.get(d, 0) for d in names]
    total = sum(n)
    prior = [math.log((x + 1) / (total + len(names))) for x in n]
    if not total:
        return prior, {}
    each = labelled.select("domain", F.explode("w").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)])

    def departs(i: int) -> Column:
        share = min(max(n[i] / total, 1e-6), 1 - 1e-6)
        return F.abs(F.col(f"n{i}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))

    z = F.greatest(*[departs(i) for i in range(len(names))]) if len(names) > 1 else departs(0)
    # Words that make no domain LIFT times as likely say little, and in their number would outvote those that do.
    telling = F.lit(False)
    for i in range(len(names)):
        telling = telling | (F.lit(n[i] > 0) & (F.col(f"n{i}") * total >= LIFT * n[i] * F.col("n")))
    rows = counts.where(F.col("n") >= MIN_DOCS).withColumn("z", z).where((F.col("z") >= SIGNAL) & telling).collect()  # the words of at most ``sample`` rows
    share = [math.exp(p) for p in prior]
    gain = lambda r, i: math.log((r[f"n{i}"] + SHRINK * share[i]) / (r.n + SHRINK) / share[i])
    features = {r.word: [gain(r, i) for i in range(len(names))] for r in sorted(rows, key=lambda r: r.word)}
    if features:
        # Texts without any of the words have their own shares, from which the words' evidence starts.
        silent = labelled.where(~F.exists("w", lambda w: w.isin(list(features))))
        alone = {r.domain: r.n for r in silent.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
        whole = sum(alone.values()) + SHRINK
        prior = [math.log((alone.get(d, 0) + SHRINK * share[i]) / whole) for i, d in enumerate(names)]
    return prior, features


def _table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def posteriors(words: Column, prior: list[float], features: dict[str, list[float]]) -> Column:
    """Array of the chances of the domains, from the presence of the chosen words."""
    logits = F.array(*[F.lit(float(x)) for x in prior])
    if features:
        # Words are first sought in a hash set; maps are searched in order, so that many short ones stand in for one.
        bins: dict[int, list[str]] = {}
        for w in features:
            bins.setdefault(len(w.encode()) * 31 % BINS, []).append(w)
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
        maps = F.array(*[F.map_from_arrays(F.array(*map(F.lit, bins[i])), _table([features[w] for w in bins[i]])) if i in bins else none for i in range(BINS)])
        known = F.filter(words, lambda w: w.isin(list(features)))
        add = lambda acc, w: F.zip_with(acc, maps[F.octet_length(w) * 31 % BINS][w], lambda a, b: a + b)
        logits = F.aggregate(known, logits, add)
    # Relative to the largest, so that nothing vanishes.
    top = lambda xs: F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(F.array(top(logits)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _rate(post: Column, z: list[float]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(float(x)) * post[i] for i, x in enumerate(z)), F.lit(0.0)))


def _solved(m: list[list[float]], v: list[float]) -> list[float]:
    """The solution of a small symmetric positive definite system."""
    d = len(v)
    a = [[*row, x] for row, x in zip(m, v)]
    for i in range(d):
        for j in range(i + 1, d):
            f = a[j][i] / a[i][i]
            a[j] = [y - f * x for x, y in zip(a[i], a[j])]
    out = [0.0] * d
    for i in reversed(range(d)):
        out[i] = (a[i][d] - sum(a[i][j] * out[j] for j in range(i + 1, d))) / a[i][i]
    return out


class Mix(NamedTuple):
    """The rate as a function of ``_post``, and targets and shares reached by domain, as parts of all tokens."""

    rate: Column
    targets: list[float]
    reached: list[float]

    @property
    def residual(self) -> float:
        return math.dist(self.targets, self.reached)


def solve_rates(rows: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, whole: list[int] = ()) -> Mix:
    """Rates for ``rows`` with _tokens and _post; targets are shares of all tokens.

    All targets are raised alike, where that is needed to leave the domains in ``whole`` as many tokens as they have.
    Documents with the same posteriors have the same rate and are summed first.
    """
    d = len(targets)
    grouped = rows.groupBy("_post").agg(F.sum(F.col("_tokens").cast("double")).alias("_t"))
    scratch = Scratch(rows.sparkSession, "rates")
    grouped = scratch.write(grouped)
    t, post = F.col("_t"), F.col("_post")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    first = grouped.agg(F.sum(t).alias("n"), *[F.sum(t * post[i]).alias(f"s{i}") for i in range(d)]).first()
    n = first.n
    if not n:
        scratch.drop(grouped)
        return Mix(F.lit(1.0), list(targets), [0.0] * d)
    natural = [first[f"s{i}"] / n for i in range(d)]
    raised = max([1.0, *[natural[i] / targets[i] for i in whole if targets[i] > 0]])
    targets = [raised * x for x in targets]

    def at(points: list[list[float]]) -> list[tuple[float, list[float], list[list[float]]]]:
        """The objective of the solver (its gradient is the gap), the shares and the Gram matrix of the free at each z."""
        sums = []
        for k, z in enumerate(points):
            r = F.col(f"_r{k}")
            sums.append(F.sum(t * r * r).alias(f"q{k}"))
            sums += [F.sum(t * r * post[i]).alias(f"s{k}_{i}") for i in range(d)]
            sums += [F.sum(F.when(r > 0, t * post[i] * post[j]).otherwise(0.0)).alias(f"g{k}_{i}_{j}") for i, j in pairs]
        got = grouped.select(t, post, *[_rate(post, z).alias(f"_r{k}") for k, z in enumerate(points)]).agg(*sums).first()
        out = []
        for k, z in enumerate(points):
            value = got[f"q{k}"] / n / 2 + sum(x * y for x, y in zip(z, targets)) + PULL / 2 * sum(x * x for x in z)
            gram = [[got[f"g{k}_{min(i, j)}_{max(i, j)}"] / n + PULL * (i == j) for j in range(d)] for i in range(d)]
            out.append((value, [got[f"s{k}_{i}"] / n for i in range(d)], gram))
        return out

    z = [0.0] * d
    value, reached, gram = at([z])[0]
    for _ in range(rounds):
        gradient = [s - x - PULL * y for s, x, y in zip(reached, targets, z)]
        if math.hypot(*gradient) < tolerance:
            break
        scaled = _solved(gram, gradient)
        points = [[x + a * y for x, y in zip(z, scaled)] for a in LENGTHS]
        found = at(points)
        best = min(range(len(points)), key=lambda k: found[k][0])
        if found[best][0] >= value:  # no length makes it less: as near as numbers of this precision come
            break
        z, (value, reached, gram) = points[best], found[best]
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds; shares reached {reached}, targets {targets}")
    scratch.drop(grouped)
    return Mix(_rate(F.col("_post"), z), targets, reached)


def assign(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float], budget: float = 1.0, keep: list[str] | None = None, whole: list[str] = ()
) -> tuple[DataFrame, Mix]:
    """(``_row, n_tokens, posteriors, rate, copies``, figures): each row of ``docs`` (or its columns ``keep``) as a struct.

    Targets are shares of ``budget`` times all tokens; see ``solve_rates`` for ``whole``. ``copies`` rounds the rate up or down
    by a hash of the kept columns, so that the expected number of copies is the rate.
    """
    names = sorted(targets)
    prior, features = train_domains(docs, domains, names)
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession, "mixing")
    seen = with_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "text"))
    rows = seen.select(
        "_row", F.xxhash64("_row").alias("_u"), F.size("_w").cast("bigint").alias("_tokens"), posteriors(F.col("_f"), prior, features).alias("_post")
    )
    rows = scratch.write(rows)
    found = solve_rates(rows.select("_tokens", "_post"), [budget * targets[d] for d in names], whole=[names.index(d) for d in whole])
    u = F.pmod("_u", F.lit(1 << 40)) / F.lit(float(1 << 40))
    done = rows.select("_row", "_tokens", F.struct(*[F.col("_post")[i].alias(d) for i, d in enumerate(names)]).alias("posteriors"), "_u", found.rate.alias("rate"))
    return done.select("_row", F.col("_tokens").alias("n_tokens"), "posteriors", "rate", F.floor(F.col("rate") + u).cast("bigint").alias("copies")), found


ADDED = ["n_tokens", "posteriors", "rate", "copies"]


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], budget: float = 1.0, whole: list[str] = ()) -> DataFrame:
    """``docs`` with ``n_tokens``, ``posteriors``, ``rate`` and ``copies``, which replace columns of these names; see ``assign``."""
    rows, _ = assign(docs, domains, targets, budget, whole=whole)
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, copies and domain chances of every document; ``residual`` is the distance of the shares reached from the targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows, found = assign(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, keep=["doc_id", "source"])
    chances = [F.col("posteriors").getField(d).alias(f"p_{d}") for d in sorted(TARGETS)]
    return rows.select("_row.doc_id", "_row.source", "n_tokens", *chances, "rate", "copies", F.lit(found.residual).alias("residual"))
