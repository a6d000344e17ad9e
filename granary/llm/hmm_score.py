"""Scores of texts under a hidden Markov language model trained by Baum-Welch counts summed across partitions.

The ``HEAD`` most frequent training tokens, the end among them, are symbols of their own. All other words share ``CLASSES``
symbols by their last three bytes, so that the states see rare and unknown words by their endings; within a class k they are
told apart by ``(c + 1) / (T_k + U_k + 1)``, with T_k tokens and U_k distinct words of the class in training, so that the model
gives every text a probability. Each round every partition runs the scaled forward and backward recursions over its training
texts and sends summed expected counts, whose size is that of the model. For training, texts are worked in pieces of
``SEGMENT`` tokens that see ``CONTEXT`` tokens more on either side: every token and every transition is counted once, in the
middle of a piece, from states that the context has settled. Scoring runs the forward recursion over whole texts; for very long
texts it does so over pieces from every state at once and chains them, which is exact.

Counts of head words and of up to ``WIDE`` other frequent words go to all tasks. Counts of the rarer words meet the texts in a
join by word.

Edge cases: null and empty texts are the end token alone; a null id counts as the empty string when folds are made; repeated
rows give repeated results; words with equal counts enter the head in the order of their bytes; without training texts all
counts are 0 and the model is uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ship, table
from granary.llm.near_dedup import Shingler

STATES = 8
HEAD = 16_384
ROUNDS = 8
CLASSES = 4_096
WIDE = 262_144  # words beside the head whose counts are sent to all tasks, some 160 bytes each there; the others are joined
SEGMENT = 1024
CONTEXT = 32
PIECE = 512  # tokens of a long text that are scored from every state
LONG = 16_384  # tokens from which a text is scored in pieces
END = b"\n"  # cannot be a word
PRIOR = 20.0  # expected counts of a state's emissions that follow the unigram shares
FLUSH = 300_000


class Model:
    """Start (of texts, of later pieces), transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (2, S), (S, S), (symbols, S)

    @classmethod
    def initial(cls, share: np.ndarray, states: int = STATES) -> Model:
        noise = np.random.Generator(np.random.PCG64(8)).gamma(0.5, 2.0, (len(share), states)) + 0.05
        emit = share[:, None] * noise
        move = np.full((states, states), 0.02 / max(states - 1, 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        return cls(np.full((2, states), 1.0 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        emit = emit + PRIOR * share[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def word_class(word: bytes) -> int:
    """The class of a word that is no head word."""
    return zlib.crc32(word[-3:]) % CLASSES


class Packed:
    """Sequences by falling length, laid out step by step; at each step the sequences still running come first."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        longest = int(self.size[0])
        running = np.cumsum(np.bincount(self.size, minlength=longest + 1)[::-1])[::-1][1:]  # of steps 1.. : size >= step
        self.running = running.tolist()
        self.first = np.concatenate(([0], np.cumsum(running))).tolist()
        flat = np.concatenate([sequences[i] for i in self.order])
        begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        step = np.arange(len(flat)) - np.repeat(begin, self.size)
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.symbol = np.empty(len(flat), np.int64)
        self.place = np.array(self.first)[step] + row  # of each token of the sequences in packed order
        self.symbol[self.place] = flat


def forward(model: Model, p: Packed, prior: np.ndarray):
    """Scaled forward values and scales of all steps; ``prior`` has each sequence's chances of its first state, in packed order."""
    alpha = model.emit[p.symbol]
    scale = np.empty(len(alpha), alpha.dtype)
    ones = np.ones(alpha.shape[1], alpha.dtype)
    a = prior
    for t, n in enumerate(p.running):
        lo = p.first[t]
        now = alpha[lo : lo + n]
        now *= a[:n] @ model.move if t else a
        s = np.matmul(now, ones, out=scale[lo : lo + n])
        now /= s[:, None]
        a = now
    return alpha, scale


def log_likelihoods(p: Packed, scale: np.ndarray) -> np.ndarray:
    """log10 of each sequence, in packed order."""
    row = np.concatenate([np.arange(n) for n in p.running])
    return np.bincount(row, np.log10(scale), len(p.size))


def expected_counts(model: Model, sequences: list[np.ndarray], later: np.ndarray, inner: list[tuple[int, int]] | None = None):
    """Baum-Welch counts (start, move, emit) and log10 likelihood; ``later`` marks pieces that do not start a text.

    ``inner`` gives the tokens of each sequence that count, from a first to before a last, and the transitions into them.
    """
    p = Packed(sequences)
    counted = None
    if inner is not None:
        low, high = (np.array(x)[p.order] for x in zip(*inner))
        counted = np.empty(len(p.symbol), np.float32)
        for t, n in enumerate(p.running):
            counted[p.first[t] : p.first[t] + n] = (low[:n] <= t) & (t < high[:n])
    kind = later[p.order].astype(np.int64)
    # Single precision is enough for counts, which are then summed in double; scores are computed in double throughout.
    # States come first here, so that each operation runs along the sequences of a step and not along a few states.
    begin, onward, shares = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    states = len(onward)
    seen = np.empty((states, len(p.symbol)), np.float32)
    np.take(np.ascontiguousarray(shares.T), p.symbol, axis=1, out=seen, mode="clip")  # which needs no buffer
    alpha, scale = np.empty_like(seen), np.empty(len(p.symbol), np.float32)
    turned, ones = np.ascontiguousarray(onward.T), np.ones(states, np.float32)
    a = begin[kind].T
    for t, n in enumerate(p.running):
        lo = p.first[t]
        now = alpha[:, lo : lo + n]
        np.multiply(seen[:, lo : lo + n], turned @ a[:, :n] if t else a, out=now)
        now /= np.matmul(ones, now, out=scale[lo : lo + n])
        a = now
    seen /= scale
    move = np.zeros((states, states))
    back = np.ones((states, p.running[-1]), np.float32)
    for t in range(len(p.running) - 1, -1, -1):
        n, lo = p.running[t], p.first[t]
        if t:
            before, more = p.first[t - 1], p.running[t - 1]
            weighed = seen[:, lo : lo + n]
            weighed *= back
            earlier = onward @ weighed
            if counted is not None:
                weighed *= counted[lo : lo + n]
            move += alpha[:, before : before + n] @ weighed.T
        alpha[:, lo : lo + n] *= back  # the chances of the states from here on
        if t:
            back = earlier
            if more > n:  # sequences that end one step before
                back = np.concatenate((back, np.ones((states, more - n), np.float32)), axis=1)
    move *= model.move
    start = np.stack([alpha[:, : p.running[0]][:, kind == k].sum(axis=1, dtype=np.float64) for k in (0, 1)])
    if counted is not None:
        alpha *= counted
    emit = np.stack([np.bincount(p.symbol, x, len(model.emit)) for x in alpha], axis=1)
    return start, move, emit, float(np.log10(scale.astype(np.float64)).sum())


def score(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence."""
    out = np.zeros(len(sequences))
    short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
    if short:
        p = Packed([sequences[i] for i in short])
        _, scale = forward(model, p, np.repeat(model.start[:1], len(short), axis=0))
        out[np.array(short)[p.order]] = log_likelihoods(p, scale)
    for i in set(range(len(sequences))).difference(short):
        out[i] = _score_long(model, sequences[i])
    return out


def _score_long(model: Model, sequence: np.ndarray) -> float:
    states, total, v = model.move.shape[0], 0.0, None
    for lo in range(0, len(sequence), PIECE * 256):
        pieces = [sequence[at : at + PIECE] for at in range(lo, min(lo + PIECE * 256, len(sequence)), PIECE)]
        p = Packed([piece for piece in pieces for _ in range(states)])
        where = np.empty(len(p.order), np.int64)
        where[p.order] = np.arange(len(p.order))
        alpha, scale = forward(model, p, model.move[p.order % states])
        ll = log_likelihoods(p, scale)
        last = alpha[np.array(p.first)[p.size - 1] + np.arange(len(p.size))]
        for k in range(len(pieces)):
            mine = where[k * states : (k + 1) * states]
            if v is None:  # the text's start replaces a state before it
                q = Packed([pieces[0]])
                a, s = forward(model, q, model.start[:1])
                v, total = a[-1], float(np.log10(s).sum())
                continue
            top = ll[mine].max()
            v = (v * 10.0 ** (ll[mine] - top)) @ last[mine]
            total += top + math.log10(v.sum())
            v = v / v.sum()
    return total


def _token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows, the end of each text counted as a word."""

    def count(batches):
        s, held = Shingler(1), Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(s.words(text))
                held[END] += 1
                if len(held) > FLUSH:
                    yield rows()
        if held:
            yield rows()

    return texts.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary(NamedTuple):
    """What training counted: all tokens and distinct words, head words as symbols with their counts, tokens and words by class.

    ``wide`` has the counts of the most frequent words that are not in the head.
    """

    tokens: int
    words: int
    head: dict[bytes, int]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    wide: dict[bytes, int]

    def share(self) -> np.ndarray:
        """The symbols' shares of all tokens, head symbols first."""
        x = np.concatenate((self.counts, self.class_tokens + 0.1)) + 1e-3
        return x / x.sum()

    def log_base(self) -> np.ndarray:
        """log10 of the base chance of a head word by its symbol; 0 for the others."""
        return np.concatenate((np.log10((self.counts + 1) / (self.tokens + self.words + 1)), np.zeros(CLASSES)))

    def log_room(self) -> np.ndarray:
        """log10 of T_k + U_k + 1 by symbol; 0 for head words."""
        return np.concatenate((np.zeros(len(self.head)), np.log10(self.class_tokens + self.class_words + 1)))


def read_vocabulary(counted: DataFrame, head: int = HEAD) -> Vocabulary:
    """The vocabulary of the table (word, c). The driver receives about ``head`` and ``WIDE`` words and ``CLASSES`` sums."""
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The least count that can be in the head comes from a histogram, so that no task sends its own first words.
    level = F.floor(F.log2("c") * 16)
    levels = sorted(((r.l, r.k) for r in counted.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, seen = 0, 0
    for least, k in levels:
        seen += k
        if seen >= head:
            break
    top = counted.where(level >= least).orderBy(F.desc("c"), "word").limit(head).collect()
    symbols = {END: 0}
    for r in top:
        symbols.setdefault(bytes(r.word), len(symbols))
    counts = np.zeros(len(symbols))
    for r in top:
        counts[symbols[bytes(r.word)]] = r.c
    if counts[0] == 0 and total.n:  # the end may be rarer than the head
        counts[0] = counted.where(F.col("word") == F.lit(bytearray(END))).first().c
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    ending = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(CLASSES)).cast("int")
    for r in counted.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[r.k], words[r.k] = r.c, r.n
    for w, i in symbols.items():
        if counts[i] > 0:
            tokens[word_class(w)] -= counts[i]
            words[word_class(w)] -= 1
    seen, whole = 0, []  # levels that are sent whole, so that no level of many words is ordered
    for at, k in levels:
        seen += k
        if seen > WIDE:
            break
        whole.append(at)
    wide: dict[bytes, int] = {}
    if whole:
        sent = counted.where(level >= whole[-1]).select("word", "c").toArrow()
        wide = {w: c for w, c in zip(sent.column("word").to_pylist(), sent.column("c").to_pylist()) if w not in symbols}
    return Vocabulary(int(total.n), int(total.v), symbols, counts, tokens, words, wide)


class Index(dict):
    """Word to number: head words, wide words, then the classes of all others, of which the last are remembered."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + FLUSH:
            self.clear()
            self.update(self.known)
        found = self[word] = len(self.known) + word_class(word)
        return found


def _encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each text as symbols (2 bytes each) beside its rarer words and what the known words and the classes add to the scores."""
    first, wide = len(vocabulary.head), vocabulary.wide
    known = vocabulary.head | {w: first + i for i, w in enumerate(wide)}
    symbol = np.concatenate((np.arange(first), [first + word_class(w) for w in wide], first + np.arange(CLASSES))).astype(np.uint16)
    logs = np.concatenate((np.zeros(first), np.log10(np.array(list(wide.values()), float) + 1), np.zeros(CLASSES)))
    shared = rows.sparkSession.sparkContext.broadcast((known, symbol, logs, vocabulary.log_base(), vocabulary.log_room()))  # HEAD and WIDE words at most
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        known, symbol, log_count, log_base, log_room = shared.value
        s, number, last = Shingler(1), Index(known), len(known)
        for batch in batches:
            symbols, words, counts, n, base, room, head, logs, wide = [], [], [], [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                found = s.words(text)
                found.append(END)
                at = np.fromiter(map(number.__getitem__, found), np.uint32, len(found))
                rest = Counter(map(found.__getitem__, np.flatnonzero(at >= last).tolist()))
                ids = symbol[at]
                symbols.append(ids.tobytes())
                words.append(list(rest))
                counts.append(list(rest.values()))
                n.append(len(found))
                base.append(float(log_base[ids].sum()))
                room.append(float(log_room[ids].sum()))
                logs.append(float(log_count[at].sum()))
                head.append(int((at < first).sum()))
                wide.append(int((at < last).sum()) - head[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(symbols, pa.binary()), pa.array(base, pa.float64()),
                    pa.array(room, pa.float64()), pa.array(head, pa.int64()), pa.array(logs, pa.float64()), pa.array(wide, pa.int64()),
                    pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "held_out", "n_tokens", "symbols", "base", "room", "head", "logs", "wide", "words", "counts"],
            )

    return rows.select("rid", "doc_id", "held_out", F.col("text").cast("binary")).mapInArrow(
        encode,
        f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, symbols binary, base double, room double, head bigint, logs double, wide bigint, words array<binary>, counts array<bigint>",
    )


def _groups(sequences, budget: int):
    """Lists of sequences of about ``budget`` tokens."""
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s[0])
        if size >= budget:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(encoded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the ``symbols`` of all rows of ``encoded``; sums of expected counts reach the driver, nothing else."""
    model = Model.initial(share, states)
    symbols = len(share)
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def expect(batches, shared=shared):
            model = shared.value
            sums = None

            def pieces():
                for batch in batches:
                    for raw in batch.column(0).to_pylist():
                        whole = np.frombuffer(raw, np.uint16).astype(np.int64)
                        for at in range(0, len(whole), SEGMENT):
                            low, high = max(0, at - CONTEXT), min(at + SEGMENT + CONTEXT, len(whole))
                            yield whole[low:high], low > 0, (at - low, min(at + SEGMENT, len(whole)) - low)

            for group in _groups(pieces(), 1_000_000):
                start, move, emit, _ = expected_counts(model, [s for s, _, _ in group], np.array([x for _, x, _ in group]), [i for _, _, i in group])
                sums = [start, move, emit] if sums is None else [a + b for a, b in zip(sums, (start, move, emit))]
            if sums is not None:
                rows = np.concatenate(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(rows)), pa.int64()), *[pa.array(rows[:, i]) for i in range(states)]], names=["k", *names]
                )

        parts = encoded.select("symbols").mapInArrow(expect, "k bigint, " + ", ".join(f"{n} double" for n in names))
        total = np.zeros((2 + states + symbols, states))
        for r in parts.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toLocalIterator():
            total[r.k] = r[1:]
        model = Model.from_counts(total[:2], total[2 : 2 + states], total[2 + states :], share)
        shared.unpersist()
    return model


class Fitted(NamedTuple):
    counted: DataFrame
    encoded: DataFrame
    vocabulary: Vocabulary
    model: Model


def fit(docs: DataFrame, held_out, states: int = STATES, head: int = HEAD, rounds: int = ROUNDS) -> Fitted:
    """A model of the rows of ``docs`` (doc_id, text) where ``held_out`` is false, and all rows as symbols."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hmm")
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counted = scratch.write(_token_counts(rows.where("NOT held_out")))
    v = read_vocabulary(counted, head)
    encoded = scratch.write(_encoded(rows.withColumn("rid", F.monotonically_increasing_id()), v))
    return Fitted(counted, encoded, v, train(encoded.where("NOT held_out"), v.share(), states, rounds if v.tokens else 0))


def scores(docs: DataFrame, held_out, states: int = STATES, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text) scored by a model of the rows where ``held_out`` is false."""
    return scored(fit(docs, held_out, states, head, rounds))


def scored(fitted: Fitted) -> DataFrame:
    """One row for each text that ``fit`` saw."""
    counted, encoded, v, model = fitted
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            all_of = [np.frombuffer(raw, np.uint16).astype(np.int64) for raw in batch.column(1).to_pylist()]
            found = [score(model, [s for s, in group]) for group in _groups(((s,) for s in all_of), 500_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], names=["row", "symbol_score"])

    keyed = encoded.select(F.struct("rid", "doc_id", "held_out", "n_tokens", "base", "room", "head", "logs", "wide").alias("row"), "symbols")
    done = keyed.mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, symbol_score double").select("row.*", "symbol_score")

    each = encoded.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    c = F.coalesce("c", F.lit(0))
    others = each.join(counted, "word", "left").groupBy("rid")
    others = others.agg(F.sum(F.col("n") * F.log10(c + 1)).alias("log_counts"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    logs = F.col("logs") + F.coalesce("log_counts", F.lit(0.0))
    all_ = F.lit(math.log10(v.tokens + v.words + 1))
    return done.join(others, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.when(F.lit(int(v.counts[0])) > 0, F.col("head")).otherwise(F.col("head") - 1) + F.col("wide") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - (F.col("n_tokens") - F.col("head")) * all_).alias("base_score"),
        (F.col("symbol_score") + logs - F.col("room")).alias("score"),
    )


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model scores; one of seven folds is held out of training."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold == 2)
