"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens. Pre-tokens not seen lately are laid out as one flat symbol array with segment starts. In
each round every segment finds its own lowest-rank adjacent pair and all segments apply theirs at once; segments without
a mergeable pair leave with their symbol count. Merging all occurrences of a segment's lowest pair at once equals merging
one at a time, because a pair that a merge creates always has a higher rank.

Edge cases: a null text counts as empty and has 0 bytes and 0 tokens; added special strings inside a text count one token
each, as the library does by default; repeated rows give repeated results; texts of any length are counted in pieces that
end at safe pre-token borders, so memory does not grow with the text.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import ship, table

NONE = np.int32(1 << 30)
PIECE = 1 << 20  # characters of a long text that are cut at a time
CACHE = 400_000  # pre-tokens that a worker remembers
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same cut for pure ASCII text, for which the standard library's engine is faster.
ASCII_SPLIT = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    names.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)})
    return [names[b] for b in range(256)]


class RankMerger:
    """Counts tokens with the merges of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, spec: str):
        whole = json.loads(spec)
        model, vocab = whole["model"], whole["model"]["vocab"]
        self.first = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        specials = sorted((t["content"] for t in whole.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.words = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged_lengths(self, pre: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string after all merges."""
        out = np.array([len(p) for p in pre], dtype=np.int64)
        live = np.flatnonzero(out > 1)
        size = out[live]
        symbol = self.first[np.frombuffer(b"".join(pre[i] for i in live), dtype=np.uint8)]
        rank = None
        while len(live):
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            last = start + size - 1
            if rank is None:
                rank = np.full(len(symbol), NONE, dtype=np.int32)
                rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
                rank[last] = NONE
            lowest = np.minimum.reduceat(rank, start)
            done = lowest == NONE
            if done.any():
                out[live[done]] = size[done]
                stay = np.repeat(~done, size)
                symbol, rank, live, size, lowest = symbol[stay], rank[stay], live[~done], size[~done], lowest[~done]
                if not len(live):
                    break
            segment = np.repeat(np.arange(len(live)), size)
            hit = np.flatnonzero(rank == lowest[segment])
            # In a run of overlapping occurrences (aaa) every second one counts, from the left.
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = (hit[1:] != hit[:-1] + 1) | (segment[hit[1:]] != segment[hit[:-1]])
            order = np.arange(len(hit))
            hit = hit[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            size = size - np.bincount(segment[hit], minlength=len(live))
            moved = hit - np.arange(len(hit))
            symbol, rank = symbol[stay], rank[stay]
            last = np.cumsum(size) - 1
            touched = np.zeros(len(symbol), dtype=bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            touched[-1] = False
            near = np.flatnonzero(touched)
            rank[near] = self.ranks(symbol[near], symbol[near + 1])
            rank[last] = NONE
        return out

    def learn(self, missing: list[str]) -> None:
        for i in range(0, len(missing), 100_000):
            part = missing[i : i + 100_000]
            self.known.update(zip(part, self.merged_lengths([p.encode() for p in part]).tolist()))

    def pre_tokens(self, piece: str) -> list[str]:
        return ASCII_SPLIT.findall(piece) if piece.isascii() else self.words.findall(piece)

    def pieces(self, text: str):
        """The text without special strings (each given as None), in parts that never split a pre-token."""
        spans, at = [], 0
        if self.special is not None:
            for m in self.special.finditer(text):
                spans += [(at, m.start()), None]
                at = m.end()
        for span in [*spans, (at, len(text))]:
            if span is None:
                yield None
                continue
            begin, end = span
            while end - begin > PIECE:
                cut = SAFE_CUT.search(text, begin + PIECE, end)
                if cut is None:
                    break
                yield text[begin : cut.start()]
                begin = cut.start()
            yield text[begin:end]

    def count(self, texts: list[str]) -> list[int]:
        return [self._count(t) for t in texts]

    def _count(self, text: str) -> int:
        n = 0
        for piece in self.pieces(text):
            if piece is None:
                n += 1
                continue
            words = self.pre_tokens(piece)
            if len(self.known) > CACHE:
                self.known.clear()
            missing = set(words).difference(self.known)
            if missing:
                self.learn(list(missing))
            n += sum(map(self.known.__getitem__, words))
        return n

    def count_batch(self, texts: list[str]) -> list[int]:
        """Like ``count``; unseen pre-tokens of many short texts are merged together."""
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            if len(self.known) > CACHE:
                self.known.clear()
            missing = set().union(*(w for _, w in held)).difference(self.known)
            if missing:
                self.learn(list(missing))
            get = self.known.__getitem__
            for i, words in held:
                out[i] += sum(map(get, words))
            held.clear()
            chars = 0

        for text in texts:
            out.append(0)
            if len(text) > PIECE:
                out[-1] = self._count(text)
                continue
            for piece in self.pieces(text):
                if piece is None:
                    out[-1] += 1
                elif piece:
                    held.append((len(out) - 1, self.pre_tokens(piece)))
                    chars += len(piece)
            if chars > 2 * PIECE:
                flush()
        flush()
        return out


@functools.lru_cache(maxsize=2)
def merger(spec: str) -> RankMerger:
    return RankMerger(spec)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; the vocabulary file is read once, on the driver."""
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the data

    def count(batches):
        m = merger(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = m.count_batch(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    # n_bytes comes with the key, so that nothing is joined back.
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n")).alias("k"), text.alias("t"))
    done = rows.mapInArrow(count, f"doc_id struct<id:{kind},n:bigint>, n_tokens bigint")
    return done.select(
        F.col("doc_id.id").alias("doc_id"),
        F.col("doc_id.n").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
