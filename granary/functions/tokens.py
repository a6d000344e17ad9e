"""Subword tokens of a public vocabulary as column functions, for chunking by tokens."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 18  # characters, or tokens, that the library sees at a time; it takes some 100 bytes for each token
SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: str):
    """The tokenizer, and the numbers of the tokens that start with a blank if texts may be cut there, else None."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    from tokenizers import Tokenizer

    t, whole = Tokenizer.from_str(spec), json.loads(spec)
    step, decoder = whole.get("pre_tokenizer") or {}, whole.get("decoder") or {}
    bytewise = (step.get("type"), decoder.get("type")) == ("ByteLevel", "ByteLevel") and step.get("use_regex", True) and not step.get("add_prefix_space")
    plain = not any(" " in a["content"] or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in whole.get("added_tokens") or [])
    if not (bytewise and plain and not whole.get("normalizer") and not whole.get("post_processor") and not whole.get("truncation") and not whole.get("padding")):
        return t, None
    return t, np.array(sorted(i for k, i in t.get_vocab().items() if k.startswith("Ġ")), dtype=np.int32)


def _cut(text: str) -> list[str]:
    """The text in parts that end where the library always splits; a part is longer than ``PIECE`` only without such a place."""
    out, begin = [], 0
    while len(text) - begin > PIECE:
        cut = SAFE_CUT.search(text, begin + PIECE)
        if cut is None:
            break
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours that have up to ``PIECE`` together, or one that has more."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > PIECE:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _encoded(t, cuttable: bool, texts: list[str]) -> pa.Array:
    parts, owner = [], []
    for i, x in enumerate(texts):
        cut = _cut(x) if cuttable else [x]
        parts += cut
        owner += [i] * len(cut)
    ids, n = [np.empty(0, np.int32)], []
    for a, b in _grouped([len(p) for p in parts]):
        for e in t.encode_batch_fast(parts[a:b], add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.int32))
            n.append(len(ids[-1]))
    ends = np.cumsum(np.bincount(np.array(owner, dtype=np.int64), weights=n, minlength=len(texts)).astype(np.int64)) if texts else []
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(ids)))


def _decoded(t, blanks: np.ndarray | None, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    spans, owner = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while blanks is not None and b - a > PIECE:
            # Before a token that starts with a blank no character is under way.
            at = a + PIECE + np.flatnonzero(np.isin(flat[a + PIECE : b], blanks))[:1]
            if not len(at):
                break
            spans.append((a, int(at[0])))
            owner.append(i)
            a = int(at[0])
        spans.append((a, b))
        owner.append(i)
    out: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    for a, b in _grouped([e - s for s, e in spans]):
        for i, x in zip(owner[a:b], t.decode_batch([flat[s:e].tolist() for s, e in spans[a:b]], skip_special_tokens=False)):
            out[i].append(x)
    return ["".join(x) for x in out]


def bpe(spark: SparkSession, path: str):
    """(encode, decode_all): text to token numbers, and arrays of windows of them to their texts.

    ``path`` names a byte-level vocabulary file of the ``tokenizers`` library, which is read on the driver and broadcast (a few
    MB, whatever the data). No special tokens are added; a null text counts as empty. The library sees a bounded piece at a time,
    of long texts too, so that a worker's memory is that of its batch.
    """
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t, blanks = _tokenizer(spec.value)
        for texts in batches:
            yield _encoded(t, blanks is not None, [x or "" for x in texts.to_pylist()])

    @F.arrow_udf("array<string>")
    def decode_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t, blanks = _tokenizer(spec.value)
        for rows in batches:
            windows = rows.flatten()
            ids = windows.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
            sizes = np.array(windows.value_lengths().fill_null(0), dtype=np.int64)
            texts = _decoded(t, blanks, ids, np.concatenate(([0], np.cumsum(sizes))))
            ends = np.cumsum(np.array(rows.value_lengths().fill_null(0), dtype=np.int64))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(texts, pa.string()))

    return encode, decode_all
