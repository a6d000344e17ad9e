"""Removal of passages that repeat across documents, by distributed sorting of suffixes cut at the wanted length.

A byte goes when a string of ``SPAN`` bytes covers it that also starts in a document with a smaller id. Steps:

1. Whole copies of a text are answered by the copy with the smallest id and leave.
2. The other documents are packed in blocks. Every window of ``SPAN`` bytes has an anchor, the least hash of the ``GRAM``-byte
   strings in it, which depends on the window's bytes alone. Neighbouring windows mostly share theirs, so the windows of a
   document fall into short runs with one anchor. Each block sends its distinct anchors, sorted and difference-coded, with the
   number of their runs; anchors seen in one document only come back unmarked and their windows leave. This filter loses no
   repeated window. Anchors of more than ``HOT`` runs come back as hot: their windows are exchanged one by one by a hash of all
   their bytes, so that a phrase that stands between other words in each document is spread over all receivers.
3. Windows with marked anchors are exchanged by anchor. The overlapping windows of one run travel as one region, their common
   text once, which is smaller than front-coded suffixes would be (see README); regions that are equal travel once a block.
4. Each receiver takes its windows in shares by anchor, sorts those of groups of blocks into runs with the length of
   the prefix that each shares with the one before, and merges the runs with a loser tree that decides by these lengths and looks at bytes only beyond what is known
   to be equal. Equal windows get the smallest id. One bit a window goes back to its block.
5. Blocks cut the covered bytes.

Edge cases: null texts count as empty; a null id ranks above all ids; rows that share an id do not remove each other's
text; texts shorter than ``SPAN`` lose nothing; an empty table gives an empty result. A document must fit in a worker.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, ship, table

SPAN, GRAM = 50, 25
BLOCK = 4 << 20  # bytes of text in a block
SHARE = 8 << 20  # bytes of text whose windows are sorted together; a receiving group takes some shares one after the other
SLICE = 1 << 17  # windows hashed at a time
MARKED = 1 << 16  # runs of windows marked at a time
RUNS = 16
HOT = 20_000  # runs of one anchor that a receiver takes together; some 2 kB each
SALTS = 32
LAST = (1 << 63) - 1
BROADCAST_IDS = 500_000  # copies to drop; an id and a digest, some 80 bytes each


@functools.lru_cache(maxsize=1)
def _byte_hashes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    return x


def _doubled(x: np.ndarray, n: int, both) -> np.ndarray:
    """Folds every ``n`` neighbours by powers of two, for an operation that needs no order of evaluation."""
    powers, have = {1: x}, 1
    while have * 2 <= n:
        powers[have * 2] = both(powers[have][: len(powers[have]) - have], powers[have][have:])
        have *= 2
    out, at, need = powers[have], have, n - have
    while need:
        p = 1 << (need.bit_length() - 1)
        count = len(x) - at - p + 1
        out = both(out[:count], powers[p][at : at + count])
        at, need = at + p, need - p
    return out


def anchor_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, anchors) of the runs of windows of one document's bytes."""
    total = len(data) - SPAN + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    starts, anchors = [], []
    for lo in range(0, total, SLICE):
        part = _byte_hashes()[data[lo : min(lo + SLICE, total) + SPAN - 1]]
        grams = _doubled(part, GRAM, _join_hash)
        grams = (grams * np.uint64(0xBF58476D1CE4E5B9)) ^ (grams >> np.uint64(32))
        least = _sliding_min(grams, SPAN - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        starts.append(first + lo)
        anchors.append(least[first])
    start, anchor = np.concatenate(starts), np.concatenate(anchors)
    fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    start, anchor = start[fresh], anchor[fresh]
    return start, np.diff(np.append(start, total)), anchor


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = n - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Block:
    """Documents of one block: ids, offsets and bytes, with their anchor runs."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.ids, self.offsets, self.data = ids, offsets, data
        starts, lengths, anchors, owner = [], [], [], []
        for i in range(len(ids)):
            s, n, a = anchor_runs(data[offsets[i] : offsets[i + 1]])
            starts.append(s + offsets[i])
            lengths.append(n)
            anchors.append(a)
            owner.append(np.full(len(s), i))
        self.start, self.length, self.anchor, self.owner = (
            np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, anchors, owner)
        )
        order = np.argsort(self.anchor, kind="stable")
        a = self.anchor[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)
        self.distinct = a[first].astype(np.uint64)
        self.times = np.diff(np.append(first, len(a))).astype(np.uint64)
        self.which = np.empty(len(a), np.int64)  # of each run, the place of its anchor among the distinct ones
        self.which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        who = self.ids[self.owner[order]] if len(a) else np.empty(0, np.int64)
        self.several = (
            np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first) if len(first) else np.empty(0, bool)
        )

    def split(self, marked: np.ndarray, hot: np.ndarray):
        """(starts, lengths, owners, anchors) of the runs with marked anchors; those with hot anchors are cut into their windows."""
        runs = np.flatnonzero(marked[self.which])
        cool, warm = runs[~hot[self.which[runs]]], runs[hot[self.which[runs]]]
        n = self.length[warm]
        each = np.repeat(self.start[warm] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        data = self.data.tobytes() if len(each) else b""
        hashes = np.array([xxhash.xxh3_64_intdigest(data[s : s + SPAN]) for s in each.tolist()], np.uint64)
        return (
            np.concatenate((self.start[cool], each)), np.concatenate((self.length[cool], np.ones(len(each), np.int64))),
            np.concatenate((self.owner[cool], np.repeat(self.owner[warm], n))), np.concatenate((self.anchor[cool].astype(np.uint64), hashes)),
        )

    def regions(self, marked: np.ndarray, hot: np.ndarray):
        """The runs of ``split``, and their regions: (runs, region number of each, distinct regions as bytes, smallest id, anchor)."""
        runs = self.split(marked, hot)
        start, length, owner, anchors = runs
        raw = self.data.tobytes()
        seen: dict[bytes, int] = {}
        at = np.empty(len(start), np.int64)
        for j, (s, n) in enumerate(zip(start.tolist(), length.tolist())):
            at[j] = seen.setdefault(raw[s : s + n + SPAN - 1], len(seen))
        least = np.full(len(seen), LAST, np.int64)
        np.minimum.at(least, at, self.ids[owner])
        anchor = np.zeros(len(seen), np.uint64)
        anchor[at] = anchors
        return runs, at, list(seen), least, anchor


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; the planes of the high bytes are nearly free."""
    head = np.array([len(arrays), *[len(a) for a in arrays], *[a.itemsize for a in arrays]], dtype=np.int64).tobytes()
    body = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    """Unsigned arrays of 1 or 8 bytes an element."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:].tolist()
    out, at = [], 8 * (1 + 2 * n)
    for count, width in zip(head[:n], head[n:]):
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 8: np.uint64}[width]).reshape(count))
        at += count * width
    return out


def _deal(total: int) -> tuple[int, int]:
    """Receiving groups, and shares of each, for so many bytes of text.

    Every block sends a row to every group, so that rows are blocks times groups; a group's bytes are in memory together.
    Beyond some GB both the groups and their shares grow with the square root of the text.
    """
    parts, subs = 64, 2
    while parts * subs * SHARE < total:
        if parts <= 512 * subs:
            parts *= 2
        else:
            subs *= 2
    return parts, subs


def _by_part(anchors: np.ndarray, parts: int, subs: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part that occurs, the places of its anchors, share by share, and the size of each share; from one sort for all parts."""
    key = anchors % np.uint64(parts * subs)
    key = (key % np.uint64(parts)) * np.uint64(subs) + key // np.uint64(parts)
    size = np.bincount(key.astype(np.int64), minlength=parts * subs).reshape(parts, subs)
    order = np.argsort(key.astype(np.uint16 if parts * subs <= 1 << 16 else np.uint64), kind="stable")
    end = np.cumsum(size.sum(axis=1))
    return {p: (order[end[p] - size[p].sum() : end[p]], size[p]) for p in np.flatnonzero(size.any(axis=1)).tolist()}


def merge_runs(keys: list[list[int]], shared: list[list[int]], width: int = SPAN) -> tuple[list[int], list[int]]:
    """Merges sorted runs of big-endian integers of ``width`` bytes with a loser tree.

    ``shared`` has, for each key, the bytes in common with the one before it in its run. Returns the run of each output and
    the bytes it has in common with the output before. A match looks at bytes only when both sides share equally much with
    the last output, and then only finds what they share beyond.
    """
    k = 1
    while k < len(keys):
        k *= 2
    bits = 8 * width
    runs = [iter(zip(r, s)) for r, s in zip(keys, shared)] + [iter(())] * (k - len(keys))
    key, common = [0] * k, [0] * k

    def load(r: int) -> None:
        step = next(runs[r], None)
        if step is None:
            common[r] = -1
        else:
            key[r], common[r] = step

    for r in range(k):
        load(r)
        common[r] = min(common[r], 0)
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        if common[a] < 0:
            return a, b
        x = key[a] ^ key[b]
        if key[b] < key[a]:
            a, b = b, a
        common[b] = (bits - x.bit_length()) >> 3
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, loser[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1) if k > 1 else 0
    out_run, out_common = [], []
    put_run, put_common = out_run.append, out_common.append
    while common[winner] >= 0:
        w = winner
        put_run(w)
        put_common(common[w])
        step = next(runs[w], None)
        if step is None:
            c = common[w] = -1
        else:
            key[w], c = step
            common[w] = c
        node = (w + k) >> 1
        while node:
            other = loser[node]
            d = common[other]
            if d > c:
                loser[node], w, c = w, other, d
            elif d == c and c >= 0:
                a, b = key[w], key[other]
                n = (bits - (a ^ b).bit_length()) >> 3
                if b < a:
                    common[w] = n
                    loser[node], w = w, other
                else:
                    common[other] = n
            node >>= 1
        winner = w
    return out_run, out_common


def smallest_ids(regions: list[bytes], ids: np.ndarray, run_of: np.ndarray) -> np.ndarray:
    """The smallest id among all equal windows, for each window of each region in order."""
    windows = np.array([len(r) - SPAN + 1 for r in regions], np.int64)
    data = np.frombuffer(b"".join(regions), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    begin = np.concatenate(([0], np.cumsum(windows + SPAN - 1)[:-1]))
    first = np.concatenate(([0], np.cumsum(windows)[:-1]))
    place = np.arange(windows.sum()) + np.repeat(begin - first, windows)  # of each window in the joined bytes
    owner = np.repeat(ids, windows)
    run = np.repeat(run_of, windows)
    keys, shared, members, least = [], [], [], []
    for r in range(RUNS):
        mine = np.flatnonzero(run == r)
        if not len(mine):
            continue
        rows = view[place[mine]]
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{SPAN}").reshape(-1), kind="stable")
        rows, mine = rows[order], mine[order]
        differs = rows[1:] != rows[:-1]
        common = np.concatenate(([0], np.where(differs.any(axis=1), differs.argmax(axis=1), SPAN)))
        head = np.flatnonzero(common < SPAN)
        raw = rows[head].tobytes()
        keys.append([int.from_bytes(raw[i : i + SPAN]) for i in range(0, len(raw), SPAN)])
        shared.append(common[head].tolist())
        least.append(np.minimum.reduceat(owner[mine], head))
        members.append((mine, np.cumsum(common < SPAN) - 1))
    out = np.full(len(owner), LAST, np.int64)
    if not keys:
        return out
    which, common = merge_runs(keys, shared)
    which, same = np.array(which), np.array(common) == SPAN
    group = np.cumsum(~same) - 1
    # The n-th output of a run is its n-th key.
    merged = np.full(group[-1] + 1, LAST, np.int64)
    spots = [np.flatnonzero(which == r) for r in range(len(keys))]
    for spot, low in zip(spots, least):
        np.minimum.at(merged, group[spot], low)
    for spot, (mine, key_of) in zip(spots, members):
        out[mine] = merged[group[spot]][key_of]
    return out


def _pack_blocks(batches):
    """Rows (id, text) to blocks (ids, offsets, compressed bytes)."""
    ids, texts, size = [], [], 0

    def block():
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        return np.array(ids, np.int64), offsets, b"".join(texts)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= BLOCK:
                yield block()
                ids, texts, size = [], [], 0
    if ids:
        yield block()


def _open_block(ids: bytes, offsets: bytes, text: bytes) -> Block:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if text else np.empty(0, np.uint8)
    return Block(np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64), data)


def _marks(block: Block, parts: int, replies: list) -> tuple[np.ndarray, np.ndarray]:
    """Which of the block's distinct anchors are marked and which are hot."""
    marked, hot = np.zeros(len(block.distinct), bool), np.zeros(len(block.distinct), bool)
    places = _by_part(block.distinct, parts) if replies else {}
    for m in replies or []:
        at, _ = places[m["part"]]
        both = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=2 * len(at)).astype(bool)
        marked[at], hot[at] = both[: len(at)], both[len(at) :]
    return marked, hot


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))


def _removed_unique(docs: DataFrame, parts: int, subs: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for documents (did, text as bytes) without whole copies."""

    def scan(batches):
        for ids, offsets, raw in _pack_blocks(batches):
            name = uuid.uuid4().hex  # the rows are written before any use, so the name stays
            zipped = zstandard.ZstdCompressor(level=6).compress(raw) if raw else b""
            block = Block(ids, offsets, np.frombuffer(raw, np.uint8))
            out = [(name, -1, zipped, ids.tobytes(), offsets.tobytes())]
            for p, (mine, _) in _by_part(block.distinct, parts).items():
                coded = np.diff(block.distinct[mine], prepend=np.uint64(0))
                out.append((name, p, _pack(coded, np.packbits(block.several[mine]), block.times[mine]), None, None))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                names=["block", "part", "body", "ids", "offsets"],
            )

    scanned = scratch.write(docs.mapInArrow(scan, "block string, part int, body binary, ids binary, offsets binary"))
    blocks = scanned.where("part < 0").select("block", "body", "ids", "offsets")

    def mark(key, frame):
        import pandas as pd

        lists, several, times = [], [], []
        for body in frame["body"]:
            coded, flags, runs = _unpack(body)
            times.append(runs)
            lists.append(np.cumsum(coded, dtype=np.uint64))
            several.append(np.unpackbits(flags, count=len(coded)).astype(bool))
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        a = every[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        count = np.diff(np.append(first, len(a)))
        many = (count > 1) | np.logical_or.reduceat(np.concatenate(several)[order], first)
        hot = many & (np.add.reduceat(np.concatenate(times)[order], first) > HOT)
        flag = np.empty((2, len(a)), bool)
        flag[:, order] = np.repeat(np.stack((many, hot)), count, axis=1)
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(flag, cuts, axis=1)]
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "bits": bits})

    replies = scratch.write(
        scanned.where("part >= 0").select("block", "part", "body").groupBy("part").applyInPandas(mark, "block string, part int, bits binary")
    )

    def send(batches):
        for batch in batches:
            for name, body, ids, offsets, marks in zip(*(batch.column(i).to_pylist() for i in range(5))):
                block = _open_block(ids, offsets, body)
                _, _, regions, least, anchor = block.regions(*_marks(block, parts, marks))
                out = []
                for p, (mine, shares) in _by_part(anchor, parts, subs).items():
                    own = [regions[i] for i in mine.tolist()]
                    text, size = np.frombuffer(b"".join(own), np.uint8), np.array([len(r) for r in own], np.uint64)
                    out.append((name, p, _pack(text, size, least[mine].view(np.uint64), shares.astype(np.uint64))))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "part", "body"]
                    )

    sent = blocks.join(_grouped(replies), "block", "left").select("block", "body", "ids", "offsets", "replies")
    sent = sent.mapInArrow(send, "block string, part int, body binary")

    def settle(key, frame):
        import pandas as pd

        frame = frame.sort_values("block")
        opened = []
        for body in frame["body"]:
            text, size, least, shares = _unpack(body)
            last = np.cumsum(shares).tolist()
            byte = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            opened.append((text, byte, size.tolist(), least.view(np.int64), [0, *last]))
        found: list[list[np.ndarray]] = [[] for _ in opened]
        for sub in range(subs):
            regions: dict[bytes, int] = {}
            ids: list[int] = []
            run_of: list[int] = []
            mine = []
            for turn, (text, byte, size, least, cuts) in enumerate(opened):
                lo, hi = cuts[sub], cuts[sub + 1]
                raw, at, own = text[byte[lo] : byte[hi]].tobytes(), 0, []
                for n, d in zip(size[lo:hi], least[lo:hi].tolist()):
                    r = regions.setdefault(raw[at : at + n], len(regions))
                    at += n
                    if r == len(ids):
                        ids.append(d)
                        run_of.append(turn * RUNS // len(opened))
                    elif d < ids[r]:
                        ids[r] = d
                    own.append(r)
                mine.append((np.array(own, np.int64), least[lo:hi]))
            if not regions:
                continue
            every = list(regions)
            low = smallest_ids(every, np.array(ids, np.int64), np.array(run_of, np.int64))
            windows = np.array([len(r) - SPAN + 1 for r in every], np.int64)
            first = np.concatenate(([0], np.cumsum(windows)[:-1]))
            for hits, (own, least) in zip(found, mine):
                n = windows[own]
                inside = np.arange(n.sum()) + np.repeat(first[own] - np.concatenate(([0], np.cumsum(n)))[:-1], n)
                hits.append(low[inside] < np.repeat(least, n))
        bits = [zstandard.ZstdCompressor(level=1).compress(np.packbits(np.concatenate(hits)).tobytes()) for hits in found]
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "bits": bits})

    settled = scratch.write(sent.groupBy("part").applyInPandas(settle, "block string, part int, bits binary"))

    def cut(batches):
        for batch in batches:
            for body, ids, offsets, marks, hits in zip(*(batch.column(i).to_pylist() for i in range(5))):
                block = _open_block(ids, offsets, body)
                runs, at, regions, least, anchor = block.regions(*_marks(block, parts, marks))
                windows = np.array([len(r) - SPAN + 1 for r in regions], np.int64)
                first = np.concatenate(([0], np.cumsum(windows)[:-1])).astype(np.int64)
                hit = np.zeros(int(windows.sum()), bool)
                places = _by_part(anchor, parts, subs)
                for h in hits or []:
                    own, _ = places[h["part"]]
                    n = windows[own]
                    inside = np.arange(n.sum()) + np.repeat(first[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                    raw = zstandard.ZstdDecompressor().decompress(h["bits"])
                    hit[inside] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(inside)).astype(bool)
                gone = np.zeros(len(block.data) + 1, np.int32)
                for lo in range(0, len(at), MARKED):
                    start, n, owner = (x[lo : lo + MARKED] for x in runs[:3])
                    region = at[lo : lo + MARKED]
                    before = np.cumsum(n) - n
                    here = np.arange(n.sum()) + np.repeat(start - before, n)
                    same = np.arange(n.sum()) + np.repeat(first[region] - before, n)
                    starts = here[hit[same] | np.repeat(block.ids[owner] > least[region], n)]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + SPAN, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out = []
                for i, d in enumerate(block.ids.tolist()):
                    lo, hi = block.offsets[i], block.offsets[i + 1]
                    g = gone[lo:hi]
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    kept = block.data[lo:hi][~g].tobytes()
                    out.append((None if d == LAST else d, int(hi - lo), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    hits = settled.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("hits"))
    both = blocks.join(_grouped(replies), "block", "left").join(hits, "block", "left").select("body", "ids", "offsets", "replies", "hits")
    return both.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("did"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")
    )
    keys = scratch.write(rows.select("did", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").cast("bigint").alias("n")))
    # By salts first, and met by salts, since one text may be a third of all.
    salted = keys.withColumn("s", F.pmod(F.xxhash64("did"), F.lit(SALTS)).cast("int"))
    dealt = salted.groupBy("sha", "s").agg(F.min("did").alias("lo"), F.max("did").alias("hi"))
    groups = dealt.groupBy("sha").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("s").alias("ss")).where("lo < hi")
    groups = scratch.write(groups.select("sha", "lo", F.explode("ss").alias("s")))
    copies = scratch.write(salted.join(groups, ["sha", "s"]).where("did > lo").select("did", "sha", "n"))
    n_copies, total = copies.count(), keys.agg(F.sum("n")).first()[0] or 0
    drop = copies.select(F.col("did").alias("d"), F.col("sha").alias("h")).distinct()
    if n_copies <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    unique = rows.join(drop, (F.col("did") == F.col("d")) & (F.unhex(F.sha2("text", 256)) == F.col("h")), "left_anti")
    kept = F.when(F.col("n") < SPAN, F.lower(F.hex("sha"))).otherwise(F.lit(hashlib.sha256(b"").hexdigest()))
    answered = copies.select(
        F.when(F.col("did") != LAST, F.col("did")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(F.col("n") < SPAN, 0).otherwise(F.col("n")).cast("bigint").alias("n_removed"),
        F.when(F.col("n") < SPAN, 0).otherwise(1).cast("bigint").alias("n_spans"),
        kept.alias("kept_sha256"),
    )
    return _removed_unique(unique, *_deal(total), scratch).unionByName(answered)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; a window is 100 of them from an even place on, told apart by 128-bit digests.
#: Texts are cut in blocks of 2,048 bytes, each with the 49 that follow, since taking a part far inside a long text is slow.
OP5_SQL = """
WITH d AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS x FROM documents),
q AS (SELECT doc_id, b, substr(x, 4096 * b + 1, 4194) AS x FROM (SELECT doc_id, x, unnest(range(0, len(x) // 4096 + 1)) AS b FROM d)),
w AS (SELECT doc_id, 2048 * b + i AS i, md5_number(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, b, x, unnest(range(0, least(2048, len(x) // 2 - 49))) AS i FROM q)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM w),
g AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER v + 50, -1) THEN 1 ELSE 0 END AS fresh FROM m WHERE lo < doc_id WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
p AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS z FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(x[2 * z + 1 : 2 * a], '' ORDER BY k) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
