"""Mapping of passages between chunkings, and evidence search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.replies import chunk_id
from granary.functions.text import normalize, overlap_ratio, space_tokens, word_tokens
from granary.operators.chunking import chunk_array
from granary.operators.vectors import top_k
from granary.sources.code import ship

THRESHOLD = 0.52
MAX_TERMS = 10_000  # evidence terms that are broadcast
WORDS, CELLS = 1 << 16, 1 << 22  # words of the source chunks, and cells of a matrix, that are compared at a time
ROWS_OUT = 1 << 17  # pairs that leave Python at a time


def chunk_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of chunks of one document with the share of the source's tokens found in the target."""
    s = source.select("doc_id", F.col("chunk_id").alias("source_id"), F.array_distinct(word_tokens(F.col("text"))).alias("_s"))
    t = target.select("doc_id", F.col("chunk_id").alias("target_id"), "chunk_index", F.array_distinct(word_tokens(F.col("text"))).alias("_t"))
    return s.join(t, "doc_id").select("doc_id", "source_id", "target_id", "chunk_index", overlap_ratio(F.col("_s"), F.col("_t")).alias("overlap_ratio"))


def document_pairs(
    docs: DataFrame, source: tuple[int, int], target: tuple[int, int], least: float = 0.0, most: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``chunk_pairs`` of two chunkings, (size, overlap) each, made where the document is read, with ratios of ``least`` or more.

    With ``most``, the best pairs of each source chunk and their ``rank``. The common words of all pairs are counted by products of
    0/1 matrices, in blocks of source chunks and of target chunks, so that nothing is exchanged and a task holds one document.
    """
    ship(docs.sparkSession)
    words = lambda size: F.transform(chunk_array(F.col("_t"), *size), lambda c: word_tokens(c["text"]))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), space_tokens(normalize(F.col(text_col))).alias("_t"))
    each = rows.select("doc_id", words(source).alias("_source"), words(target).alias("_target"))
    out = each.mapInArrow(_pairs(least, most), "doc_id string, s int, t int, overlap_ratio double, rank int")
    ids = [chunk_id(F.col("doc_id"), F.col(c)).alias(name) for c, name in (("s", "source_id"), ("t", "target_id"))]
    return out.select("doc_id", *ids, F.col("t").alias("chunk_index"), "overlap_ratio", *(["rank"] if most is not None else []))


def _pairs(least: float, most: int | None):
    """Rows of (id, words of each source chunk, words of each target chunk) to pairs of chunks by number."""

    def pairs(batches):
        for batch in batches:
            held, n = [], 0
            texts = [w for w in (batch.column(i).flatten().flatten() for i in (1, 2)) if len(w)]  # an empty array may lack its buffers
            codes = pa.concat_arrays([pa.array([], pa.string()), *texts]).dictionary_encode().indices.to_numpy()
            chunks = [_ends(batch.column(i)) for i in (1, 2)]
            words = [_ends(batch.column(i).flatten()) for i in (1, 2)]
            words[1] += words[0][-1]
            for d in range(len(batch)):
                bounds = [w[c[d] : c[d + 1] + 1] for w, c in zip(words, chunks)]
                for s, t, ratio, rank in common_words(codes, *bounds, least, most):
                    held.append((np.full(len(s), d), s, t, ratio, rank))
                    n += len(s)
                    if n >= ROWS_OUT:
                        yield _pair_rows(batch.column(0), held)
                        held, n = [], 0
            if held:
                yield _pair_rows(batch.column(0), held)

    return pairs


def _ends(lists: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.array(lists.value_lengths().fill_null(0), dtype=np.int64))))


def _pair_rows(ids: pa.Array, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    d, s, t, ratio, rank = map(np.concatenate, zip(*held))
    columns = [ids.take(pa.array(d)), pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(ratio, pa.float64()), pa.array(rank, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "s", "t", "overlap_ratio", "rank"])


def common_words(codes: np.ndarray, source: np.ndarray, target: np.ndarray, least: float, most: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(source, target, ratio, rank) of one document in parts; ``source`` and ``target`` are the borders of chunks in ``codes``."""
    ns, nt = len(source) - 1, len(target) - 1
    if not ns or not nt:
        return
    # Places in the order of ids, whose numbers have four digits at least.
    by_id = np.arange(nt) if nt <= 10_000 else np.array(sorted(range(nt), key=lambda i: f"{i:04d}"))
    t_code, t_chunk = codes[target[0] : target[-1]], np.repeat(np.arange(nt), np.diff(target))
    a = 0
    while a < ns:
        # As many source chunks as have WORDS together, one at least; fewer where there are very many targets.
        b = min(max(int(np.searchsorted(source, source[a] + WORDS, "right")) - 1, a + 1), a + max(1, CELLS // nt), ns)
        known, place = np.unique(codes[source[a] : source[b]], return_inverse=True)
        left = np.zeros((b - a, max(len(known), 1)), dtype=np.float32)
        left[np.repeat(np.arange(b - a), np.diff(source[a : b + 1])), place] = 1
        count = np.zeros((b - a, nt), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, t_code), len(known) - 1)
            hit = known[at] == t_code
            step = max(1, CELLS // len(known))
            for c in range(0, nt, step):
                lo, hi = target[c] - target[0], target[min(c + step, nt)] - target[0]
                mine = hit[lo:hi]
                right = np.zeros((min(c + step, nt) - c, len(known)), dtype=np.float32)
                right[t_chunk[lo:hi][mine] - c, at[lo:hi][mine]] = 1
                count[:, c : c + step] = np.rint(left @ right.T)
        n = left.sum(axis=1, dtype=np.float64)[:, None]
        ratio = np.divide(count, n, out=np.zeros(count.shape), where=n > 0)
        if most is None:
            s, t = np.nonzero(ratio >= least)
            rank = np.zeros(len(s), dtype=np.int64)
        else:
            best = by_id[np.argsort(-count[:, by_id], axis=1, kind="stable")[:, :most]]
            good = np.take_along_axis(ratio, best, axis=1) >= least
            s, rank = np.nonzero(good)
            t = best[s, rank]
        yield s + a, t, ratio[s, t], rank + 1
        a = b


def overlap_mapping(source: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return chunk_pairs(source, target).where(F.col("overlap_ratio") >= threshold)


def overlap_topn(source: DataFrame, target: DataFrame, n: int = 10) -> DataFrame:
    return top_k(chunk_pairs(source, target), "source_id", n, "rank", F.desc("overlap_ratio"), F.col("target_id"))


def candidates_of_questions(questions: DataFrame, source: DataFrame, target: DataFrame, n: int = 10) -> DataFrame:
    """The best ``n`` targets of each chunk that a question names: ``id, source_id, target_id, overlap_ratio, rank``.

    A run fails on a chunk that ``source`` does not hold.
    """
    each = questions.select("id", F.explode("relevant_chunk_ids").alias("source_id")).distinct()
    known = source.select(F.col("chunk_id").alias("source_id"), F.lit(True).alias("_there"))
    unknown = F.raise_error(F.concat(F.lit("unknown chunk "), F.col("source_id")))
    each = each.join(known, "source_id", "left").withColumn("source_id", F.when(F.col("_there").isNull(), unknown).otherwise(F.col("source_id")))
    return each.drop("_there").join(overlap_topn(source, target, n), "source_id").select("id", "source_id", "target_id", "overlap_ratio", "rank")


def mapping_of_questions(questions: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each question the distinct targets of its chunks, in the order of the chunks and of falling overlap."""
    each = questions.select("id", F.posexplode_outer("relevant_chunk_ids").alias("pos", "source_id"))
    found = each.join(mapping.select("source_id", "target_id", "overlap_ratio"), "source_id", "left")
    item = F.when(F.col("target_id").isNotNull(), F.struct("pos", (-F.col("overlap_ratio")).alias("o"), "target_id"))
    grouped = found.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    return grouped.select("id", F.array_distinct(F.transform("m", lambda x: x["target_id"])).alias("mapped_relevant_chunk_ids"))


def overlaid(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped ids in place of ``relevant_chunk_ids`` where a question is mapped; the original ids stay beside them."""
    m = mapping.select("id", "mapped_relevant_chunk_ids")
    joined = results.join(m, "id", "left").withColumn("original_relevant_chunk_ids", F.col("relevant_chunk_ids"))
    return joined.withColumn("relevant_chunk_ids", F.coalesce("mapped_relevant_chunk_ids", "relevant_chunk_ids")).drop("mapped_relevant_chunk_ids")


def claim_evidence(chunks: DataFrame, claims: DataFrame, context: int = 220) -> DataFrame:
    """First occurrence of each evidence term in each chunk: ``claim, term, chunk_id, snippet``.

    Each chunk is searched for every term. Terms are broadcast up to a counted bound, beyond it in blocks of that size.
    """
    terms = claims.select("claim", F.explode("evidence_terms").alias("term"))
    blocks = -(-terms.count() // MAX_TERMS)
    if blocks <= 1:
        pairs = chunks.select("chunk_id", "text").crossJoin(F.broadcast(terms))
    else:
        dealt = terms.withColumn("_block", F.pmod(F.xxhash64("claim", "term"), F.lit(blocks)))
        every = chunks.select("chunk_id", "text", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("_block"))
        pairs = every.join(dealt, "_block").drop("_block")
    at = F.position(F.lower("term"), F.lower("text"))
    found = pairs.withColumn("_at", at).where("_at > 0")
    begin = F.greatest(F.col("_at") - 1 - context, F.lit(0))
    end = F.least(F.col("_at") - 1 + F.char_length("term") + context, F.char_length("text"))
    return found.select("claim", "term", "chunk_id", F.substr("text", begin + 1, end - begin).alias("snippet"))


def claim_status(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """``claim, n_terms_found, n_chunks, status``; a claim without evidence is likely not grounded."""
    found = claim_evidence(chunks, claims).groupBy("claim").agg(
        F.countDistinct("term").alias("n_terms_found"), F.countDistinct("chunk_id").alias("n_chunks")
    )
    out = claims.select("claim").join(found, "claim", "left")
    status = F.when(F.col("n_terms_found").isNull(), "likely not grounded").otherwise("evidence found")
    return out.select("claim", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_terms_found", "n_chunks")], status.alias("status"))
