"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.code import ship

MAX_BROADCAST = 20_000  # query vectors; at 64 doubles each, 10 MB
QUERIES_A_BLOCK, ROWS_A_BLOCK = 1_024, 2_048  # of one product of matrices, 16 MB; packed, 0.5 and 1 MB at 64 doubles a vector
PAIRS = 1 << 16  # whose distances are computed singly at a time
FAR = 4.0  # more than any distance: what rows with another label come after


def top_k(rows: DataFrame, by: str, k: int, rank: str, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank; the order must end in a unique column."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One row a vector, and whether it is missing: null, with a null element or of another length."""
    out, missing = np.full((len(vectors), width), np.nan), np.ones(len(vectors), dtype=bool)
    sizes = np.array(vectors.value_lengths().fill_null(-1), dtype=np.int64)
    good = np.flatnonzero(sizes == width)
    flat = vectors.flatten()
    held = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    start = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))[:-1])) if len(sizes) else np.empty(0, np.int64)
    if width and len(good):
        at = start[good][:, None] + np.arange(width)
        whole = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False))[at].any(axis=1)
        out[good[whole]] = held[at[whole]]
        missing[good[whole]] = False
    return out, missing


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each sum taken from its first product to its last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As the engine's ``round``: half up in the decimal form of a number."""
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        up = np.floor(x * scale + 0.5)
        out = np.where(np.isfinite(x), up / scale, x)
        near = np.flatnonzero(np.isfinite(x) & ((np.abs(x * scale + 0.5 - np.round(x * scale + 0.5)) < 1e-3) | (np.abs(x) * scale > 1e11)))
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids, a missing id first."""
    if ids.dtype != object:
        return ids
    place = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}))}
    return np.array([place.get(x, -1) for x in ids], dtype=np.int64)


class _Nearest:
    """The ``k`` first rows of each query among the rows seen, by own label, rounded distance and id.

    Products of whole blocks tell which pairs can be among the first; only these get the distance of plain sums.
    """

    def __init__(self, queries: np.ndarray, missing: np.ndarray, labels: np.ndarray | None, k: int, digits: int | None, id_down: bool):
        self.q, self.labels, self.k, self.digits, self.down = queries, labels, k, digits, id_down
        self.norm = np.sqrt(_dots(queries, queries))
        self.missing = missing
        self.unit = _unit(queries, self.norm)
        self.margin = 1e-9 + (10.0**-digits if digits is not None else 0.0)
        self.bound = np.full(len(queries), np.nan)
        self.found: tuple[np.ndarray, ...] | None = None

    def add(self, ids: np.ndarray, rows: np.ndarray, missing: np.ndarray, labels: np.ndarray | None) -> None:
        norm = np.sqrt(_dots(rows, rows))
        about = 1 - self.unit @ _unit(rows, norm).T
        if labels is not None:
            about += FAR * (self.labels[:, None] != labels)
        bound = self.bound
        if len(ids) >= self.k and np.isnan(bound).any():
            bound = np.fmin(bound, np.partition(about, self.k - 1, axis=1)[:, self.k - 1])
        q, row = np.nonzero(~(about > (bound + self.margin)[:, None]))
        for i in range(0, len(q), PAIRS):
            self._meet(q[i : i + PAIRS], row[i : i + PAIRS], ids, rows, norm, missing, labels)

    def _meet(self, q: np.ndarray, row: np.ndarray, ids, rows, norm, missing, labels) -> None:
        with np.errstate(all="ignore"):
            size = norm[row] * self.norm[q]
            distance = 1 - _dots(rows[row], self.q[q]) / size
        none = missing[row] | self.missing[q] | (size == 0)
        if self.digits is not None:
            distance = _rounded(distance, self.digits)
        distance[none] = np.nan
        far = (labels[row] != self.labels[q]).astype(np.int8) if labels is not None else np.zeros(len(q), np.int8)
        new = (q, far, none, distance, ids[row])
        if self.found is not None:
            new = tuple(np.concatenate(x) for x in zip(self.found, new))
        q, far, none, distance, seen = new
        place = _order(seen)
        order = np.lexsort((-place if self.down else place, distance, none, far, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[rank < self.k]
        self.found = tuple(x[keep] for x in new)
        last = order[rank == self.k - 1]
        self.bound[new[0][last]] = distance[last] + FAR * far[last]


def _unit(rows: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN, which is always looked at, where the length is none or near the ends of what numbers can be."""
    with np.errstate(all="ignore"):
        return rows / np.where((norm > 1e-100) & (norm < 1e100), norm, np.nan)[:, None]


def _numbers(column: pa.Array) -> np.ndarray:
    plain = pa.types.is_signed_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if plain else np.array([*column.to_pylist(), None], dtype=object)[:-1]


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", digits: int | None = None, label: str | None = None, id_down: bool = False, max_broadcast: int | None = None
) -> DataFrame:
    """``query_id, <id>, distance, far``: the first ``k`` rows of each query in each partition of the corpus, among them those of the whole.

    Rows come by distance and id (falling with ``id_down``); with ``label``, which names a column of the corpus, rows with the
    query's own ``query_label`` come first and have 0 in ``far``. The search is exact: its work is queries times rows, as products of
    matrices. Both sides are packed into blocks of rows first. Blocks of queries are broadcast up to a bound on their number, beyond
    it they are joined by number.
    """
    ship(corpus.sparkSession)
    max_broadcast = max_broadcast or MAX_BROADCAST
    doubles = F.col("embedding").cast("array<double>").alias("_v")
    asked = queries.select("query_id", doubles, *(["query_label"] if label else []))
    rows = corpus.select(F.col(id_col), doubles, *([label] if label else []))
    schema = f"query_id {asked.schema[0].dataType.simpleString()}, `{id_col}` {rows.schema[0].dataType.simpleString()}, distance double, far int"
    blocks, found = -(-queries.count() // max_broadcast), _finder(k, digits, label is not None, id_down)
    packs = rows.mapInArrow(_packer(ROWS_A_BLOCK), "_block bigint, _rows_id string, _rows binary")
    to_packs = _packer(QUERIES_A_BLOCK), "_block bigint, _queries_id string, _queries binary"
    if blocks <= 1:
        met = packs.drop("_block").crossJoin(F.broadcast(asked.coalesce(1).mapInArrow(*to_packs).drop("_block")))
    else:
        dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("bigint")).repartition("_block").mapInArrow(*to_packs)
        every = packs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        met = every.join(dealt, "_block")
    return met.select("_rows", "_queries_id", "_queries").mapInArrow(found, schema)


def _packer(size: int):
    """Rows to blocks of ``size``, of one ``_block`` each if they have such a column, as bytes with an id."""

    def pack(batches):
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(n: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held.pop(n)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_block", "_id", "_data"])

        for batch in batches:
            numbers = batch.column("_block") if "_block" in batch.schema.names else None
            for n in [0] if numbers is None else numbers.unique().to_pylist():
                mine = batch if numbers is None else batch.filter(pc.equal(numbers, n))
                while len(mine):
                    room = size - sum(map(len, held.get(n, [])))
                    held.setdefault(n, []).append(mine.slice(0, room))
                    if len(mine) >= room:
                        yield block(n)
                    mine = mine.slice(room)
        for n in list(held):
            yield block(n)

    return pack


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


class _Queries:
    """One block of queries: a search for each length of its vectors."""

    def __init__(self, block: pa.RecordBatch, k: int, digits: int | None, labelled: bool, id_down: bool):
        self.keys, held = block.column(0), block.column(1)
        self.codes: dict = {}
        own = [self.codes.setdefault(x, len(self.codes)) if x is not None else -2 for x in block.column(2).to_pylist()] if labelled else []
        own = np.array(own, dtype=np.int64)
        lengths = np.array(held.value_lengths().fill_null(0), dtype=np.int64)
        self.searches = []
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            self.searches.append((width, at, _Nearest(*_matrix(held.take(pa.array(at)), width), own[at] if labelled else None, k, digits, id_down)))
        self.labelled = labelled

    def add(self, rows: pa.RecordBatch) -> None:
        self.kind = rows.schema.field(0).type
        labels = np.array([self.codes.get(x, -1) for x in rows.column(2).to_pylist()], dtype=np.int64) if self.labelled else None
        for width, _, search in self.searches:
            search.add(_numbers(rows.column(0)), *_matrix(rows.column(1), width), labels)

    def found(self):
        for _, at, search in self.searches:
            if search.found is not None:
                q, far, none, distance, ids = search.found
                columns = [self.keys.take(pa.array(at[q])), pa.array(ids.tolist(), self.kind), pa.array(distance, pa.float64(), mask=none), pa.array(far, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "distance", "far"])


def _finder(k: int, digits: int | None, labelled: bool, id_down: bool):
    def find(batches):
        blocks: dict[str, _Queries] = {}
        for batch in batches:
            for rows, name, queries in zip(*batch.columns):
                name = name.as_py()
                if name not in blocks:
                    blocks[name] = _Queries(_unpacked(queries.as_buffer()), k, digits, labelled, id_down)
                blocks[name].add(_unpacked(rows.as_buffer()))
        for block in blocks.values():
            yield from block.found()

    return find


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", digits: int | None = None, **more) -> DataFrame:
    """``query_id, <id>, distance, dense_rank``. ``queries`` has query_id and embedding; a zero vector has no distance and ranks last.

    Each partition keeps k rows a query before anything is exchanged.
    """
    pairs = nearest(corpus, queries, k, id_col, digits, **more).drop("far")
    return top_k(pairs, "query_id", k, "dense_rank", F.asc_nulls_last("distance"), F.col(id_col))


def dimension_set(rows: DataFrame, n: int = 20, order: str = "vec_id") -> DataFrame:
    """Distinct vector lengths among the first ``n`` rows."""
    return rows.orderBy(order).limit(n).agg(F.sort_array(F.collect_set(F.size("embedding"))).alias("dims"))
