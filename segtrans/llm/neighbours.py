"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, floats for what they leave open.

1. Vectors are packed into blocks of rows. Candidates are dealt to bands and
   queries to groups, both by a hash; every pair of a band and a group is a cell,
   so a block of candidates goes to one cell per group and a block of queries to
   one per band. Cells are met by number, not by value.
2. A task reads the queries of a cell first and then streams its candidates. A
   tile is the product of two int8 matrices, which is exact; the norms of what
   rounding took away bound the error of each squared distance from both sides.
   A pair stays if its lower bound is not above the query's tenth best so far.
3. Pairs that stay are recomputed from the vectors as they are, in double
   precision, into a heap of the ten nearest for each query. The heaps of all
   bands are merged by one ranked window, ten rows a query and cell.

No pair is lost: a pair is left out only where the bounds prove it farther than
ten others. So the result is that of comparing every query with every row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024  # rows of a tile, at most, on either side
EXACT = 1024  # so many products of two int8 numbers are exact when summed as float32
SLACK = 1e-9  # of the sum of the squared norms, for the rounding of the bounds themselves
BAND_BYTES = 256 << 20  # of candidate vectors in a band
GROUP_BYTES = 16 << 20  # of query vectors in a group: these are held at once
MOST_TASKS = 20_000
PAIRS = 1 << 16  # recomputed at once
BLOCKS = "band int, size int, ids binary, marks binary, vectors binary"


def usable(vectors: pa.Array, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vector, the rows that take part and their matrix.

    Vectors that are null, empty, zero or hold a null or non-finite component do not.
    """
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    bare = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        found = bare[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(found).all(axis=1) & found.any(axis=1)
        if good.any():
            yield rows[good], found[good]


def fewer_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep so that of equal vectors the ``k + 1`` smallest ids are left, each once.

    Equal vectors are equally near to every query, and of those the smaller ids win;
    one more than ``k``, because one of them may be the query itself.
    """
    as_bytes = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, kind = np.unique(as_bytes, return_inverse=True)
    order = np.lexsort((ids, kind))
    kind, ids = kind[order], ids[order]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])]
    order, kind = order[new], kind[new]
    first = np.r_[True, kind[1:] != kind[:-1]]
    place = np.arange(len(kind)) - np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
    return np.sort(order[place <= k])


def _packer(dtype: type, k: int | None):
    """Rows ``(id, mark, band, vector)`` to blocks; with ``k``, copies that cannot matter are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, bands = (batch.column(c).to_numpy() for c in ("id", "mark", "band"))
            out: list[tuple] = []
            for rows, found in usable(batch.column("vector"), dtype):
                if k is not None:
                    kept = fewer_copies(ids[rows], found, k)
                    rows, found = rows[kept], found[kept]
                order = np.argsort(bands[rows], kind="stable")
                rows, found = rows[order], found[order]
                cuts = np.flatnonzero(np.diff(bands[rows])) + 1
                for start, end in zip([0, *cuts], [*cuts, len(rows)]):
                    for at in range(start, end, BLOCK):
                        part = rows[at:min(at + BLOCK, end)]
                        out.append((int(bands[part[0]]), found.shape[1], ids[part].tobytes(), marks[part].tobytes(),
                                    found[at:at + len(part)].tobytes()))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["band", "size", "ids", "marks", "vectors"])

    return pack


class Coded:
    """Vectors as int8 codes with a scale each, and the norms that bound what the codes leave out."""

    def __init__(self, exact: np.ndarray):
        self.exact = exact.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            self.scale = np.maximum(np.abs(self.exact).max(axis=1) / 127, np.finfo(np.float64).tiny)
            codes = np.rint(self.exact / self.scale[:, None])
            near = codes * self.scale[:, None]
            self.codes = codes.astype(np.int8)
            self.square = (self.exact**2).sum(axis=1)
            self.near = np.sqrt((near**2).sum(axis=1))
            self.rest = np.sqrt(((self.exact - near) ** 2).sum(axis=1))

    def part(self, at: int) -> Coded:
        some = Coded.__new__(Coded)
        for name, value in vars(self).items():
            setattr(some, name, value[at:at + BLOCK])
        return some


def tile(a: Coded, b: Coded) -> np.ndarray:
    """Products of all rows of ``a`` with all of ``b``: sums of at most 2**24, so float32 holds them exactly."""
    total = np.zeros((len(a.codes), len(b.codes)))
    for at in range(0, a.codes.shape[1], EXACT):
        total += a.codes[:, at:at + EXACT].astype(np.float32) @ b.codes[:, at:at + EXACT].astype(np.float32).T
    return total


def bounds(a: Coded, b: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of all rows of ``a`` and ``b``."""
    with np.errstate(over="ignore", invalid="ignore"):
        dot = tile(a, b) * a.scale[:, None] * b.scale
        error = np.multiply.outer(a.near + a.rest, b.rest) + np.multiply.outer(a.rest, b.near)
        squares = np.add.outer(a.square, b.square)
        middle, slack = squares - 2 * dot, 2 * error + SLACK * squares
        return middle - slack, middle + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of ``a`` from those of ``b``; components are summed in their order."""
    apart = np.ascontiguousarray((a - b).T)
    with np.errstate(over="ignore"):
        return np.sqrt(np.add.reduce(apart * apart, axis=0))


class Cell:
    """The queries of one cell, of one length of vector, and the nearest rows found for each."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.marks, self.k = ids, marks, k
        self.queries = Coded(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # negated, so the farthest is on top
        self.limit = np.full(len(ids), np.inf)  # squared; nothing beyond can be among the nearest
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.waiting.append((ids, vectors))
        if sum(len(w[0]) for w in self.waiting) >= BLOCK:
            self.meet()

    def meet(self) -> None:
        if not self.waiting:
            return
        ids, vectors = map(np.concatenate, zip(*self.waiting))
        self.waiting = []
        candidates = Coded(vectors)
        for b in range(0, len(ids), BLOCK):
            for a in range(0, len(self.ids), BLOCK):
                self._tile(a, ids[b:b + BLOCK], candidates.part(b))

    def _tile(self, a: int, ids: np.ndarray, candidates: Coded) -> None:
        limit = self.limit[a:a + BLOCK]
        low, high = bounds(self.queries.part(a), candidates)
        own = self.ids[a:a + BLOCK, None] == ids
        high[own] = np.inf
        if len(ids) >= self.k:
            np.fmin(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1], out=limit)
        rows, columns = np.nonzero(~(low > limit[:, None]) & ~own)
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at:at + PAIRS] + a, columns[at:at + PAIRS]
            scores = distances(self.queries.exact[r], candidates.exact[c])
            for row, score, vec_id in zip(r.tolist(), scores.tolist(), ids[c].tolist()):
                heap, found = self.heaps[row], (-score, -vec_id)
                if len(heap) < self.k:
                    if found not in heap:
                        heapq.heappush(heap, found)
                elif found > heap[0] and found not in heap:
                    heapq.heapreplace(heap, found)
        for row in np.unique(rows) + a:
            if len(self.heaps[row]) == self.k:
                self.limit[row] = min(self.limit[row], self.heaps[row][0][0] ** 2 * (1 + SLACK))

    def found(self) -> Iterator[tuple[int, int, int, float]]:
        self.meet()
        for mark, query_id, heap in zip(self.marks.tolist(), self.ids.tolist(), self.heaps):
            for score, vec_id in heap:
                yield mark, query_id, -vec_id, -score


FOUND = "mark long, query_id long, vec_id long, score double"


def _meeter(dtype: type, k: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        waiting: dict[int, list[tuple]] = {}
        cells: dict[int, Cell] = {}

        def results() -> Iterator[pa.RecordBatch]:
            for cell in cells.values():
                columns = list(zip(*cell.found())) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["mark", "query_id", "vec_id", "score"])
            cells.clear()
            waiting.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                number, candidate, size, ids, marks, vectors = (column[i].as_py() for column in batch.columns)
                if number != now:
                    yield from results()
                    now = number
                block = (np.frombuffer(ids, np.int64), np.frombuffer(marks, np.int64),
                         np.frombuffer(vectors, dtype).reshape(-1, size))
                if not candidate:
                    waiting.setdefault(size, []).append(block)
                    continue
                if size in waiting:
                    cells[size] = Cell(*map(np.concatenate, zip(*waiting.pop(size))), k)
                if size in cells:
                    cells[size].add(block[0], block[2])
        yield from results()

    return meet


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            band_bytes: int = BAND_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each row whose id ``every`` divides.

    Distances are Euclidean, in double precision, components summed in order;
    ties go to the smaller id. Vectors that are null, empty or zero or hold a
    null or non-finite component take no part, nor do rows without an id; only
    vectors of one length are compared. A row is not a candidate of queries with
    its own id. Rows equal in id and vector count once, as query and as
    candidate; one id with several vectors is as many queries. A query with
    fewer than ``k`` candidates gets those there are, with none no row. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype = np.float32 if single else np.float64
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    queries = written(
        rows.where((F.col("id") % every == 0) & F.col("vector").isNotNull()).distinct()
        .withColumn("mark", F.monotonically_increasing_id()), "queries")
    width = np.dtype(dtype).itemsize * F.size("vector").cast("long")
    (n, size), n_queries = rows.agg(F.count("vector"), F.coalesce(F.sum(width), F.lit(0))).first(), queries.count()
    # Bands and groups follow the bytes; there are at least as many bands as keep all cores busy.
    bands = max(-(-size // band_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK)), 1)
    groups = max(-(-n_queries * size // max(n, 1) // group_bytes), 1)

    def blocks(df: DataFrame, dealt: int, copies: int, cell, k: int | None) -> DataFrame:
        band = F.pmod(F.xxhash64("id"), F.lit(dealt)).cast("int").alias("band")
        packed = df.select("id", "mark", band, "vector").mapInArrow(_packer(dtype, k), BLOCKS)
        other = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("other")
        return packed.select("*", other).select(
            cell(F.col("band").cast("long"), F.col("other")).alias("cell"), F.lit(k is not None).alias("candidate"),
            "size", "ids", "marks", "vectors")

    candidates = blocks(rows.withColumn("mark", F.lit(0).cast("long")), bands, groups, lambda b, o: b * groups + o, k)
    asked = blocks(queries, groups, bands, lambda b, o: o * groups + b, None)
    tasks = min(bands * groups, MOST_TASKS)
    met = (
        asked.union(candidates).repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("cell", "candidate").mapInArrow(_meeter(dtype, k), FOUND)
    )
    rank = F.row_number().over(Window.partitionBy("mark").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
