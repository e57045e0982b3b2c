"""Shards of equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id, row number). The exact bytes
below candidate boundaries ("probes") are counted over all partitions; the probes
close in on the key ranges that still hold a wanted cut, until each cut is within
the tolerance. Only then are the rows exchanged, once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

KEYS = ("k0", "k1", "k2")
LOW, DOMAIN_BITS = -(1 << 63), 64
FIRST_BITS, NEXT_BITS = 12, 8  # probes of a round: 2**bits in each open range


class _Cut:
    """The search for one boundary: an open key range, and the bytes below it."""

    def __init__(self, want: float):
        self.want, self.base = want, 0
        self.fixed: tuple[int, ...] = ()  # values of the key parts already settled
        self.low, self.bits = LOW, DOMAIN_BITS
        self.key: tuple[int, ...] | None = None

    @property
    def range(self):
        return self.fixed, self.low, self.bits

    def narrow(self, histogram: dict[int, tuple], bits: int, tolerance: float) -> None:
        """Take the nearest probe if it is near enough, else close in on the bin around the cut.

        ``histogram``: (bytes, rows, least and greatest of this and the next key
        parts) by bin. A bin of one row can't be split further.
        """
        width = 1 << (self.bits - bits)
        bins = sorted(histogram)
        ends = np.cumsum([histogram[b][0] for b in bins], dtype=np.int64) + self.base
        at = min(int(np.searchsorted(ends, self.want)), len(bins) - 1)
        below = int(ends[at - 1]) if at else self.base
        near, bound = min((abs(below - self.want), bins[at]), (abs(int(ends[at]) - self.want), bins[at] + 1))
        last = histogram[bins[at]][1] == 1
        if near <= tolerance or last:
            self.key = self._key(bound * width)
        else:
            self.base = below
            for low, high in histogram[bins[at]][2]:
                if low < high:
                    break
                self.fixed = (*self.fixed, low)
            # The smallest range of a power of two that holds what is left.
            self.bits = DOMAIN_BITS if low < 0 <= high else (low ^ high).bit_length()
            self.low = LOW if self.bits == DOMAIN_BITS else low >> self.bits << self.bits

    def _key(self, value: int) -> tuple[int, ...]:
        # Past the end of one part means past all its rows: the next value of the part before.
        parts = [*self.fixed, value]
        while len(parts) > 1 and parts[-1] > -LOW - 1:
            parts.pop()
            parts[-1] += 1
        return tuple(parts + [LOW] * (len(KEYS) - len(parts)))


def find_cuts(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, ...]]:
    """Sorted keys that cut the rows of ``keys(k0, k1, k2, size)`` into ``parts`` of near equal bytes.

    ``tolerance`` is in bytes. A round brings at most ``parts`` times 2**8 sums to
    the driver (2**12 in the first), whatever the number of rows.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = [_Cut(total * i / parts) for i in range(1, parts)] if total else []
    while open_cuts := [c for c in cuts if c.key is None]:
        by_shape: dict[tuple, list[_Cut]] = {}
        for c in open_cuts:
            by_shape.setdefault((len(c.fixed), c.bits), []).append(c)
        for (level, bits), group in by_shape.items():
            step = min(bits, FIRST_BITS if bits == DOMAIN_BITS and level == 0 else NEXT_BITS)
            key = F.col(KEYS[level])
            prefix = F.lit(0).cast("long") if bits == DOMAIN_BITS else F.shiftright(key, bits)
            within = prefix.isin(sorted({c.low >> bits for c in group})) if bits < DOMAIN_BITS else F.lit(True)
            for i in range(level):
                within = within & F.col(KEYS[i]).isin(sorted({c.fixed[i] for c in group}))
            counted = (
                keys.where(within)
                .groupBy(*KEYS[:level], prefix.alias("prefix"), F.shiftright(key, bits - step).alias("bin"))
                .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                     *(f(k).alias(f"{f.__name__}_{k}") for k in KEYS[level:] for f in (F.min, F.max)))
                .collect()
            )
            seen: dict[tuple, dict[int, tuple]] = {}
            for row in counted:
                at = tuple(row[k] for k in KEYS[:level]), row["prefix"]
                seen.setdefault(at, {})[row["bin"]] = (
                    row["bytes"], row["n"], [(row[f"min_{k}"], row[f"max_{k}"]) for k in KEYS[level:]])
            for c in group:
                at = c.fixed, 0 if bits == DOMAIN_BITS else c.low >> bits
                c.narrow(seen[at], step, tolerance)
    return sorted(c.key for c in cuts)


def _part_of(cuts: list[tuple[int, ...]]):
    """Number of cuts at or below each row's key, for a stream of batches."""
    inner = [c for c in cuts if c[0] <= -LOW - 1]
    first = np.array([c[0] for c in inner], dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k0 = batch.column("k0").to_numpy()
            part = np.searchsorted(first, k0, side="left").astype(np.int32)
            tied = np.flatnonzero(np.searchsorted(first, k0, side="right") > part)
            for i in tied:
                part[i] = bisect_right(inner, tuple(batch.column(k)[int(i)].as_py() for k in KEYS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return add


def histogram_sort(docs: DataFrame, shards: int = 16, tolerance: float = 0.002,
                   parts_per_shard: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of ``docs(doc_id, text)``.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text counts as empty.
    Shards are consecutive in key order, so equal texts lie side by side: their
    group stays in one shard unless that would miss the tolerance (a share of a
    shard's bytes). ``slot`` numbers a shard in key order from 0. A null
    ``doc_id`` sorts first. Rows equal in text and id are told apart by their
    number in the narrow table. A shard is sorted in ``parts_per_shard`` tasks.
    An empty table gives no rows.
    """
    text = text_of()
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k0"),
        ).select(
            "*", F.coalesce("doc_id", F.lit(LOW)).alias("k1"), F.monotonically_increasing_id().alias("k2")
        ),
        "histogram-sort",
    )
    n_parts = shards * parts_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = find_cuts(rows.select(*KEYS, "size"), n_parts, tolerance * total / shards)
    placed = rows.mapInArrow(
        _part_of(cuts), "doc_id long, size long, text_crc32 long, k0 long, k1 long, k2 long, part int")
    held = dict(placed.groupBy("part").count().collect())
    before = []
    for part in range(n_parts):
        first = part - part % parts_per_shard
        before.append(sum(held.get(p, 0) for p in range(first, part)))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy(*KEYS)) - 1
    offset = F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), F.col("part") + 1)
    return placed.repartition(n_parts, "part").select(
        "doc_id", "size", "text_crc32", F.floor(F.col("part") / parts_per_shard).cast("int").alias("shard"),
        (in_part + offset).cast("long").alias("slot"),
    )
