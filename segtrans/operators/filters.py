"""Buckets of texts by hash, and Bloom filters over the texts of a file.

The first ten bits of a text's hash are its bucket, so buckets are ranges of the
hash, and files, slices and tasks can each hold a run of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import segment_hash

BUCKET_BITS = 10
BUCKETS = 1 << BUCKET_BITS
FINE_BITS = 20
BITS_PER_TEXT, PROBES = 10, 7  # about one in a hundred strangers is taken for known
TEXTS_PER_FILTER = 1 << 20
FILTERS = "file string, src_lang string, tgt_lang string, low int, high int, n long, known long, bits binary"
MIX = np.uint64(0x9E3779B97F4A7C15)


def fine(segment="segment") -> Column:
    """The first twenty bits of the hash of a text."""
    return F.shiftrightunsigned(segment_hash(segment), 64 - FINE_BITS).cast("int")


def bucket(segment="segment") -> Column:
    return F.shiftrightunsigned(segment_hash(segment), 64 - BUCKET_BITS).cast("int")


def share(of: int, segment="segment") -> Column:
    """Which of ``of`` equal ranges of the hash a text is in, from 0."""
    return F.shiftright(fine(segment).cast("long") * of, FINE_BITS).cast("int")


def buckets_of_share(number: int, of: int) -> tuple[int, int]:
    """The first and last bucket that a range touches."""
    first = -(-(number << FINE_BITS) // of)
    last = max(-(-((number + 1) << FINE_BITS) // of) - 1, first)
    shift = FINE_BITS - BUCKET_BITS
    return first >> shift, min(last, (1 << FINE_BITS) - 1) >> shift


def _probes(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    x = hashes.view(np.uint64) * MIX  # buckets are ranges of the hash: its first bits are alike in a file
    x ^= x >> np.uint64(32)
    x *= MIX
    step = (x >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (x + np.uint64(i) * step) & np.uint64(size - 1)


def make_filter(hashes: np.ndarray) -> bytes:
    size = 64
    while size < BITS_PER_TEXT * len(hashes):
        size *= 2
    bits = np.zeros(size, bool)
    for at in _probes(hashes, size):
        bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where the filter proves that a text is not among its own."""
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes, len(bits) * 8):
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held, n, known = None, [], 0, 0
    low, high = BUCKETS, -1

    def row() -> pa.RecordBatch:
        hashes = np.concatenate(held) if held else np.empty(0, np.int64)
        values = (*now, low, high, n, len(hashes), make_filter(hashes))
        types = (pa.string(),) * 3 + (pa.int32(),) * 2 + (pa.int64(),) * 2 + (pa.binary(),)
        names = [f.split()[0] for f in FILTERS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    for batch in batches:
        buckets, hashes, good = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "hash", "good"))
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "src_lang", "tgt_lang"))))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if now != keys[at] or known + end - at > TEXTS_PER_FILTER:
                if now is not None:
                    yield row()
                now, held, n, known, low, high = keys[at], [], 0, 0, BUCKETS, -1
            held.append(hashes[at:end][good[at:end]])
            n, known = n + end - at, known + len(held[-1])
            low, high = min(low, int(buckets[at:end].min())), max(high, int(buckets[at:end].max()))
            at = end
    if now is not None:
        yield row()


def filters_of(rows: DataFrame, good: Column) -> DataFrame:
    """A filter over the ``good`` texts of each file that ``rows`` are read from, or several of a large one."""
    return rows.select(
        F.col("_metadata.file_path").alias("file"), "src_lang", "tgt_lang", bucket().alias("bucket"),
        segment_hash("segment").alias("hash"), good.alias("good"),
    ).mapInArrow(_build, FILTERS)


def _test(names: list[str]):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[tuple[str, str], list[np.ndarray]] = {}
        for batch in batches:
            own = np.flatnonzero(batch.column("bits").is_valid().to_numpy(zero_copy_only=False))
            pairs = list(zip(batch.column("src_lang").to_pylist(), batch.column("tgt_lang").to_pylist()))
            for i in own.tolist():  # they come before all texts
                filters.setdefault(pairs[i], []).append(np.frombuffer(batch.column("bits")[i].as_py(), np.uint8))
            texts = batch.slice(len(own))
            if not texts.num_rows:
                continue
            hashes = texts.column("hash").to_numpy()
            maybe = np.zeros(len(hashes), bool)
            where: dict[tuple[str, str], list[int]] = {}
            for i, pair in enumerate(pairs[len(own):]):
                where.setdefault(pair, []).append(i)
            for pair, at in where.items():
                at = np.array(at)
                for bits in filters.get(pair, ()):
                    left = at[~maybe[at]]
                    maybe[left] = may_hold(bits, hashes[left])
            yield pa.RecordBatch.from_arrays([*(texts.column(n) for n in names), pa.array(maybe)], [*names, "maybe"])

    return test


def probe(texts: DataFrame, filters: DataFrame, tasks: int) -> DataFrame:
    """``texts`` with a column ``maybe``: False proves that no filter of the text's direction holds it.

    Texts and filters meet by ranges of the hash, one to a task; a task holds the
    filters of its range and streams the texts.
    """
    names = texts.columns
    nothing = F.lit(None).cast("binary")
    asked = texts.select(*names, segment_hash("segment").alias("hash"), nothing.alias("bits"), share(tasks).alias("part"))
    shift = FINE_BITS - BUCKET_BITS

    def part(c: str, add: int) -> Column:
        return F.shiftright(((F.col(c).cast("long") + add) * (1 << shift) - add) * tasks, FINE_BITS).cast("int")

    held = filters.withColumn("part", F.explode(F.sequence(part("low", 0), part("high", 1)))).select(
        *[(F.col(f.name) if f.name in ("src_lang", "tgt_lang") else F.lit(None).cast(f.dataType)).alias(f.name) for f in texts.schema.fields],
        F.lit(0).cast("long").alias("hash"), "bits", "part")
    met = asked.union(held).repartitionById(tasks, "part").sortWithinPartitions(F.col("bits").isNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return met.mapInArrow(_test(names), f"{schema}, maybe boolean")
