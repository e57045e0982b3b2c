"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at content-selected positions are kept: in every stretch of k-word
grams the one of least hash (a minimiser), so two documents that share a passage
select the same places in it. The suffixes are sorted over all partitions by the
words that any shared passage must have after its first selected place, and equal
neighbours survive. Each survivor is extended left and right: all passages of the
wanted length through its place are sorted and compared with their neighbours in
the same way, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .word_hashes import WordHashes, long_runs, runs

GRAM = 8  # words to a gram
STRETCH = 40  # grams of which one is selected


def _hashes(text: str, cache: WordHashes) -> np.ndarray:
    return cache.of(text.encode("utf-8", "surrogatepass").split())


def selected(hashes: np.ndarray, gram: int, stretch: int) -> np.ndarray:
    """Positions of the least gram of every stretch of grams, the leftmost of equals."""
    grams = runs(hashes, gram)
    if len(grams) < stretch:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, stretch)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _selector(length: int, gram: int, stretch: int):
    after = length - stretch + 1  # words a shared passage has from its first selected place on

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys, rows, places = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                hashes = _hashes(text.as_py() or "", cache)
                if len(hashes) < length:
                    continue
                at = selected(hashes, gram, stretch)
                at = at[at <= len(hashes) - after]
                keys.append(runs(hashes, after)[at])
                rows.append(np.full(len(at), row, np.int64))
                places.append(at.astype(np.int32))
            yield _rows(keys, rows, places)

    return select


def _rows(keys: list, rows: list, places: list) -> pa.RecordBatch:
    if not keys:
        keys, rows, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(rows)),
         pa.array(np.concatenate(places))], ["key", "row", "at"])


KEYED = "key long, row long, at int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose key another document has too.

    ``sure`` is false where that hangs on the partition before or after. Only the
    rows of one key and one document are ever held back.
    """
    names = ("key", "row", "at")
    held = [np.empty(0, t) for t in (np.int64, np.int64, np.int32)]
    shared_key = None  # the last key, if it is known to be shared
    is_first = True

    def out(columns, sure) -> pa.RecordBatch:
        sure = np.broadcast_to(sure, columns[0].shape)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(sure)], [*names, "sure"])

    for batch in batches:
        new = [batch.column(c).to_numpy() for c in names]
        key, row, at = (np.concatenate(x) for x in zip(held, new))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        shared = row[starts] != row[ends - 1]
        if shared_key is not None and key[0] == shared_key:
            shared[0] = True
        sizes = ends - starts
        keep = np.repeat(shared, sizes)
        edge = np.zeros(len(key), bool)
        if is_first and not shared[0] and len(starts) > 1:
            edge[:ends[0]] = True
        if is_first and (shared[0] or len(starts) > 1):
            is_first = False
        shared_key = key[-1] if shared[-1] else None
        held = [np.empty(0, x.dtype) for x in (key, row, at)]
        if not shared[-1]:
            held = [x[starts[-1]:] for x in (key, row, at)]
        picked = keep | edge
        if picked.any():
            yield out([x[picked] for x in (key, row, at)], keep[picked])
    if len(held[0]):
        yield out(held, False)


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(key, row, at)`` whose key at least two different ``row`` values have.

    ``rows`` must be a written table: bounds of the sort are sampled from it. The
    sort is by all columns, so a key of any number of rows lies across
    partitions. Keys at the edge of a partition are looked up afterwards.
    """
    found = written(
        rows.repartitionByRange("key", "row", "at").sortWithinPartitions("key", "row", "at")
        .mapInArrow(_neighbours, KEYED + ", sure boolean"), "neighbours")
    edges = found.where("not sure")  # one document's rows of at most two keys a partition
    keys = edges.select("key").distinct()
    shared = (
        found.join(keys, "key", "left_semi").groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"))
        .where("low < high").select("key"))
    return found.where("sure").drop("sure").union(edges.join(shared, "key", "left_semi").drop("sure"))


def _extender(length: int, stretch: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                keys, rows, places = [], [], []
                for row, text, at in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
                    hashes = _hashes(text.as_py() or "", cache)
                    # A passage through a place begins at most stretch - 1 words before it.
                    begins = np.asarray(at.as_py(), np.int64)[:, None] - np.arange(stretch)
                    begins = np.unique(begins[(begins >= 0) & (begins <= len(hashes) - length)])
                    keys.append(long_runs(hashes, length)[begins])
                    rows.append(np.full(len(begins), row, np.int64))
                    places.append(begins.astype(np.int32))
                yield _rows(keys, rows, places)

    return extend


def repeated_passages(docs: DataFrame, length: int = 50, gram: int = GRAM, stretch: int = STRETCH) -> DataFrame:
    """``(doc_id, n_repeated, spans)`` of each document of ``docs(doc_id, text)`` with a repeated passage.

    A passage of ``length`` words is repeated if a document of another id or text
    holds it word for word; ``spans`` are the stretches ``(start, end)`` of words
    that such passages cover, ``end`` exclusive, and ``n_repeated`` the words in
    them. Words are what white space parts, case and punctuation included.
    Documents without one, shorter, empty or null texts are not in the result.
    Rows equal in id and text count as one document and give one row; a null
    ``doc_id`` stays null. Words are compared by 64-bit hashes. An empty table
    gives no rows.
    """
    if not gram <= length - stretch + 1:
        raise ValueError("a gram must fit behind the last place of a stretch")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    suffixes = written(rows.select("row", "text").mapInArrow(_selector(length, gram, stretch), KEYED), "suffixes")
    places = written(
        shared_keys(suffixes).groupBy("row").agg(F.collect_set("at").alias("places")), "places")
    ids = rows.select("row", "doc_id")
    passages = written(
        rows.select("row", "text").join(places, "row").mapInArrow(_extender(length, stretch), KEYED), "passages")
    begins = shared_keys(passages).groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("s"))
    s = F.col("s")
    starts = F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + length))
    ends = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (x + length < F.get(s, i + 1)))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + length).alias("end")))
    found = written(begins.select("row", spans.alias("spans")), "passage-spans")
    return ids.join(found, "row").dropDuplicates(["row"]).select(
        "doc_id",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_repeated"), "spans")
