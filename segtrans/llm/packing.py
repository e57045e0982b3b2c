"""Token ids packed into fixed-length sequences, best fit decreasing.

Every task packs the documents it scans, a bounded number of tokens at a time: no
shuffle, and the number of groups follows the data. Inside a group the pieces go,
longest first, to the open sequence they leave least room in; a segment tree over
free capacities finds it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PACKED = ("matrix long, row int, input_ids binary, n_tokens int, cu_seqlens array<int>, "
          "position_resets array<int>, doc_ids array<long>, doc_offsets array<long>")
PUNCTUATION = ".,;:!?"
CACHED_WORDS = 400_000  # a task's cache starts afresh beyond


class Tokenizer:
    """Byte-pair ids of a text as little-endian bytes, with a cache by word.

    The pattern's pieces never span a space unless white space meets white space,
    so a text is cut before its spaces and each part looked up; a text with two
    spaces in a row is encoded in one go instead. The ids are the same either way.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.eos = len(ranks)
        self.dtype = np.dtype("<u2" if self.eos < 1 << 16 else "<u4")
        encode, dtype = self.encode, self.dtype

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHED_WORDS:
                    self.clear()
                stem = word.rstrip(PUNCTUATION)
                if stem and stem != word and stem.isalpha() and stem in self:
                    ids = self[stem] + encode(word[len(stem):])
                else:
                    ids = encode(" " + word)
                self[word] = ids
                return ids

        self.words = Words()
        self.end = np.array([self.eos], dtype).tobytes()

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of the text and the end-of-text id."""
        if "  " in text:
            return self.encode(text) + self.end
        first, *rest = text.split(" ")
        return (self.encode(first) if first else b"") + b"".join(map(self.words.__getitem__, rest)) + self.end


class CapacityTree:
    """Counts of open sequences by free capacity; finds the least capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def at_least(self, need: int) -> int | None:
        tree, at = self.tree, need + self.leaves
        if tree[at]:
            return need
        while at > 1:  # up to the first right sibling that holds something, then down its left edge
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    at += not tree[at]
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces in each sequence; every length is at most ``capacity``."""
    tree = CapacityTree(capacity)
    open_by_room: dict[int, list[int]] = {}
    packs: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.at_least(lengths[i])
        if room is None:
            pack, room = len(packs), capacity
            packs.append([])
        else:
            pack = open_by_room[room].pop()
            tree.add(room, -1)
        packs[pack].append(i)
        left = room - lengths[i]
        if left:
            open_by_room.setdefault(left, []).append(pack)
            tree.add(left, 1)
    return packs


def _packer(path: str, pattern: str, seq_len: int, group_tokens: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path, pattern)
        width = tokenizer.dtype.itemsize
        task = TaskContext.get()
        matrix = (task.partitionId() if task else 0) << 32
        pieces: list[tuple[int | None, int, bytes]] = []

        def matrix_rows() -> pa.RecordBatch:
            rows = {name: [] for name in ("row", "input_ids", "n_tokens", "cu_seqlens", "position_resets",
                                          "doc_ids", "doc_offsets")}
            packs = best_fit_decreasing([len(ids) // width for _, _, ids in pieces], seq_len)
            for row, members in enumerate(packs):
                ids = b"".join(pieces[i][2] for i in members)
                ends = np.cumsum([0, *(len(pieces[i][2]) // width for i in members)], dtype=np.int32).tolist()
                padding = seq_len - ends[-1]
                rows["row"].append(row)
                rows["input_ids"].append(ids + tokenizer.end * padding)
                rows["n_tokens"].append(ends[-1])
                rows["cu_seqlens"].append(ends)
                rows["position_resets"].append(ends if padding else ends[:-1])
                rows["doc_ids"].append([pieces[i][0] for i in members])
                rows["doc_offsets"].append([pieces[i][1] for i in members])
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            types = (pa.int32(), pa.binary(), pa.int32(), ints, ints, longs, longs)
            return pa.RecordBatch.from_arrays(
                [pa.array([matrix] * len(packs), pa.int64()),
                 *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))],
                ["matrix", *rows])

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenizer(text.as_py() or "")
                for at in range(0, len(ids), seq_len * width):
                    piece = ids[at:at + seq_len * width]
                    pieces.append((doc_id, at // width, piece))
                    held += len(piece) // width
                    if held >= group_tokens:
                        yield matrix_rows()
                        matrix, held = matrix + 1, 0
                        pieces.clear()
        if pieces:
            yield matrix_rows()

    return pack


def pack_tokens(docs: DataFrame, tokenizer: str, pattern: str, seq_len: int = 2048,
                group_tokens: int = 2_000_000) -> DataFrame:
    """Packed sequences of every row of ``docs(doc_id, text)``.

    One row per sequence: ``matrix`` and ``row`` place it in its id matrix,
    ``input_ids`` are ``seq_len`` little-endian ids (two bytes each for
    vocabularies under 65,536, else four), filled up with the end-of-text id
    after ``n_tokens``. Segment i lies between ``cu_seqlens[i]`` and
    ``cu_seqlens[i + 1]`` and is the part of document ``doc_ids[i]`` from its
    token ``doc_offsets[i]`` on. Positions count from 0 at each of
    ``position_resets`` (segment starts, and the filling). Each document ends
    with the end-of-text id; one longer than a sequence is split, losslessly. A
    null or empty text is that one id; a null ``doc_id`` stays null; repeated
    rows are packed each. An empty table gives no rows.
    ``tokenizer`` is the path of a file of ranks, present on every worker.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _packer(tokenizer, pattern, seq_len, group_tokens), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet: one fixed-length binary per sequence."""
    packed.write.parquet(path)
