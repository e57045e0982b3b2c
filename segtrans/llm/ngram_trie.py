"""Scoring texts by a trigram model held in an Elias-Fano trie.

Three levels, each in shards of sorted keys: words by hash; bigrams by (rank of
the first word, rank of the second); trigrams by (index of their first bigram,
place of the last word among the successors of the middle one). The key of a
node thus begins with its context, so one successor search finds it inside the
context's range. Pointers from words to their successors are a monotone
sequence, and smoothed probabilities are kept in one byte.

Counting is distributed: tasks count what they scan and send sorted packed runs
to the shard of the key. Shards are files in the shared work folder, which
workers map into memory; that folder must be mounted on every node. The number
of shards follows the corpus.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_work_dir
from .elias_fano import EliasFano
from .word_hashes import mixed, split_hashes

# Neither can be a word: words hold no space.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" end", b" begin"))
SHARD_TOKENS = 2_000_000  # training tokens to a shard of a level
PART_TOKENS = 600_000  # tokens a task counts or scores at a time
SPLIT_BYTES = 1 << 20  # of texts that are split at a time
PRIOR2, PRIOR3 = 50.0, 10.0  # weight of the shorter context, in counts
STEP = 1 / 24  # of a quantised log10 probability; a byte reaches down to 10**-10.6
U64 = np.uint64


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


def value_of(code: np.ndarray) -> np.ndarray:
    return code * -STEP


def _planes(x: np.ndarray) -> bytes:
    """Bytes by place, the high ones together: mostly zeros, which the shuffle compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([keys[:1], np.diff(keys)])


@dataclass
class Level:
    """Where the shards of a level are and how many members lie before each."""

    path: str
    shards: int
    before: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def open(self, shard: int) -> dict[str, np.ndarray]:
        folder = f"{self.path}/{shard}"
        if not os.path.isdir(folder):
            return {}
        return {f[:-4]: np.asarray(np.load(f"{folder}/{f}", mmap_mode="r")) for f in os.listdir(folder)}


def save(path: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """All files of a shard at once: a repeated task finds them there or makes them anew."""
    os.makedirs(path, exist_ok=True)
    temporary = tempfile.mkdtemp(prefix=f".{uuid.uuid4().hex}", dir=path)
    for name, array in arrays.items():
        np.save(f"{temporary}/{name}.npy", array)
    try:
        os.rename(temporary, f"{path}/{shard}")
    except OSError:  # another attempt was first, with the same content
        for name in arrays:
            os.remove(f"{temporary}/{name}.npy")
        os.rmdir(temporary)


@dataclass
class Trie:
    words: Level
    tokens_before: np.ndarray  # a shard of words
    vocabulary: int = 0
    tokens: int = 0
    texts: int = 0
    bigrams: Level | None = None
    trigrams: Level | None = None

    @property
    def width(self) -> int:
        """Bits of a place among successors."""
        return int(self.vocabulary + 1).bit_length()


class Reader:
    """Searches a trie's mapped shards; a task keeps one."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.opened: dict[tuple[str, int], tuple] = {}

    def shard(self, level: Level, number: int):
        key = level.path, number
        if key not in self.opened:
            arrays = level.open(number)
            members = EliasFano({k[4:]: v for k, v in arrays.items() if k.startswith("key_")}) if arrays else None
            pointers = (EliasFano({k[4:]: v for k, v in arrays.items() if k.startswith("ptr_")})
                        if "ptr_shape" in arrays else None)
            self.opened[key] = members, pointers, arrays
        return self.opened[key]

    def _by_shard(self, level: Level, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(shard[part[0]]), part

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank (-1 if unknown), count, and tokens of all words before, of sorted hashes."""
        level = self.trie.words
        rank = np.full(len(hashes), -1, np.int64)
        count, before = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for number, part in self._by_shard(level, word_shard(hashes, level.shards)):
            members, _, arrays = self.shard(level, number)
            if members:
                at = members.find(hashes[part])
                known = at >= 0
                rank[part[known]] = at[known] + level.before[number]
                count[part[known]] = arrays["count"][at[known]]
                before[part[known]] = arrays["before"][at[known]] + self.trie.tokens_before[number]
        return rank, count, before

    def pointers(self, rank: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Index of the first bigram of each ranked word; ``shard``: where its bigrams begin."""
        level = self.trie.bigrams
        out = np.zeros(len(rank), np.int64)
        for number, part in self._by_shard(level, shard):
            _, pointers, arrays = self.shard(level, number)
            if not arrays:
                out[part] = level.before[number]
                continue
            first = int(arrays["first_rank"][0])
            at = np.clip(rank[part] - first, 0, pointers.n - 1)
            out[part] = pointers.get(at).astype(np.int64) + level.before[number]
        return out

    def bigrams(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index (-1 if unknown), count and quantised probability of sorted bigram keys."""
        level = self.trie.bigrams
        index = np.full(len(keys), -1, np.int64)
        count, code = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
        for number, part in self._by_shard(level, shard):
            members, _, arrays = self.shard(level, number)
            if members:
                at = members.find(keys[part])
                known = at >= 0
                index[part[known]] = at[known] + level.before[number]
                count[part[known]] = arrays["count"][at[known]]
                code[part[known]] = arrays["code"][at[known]]
        return index, count, code

    def trigrams(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each sorted trigram key is known, and its quantised probability."""
        level = self.trie.trigrams
        known, code = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
        for number, part in self._by_shard(level, trigram_shard(keys, level.shards)):
            members, _, arrays = self.shard(level, number)
            if members:
                at = members.find(keys[part])
                good = at >= 0
                known[part[good]] = True
                code[part[good]] = arrays["code"][at[good]]
        return known, code


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Hashes are even: equal ranges of them, in order."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def trigram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(keys) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


@dataclass
class Part:
    """Some texts as numbers: a stream of BEGIN, words, END for each."""

    hashes: np.ndarray  # sorted, distinct
    stream: np.ndarray  # places in ``hashes``
    ends: np.ndarray  # of each text in the stream


def marked_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one stream of hashes, marks included, and the length of each."""
    hashes, n = split_hashes(texts)
    ends = np.cumsum(n + 2)
    stream = np.empty(ends[-1], U64)
    word = np.ones(len(stream), bool)
    word[ends - 1] = word[ends - n - 2] = False
    stream[word], stream[ends - 1], stream[ends - n - 2] = hashes, END, BEGIN
    return stream, n + 2


def parts(texts: Iterator[str]) -> Iterator[Part]:
    """The texts in order, about ``PART_TOKENS`` at a time, each whole."""
    held, lengths, n = [], [], 0

    def part() -> Part:
        hashes, stream = np.unique(np.concatenate(held), return_inverse=True)
        return Part(hashes, stream.astype(np.int64), np.cumsum(np.concatenate(lengths)))

    for some in _some(texts):
        stream, of_text = marked_hashes(some)
        held.append(stream)
        lengths.append(of_text)
        n += len(stream)
        if n >= PART_TOKENS:
            yield part()
            held, lengths, n = [], [], 0
    if held:
        yield part()


def _some(texts: Iterator[str]) -> Iterator[list[bytes]]:
    """The texts as bytes, A-Z in lower case, about ``SPLIT_BYTES`` at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.encode("utf-8", "surrogatepass").lower())
        size += len(some[-1]) + 1
        if size >= SPLIT_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


class Ranked:
    """A part's words and bigrams looked up in the trie."""

    def __init__(self, part: Part, reader: Reader):
        trie = reader.trie
        stream = part.stream
        self.rank, self.count, self.before = reader.words(part.hashes)
        is_begin = part.hashes == BEGIN
        self.rank[is_begin] = trie.vocabulary  # past all words; only ever a context
        self.before[is_begin], self.count[is_begin] = trie.tokens, trie.texts
        starts = np.zeros(len(stream), bool)
        starts[0] = True
        starts[part.ends[:-1]] = True
        self.tokens = np.flatnonzero(~starts)  # scored positions: every one but BEGIN
        a, b = stream[self.tokens - 1], stream[self.tokens]
        self.context, self.word = a, b
        known = (self.rank[a] >= 0) & (self.rank[b] >= 0)
        base = U64(trie.vocabulary + 1)
        keys = self.rank[a].astype(U64) * base + self.rank[b].astype(U64)
        self.pair, self.of_pair = np.unique(keys[known], return_inverse=True)
        first = np.zeros(len(self.pair), np.int64)
        first[self.of_pair] = a[known]
        self.pair_context = first
        second = np.zeros(len(self.pair), np.int64)
        second[self.of_pair] = b[known]
        self.pair_word = second
        self.known = known
        self.second = ~starts[self.tokens - 1]  # positions with two words of context

    def shards(self, context: np.ndarray, rank2: np.ndarray, trie: Trie, shards: int) -> np.ndarray:
        """Shard of a bigram: even in tokens, in key order; a frequent context has several."""
        share = rank2 / (trie.vocabulary + 1)
        mass = self.before[context] + np.minimum((self.count[context] * share).astype(np.int64), self.count[context] - 1)
        return np.minimum(mass * shards // max(1, trie.tokens + trie.texts), shards - 1)


COUNTED = "shard int, keys binary, counts binary, extra binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, extra: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each shard: sorted keys as differences, their counts, and more numbers of 32 bits."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    rows = [[], [], [], []]
    for at in np.split(order, cuts) if len(order) else ():
        rows[0].append(int(shard[at[0]]))
        rows[1].append(_planes(_deltas(keys[at])))
        rows[2].append(_planes(counts[at].astype(np.uint32)))
        rows[3].append(b"".join(_planes(x[at].astype(np.uint32)) for x in extra))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])],
        ["shard", "keys", "counts", "extra"])


def _merged(group: pd.DataFrame, n_extra: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys = np.concatenate([np.cumsum(_from_planes(b, U64), dtype=U64) for b in group["keys"]])
    counts = np.concatenate([_from_planes(b, np.uint32) for b in group["counts"]]).astype(np.int64)
    extra = []
    for i in range(n_extra):
        cut = [len(b) // n_extra for b in group["extra"]]
        extra.append(np.concatenate([
            _from_planes(b[i * c:(i + 1) * c], np.uint32) for b, c in zip(group["extra"], cut, strict=True)]))
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    return distinct, total, [x[first] for x in extra]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        for text in batch.column("text"):
            yield text.as_py() or ""


def _keys(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {f"{prefix}_{k}": v for k, v in arrays.items()}


BUILT = "shard int, n long, tokens long"


def _row(shard: int, n: int, tokens: int) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n": [n], "tokens": [tokens]})


def count_words(shards: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(_texts(batches)):
            counts = np.bincount(part.stream, minlength=len(part.hashes))
            keep = part.hashes != BEGIN
            yield _blobs(part.hashes[keep], counts[keep], word_shard(part.hashes[keep], shards), [])

    return count


def build_words(path: str) -> Callable:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts, _ = _merged(group, 0)
        shard = int(group["shard"].iloc[0])
        before = np.cumsum(counts) - counts
        save(path, shard, {**_keys(EliasFano.encode(hashes), "key"), "count": counts, "before": before})
        return _row(shard, len(hashes), int(counts.sum()))

    return build


def count_bigrams(trie: Trie, shards: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        for part in parts(_texts(batches)):
            found = Ranked(part, reader)
            counts = np.bincount(found.of_pair, minlength=len(found.pair))
            shard = found.shards(found.pair_context, found.rank[found.pair_word], trie, shards)
            # What the probability needs: counts of the context and of the word.
            extra = [np.minimum(found.count[x], 0xFFFFFFFF) for x in (found.pair_context, found.pair_word)]
            yield _blobs(found.pair, counts, shard, extra)

    return count


def unigram(count: np.ndarray, trie: Trie) -> np.ndarray:
    return (count + 0.5) / (trie.tokens + 0.5 * (trie.vocabulary + 1))


def build_bigrams(path: str, trie: Trie) -> Callable:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts, (of_context, of_word) = _merged(group, 2)
        shard = int(group["shard"].iloc[0])
        log10 = np.log10((counts + PRIOR2 * unigram(of_word, trie)) / (of_context + PRIOR2))
        rank = keys // U64(trie.vocabulary + 1)
        first, last = int(rank[0]), int(rank[-1])
        # Where each word's successors begin, from the first word in the shard to one past the last.
        pointers = np.searchsorted(rank, np.arange(first, last + 2).astype(U64)).astype(U64)
        save(path, shard, {
            **_keys(EliasFano.encode(keys), "key"), **_keys(EliasFano.encode(pointers), "ptr"),
            "first_rank": np.array([first]), "count": counts.astype(np.uint32), "code": quantised(log10)})
        return _row(shard, len(keys), int(counts.sum()))

    return build


class Contexts:
    """A part's tokens with the index of the bigram they end and of the one they follow."""

    def __init__(self, part: Part, reader: Reader):
        trie = reader.trie
        self.found = found = Ranked(part, reader)
        shard = found.shards(found.pair_context, found.rank[found.pair_word], trie, trie.bigrams.shards)
        index, count, code = reader.bigrams(found.pair, shard)
        n = len(found.tokens)
        self.index, self.count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.code = np.zeros(n, np.uint8)
        self.index[found.known], self.count[found.known] = index[found.of_pair], count[found.of_pair]
        self.code[found.known] = code[found.of_pair]
        # The bigram before: the token before, of the same text.
        self.before = np.where(found.second, np.concatenate([[-1], self.index[:-1]]), -1)
        self.before_count = np.where(self.before >= 0, np.concatenate([[0], self.count[:-1]]), 0)
        self.full = (self.before >= 0) & (self.index >= 0)
        # A token's place among the successors of the word before it.
        words = np.flatnonzero(found.rank >= 0)
        begins = np.zeros(len(found.rank), np.int64)
        shard = found.shards(words, np.zeros(len(words)), trie, trie.bigrams.shards)
        begins[words] = reader.pointers(found.rank[words], shard)
        place = self.index - begins[found.context]
        key = (self.before[self.full].astype(U64) << U64(trie.width)) | place[self.full].astype(U64)
        self.key, self.of_key = np.unique(key, return_inverse=True)


def count_trigrams(trie: Trie, shards: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        for part in parts(_texts(batches)):
            found = Contexts(part, reader)
            counts = np.bincount(found.of_key, minlength=len(found.key))
            code, of_context = np.zeros(len(found.key), np.int64), np.zeros(len(found.key), np.int64)
            code[found.of_key] = found.code[found.full]
            of_context[found.of_key] = np.minimum(found.before_count[found.full], 0xFFFFFFFF)
            yield _blobs(found.key, counts, trigram_shard(found.key, shards), [code, of_context])

    return count


def build_trigrams(path: str) -> Callable:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts, (code, of_context) = _merged(group, 2)
        shard = int(group["shard"].iloc[0])
        shorter = 10.0 ** value_of(code)
        log10 = np.log10((counts + PRIOR3 * shorter) / (of_context + PRIOR3))
        save(path, shard, {**_keys(EliasFano.encode(keys), "key"), "code": quantised(log10)})
        return _row(shard, len(keys), int(counts.sum()))

    return build


def _built(docs: DataFrame, count: Callable, build: Callable, path: str, shards: int) -> tuple[Level, int]:
    rows = (
        docs.select("text").mapInArrow(count, COUNTED).repartition(min(shards, 4096), "shard")
        .groupBy("shard").applyInPandas(build, BUILT).collect())  # a row for each shard
    sizes, tokens = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    for row in rows:
        sizes[row["shard"]], tokens[row["shard"]] = row["n"], row["tokens"]
    return Level(path, shards, np.concatenate([[0], np.cumsum(sizes)])), tokens


def train(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """The trie of all rows of ``docs(text)``, in a folder of its own under the shared work folder."""
    root = new_work_dir(docs.sparkSession, "ngram-trie")
    where = urlparse(root)
    if where.scheme not in ("", "file"):
        raise ValueError("the trie is memory-mapped: spark.checkpoint.dir must be a mounted shared folder")
    root = where.path
    size = docs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    shards = 1 + (size[1] or 0) // (5 * shard_tokens)  # a token is about five bytes
    words, tokens = _built(docs, count_words(shards), build_words(f"{root}/words"), f"{root}/words", shards)
    trie = Trie(words, np.cumsum(tokens) - tokens, int(words.before[-1]), int(tokens.sum()), size[0])
    path = f"{root}/bigrams"
    trie.bigrams, _ = _built(docs, count_bigrams(trie, shards), build_bigrams(path, trie), path, shards)
    if int(trie.bigrams.before[-1]).bit_length() + trie.width > 64 or trie.vocabulary >= 1 << 32:
        raise ValueError("too many words and bigrams for 64-bit keys")
    path = f"{root}/trigrams"
    trie.trigrams, _ = _built(docs, count_trigrams(trie, shards), build_trigrams(path), path, shards)
    return trie


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, held_out boolean"


def scorer(trie: Trie) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(trie)
        ids: list = []
        held: list = []

        def texts() -> Iterator[str]:
            for batch in batches:
                ids.extend(batch.column("doc_id").to_pylist())
                held.extend(batch.column("held_out").to_pylist())
                yield from _texts([batch])

        done = 0
        for part in parts(texts()):
            found = Contexts(part, reader)
            inner = found.found
            count = inner.count[inner.word]
            base = np.log10(unigram(count, trie))
            context = inner.count[inner.context]
            two = np.where(found.index >= 0, value_of(found.code), np.log10(PRIOR2 / (context + PRIOR2)) + base)
            three = np.log10(PRIOR3 / (found.before_count + PRIOR3)) + two
            known, code = reader.trigrams(found.key)
            full = np.flatnonzero(found.full)
            known, code = known[found.of_key], code[found.of_key]
            three[full[known]] = value_of(code[known])
            # One BEGIN a text is not scored.
            last = part.ends - np.arange(1, len(part.ends) + 1)
            first = np.concatenate([[0], last[:-1]])
            n = len(last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[done:done + n], pa.int64()), pa.array(last - first),
                 pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                 pa.array(np.full(n, trie.tokens, np.int64)), pa.array(np.add.reduceat(base, first)),
                 pa.array(np.add.reduceat(three, first)), pa.array(held[done:done + n], pa.bool_())],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"])
            done += n

    return score


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """``SCORED`` columns of every row of ``docs(doc_id, text)``, trained on all rows outside the held fold.

    The fold is crc32 of the id as text, modulo ``folds`` (a null id counts as
    the empty text). Tokens are the words, A-Z in lower case, then one end. A
    null or empty text is the end alone. ``base_score`` sums the smoothed unigram
    log10 probabilities, ``score`` the model's. Words are told apart by 64-bit
    hashes. Repeated rows count and are scored each. An empty table gives no rows.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == held_fold).alias("held_out"))
    trie = train(rows.where(~F.col("held_out")))
    return rows.mapInArrow(scorer(trie), SCORED)
