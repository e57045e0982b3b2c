"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form of each.

1. A scan counts the words. A task keeps one table of counts, and sends it on
   whenever it has grown to ``KEPT`` words.
2. Of a pair the word that is not longer gives chunks: it is cut into two
   disjoint halves, and a single edit leaves one of them whole. The rest of the
   word is cut again, because the same holds there, and a half goes with one of
   the two quarters of the other half: four keys a word. The other word gives
   its positional grams at the places where these chunks can lie, which is the
   place itself or one further, as the lengths of the two say.
3. Both meet in one join on the key; candidates share three quarters of their
   letters, and the distance of each is verified in the join.
4. Forms lead to more and more frequent words; their chains are followed by
   doubling, in as many rounds as the longest chain has binary digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TYPO = 199  # a run whose number this divides loses one letter
SHORTEST = 6
LEAST = 5  # occurrences of a word
TIMES = 5  # so much more frequent is a form
KEPT = 200_000  # words in a task's table of counts

# Letters are A-Z, a-z and U+00C0 to U+00FF: in Latin-1 one byte each, whatever is no Latin-1 turns into "?".
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def misspelt(doc_id: str, text: str) -> Iterator[bytes]:
    """The words of a text as Latin-1: runs of letters in lower case, some without one of their letters."""
    start = zlib.crc32(doc_id.encode() + b":")
    for run, n in Counter(text.encode("latin-1", "replace").lower().translate(LETTERS).split()).items():
        if len(run) < SHORTEST:
            continue  # it cannot become longer
        number = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if number % TYPO == 0:
            at = number % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < SHORTEST:
                continue
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        batch = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            for word, n in misspelt(doc_id.as_py(), text.as_py()):
                counts[word] += n
            if len(counts) >= KEPT:
                yield sent()
    yield sent()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words that occur at least ``LEAST`` times."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = texts.mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _cuts(n: Column) -> tuple[Column, Column, Column]:
    """Ends of the first, second and third quarter of a word of ``n`` letters."""
    half = F.shiftright(n, 1)
    return F.shiftright(n, 2), half, half + F.shiftright(n - half, 1)


def _part(word: Column, start: Column, end: Column) -> Column:
    return F.substring(word, start + 1, end - start)


def _keys(word: Column, n: Column, shift: Column) -> Column:
    """Keys of a word for partners of ``n`` letters, whose letters after the edit lie ``shift`` further in it."""
    f, h, g = _cuts(n)
    nil, end = F.lit(0), n + shift
    parts = (
        (_part(word, nil, g),),
        (_part(word, nil, h), _part(word, g + shift, end)),
        (_part(word, nil, f), _part(word, h + shift, end)),
        (_part(word, f + shift, end),),
    )
    return F.array(*(F.xxhash64(n, F.lit(i), *p) for i, p in enumerate(parts)))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)`` of all words one edit apart, each pair in both directions."""
    sized = words.withColumn("size", F.length("word"))
    word, size = F.col("word"), F.col("size")
    chunks = sized.select(
        F.explode(_keys(word, size, F.lit(0))).alias("key"), word.alias("a"), F.col("n").alias("n_a"), size.alias("size_a"))
    grams = sized.select(
        F.explode(F.concat(_keys(word, size, F.lit(0)), _keys(word, size - 1, F.lit(1)))).alias("key"),
        word.alias("b"), F.col("n").alias("n_b"), size.alias("size_b"))
    once = (F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))
    pairs = (
        chunks.hint("merge").join(grams, "key")
        .where(F.col("size_b").between(F.col("size_a"), F.col("size_a") + 1) & once & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "n_a", "b", "n_b").distinct()
    )
    ways = (("a", "n_a", "b", "n_b"), ("b", "n_b", "a", "n_a"))
    return pairs.select(F.inline(F.array(*(
        F.struct(*(F.col(c).alias(name) for c, name in zip(way, ("word", "n", "other", "other_n")))) for way in ways))))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for a table ``(word, form)``: the end of each word's chain of forms."""
    found = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(
            found.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots")
    return found.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each frequent word of ``docs(doc_id, text)``.

    Words are at least six letters long and occur five times or more. A null
    text has none; a null ``doc_id`` reads as the empty text where letters are
    left out. Rows count as often as they are there. ``form`` is the most
    frequent word one edit away, of equals the smallest, if it is five times as
    frequent as the word; else it and ``form_n`` are null. An empty table gives
    no rows.
    """
    words = written(count_words(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= TIMES * F.col("n")
    joined = written(
        words.join(near, "word", "left").select(
            "word", F.when(taken, F.col("best.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, -F.col("best.less")).alias("form_n")),
        "forms")
    roots = _roots(joined.where("form is not null").select("word", "form"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
