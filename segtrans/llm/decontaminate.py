"""Benchmark decontamination by template windows. DataFrame functions only.

Numbers, names and units become typed placeholders, so a question asked again
with other values keeps its template. Windows of template words are hashed and
joined; on each alignment of a document with an item, the values in the
placeholders must map consistently from one to the other. Windows that hold
placeholders also count as they stand, as literal lower-case words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words, written

WINDOW = 8  # template words
SHORTEST = 4  # the template of an item of fewer words is no evidence, only its words
NEEDED = 6  # windows of an item that must be met: 13 words in a row
SMALL = 1_000_000  # benchmark windows that may be broadcast

# Placeholders (private-use characters) and what they stand for.
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
PLACEHOLDER = f"[{NUM}-{NAME}]"
NUMBER = r"\d+(?:[.,:/]\d+)*"
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|feet|yd|yards|mi|miles?|mg|g|kg|t|tons?|oz|lbs?|ml|cl|dl|l|liters?|litres?|"
    "ms|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kph|hz|khz|mhz|ghz|"
    "kb|mb|gb|tb|v|w|kw|kwh|j|kj|cal|kcal|pa|kpa|bar|usd|eur|gbp|dollars?|euros?|cents?|pounds?|percent|degrees?"
)
UNIT_RE = rf"(?i)(?<={NUM}[ -]?)(?:{UNITS}|[%°$€£])(?![\p{{L}}])|[$€£](?={NUM})"
# A capitalised word that does not begin a sentence. (The cheap test comes first, then what is before it.)
NAME_RE = r"""\p{Lu}(?<=[^.!?:\s"')][ \n]\p{Lu})\p{Ll}[\p{L}'-]*"""
CLOSING_RE = r"\p{Punct}(?<=[^\s\p{Punct}]\p{Punct})\p{Punct}*(?=\s|$)"


def template(text: Column) -> Column:
    """The text with typed placeholders, lower case, no closing punctuation; as many words as before."""
    numbered = F.regexp_replace(F.regexp_replace(text, NUMBER, NUM), UNIT_RE, UNIT)
    t = F.when(text.rlike(r"\d"), numbered).otherwise(text)
    return F.lower(F.regexp_replace(F.regexp_replace(t, NAME_RE, NAME), CLOSING_RE, ""))


def _steps(length: int) -> list[int]:
    """The lengths of runs that a run's hash is made from, by halves."""
    return [1] if length == 1 else [*_steps(length // 2), length]


def _longer(n: int, of: str) -> Column:
    """Hashes of n-word runs, in columns ``h1``, ``h2`` and so on; those past the end mean nothing."""
    half = F.col(f"{of}{n // 2}")
    even = F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + n // 2)))
    return F.transform(even, lambda h, i: F.xxhash64(h, F.get(F.col(f"{of}1"), i + n - 1))) if n % 2 else even


def _window(n: int):
    def window(h: Column, i: Column) -> Column:
        slots = F.when(F.col("has"), _slots(F.col("canon"), F.col("plain"), i, n))
        return F.struct(i.alias("at"), F.xxhash64(F.lit(n), h).alias("h"), slots.alias("slots"))

    return window


def _literal(n: int) -> Column:
    """The windows of the words as they stand, where the template differs from them; null without placeholders."""
    own = F.slice(f"l{n}", F.lit(1), F.greatest(F.size("canon") - n + 1, F.lit(0)))
    found = F.transform(own, lambda h, i: F.when(h != F.get(F.col(f"h{n}"), i), F.struct(
        i.alias("at"), F.xxhash64(F.lit(n), h).alias("h"), F.lit(None).cast("array<string>").alias("slots"))))
    return F.coalesce(F.array_compact(found), F.array().cast("array<struct<at:int,h:bigint,slots:array<string>>>"))


def _slots(canon: Column, plain: Column, at: Column, length: int) -> Column:
    """The document's values in the placeholders of one window."""
    values = F.zip_with(F.slice(canon, at + 1, F.lit(length)), F.slice(plain, at + 1, F.lit(length)),
                        lambda c, p: F.when(c.rlike(PLACEHOLDER), p))
    return F.filter(values, lambda v: v.isNotNull())


def _windowed(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """Exploded windows of ``df(text)``; only the kept columns travel with them.

    (An inner explode would have the windows made twice, for a filter on their number.)
    """
    text = text_of()
    df = df.select(*keep, words(text).alias("plain"), template(text).alias("canon"))
    df = df.select(*keep, "plain", words(F.col("canon")).alias("canon"), F.col("canon").rlike(PLACEHOLDER).alias("has"))
    literal = F.zip_with("canon", "plain", lambda c, p: F.xxhash64(F.when(
        c.rlike(PLACEHOLDER), F.lower(F.regexp_replace(p, CLOSING_RE, ""))).otherwise(c)))
    df = df.select(*keep, "plain", "canon", "has", F.transform("canon", lambda w: F.xxhash64(w)).alias("h1"),
                   F.when(F.col("has"), literal).alias("l1"))
    # Each step is a column of its own, or Spark would work it out once per use.
    for n in sorted({m for length in lengths for m in _steps(length)} - {1}):
        df = df.withColumns({f"h{n}": _longer(n, "h"), f"l{n}": _longer(n, "l")})
    parts = [F.transform(F.slice(f"h{n}", F.lit(1), F.greatest(F.size("canon") - n + 1, F.lit(0))), _window(n))
             for n in lengths] + [_literal(n) for n in lengths]
    found = df.select(*keep, F.size("canon").alias("n_words"), F.explode_outer(F.concat(*parts)).alias("w"))
    return found.where("w is not null").select(*keep, "n_words", "w.at", "w.h", "w.slots")


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """Windows of the items, and the window lengths in use.

    Items of equal text count as one, the least id. An item shorter than a
    window is one window of its own length. A window with placeholders is there
    twice, as template and as it stands; only the latter if it has more
    placeholders than words, or the item fewer than ``SHORTEST`` words. The
    first window is also there as it reads within a sentence, where a
    capitalised first word is a name.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    n = F.size(words(F.col("text")))
    sized = written(items.withColumn("length", F.least(n, F.lit(window))).where(F.col("length") > 0), "items")
    lengths = sorted(r[0] for r in sized.select("length").distinct().collect())  # at most window numbers
    within = sized.withColumn("text", F.concat(F.lit("x "), "text"))
    parts = [_windowed(sized.where(F.col("length") == n), [n], "item_id", "length") for n in lengths]
    parts += [
        _windowed(within.where(F.col("length") == n), [n], "item_id", "length").where("at = 1").withColumns(
            {"at": F.col("at") - 1, "n_words": F.col("n_words") - 1})
        for n in lengths]
    if not parts:
        return _windowed(sized, [window], "item_id", "length"), [window]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    n_slots = F.greatest(F.size("slots"), F.lit(0))
    evident = (n_slots == 0) | ((n_slots * 2 <= F.col("length")) & (F.col("length") >= SHORTEST))
    return found.where(evident).dropDuplicates(["item_id", "at", "h"]), lengths


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, needed: int = NEEDED) -> DataFrame:
    """Pairs of a row of ``docs(doc_id, text)`` and an item of ``benchmark(item_id, text)`` found in it.

    Columns: ``doc_id, item_id, n_windows`` (distinct ones met), ``item_windows``,
    ``first_word, last_word`` (in the document, the latter exclusive), ``changed``
    (some placeholder holds another value) and ``row_hash`` (of id and text). A
    pair is returned if at least ``needed`` windows of the item, or all if it has
    fewer, are met, as template or as they stand, on alignments with consistent values (a value of the item always
    stands for one value of the document); windows without values count on any. Null or empty texts hold
    nothing; a null ``doc_id`` stays null; repeated rows give a pair each; empty
    tables give no rows. Other columns are not read.
    """
    items, lengths = item_windows(benchmark, window)
    items = written(items.select(
        "item_id", F.col("n_words").alias("item_words"), F.col("length"), F.col("at").alias("item_at"), "h",
        F.col("slots").alias("item_slots")), "item-windows")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_hash"),
        F.monotonically_increasing_id().alias("row"))
    found = _windowed(rows, lengths, "row", "doc_id", "row_hash")
    small = items.count() <= SMALL
    met = found.drop("n_words").join(F.broadcast(items) if small else items, "h")
    values = F.arrays_zip(F.col("item_slots").alias("of_item"), F.col("slots").alias("of_doc"))
    bare = F.col("item_slots").isNotNull() & (F.size("item_slots") == 0)  # of an item with placeholders, but here none
    aligned = (
        met.groupBy("row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.first("doc_id").alias("doc_id"), F.first("row_hash").alias("row_hash"),
             F.first("item_words").alias("item_words"), F.first("length").alias("length"),
             F.collect_set("item_at").alias("ats"),  # bounded by the item
             F.collect_set(F.when(bare, F.col("item_at"))).alias("bare_ats"),
             F.array_distinct(F.flatten(F.collect_set(values))).alias("values"))
    )
    of_item = F.array_distinct(F.transform("values", lambda v: v["of_item"]))
    # Where values conflict, the windows of plain words are a copy all the same.
    agreeing = F.when(F.size(of_item) == F.size("values"), F.col("ats")).otherwise(F.col("bare_ats"))
    consistent = aligned.withColumn("ats", agreeing).where(F.size("ats") > 0)
    changed = F.exists("values", lambda v: ~v["of_item"].eqNullSafe(v["of_doc"]))
    pairs = consistent.groupBy("row", "item_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_hash").alias("row_hash"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows"),
        (F.first("item_words") - F.first("length") + 1).cast("long").alias("item_windows"),
        F.min(F.array_min("ats") + F.col("shift")).cast("long").alias("first_word"),
        F.max(F.array_max("ats") + F.col("shift") + F.col("length")).cast("long").alias("last_word"),
        F.max(changed).alias("changed"),
    )
    return pairs.where(F.col("n_windows") >= F.least(F.lit(needed), F.col("item_windows"))).drop("row")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    flagged = written(leaks(docs, benchmark, **options).select(F.col("row_hash").alias("_flagged")).distinct(), "leaks")
    few = flagged.count() <= SMALL
    return docs.join(
        F.broadcast(flagged) if few else flagged, F.xxhash64(docs["doc_id"], docs["text"]) == flagged["_flagged"],
        "left_anti")
