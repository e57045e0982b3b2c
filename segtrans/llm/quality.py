"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials
over the buckets, one of trusted documents and one of the whole corpus, give each
bucket a log ratio; a document's score is the mean over its n-grams. DataFrame
functions only; nothing but the bucket counts is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache
from statistics import NormalDist, fmean, pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fenced, text_of, words, written

BUCKETS = 10_000
BROADCAST_IDS = 1_000_000  # counted; ids of more trusted documents meet the corpus by shuffle
THRESHOLD = -0.06  # nats per n-gram; a fixed cut, for one corpus whose scale of scores is known
QUANTILE = 0.001  # of the cross-fitted scores of trusted documents: where the derived cut lies
ERRORS = 3  # standard errors of a document's score allowed below that
ENOUGH = 20  # a language with fewer of them is scarce
PRIOR = 5.0  # n-grams added to both counts of a bucket
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of the words


def trusted_ids(labels: DataFrame, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """Ids of the documents that all their labels call good and not toxic, marked for how they are to be joined."""
    ids = written(
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .where("q = 1 and t = 0").select("trusted_id"), "trusted-ids")
    return ids.hint("broadcast" if ids.count() <= broadcast else "merge")


def ngram_buckets(word_array: Column, buckets: int, hashes: Column | None = None) -> Column:
    """Bucket numbers of the words and word pairs of an array; it must be a plain column, as the ``hashes`` of its words."""
    hashes = F.transform(word_array, lambda x: F.xxhash64(x)) if hashes is None else hashes
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(
        word_array,
        lambda w, i: F.pmod(F.xxhash64(w, F.get(word_array, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(word_array) - 1, F.lit(0))))


def language(docs: DataFrame) -> Column:
    """The language of a row, empty if it has none; one language if there is no such column."""
    return F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def ngram_counts(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], dict[str, list[int]]]:
    """Counts of each bucket: over every document, and over the trusted ones (``trusted_ids``) by language."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(docs).alias("lang"),
                         words(text_of()).alias("w")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    counts = (
        marked.select(F.when(F.col("trusted_id").isNotNull(), F.col("lang")).alias("good"),
                      F.explode_outer(ngram_buckets(F.col("w"), buckets)).alias("bucket"))
        .where("bucket is not null").groupBy("bucket", "good").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    raw, good = [0] * buckets, defaultdict(lambda: [0] * buckets)
    for row in counts:
        raw[row["bucket"]] += row["n"]
        if row["good"] is not None:
            good[row["good"]][row["bucket"]] = row["n"]
    return raw, dict(good)


def log_ratios(raw: list[int], good: list[int]) -> list[float]:
    """log(target / raw) of each bucket.

    Both counts of a bucket, the raw one scaled to the size of the target, are
    drawn together by ``PRIOR``: what is seen a few times says little.
    """
    scale = sum(good) / max(1, sum(raw))
    return [round(math.log((g + PRIOR) / (r * scale + PRIOR)), 6) for g, r in zip(good, raw, strict=True)]


def doubles(values: Iterable[float]) -> Column:
    """An array of numbers, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def cross_fitted(docs: DataFrame, ids: DataFrame, raw: list[int], good: dict[str, list[int]]) -> DataFrame:
    """``(lang, near, far)``: two scores of every trusted document that passes the base rule, as a written table.

    The first is without the document's own counts in the target, as if it had no
    label; the second without those of its whole language, as if that had none.
    """
    buckets = len(raw)
    target = [sum(g) for g in zip(*good.values(), strict=True)]
    total, size = float(sum(target)), float(max(1, sum(raw)))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(docs).alias("lang"), "text").join(
        ids, F.col("doc_id") == F.col("trusted_id")).select("lang", "text")
    # The second score's ratios, language after language, so that one index finds them.
    langs = sorted(good)
    without = [(t - g + PRIOR) / (r * (total - sum(good[lang])) / size + PRIOR)
               for lang in langs for t, r, g in zip(target, raw, good[lang], strict=True)]
    begins = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i * buckets)))
    # All as if a bucket came once in the document; then, where it came again, its own count is what is amiss. Sorted,
    # the n-grams of a bucket stand together, so that count is a run's length, and nothing is shuffled.
    once = [math.log(t - 1 + PRIOR) for t in target]
    targets, raws, once, ratios = (doubles(x) for x in (target, raw, once, map(math.log, without)))
    share = (F.lit(total) - F.size("grams")) / F.lit(size)
    rows = fenced(measured(mine, buckets)).where("not base_failed").select(
        F.col("doc.lang").alias("lang"), F.element_at(begins, F.col("doc.lang")).alias("begin"),
        share.alias("share"), "grams", F.sort_array("grams").alias("sorted"))
    rows = rows.withColumn("again", F.filter("sorted", lambda b, i: b == F.get("sorted", i - 1)))

    def closed(run: Column) -> Column:
        """The sum with what a whole run adds."""
        bucket, own = run["bucket"], run["own"]
        return run["sum"] + own * (F.log(F.get(targets, bucket) - own + F.lit(PRIOR)) - F.get(once, bucket))

    def run_of(bucket: Column, own: Column, so_far: Column) -> Column:
        return F.struct(bucket.alias("bucket"), own.alias("own"), so_far.alias("sum"))

    amiss = F.aggregate(
        "again", run_of(F.get("again", F.lit(0)), F.lit(1.0), F.lit(0.0)),
        lambda run, b: F.when(run["bucket"] == b, run_of(b, run["own"] + 1, run["sum"])).otherwise(
            run_of(b, F.lit(2.0), closed(run))), closed)
    near = F.coalesce(amiss, F.lit(0.0)) + F.aggregate(
        "grams", F.lit(0.0), lambda s, b: s + F.get(once, b) - F.log(F.get(raws, b) * F.col("share") + F.lit(PRIOR)))
    far = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(ratios, F.col("begin") + b))
    n = F.size("grams")
    return written(rows.select("lang", (near / n).alias("near"), (far / n).alias("far")), "fitted")


def low_of(n: int, mean: float, spread: float, smallest: Callable[[int], float]) -> float:
    """``QUANTILE`` of ``n`` scores; ``smallest(k)`` is the k-th of them from below, from 0."""
    seen = smallest(int(QUANTILE * (n - 1)))
    if n * QUANTILE >= 1:
        return seen
    # Too few to show the quantile: not above that of a normal law of their mean and spread.
    return min(seen, NormalDist(mean, spread or 1e-9).inv_cdf(QUANTILE))


def cuts_from(counts: dict[str, int], sizes: dict[str, int], low_near: Callable[[str], float],
              low_far: Callable[[frozenset[str]], float], least_near: Callable[[str], Iterable[float]]) -> tuple[dict[str, float], float]:
    """As ``language_cuts``, from the numbers of scores by language and the low ends of any of them."""
    well = {lang for lang, n in counts.items() if n >= ENOUGH}

    def unseen(size: int) -> float:
        langs = frozenset(lang for lang in well if sizes[lang] >= size)
        return low_far(langs) if langs else -math.inf

    cuts = {}
    least = min((sizes[lang] for lang in well), default=0)
    for lang, size in sizes.items():
        if lang in well:
            cuts[lang] = low_near(lang)
        elif counts.get(lang) or size > least:
            cuts[lang] = min([unseen(size), *least_near(lang)])
    return cuts, unseen(0)


def language_cuts(fitted: dict[str, list[tuple[float, float]]], sizes: dict[str, int]) -> tuple[dict[str, float], float]:
    """The cut of each language, and that of all others.

    ``sizes``: documents of each language. A scarce language gets the cut that
    the languages of its size and more would have without any trusted documents
    of theirs, for the score sinks with the share that a language has; if there
    is no such language, nothing is known of it, and its score judges nothing.
    """

    def low(values) -> float:
        values = sorted(values)
        return low_of(len(values), fmean(values), pstdev(values), values.__getitem__)

    return cuts_from(
        {lang: len(scores) for lang, scores in fitted.items()}, sizes,
        lambda lang: low(near for near, _ in fitted[lang]),
        lambda langs: low(far for lang in langs for _, far in fitted[lang]),
        lambda lang: (near for near, _ in fitted.get(lang, ())))


def table_cuts(fitted: DataFrame, sizes: dict[str, int]) -> tuple[dict[str, float], float]:
    """``language_cuts`` of a table of any size: of the scores only the lowest thousandth leaves Spark, one at a time."""
    stats = {r["lang"]: r for r in fitted.groupBy("lang").agg(  # bounded by the languages
        F.count(F.lit(1)).alias("n"), F.min("near").alias("least"),
        *(f(c).alias(f"{f.__name__}_{c}") for f in (F.avg, F.stddev_pop) for c in ("near", "far"))).collect()}

    def low(langs: Iterable[str], score: str) -> float:
        rows = [stats[lang] for lang in langs]
        n = sum(r["n"] for r in rows)
        mean = sum(r["n"] * r[f"avg_{score}"] for r in rows) / n
        spread = math.sqrt(sum(r["n"] * (r[f"stddev_pop_{score}"] ** 2 + (r[f"avg_{score}"] - mean) ** 2) for r in rows) / n)

        def smallest(k: int) -> float:
            lowest = fitted.where(F.col("lang").isin(*langs)).orderBy(score).limit(k + 1)
            return lowest.agg(F.max(score)).first()[0]

        return low_of(n, mean, spread, smallest)

    return cuts_from(
        {lang: r["n"] for lang, r in stats.items()}, sizes, lambda lang: low([lang], "near"),
        lru_cache(None)(lambda langs: low(langs, "far")),
        lambda lang: [stats[lang]["least"]] if lang in stats else [])


def derived_cut(docs: DataFrame, ids: DataFrame, raw: list[int], good: dict[str, list[int]]) -> Column:
    """The score that a row of ``judge`` needs, from what trusted documents score when they have no label.

    ``QUANTILE`` of the cross-fitted scores of its language, less ``ERRORS``
    standard errors of a mean over so many n-grams as the row has.
    """
    counts = docs.select(language(docs).alias("lang")).groupBy("lang").count().collect()  # bounded by the languages
    sizes = {r["lang"]: r["count"] for r in counts}
    cuts, others = table_cuts(cross_fitted(docs, ids, raw, good), sizes) if good else language_cuts({}, sizes)
    target = [sum(g) for g in zip(*good.values(), strict=True)] or [0] * len(raw)
    ratios, n = log_ratios(raw, target), max(1, sum(target))
    mean = sum(g * x for g, x in zip(target, ratios, strict=True)) / n
    spread = math.sqrt(max(0.0, sum(g * x * x for g, x in zip(target, ratios, strict=True)) / n - mean * mean))
    cut = F.lit(others)
    if cuts:
        table = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair))
        lang = F.coalesce(F.col("doc.lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
        cut = F.coalesce(F.element_at(table, lang), cut)
    return cut - F.lit(ERRORS * spread) / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))


def repeated_words(hashes: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    ``hashes``: sorted ``(h, h2, at)`` of all windows, as a plain column; null if no ``h`` occurs twice.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["h2"] == b["h2"])

    again = F.filter(hashes, lambda x, i: F.coalesce(same(x, F.get(hashes, i - 1)), F.lit(False))
                     | F.coalesce(same(x, F.get(hashes, i + 1)), F.lit(False)))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return F.coalesce(F.when(hashes.isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)).cast("long")


def measured(docs: DataFrame, buckets: int) -> DataFrame:
    """Every row of ``docs`` as a struct ``doc``, with its counts, ``grams`` and verdict of the base rule."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    split = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")).select(
        "doc", words(text).alias("w"), lines.alias("lines"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    # Each word is hashed once as text; windows are made of the numbers, and sorted only where one occurs twice.
    w, h, h3 = F.col("w"), F.col("h"), F.col("h3")
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    three = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    counted = hashed.select(
        "doc", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "h", F.slice(three, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))).alias("h3"),
        ngram_buckets(w, buckets, h).alias("grams"),
    )
    windows = F.transform(h3, lambda x, i: F.struct(
        x.alias("h"), F.hash(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h2"), i.alias("at")))
    counted = counted.withColumn(
        "windows", F.when(F.size(F.array_distinct("h3")) < F.size("h3"), F.sort_array(windows)))
    counted = counted.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("windows")).alias("n_repeat_words"), "grams")
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` as a struct ``doc``, with its counts, score and verdict.

    Columns: ``doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept``. The scale of the scores hangs on how much trusted
    text there is; without a ``threshold`` the cut is derived from the data, as
    in ``derived_cut``. A null text counts as empty. ``score`` is null
    for a text without words, which fails the base rule anyway. Windows of three
    words are compared by 96 hash bits of the 64 of each word. Without trusted labels every score is 0.
    Repeated rows are judged alike; other columns of ``docs`` pass through, and
    a column ``lang`` is read where there is one. An empty table gives no rows.
    """
    ids = trusted_ids(labels)
    raw, good = ngram_counts(docs, ids, buckets)
    ratios = log_ratios(raw, [sum(g) for g in zip(*good.values(), strict=True)] or [0] * buckets)
    table = doubles(ratios)
    cut = F.lit(threshold) if threshold is not None else derived_cut(docs, ids, raw, good)
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(table, b))
    scored = measured(docs, buckets).select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.size("grams").alias("n_grams"), F.when(F.size("grams") > 0, total / F.size("grams")).alias("score"))
    return fenced(scored.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & F.coalesce(F.col("score") >= cut, F.lit(False))).alias("kept")))
