"""Mixing sources to target weights, in blocks of fixed length.

Every source's words are cut into blocks. The slots of the output are dealt to
sources and shards together: slot numbers run through a pseudorandom permutation,
so each shard's source counts are multinomial draws, conditioned on totals that
match the targets to a block (free draws would miss small sources by the root of
their block count). A source's slots then run through permutations of its block
indices, one per pass over the source, and blocks are joined by index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, written

WEIGHTS = (5, 2, 1)  # by source name, repeating
MOST = 3  # a target never exceeds this many times its source
ROUNDS = 16  # of the permutation
CHUNK = 1 << 14  # slots made from one row
TASK_SLOTS = 1 << 16  # and from one task's rows, about


def permuted(x: Column, size: Column, *seed: Column) -> Column:
    """``x`` in ``[0, size)`` through a pseudorandom permutation (swap-or-not shuffle).

    Each round pairs x with (key - x) mod size and swaps the pair or not, by a
    hash of its larger member: a bijection for any size.
    """

    def step(at: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(*seed, r, F.lit("key")), size)
        other = F.pmod(key + size - at, size)
        swap = F.xxhash64(*seed, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources sort by code point, null last, and take the weights in turn. Targets
    share the sum of all sizes by weight; one that would exceed ``MOST`` times
    its source stops there and the excess goes to the others by weight. That is
    the level of water in vessels: in order of capacity per weight, a vessel is
    full if the level reached with all before it full would overflow it.
    The windows hold one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * MOST
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    full = F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight")
    # From the first vessel that is not full on, all stand at its level.
    level = F.first(F.when(~full, F.struct("left", "left_weight")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", left).withColumn("left_weight", left_weight)
        .withColumn("full", full).withColumn("level", level)
        .select(
            "source", "source_size",
            F.when(F.col("full") | F.col("level").isNull(), F.col("cap").cast("double"))
            .otherwise(F.col("weight") * F.col("level.left") / F.col("level.left_weight")).alias("target"),
        )
    )


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


def sized(docs: DataFrame, seed: int, order_buckets: int) -> DataFrame:
    """Narrow rows, written once: the texts are read here and nowhere else."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return written(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(n_words(F.col("text")), F.lit(0)).alias("size"),
            order.alias("at"), row_key(docs).alias("tie"),
        ).withColumn("bucket", F.floor(F.col("at") / 2.0**64 * order_buckets + order_buckets / 2).cast("int")),
        "mixing",
    )


def laid_out(rows: DataFrame, block: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Each document's first word in its source's stream, and the table of sources.

    The order in a source is by a hash of the id. Running sums go by (source,
    bucket of the hash), with the sums of the buckets before, so no source is
    ever sorted in one task.
    """
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # Whole passes take the source exactly; the rest is a number of blocks.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / block).cast("long")
    sources = written(
        sources.withColumn("blocks", blocks).withColumn("passes", F.least(passes, F.lit(MOST)))
        .withColumn("slots", F.when(F.col("passes") == MOST, MOST * F.col("blocks")).otherwise(
            F.col("passes") * F.col("blocks") + F.least(rest, F.col("blocks")))),
        "mixing-sources",
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("bucket", F.col("source").alias("s"), "offset", "source_size", "target")
    )
    running = (
        Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = (
        starts.withColumnRenamed("bucket", "b")
        .join(offsets, (F.col("b") == F.col("bucket")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("start", F.col("offset") + F.col("in_bucket"))
        .select("doc_id", "source", "size", "tie", "start", "source_size", "target")
    )
    return placed, sources


def draw_slots(sources: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """``(source, shard, slot, pass, block)``: one row per slot of the mixture."""
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    first = F.coalesce(F.sum("slots").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("slots").over(Window.partitionBy(F.lit(0)))
    chunks = (
        sources.where("slots > 0").withColumn("first", first).withColumn("total", total)
        .select("source", "slots", "blocks", "first", "total",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("low"))
    )
    # By number, or the few narrow chunks would be put in one task again.
    tasks = math.ceil((sources.agg(F.sum("slots")).first()[0] or 1) / TASK_SLOTS)
    chunks = chunks.repartition(tasks, "source", "low")
    numbered = chunks.select(
        "source", "blocks", "first", "total",
        F.explode(F.sequence(F.col("low"), F.least(F.col("low") + CHUNK, F.col("slots")) - 1)).alias("j"),
    )
    slot = permuted(F.col("first") + F.col("j"), F.col("total"), F.lit(seed), F.lit("slots"))
    nth = F.floor(F.col("j") / F.col("blocks")).cast("long")
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("\0")), nth)
    return numbered.select(
        "source", slot.alias("slot"), nth.alias("pass"), block.alias("block"),
    ).withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("long"))


def mix(docs: DataFrame, block: int = 64, weights: tuple[int, ...] = WEIGHTS, seed: int = 7,
        shard_slots: int = 1 << 16, order_buckets: int = 1024) -> DataFrame:
    """What the mixture takes of every row of ``docs(doc_id, source, text)``.

    ``(doc_id, source, tie, size, source_size, target, taken, pieces)``: a hash of
    id, source and text, the size in words (null text: 0), the words taken with
    repeats, and pieces as an array of ``(from_word, n, times)``. Reruns agree: every choice is a hash of seed,
    source, id and index. Rows equal in every used column are interchangeable;
    a row without words takes nothing. An empty table gives no rows. Choose
    ``block`` as the sequence length in training, but well under the words of
    the smallest source, since targets are met to a block.
    """
    placed, sources = laid_out(sized(docs, seed, order_buckets), block, weights)
    taken = draw_slots(sources, seed, shard_slots).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    touched = placed.where("size > 0").select(
        "source", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"),
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # null sources join too
    # Spark takes the size of exploded rows for that of their source: no broadcast may come of it.
    pieces = touched.withColumn("key", key).join(
        taken.withColumn("key", key).select("key", "block", "times").hint("merge"), ["key", "block"])
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    piece = F.struct((low - F.col("start")).alias("from_word"), (high - low).alias("n"), F.col("times"))
    per_doc = pieces.groupBy("key", "start").agg(
        F.sum((high - low) * F.col("times")).alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    # A row without words may share its start with the row after it.
    doc_key = F.when(F.col("size") > 0, key)
    return placed.withColumn("key", doc_key).join(per_doc.hint("merge"), ["key", "start"], "left").select(
        "doc_id", "source", "tie", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents, with the columns of ``docs``.

    A document comes once for each time it is taken, its text cut to the words
    taken that time; a gap between them becomes a line break, and ``n_chars``,
    if there is such a column, is the new length. What is not taken, such as
    texts without words, is gone.
    """
    taken = mix(docs, **options).where("taken > 0").groupBy("tie").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
    rows = docs.select(row_key(docs).alias("tie"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    # Rows that agree in id, source and text share their pieces.
    placed = rows.join(taken.hint("merge"), "tie").dropDuplicates(["tie"])
    each = placed.select("doc", "pieces", F.explode(F.sequence(
        F.lit(1), F.array_max(F.transform("pieces", lambda p: p["times"])).cast("int"))).alias("nth"))
    cut = each.select(
        "doc", F.filter("pieces", lambda p: p["times"] >= F.col("nth")).alias("pieces"),
        F.regexp_extract_all("doc.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)).alias("w"))
    pieces, w = F.col("pieces"), F.col("w")

    def text_of_piece(p: Column, i: Column) -> Column:
        before = F.get(pieces, i - 1)
        gap = (i > 0) & (before["from_word"] + before["n"] != p["from_word"])
        part = F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), p["n"].cast("int")), "")
        return F.when(gap, F.concat(F.lit("\n"), part)).otherwise(part)

    whole = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + p["n"]) == F.size(w)
    text = F.when(whole, F.col("doc.text")).otherwise(F.array_join(F.transform(pieces, text_of_piece), ""))
    mixed = cut.select("doc", text.alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return mixed.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
