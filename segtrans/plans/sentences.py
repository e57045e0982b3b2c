"""Sentence as the unit of translation (optional; the cell is the default)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_translatable, sentence_pieces
from ..operators.backends import OK, Backend
from ..operators.memory import Lookup, write_measured, apply_lookup, translate_segments
from ..operators.segments import SEGMENT_KEY
from ..session import new_work_dir


def sentence_segments(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per sentence: ``keep`` columns, ``sentence_idx``, ``sentence``, ``separator``.

    ``separator`` is the white space that followed, so that joining sentences and
    separators in order gives the text back to the letter.
    """
    # One array per text, below the explode: the text is searched once, whatever
    # its number of sentences. (An inner explode would search it again for a filter.)
    pieces = df.select(
        *keep, F.posexplode_outer(sentence_pieces(column)).alias("sentence_idx", "_piece")
    )
    return pieces.where("_piece is not null").select(
        *keep, "sentence_idx", F.col("_piece.sentence").alias("sentence"),
        F.coalesce("_piece.separator", F.lit("")).alias("separator"),
    )


def translate_by_sentence(segments: DataFrame, backend: Backend, memory=None,
                          on_error: str = "fail", **run) -> Lookup:
    """Lookup of whole texts, made from the translations of their sentences.

    A text has the worst status of its sentences, with that sentence's error, and
    the most attempts any of them took.

    Works on distinct texts only. Each gets an id that is written before it is
    used, so sentences travel with eight bytes instead of the text around them.
    """
    spark = segments.sparkSession
    work = new_work_dir(spark, "sentences")
    segments.withColumn("text_id", F.monotonically_increasing_id()).write.parquet(f"{work}/texts")
    texts = spark.read.parquet(f"{work}/texts")
    pieces = sentence_segments(
        texts, "segment", "text_id", "src_lang", "tgt_lang", "uses"
    )
    sentences = (
        pieces.where(is_translatable("sentence"))
        .groupBy("src_lang", "tgt_lang", F.col("sentence").alias("segment"))
        .agg(F.sum("uses").alias("uses"))
    )
    lookup = translate_segments(sentences, backend, memory, on_error, **run)
    done = apply_lookup(pieces, "sentence", lookup, pair_columns=True)
    # A group is the sentences of one text, so no larger than one value.
    ordered = F.array_sort(F.collect_list(F.struct("sentence_idx", "sentence", "separator")))
    whole = done.groupBy("text_id").agg(
        F.array_join(
            F.transform(ordered, lambda s: F.concat(s["sentence"], s["separator"])), ""
        ).alias("translation")
    )
    outcome = F.coalesce("status", F.lit("missing"))
    eventful = lookup.df.where((outcome != OK) | (F.col("attempts") > 1)).select(
        "src_lang", "tgt_lang", F.col("segment").alias("sentence"),
        outcome.alias("status"), "attempts", "error",
    )
    # A failure sorts before a success, and the earliest failed sentence counts.
    worst = F.min(F.struct(
        (F.col("status") == OK).alias("fine"), F.col("sentence_idx"), F.col("status"), F.col("error")))
    events = (
        pieces.select("text_id", "src_lang", "tgt_lang", "sentence_idx", "sentence")
        .join(eventful, ["src_lang", "tgt_lang", "sentence"])
        .groupBy("text_id").agg(worst.alias("worst"), F.max("attempts").alias("most"))
    )
    result = texts.join(whole, "text_id", "left").join(events, "text_id", "left").select(
        *SEGMENT_KEY, "uses", "translation",
        F.coalesce("worst.status", F.lit(OK)).alias("status"),
        F.coalesce("most", F.lit(1)).alias("attempts"),
        F.col("worst.error").alias("error"),
    )
    df, seen = write_measured(result, f"{work}/lookup")
    return Lookup(df, calls=lookup.calls, **seen)
