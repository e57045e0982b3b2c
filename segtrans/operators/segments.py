"""Distinct texts of a table, and those of them not translated yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ident, is_translatable

SEGMENT_KEY = ["src_lang", "tgt_lang", "segment"]


def cells_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The cells of ``columns`` as one ``segment`` column, blanks left out.

    Only the named columns are read: the projection reaches the file scan.
    """
    cell = F.explode(F.array(*[ident(c).cast("string") for c in columns]))
    return df.select(cell.alias("segment")).where(is_translatable("segment"))


def distinct_segments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(segment, uses)``: each non-blank text once, with its number of cells.

    The count costs nothing next to the distinct (both are one aggregation,
    combined before the shuffle) and later tells which texts are hot.
    """
    return count_segments(cells_of(df, columns))


def count_segments(cells: DataFrame) -> DataFrame:
    return cells.groupBy("segment").agg(F.count(F.lit(1)).alias("uses"))


def with_pair(segments: DataFrame, src: str, tgt: str, *more: str) -> DataFrame:
    return segments.select(
        F.lit(src).alias("src_lang"), F.lit(tgt).alias("tgt_lang"), "segment", "uses", *more
    )


def new_segments(segments: DataFrame, memory: DataFrame, on: list[str] | None = None,
                 segments_are_small: bool = False) -> DataFrame:
    """Segments the memory has no translation of.

    With a candidate set of checked, small size the memory is only scanned: the
    candidates are broadcast to find the hits, and hits are no more than
    candidates. Otherwise both sides are shuffled on the text.
    """
    on = on or SEGMENT_KEY
    known = memory.select(*on)
    if segments_are_small:
        known = known.join(F.broadcast(segments.select(*on)), on, "left_semi").distinct()
    return segments.join(known, on, "left_anti")
