"""First units of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ident, is_translatable

# Units shown of each kind of file, before and after translation.
PREVIEW_BEFORE = {"csv": 5, "docx": 6, "pdf": 8}
PREVIEW_AFTER = {"csv": 4, "docx": 6, "pdf": 6}


def preview(df: DataFrame, group: list[str], order: list[str], n: int,
            text: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, with their number ``n_shown``.

    With ``text``, blank units are passed over first. The limit is applied to
    every input partition before the shuffle, so a document of any size sends at
    most ``n`` rows per task.
    """
    if text is not None:
        df = df.where(is_translatable(text))
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("n_shown", F.row_number().over(window)).where(F.col("n_shown") <= n)


def preview_line(columns: list[str]) -> Column:
    """A table row as one line of text."""
    return F.concat_ws(" | ", *[F.coalesce(ident(c).cast("string"), F.lit("")) for c in columns])
