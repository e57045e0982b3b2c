"""CSV in: every column a string, missing values normalised, order kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ident, normalize_missing
from .csv_records import DOC, POS

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}


def read_csv_cells(
    spark: SparkSession,
    path,
    *,
    multi_line: bool = True,
    mode: str = "FAILFAST",
    with_position: bool = False,
    max_bytes: int | None = None,
    **options,
) -> DataFrame:
    """Read CSV files that share one header; another header fails loudly.

    Nothing is inferred, so ``007`` stays ``007``. ``multi_line`` allows line
    breaks inside quotes, at the price of one task per file; without it large
    files are split. With ``with_position`` the file (``_doc``) and the position
    of the row (``_pos``, rising in file order) come along. ``max_bytes`` prunes
    larger files before they are opened.
    """
    raw = (
        spark.read.options(**{**CSV_OPTIONS, **options})
        .option("multiLine", multi_line).option("mode", mode).csv(path)
    )
    cells = [normalize_missing(ident(c)).alias(c) for c in raw.columns]
    if max_bytes is not None:
        raw = raw.where(F.col("_metadata.file_size") <= max_bytes)
    if with_position:
        cells += [
            F.col("_metadata.file_path").alias(DOC), F.monotonically_increasing_id().alias(POS)
        ]
    return raw.select(*cells)


def normalize_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing-value spellings to NULL in the named columns of any table."""
    return df.select(*[
        normalize_missing(ident(c)).alias(c) if c in columns else ident(c) for c in df.columns
    ])
