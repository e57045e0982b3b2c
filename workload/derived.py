"""Tables the base data does not have, derived from ``documents`` by fixed rules.

Document lines become page lines, ", "-separated pieces become spans or runs, and
positions, fonts and boxes follow from the row numbers. ``oracle`` states the
same rules in SQL. Layout and run tables are stored once per session, as the
output of an extractor would be; queries start from the stored tables.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtrans.operators.layout import Layout
from segtrans.session import PACKED, new_work_dir

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its footer is read once per session, not per use."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of a table of fewer files than cores (one may be a single row group) dealt out by ``columns``."""
    return df if len(df.inputFiles()) >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(*columns)


def stored(build):
    """Write what ``build(spark, sf_dir)`` gives on first use, and read it from then on."""

    @lru_cache(maxsize=64)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(spark, sf_dir)
        path = new_work_dir(spark, build.__name__)
        made.write.option("compression", PACKED).parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    return read


def document_lines(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """``dealt``: for tables that are stored; the texts are spread, not the many wide rows made of them."""
    docs = table(spark, sf_dir, "documents")
    if dealt:
        docs = spread(docs.select("doc_id", "text"), "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


def conversation_lines(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_idx", "line")
    )


def pieces(spark, sf_dir) -> DataFrame:
    lines = document_lines(spark, sf_dir, dealt=True)
    return lines.select(
        "doc_id", "line_idx", F.posexplode(F.split("line", ", ")).alias("span_idx", "raw")
    )


@stored
def spans(spark, sf_dir) -> DataFrame:
    d, line, span = F.col("doc_id"), F.col("line_idx"), F.col("span_idx")
    total = d + line + span
    font = (
        F.when(total % 5 == 0, "NotoSans-Bold").when(total % 5 == 1, "NotoSans-Italic")
        .otherwise("NotoSans")
    )
    text = (
        F.when(total % 17 == 0, "  ")
        .when((d + line) % 9 == 0, F.translate("raw", LOWER, UPPER))
        .otherwise(F.col("raw"))
    )
    flags = (total % 2) * 16 + F.when((d + span) % 3 == 0, 2).otherwise(0)
    left = 40.0 + (line % 2) * 250
    top = 40.0 + F.floor((line % 20) / 2) * 60
    return pieces(spark, sf_dir).select(
        "doc_id", F.floor(line / 20).cast("int").alias("page_idx"),
        line.alias("block_idx"), F.lit(0).alias("block_type"), left.alias("block_x0"),
        "line_idx", top.alias("line_y0"), "span_idx", text.alias("text"),
        flags.cast("int").alias("flags"), font.alias("font"),
        ((16 + (d * 7 + line * 13 + span * 5) % 24) / 2).alias("size"),
        (left + span * 60).alias("x0"), top.alias("y0"),
        (left + span * 60 + 50).alias("x1"), (top + 12).alias("y1"),
    )


@stored
def layout_pages(spark, sf_dir) -> DataFrame:
    """Pages 0 to the page of the last line, straight from the line count."""
    last = F.floor((F.size(F.split("text", "\n")) - 1) / 20).cast("int").alias("last")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", last), "doc_id")
    return docs.select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page_idx"),
        F.lit(595.0).alias("width"),
    )


@stored
def table_boxes(spark, sf_dir) -> DataFrame:
    pages = layout_pages(spark, sf_dir)
    return pages.where((F.col("doc_id") + F.col("page_idx")) % 3 == 0).select(
        "doc_id", "page_idx", F.lit(0).alias("table_idx"), F.lit(30.0).alias("x0"),
        F.lit(160.0).alias("y0"), F.lit(280.0).alias("x1"), F.lit(290.0).alias("y1"),
    )


@stored
def table_cells(spark, sf_dir) -> DataFrame:
    d, row, col = F.col("doc_id"), F.col("row_idx"), F.col("col_idx")
    number = ((d * row + col) % 11).cast("string")
    cell = F.when((row + col + d) % 7 != 0, F.concat(F.lit("  item "), number, F.lit(" ")))
    return (
        table_boxes(spark, sf_dir).where(d % 11 != 0)
        .select("doc_id", "page_idx", "table_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row_idx"))
        .select("*", F.explode(F.sequence(F.lit(0), (1 + (row + d) % 2).cast("int"))).alias("col_idx"))
        .select("*", cell.alias("cell"))
    )


@stored
def drawings(spark, sf_dir) -> DataFrame:
    n = F.col("path_idx")
    y1 = 52.0 + n * 120 + (F.col("doc_id") % 2) * 0.5
    pages = layout_pages(spark, sf_dir)
    return pages.select(
        "doc_id", "page_idx", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("path_idx")
    ).select(
        "*", F.lit(0).alias("item_idx"),
        F.when(n % 3 == 2, "f").otherwise("s").alias("path_type"),
        F.when(n % 4 == 3, "re").otherwise("l").alias("item_kind"),
        F.lit(40.0).alias("x1"), y1.alias("y1"), F.lit(540.0).alias("x2"),
        (y1 + F.when(n == 1, 3).otherwise(0)).alias("y2"),
    )


def layout(spark, sf_dir) -> Layout:
    return Layout(
        spans(spark, sf_dir), table_boxes(spark, sf_dir), table_cells(spark, sf_dir),
        drawings(spark, sf_dir), layout_pages(spark, sf_dir),
    )


@stored
def runs(spark, sf_dir) -> DataFrame:
    """Run table; paragraphs with ``line_idx % 7 = 3`` sit in table cells."""
    line = F.col("line_idx")
    parts = document_lines(spark, sf_dir, dealt=True).select("doc_id", "line_idx", F.split("line", ", ").alias("p"))
    in_table = line % 7 == 3
    return parts.select(
        "doc_id", "line_idx", F.size("p").alias("n"), F.posexplode("p").alias("run_idx", "piece")
    ).select(
        "doc_id",
        F.when(in_table, 0).alias("table_idx"), F.when(in_table, line).alias("row_idx"),
        F.when(in_table, 0).alias("col_idx"), line.alias("para_idx"), "run_idx",
        F.concat("piece", F.when(F.col("run_idx") < F.col("n") - 1, ", ").otherwise("")).alias("text"),
        ((F.col("doc_id") + line + F.col("run_idx")) % 2 == 1).alias("bold"),
    )


def files(spark, sf_dir) -> DataFrame:
    ext = (
        F.when(F.col("doc_id") % 4 == 0, ".csv").when(F.col("doc_id") % 4 == 1, ".docx")
        .when(F.col("doc_id") % 4 == 2, ".PDF").otherwise(".txt")
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
        (F.col("n_chars") * 64).alias("length"),
    )
