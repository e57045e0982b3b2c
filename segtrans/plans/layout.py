"""Translation of extracted page layout, and the plan to set it again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.langs import check_pair
from ..functions.style import (
    EMPTY_PAGE_GAP_MM, TABLE_GAP_MM, column_width, is_heading, paragraph_style, table_row_role,
)
from ..functions.text import escape_markup, is_translatable, strip_key
from ..operators.backends import Backend, make_backend
from ..operators.layout import GROUP_ROWS, PAGE, Layout, clean_table_cells, extract_blocks
from ..operators.memory import TranslationMemory, apply_lookup, translate_segments
from ..operators.ranking import large_groups, number_rows
from ..operators.segments import count_segments, with_pair
from ..session import PACKED, new_work_dir

LINES_PER_PART = 10_000


@dataclass(frozen=True)
class TranslatedLayout:
    """``blocks`` and ``cells`` have a ``translation``; table cells stay normalised."""

    blocks: DataFrame
    cells: DataFrame
    pages: DataFrame


def distinct_layout_segments(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """``(segment, uses)`` over stripped lines and stripped table cells together."""
    lines = blocks.where(F.col("type") == "text").select(strip_key("line").alias("segment"))
    texts = lines.unionByName(cells.select(strip_key("cell").alias("segment")))
    return count_segments(texts.where(is_translatable("segment")))


def translate_layout(
    layout: Layout, src: str, tgt: str, *, backend: str | Backend = "mock",
    memory: TranslationMemory | None = None, on_error: str = "source",
    dedup: bool | None = None, page_rows: int = GROUP_ROWS, detect_large: bool = True, **run,
) -> TranslatedLayout:
    """Blocks and table cells of all documents, each distinct text translated once.

    A failed text keeps its source by default.
    """
    check_pair(src, tgt)
    backend = make_backend(backend)
    blocks = extract_blocks(layout, page_rows, detect_large)
    cells = clean_table_cells(layout.table_cells)
    line_key, cell_key = strip_key("line"), strip_key("cell")
    pair = F.lit(src), F.lit(tgt)
    inline = backend.as_column(line_key, *pair) is not None
    if dedup is None:
        dedup = not inline or memory is not None

    if not dedup:
        return TranslatedLayout(
            blocks.withColumn("translation", backend.as_column(line_key, *pair)),
            cells.withColumn("translation", backend.as_column(cell_key, *pair)),
            layout.pages,
        )

    # Laid out once, read twice: by the distinct and by the map-back.
    spark = blocks.sparkSession
    path = new_work_dir(spark, "blocks")
    blocks.write.option("compression", PACKED).parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    segments = with_pair(distinct_layout_segments(blocks, cells), src, tgt)
    lookup = translate_segments(segments, backend, memory, on_error, pairs=[(src, tgt)], **run)
    return TranslatedLayout(
        apply_lookup(blocks, "line", lookup, key=line_key, out="translation"),
        apply_lookup(cells, "cell", lookup, key=cell_key, out="translation"),
        layout.pages,
    )


# -------------------------------------------------------------------- reflow

PLAN_COLUMNS = (
    *PAGE, "seq", "part", "kind", "height_mm", "text", "heading", "bold", "underline", "size",
    "leading", "space_before", "space_after", "x0", "table_idx", "n_rows", "n_cols", "col_width",
)


def page_breaks(pages: DataFrame) -> DataFrame:
    """A break in front of every page but the first; page numbers start at 0."""
    return pages.where(F.col("page_idx") > 0).select(
        *PAGE, F.lit(-1).alias("seq"), F.lit(0).alias("part"), F.lit("page_break").alias("kind")
    )


def empty_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A tall gap for each page that has no block."""
    return pages.join(blocks.select(*PAGE).distinct(), PAGE, "left_anti").select(
        *PAGE, F.lit(0).alias("seq"), F.lit(0).alias("part"), F.lit("spacer").alias("kind"),
        F.lit(EMPTY_PAGE_GAP_MM).alias("height_mm"),
    )


def styled_paragraphs(blocks: DataFrame) -> DataFrame:
    """Text blocks with heading flag, style and marked-up translation."""
    text = blocks.where(F.col("type") == "text").withColumn("heading", is_heading())
    return text.withColumn("style", paragraph_style("heading")).select(
        *PAGE, "seq", F.lit(0).alias("part"), F.lit("paragraph").alias("kind"),
        escape_markup("translation", "style.underline").alias("text"), "heading", "style.*", "x0",
    )


def reflow_plan(translated: TranslatedLayout) -> DataFrame:
    """What to set, in order of ``(doc_id, page_idx, seq, part)``.

    Page breaks, gaps, styled paragraphs, and tables between two gaps. The cells
    of a table are in :func:`reflow_cells`, so a table may have any number.
    """
    blocks = translated.blocks
    gap = [F.lit("spacer"), F.lit("table"), F.lit("spacer")]
    tables = blocks.where(F.col("type") == "table").select(
        *PAGE, "seq", F.posexplode(F.array(*gap)).alias("part", "kind"),
        "table_idx", "n_rows", "n_cols",
    ).select(
        "*",
        F.when(F.col("kind") == "spacer", F.lit(TABLE_GAP_MM)).alias("height_mm"),
        F.when(F.col("kind") == "table", column_width("n_cols")).alias("col_width"),
    )
    plan = styled_paragraphs(blocks)
    for rows in (tables, page_breaks(translated.pages), empty_pages(translated.pages, blocks)):
        plan = plan.unionByName(rows, allowMissingColumns=True)
    return plan.select(*PLAN_COLUMNS)


def reflow_cells(cells: DataFrame) -> DataFrame:
    """Cells with the role of their row and marked-up translation."""
    return cells.select(
        *PAGE, "table_idx", "row_idx", "col_idx", table_row_role().alias("role"),
        escape_markup("translation").alias("text"),
    )


def text_lines(translated: TranslatedLayout) -> DataFrame:
    """The translated text as ordered lines: ``(page, seq, row_idx, text)``.

    A table gives a line per row, its cells between tabs.
    """
    blocks = translated.blocks
    text = blocks.where(F.col("type") == "text").select(
        *PAGE, "seq", F.lit(0).alias("row_idx"), F.col("translation").alias("text")
    )
    cells = F.array_sort(F.collect_list(F.struct("col_idx", "translation")))
    rows = translated.cells.groupBy(*PAGE, "table_idx", "row_idx").agg(
        F.array_join(F.transform(cells, lambda c: c["translation"]), "\t").alias("text")
    )
    tables = blocks.where(F.col("type") == "table").select(*PAGE, "table_idx", "seq")
    return text.unionByName(
        rows.join(tables, [*PAGE, "table_idx"]).select(*PAGE, "seq", "row_idx", "text")
    )


def reassemble_text(translated: TranslatedLayout, lines_per_part: int = LINES_PER_PART,
                    page_rows: int = GROUP_ROWS, detect_large: bool = True) -> DataFrame:
    """``(doc_id, page_idx, part, text)``: each page as text in reading order.

    A page of more lines than ``lines_per_part`` comes in several consecutive
    parts, so no row and no group outgrows a task.
    """
    lines = text_lines(translated)
    large = None
    if detect_large:
        per_block = F.coalesce(F.col("n_rows"), F.lit(1))
        large = large_groups(translated.blocks, PAGE, page_rows, per_block)
    lines = number_rows(
        lines, PAGE, [F.col("seq"), F.col("row_idx")], "_line", large
    ).withColumn("part", F.floor(F.col("_line") / lines_per_part).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("_line", "text")))
    return lines.groupBy(*PAGE, "part").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")
    )
