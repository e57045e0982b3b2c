"""From extracted spans, rules and table boxes to blocks in reading order.

Everything is keyed by page. A page can hold any share of the rows: where there
are large pages, rows carry a ``salt`` (a function of the line, so a line is never
divided; 0 on all other pages), and the few boxes and rules of a large page are
repeated per salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.style import (
    round_point, span_bold, span_fontsize, span_italic,
)
from ..functions.text import clean_cell, strip_key
from .ranking import GROUP_ROWS, large_groups, number_rows

PAGE = ["doc_id", "page_idx"]
LINE = [*PAGE, "block_idx", "line_idx"]
# A rule is flat below this, and underlines spans closer than that.
FLAT_BELOW = 2
UNDERLINE_WITHIN = 6
# On large pages boxes are met by bands of the page this many points high.
BAND = 64


@dataclass(frozen=True)
class Layout:
    """The five tables an extractor delivers."""

    spans: DataFrame
    table_boxes: DataFrame
    table_cells: DataFrame
    drawings: DataFrame
    pages: DataFrame


# ------------------------------------------------------------------- salting


def salt_lines(df: DataFrame, large: DataFrame | None, rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``salt``: 0, or for a large page one of as many values as it needs."""
    if large is None:
        return df
    many = F.broadcast(large.select(*PAGE, F.ceil(F.col("n_rows") / rows).alias("_salts")))
    line = F.pmod(F.xxhash64("block_idx", "line_idx"), F.col("_salts")).cast("int")
    return (
        df.join(many, PAGE, "left")
        .withColumn("salt", F.coalesce(line, F.lit(0)))
        .drop("_salts")
    )


def page_key(df: DataFrame) -> list[str]:
    return [*PAGE, "salt"] if "salt" in df.columns else PAGE


def repeat_per_salt(df: DataFrame, large: DataFrame | None, rows: int = GROUP_ROWS) -> DataFrame:
    """The page-side of a salted join: one copy for each salt of a large page."""
    if large is None:
        return df
    many = F.broadcast(large.select(*PAGE, F.ceil(F.col("n_rows") / rows).alias("_salts")))
    last = F.coalesce(F.col("_salts").cast("int"), F.lit(1)) - 1
    return (
        df.join(many, PAGE, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )


# --------------------------------------------------------------------- spans


def text_spans(spans: DataFrame) -> DataFrame:
    """Spans of text blocks; pictures are left out. Blank spans are still there."""
    return spans.where(F.col("block_type") == 0)


def span_style(spans: DataFrame) -> DataFrame:
    """Add ``is_bold``, ``is_italic`` and ``fontsize``."""
    return spans.select(
        "*", span_bold().alias("is_bold"), span_italic().alias("is_italic"),
        span_fontsize().alias("fontsize"),
    )


def horizontal_rules(drawings: DataFrame) -> DataFrame:
    """Distinct ``(page, y)`` of the flat stroked lines."""
    flat = (
        (F.col("path_type") == "s") & (F.col("item_kind") == "l")
        & (F.abs(F.col("y1") - F.col("y2")) < FLAT_BELOW)
    )
    return drawings.where(flat).select(*PAGE, round_point("y1").alias("y")).distinct()


def underlined_spans(spans: DataFrame, rules: DataFrame, large: DataFrame | None = None,
                     rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``is_underline``: a rule lies within 6 points of the span's bottom.

    Both positions are whole points, so "within" is one of 11 values: each rule
    is spread over them and the band test becomes an equality, at most one match
    per span.
    """
    own = "salt" in spans.columns
    if not own:
        spans = salt_lines(spans, large, rows)
    reach = UNDERLINE_WITHIN - 1
    covered = rules.select(
        *PAGE, F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("bottom")
    ).distinct()
    covered = repeat_per_salt(covered, large, rows).withColumn("_hit", F.lit(True))
    # There are as many rules as the pages have, and their size is estimated from the
    # file, before they are spread: a broadcast of them would outgrow the driver.
    flagged = (
        spans.withColumn("bottom", round_point("y1"))
        .join(covered.hint("merge"), [*page_key(spans), "bottom"], "left")
        .withColumn("is_underline", F.col("_hit").isNotNull())
    )
    keep = [*spans.columns, "is_underline"]
    return flagged.select(*(keep if own else [c for c in keep if c != "salt"]))


# --------------------------------------------------------------------- lines


TABLE = ["table_idx", "n_rows", "n_cols"]
STYLE = ["is_bold", "is_italic", "is_underline", "fontsize"]
PIECE = ["span_idx", "text", *STYLE]
PLACE = ["x0", "y0", "x1", "y1", "line_y0", "block_x0"]


def _assemble(spans: DataFrame, key: list[str]) -> DataFrame:
    """One row per ``key``: spans in order, their text, the style of the longest.

    The key holds the line; a line is one text value, so what is collected for it
    is no larger than that.
    """
    # Stripped below the aggregation: once per span. Spans are collected once and
    # the rest is read off the array, which costs half of separate aggregates.
    spans = spans.withColumn("text", strip_key("text"))
    grouped = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(*PIECE, *PLACE))).alias("all")
    )
    live = F.filter("all", lambda s: s["text"] != "")
    pieces = F.transform(live, lambda s: F.struct(*[s[c].alias(c) for c in PIECE]))
    lengths = F.transform("spans", lambda s: F.length(s["text"]))
    # array_position finds the first of equals, as a tie requires.
    longest = (F.array_position("lengths", F.array_max("lengths")) - 1).cast("int")
    return (
        grouped.select(*key, F.col("all")[0].alias("first"), pieces.alias("spans"))
        .withColumn("lengths", lengths)
        .withColumn("dominant", F.get("spans", longest))
        .select(
            *key, F.col("first.line_y0").alias("y_top"), F.col("first.block_x0").alias("x0"),
            F.struct("first.x0", "first.y0", "first.x1", "first.y1").alias("first_box"), "spans",
            F.array_join(F.col("spans").getField("text"), " ").alias("line"),
            *[f"dominant.{c}" for c in STYLE],
        )
    )


def assemble_lines(spans: DataFrame) -> DataFrame:
    """One row per visual line that has text.

    ``line`` is its non-blank spans, stripped, one space between. Style is that
    of the longest span, the first of them on a tie. ``first_box`` is the box of
    the first span, blank or not.
    """
    key = [*page_key(spans)[len(PAGE):], *LINE]
    return _assemble(spans, key).where(F.size("spans") > 0)


def assemble_blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines and table blocks together, partitioned by page.

    The few table rows join the spans before these are shuffled, so that the one
    shuffle by page serves lines, table boxes and page order.
    """
    if "salt" in spans.columns:
        tables = tables.withColumn("salt", F.lit(0))
    rows = spans.unionByName(tables.withColumnRenamed("y_top", "line_y0"), allowMissingColumns=True)
    key = page_key(spans)
    blocks = _assemble(rows.repartition(*key), [*key, "block_idx", "line_idx", *TABLE])
    text = F.col("table_idx").isNull()
    return (
        blocks.where(~text | (F.size("spans") > 0))
        .withColumns({
            "type": F.when(text, F.lit("text")).otherwise(F.lit("table")),
            "spans": F.when(text, F.col("spans")), "line": F.when(text, F.col("line")),
        })
    )


def dominant_span(spans: DataFrame) -> DataFrame:
    """``(line key, span_idx, text, ...)`` of the longest span of each line."""
    rest = [c for c in spans.columns if c not in LINE]
    best = F.max_by(F.struct(*rest), F.struct(F.length("text"), -F.col("span_idx")))
    spans = spans.withColumn("text", strip_key("text"))
    return spans.where(F.col("text") != "").groupBy(*LINE).agg(best.alias("best")).select(*LINE, "best.*")


def drop_text_in_tables(lines: DataFrame, boxes: DataFrame, large: DataFrame | None = None,
                        rows: int = GROUP_ROWS) -> DataFrame:
    """Lines whose first span is not centred in a table box of the page.

    The match is by page; with large pages also by salt and by a horizontal band,
    so that a line is held only against the boxes at its height.
    """
    own = "salt" in lines.columns
    if not own:
        lines = salt_lines(lines, large, rows)
    box = boxes.select(
        *PAGE, F.col("x0").alias("bx0"), F.col("y0").alias("by0"),
        F.col("x1").alias("bx1"), F.col("y1").alias("by1"),
    )
    cx = (F.col("line.first_box.x0") + F.col("line.first_box.x1")) / 2
    cy = (F.col("line.first_box.y0") + F.col("line.first_box.y1")) / 2
    same_page = F.lit(True)
    for name in page_key(lines):
        same_page = same_page & (F.col(f"line.{name}") == F.col(f"box.{name}"))
    if large is not None:
        bands = F.sequence(F.floor(F.col("by0") / BAND), F.floor(F.col("by1") / BAND))
        box = repeat_per_salt(box.where("by0 <= by1").withColumn("band", F.explode(bands)), large, rows)
        same_page = same_page & (F.floor(cy / BAND) == F.col("box.band"))
    box, line = box.alias("box"), lines.alias("line")
    inside = cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1"))
    # Boxes grow with the pages and compress well, so they are not broadcast by their file's size.
    left = line.join(box.hint("merge"), same_page & inside, "left_anti")
    return left if own else left.drop("salt")


# -------------------------------------------------------------------- tables


def clean_table_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell", clean_cell("cell"))


def table_shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table; the longest row sets the columns."""
    return cells.groupBy(*PAGE, "table_idx").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")
    )


def table_blocks(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes that have cells, with their shape; an empty grid makes no block.

    Boxes and cells go through one aggregation together, so there is no join.
    """
    box = boxes.select(*PAGE, "table_idx", F.col("y0").alias("y_top"))
    grid = cells.select(*PAGE, "table_idx", "row_idx", "col_idx")
    tables = box.unionByName(grid, allowMissingColumns=True).groupBy(*PAGE, "table_idx").agg(
        F.min("y_top").alias("y_top"),
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"),
    )
    return tables.where(F.col("y_top").isNotNull() & F.col("n_rows").isNotNull()).select(
        *PAGE, "y_top", "table_idx", "n_rows", "n_cols"
    )


# -------------------------------------------------------------------- blocks


def merge_blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Text and table blocks of the pages under one schema."""
    text = lines.drop("first_box").withColumn("type", F.lit("text"))
    table = tables.withColumn("type", F.lit("table"))
    return text.unionByName(table, allowMissingColumns=True)


def reading_order(blocks: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Add ``seq``: from the top of the page down, text before tables on a tie,
    and otherwise the order of extraction."""
    order = [
        F.col("y_top"), (F.col("type") == "table").cast("int"), F.col("block_idx"),
        F.col("line_idx"), F.col("table_idx"),
    ]
    return number_rows(blocks, PAGE, order, "seq", large)


def large_pages(layout: Layout, page_rows: int = GROUP_ROWS) -> DataFrame | None:
    """Pages with more spans, or more tables, than one task should take."""
    spans = text_spans(layout.spans).select(*PAGE)
    return large_groups(spans.unionAll(layout.table_boxes.select(*PAGE)), PAGE, page_rows)


def extract_blocks(layout: Layout, page_rows: int = GROUP_ROWS, detect_large: bool = True) -> DataFrame:
    """All blocks of all pages in reading order.

    The spans are shuffled twice: by position for the underlines, then by page,
    where lines, table boxes and page order all meet without moving again.
    """
    spans = text_spans(layout.spans)
    large = large_pages(layout, page_rows) if detect_large else None
    styled = underlined_spans(
        salt_lines(span_style(spans), large, page_rows), horizontal_rules(layout.drawings),
        large, page_rows,
    )
    blocks = assemble_blocks(styled, table_blocks(layout.table_boxes, layout.table_cells))
    # A table block has no first box, so it is in no table.
    kept = drop_text_in_tables(blocks, layout.table_boxes, large, page_rows)
    return reading_order(kept.drop("salt", "first_box"), large)
