"""Column expressions for span and paragraph style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_upper

# Font flag bits, sizes in points, page geometry.
FLAG_ITALIC = 1 << 1
FLAG_BOLD = 1 << 4
DEFAULT_SIZE = 10.0
HEADING_SIZE = 14
BOLD_HEADING_SIZE = 11
MIN_SIZE, MAX_SIZE = 8, 18
LEADING_EXTRA = 4
SPACE_AFTER = 2
SPACE_BEFORE_HEADING = 6
MM = 72.0 / 25.4
PAGE_WIDTH = 210 * MM
PAGE_MARGIN = 20 * MM
TABLE_GAP_MM = 3
EMPTY_PAGE_GAP_MM = 20


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _font_has(font: Column, word: str) -> Column:
    return F.contains(font, F.lit(word.capitalize())) | F.contains(font, F.lit(word))


def span_bold(flags="flags", font="font") -> Column:
    bit = _col(flags).bitwiseAND(F.lit(FLAG_BOLD)) != 0
    return F.coalesce(bit, F.lit(False)) | F.coalesce(_font_has(_col(font), "bold"), F.lit(False))


def span_italic(flags="flags", font="font") -> Column:
    bit = _col(flags).bitwiseAND(F.lit(FLAG_ITALIC)) != 0
    return F.coalesce(bit, F.lit(False)) | F.coalesce(_font_has(_col(font), "italic"), F.lit(False))


def span_fontsize(size="size") -> Column:
    """Whole points, halves to even."""
    return F.bround(F.coalesce(_col(size), F.lit(DEFAULT_SIZE)), 0).cast("int")


def round_point(y) -> Column:
    """A coordinate as a whole number of points, halves to even."""
    return F.bround(_col(y), 0).cast("int")


def is_heading(line="line", fontsize="fontsize", bold="is_bold") -> Column:
    line, fontsize, bold = _col(line), _col(fontsize), _col(bold)
    return (
        (fontsize >= HEADING_SIZE)
        | (bold & (fontsize >= BOLD_HEADING_SIZE))
        | ((F.length(line) > 2) & is_upper(line))
    )


def paragraph_style(heading, fontsize="fontsize", bold="is_bold", italic="is_italic",
                    underline="is_underline") -> Column:
    """Struct with the style a reflowed line is set in."""
    heading = _col(heading)
    size = F.least(F.greatest(_col(fontsize), F.lit(MIN_SIZE)), F.lit(MAX_SIZE))
    return F.struct(
        ((_col(bold) | heading) & ~_col(italic)).alias("bold"),
        _col(underline).alias("underline"),
        size.alias("size"),
        (size + LEADING_EXTRA).alias("leading"),
        F.when(heading, F.lit(SPACE_BEFORE_HEADING)).otherwise(F.lit(0)).alias("space_before"),
        F.lit(SPACE_AFTER).alias("space_after"),
    )


def table_row_role(row_idx="row_idx") -> Column:
    """Row 0 is the (repeated) header; the others alternate between two shades."""
    row = _col(row_idx)
    return (
        F.when(row == 0, F.lit("header"))
        .when(F.pmod(row, F.lit(2)) == 1, F.lit("body_a"))
        .otherwise(F.lit("body_b"))
    )


def column_width(n_cols) -> Column:
    """Equal column width in points over the usable width of the page."""
    return F.lit(PAGE_WIDTH - 2 * PAGE_MARGIN) / _col(n_cols)
