"""Column expressions over segment text (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's ``str.strip`` treats as whitespace.
WS_CODE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WS = "".join(chr(c) for c in WS_CODE_POINTS)

# Cell texts pandas' CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# A sentence ends at one of these marks when white space follows.
SENTENCE_END = ".!?।"


def ident(name: str) -> Column:
    """Column by its literal name: headers may hold dots and back quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_key(c) -> Column:
    """``str.strip()`` as a column: Unicode white space off both ends."""
    return F.btrim(_col(c), F.lit(WS))


def is_translatable(c) -> Column:
    """True for text that is neither missing nor blank; never NULL."""
    c = _col(c)
    return c.isNotNull() & (F.btrim(c, F.lit(WS)) != "")


def normalize_missing(c) -> Column:
    """NULL for every spelling of a missing value, the text itself otherwise."""
    c = _col(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def clean_cell(c) -> Column:
    """Table-cell text: stripped, empty string where the extractor gave none."""
    return F.coalesce(strip_key(c), F.lit(""))


def is_upper(c) -> Column:
    """``str.isupper()``: some cased character and none of them lower or title.

    Two searches that stop at the first hit, so the usual mixed-case line costs
    a couple of characters and never builds an upper-cased copy.
    """
    c = _col(c)
    return ~c.rlike(r"[\p{IsLowercase}\p{Lt}]") & c.rlike(r"\p{IsUppercase}")


def escape_markup(c, underline=None) -> Column:
    """Text made safe inside markup; ``<u>`` around it where ``underline``."""
    safe = _col(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    if underline is None:
        return safe
    return F.when(_col(underline), F.concat(F.lit("<u>"), safe, F.lit("</u>"))).otherwise(safe)


def sentence_array(c) -> Column:
    """Sentences of a text, in order."""
    return F.split(_col(c), rf"(?<=[{SENTENCE_END}])\s+")


def separator_array(c) -> Column:
    """White space between the sentences; one element fewer than sentences."""
    return F.regexp_extract_all(_col(c), F.lit(rf"(?<=[{SENTENCE_END}])(\s+)"), F.lit(1))


def sentence_pieces(c) -> Column:
    """Sentences with the white space after each, as one array of structs."""
    return F.arrays_zip(sentence_array(c).alias("sentence"), separator_array(c).alias("separator"))


def segment_hash(c) -> Column:
    """64-bit companion of a text join key: cheap to compare, not a key itself."""
    return F.xxhash64(_col(c))
