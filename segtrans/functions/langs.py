"""Languages and directions of translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported languages and their codes.
LANGUAGES = {
    "english": "en",
    "nepali": "ne",
    "tamang": "tmg",
}
CODES = tuple(LANGUAGES.values())


class LanguageError(ValueError):
    """An unknown language code, or source and target the same."""


def check_pair(src: str, tgt: str) -> None:
    """Reject a direction before any job starts."""
    for code in (src, tgt):
        if code not in CODES:
            raise LanguageError(f"unknown language code {code!r}; expected one of {CODES}")
    if src == tgt:
        raise LanguageError(f"source and target language are both {src!r}")


def check_pairs(pairs) -> list[tuple[str, str]]:
    pairs = list(dict.fromkeys((s, t) for s, t in pairs))
    if not pairs:
        raise LanguageError("no language pair given")
    for src, tgt in pairs:
        check_pair(src, tgt)
    return pairs


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES.items()), "name string, code string")


def language_pairs(spark: SparkSession) -> DataFrame:
    """The directions between the languages; each row is expanded in place."""
    return (
        languages(spark)
        .select(F.col("code").alias("src_lang"), F.explode(F.lit(list(CODES))).alias("tgt_lang"))
        .where(F.col("src_lang") != F.col("tgt_lang"))
    )


def pair_structs(pairs) -> Column:
    """Array literal of (src_lang, tgt_lang), to be exploded next to a row."""
    return F.array(
        *[F.struct(F.lit(s).alias("src_lang"), F.lit(t).alias("tgt_lang")) for s, t in pairs]
    )


def with_lang_code(df: DataFrame, name_col: str, out: str = "lang_code") -> DataFrame:
    """Add the code of the language named (or already coded) in ``name_col``.

    The language list has three entries, so it is a map literal inside the
    projection: no join and nothing to broadcast. Unsupported names give NULL.
    """
    known = {**LANGUAGES, **{c: c for c in CODES}}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return df.withColumn(out, F.element_at(pairs, F.lower(F.col(name_col))))


def pair_ok(src, tgt) -> Column:
    """Row-wise form of :func:`check_pair` for tables that carry their languages."""
    src = F.col(src) if isinstance(src, str) else src
    tgt = F.col(tgt) if isinstance(tgt, str) else tgt
    return F.coalesce(src.isin(*CODES) & tgt.isin(*CODES) & (src != tgt), F.lit(False))
