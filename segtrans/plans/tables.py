"""Translation of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.langs import check_pair, check_pairs, pair_structs
from ..functions.text import ident, is_translatable
from ..operators.backends import Backend, make_backend
from ..operators.memory import Lookup, TranslationMemory, apply_lookup_columns, translate_segments
from ..operators.segments import distinct_segments, with_pair
from .sentences import translate_by_sentence


def text_columns(df: DataFrame, columns=None, cast_non_string: bool = False) -> list[str]:
    """The columns to translate: those asked for, else the string ones, else all."""
    if columns is not None:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"no such column: {unknown}")
        return list(columns)
    if cast_non_string:
        return df.columns
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def refuse_names(df: DataFrame, *names: str) -> None:
    """Fail early where a column has a name the result needs for its own."""
    taken = [c for c in df.columns if c.lower() in names]
    if taken:
        raise ValueError(f"rename these columns, the result has its own: {taken}")


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to translate as strings; string columns are left alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if all(isinstance(types[c], StringType) for c in columns):
        return df
    return df.select(*[
        ident(c).cast("string").alias(c) if c in columns else ident(c) for c in df.columns
    ])


def table_lookup(df: DataFrame, src: str, tgt: str, columns: list[str], backend: Backend,
                 unit: str = "cell", **run) -> Lookup:
    """Distinct texts of the columns, translated and written."""
    return segment_lookup(distinct_segments(df, columns), src, tgt, backend, unit, **run)


def segment_lookup(segments: DataFrame, src: str, tgt: str, backend: Backend, unit: str = "cell",
                   **run) -> Lookup:
    """Distinct ``(segment, uses)``, translated and written."""
    segments = with_pair(segments, src, tgt)
    run["pairs"] = [(src, tgt)]
    if unit == "sentence":
        return translate_by_sentence(segments, backend, **run)
    if unit != "cell":
        raise ValueError(f"unit must be 'cell' or 'sentence', not {unit!r}")
    return translate_segments(segments, backend, **run)


def translate_inline(df: DataFrame, src: str, tgt: str, columns: list[str],
                     backend: Backend) -> DataFrame:
    """Evaluate a column backend in place: one projection, no shuffle, no join."""
    def value(c: str):
        made = backend.as_column(ident(c), F.lit(src), F.lit(tgt))
        return F.when(is_translatable(ident(c)), made).otherwise(ident(c)).alias(c)

    return df.select(*[value(c) if c in columns else ident(c) for c in df.columns])


def translate_table(
    df: DataFrame,
    src: str,
    tgt: str,
    *,
    columns=None,
    backend: str | Backend = "mock",
    memory: TranslationMemory | None = None,
    on_error: str = "fail",
    cast_non_string: bool = False,
    dedup: bool | None = None,
    unit: str = "cell",
    **run,
) -> DataFrame:
    """Translate the text columns; rows, columns, missing and blank cells survive.

    With ``dedup`` each distinct text goes to the backend once, results are
    written, and the table is read a second time to take them in. That pays for
    any real backend and is the default for one; a backend that is just a column
    expression is by default evaluated in place.
    """
    check_pair(src, tgt)
    backend = make_backend(backend)
    columns = text_columns(df, columns, cast_non_string)
    df = as_text(df, columns)
    if not columns:
        return df
    is_expression = backend.as_column(F.lit(""), F.lit(src), F.lit(tgt)) is not None
    if dedup is None:
        dedup = not is_expression or memory is not None or unit != "cell"
    if not dedup:
        if not is_expression:
            raise ValueError("only a column backend can run without dedup")
        return translate_inline(df, src, tgt, columns, backend)
    lookup = table_lookup(
        df, src, tgt, columns, backend, unit, memory=memory, on_error=on_error, **run
    )
    return apply_lookup_columns(df, columns, lookup)


def translate_pairs(
    df: DataFrame,
    pairs,
    *,
    columns=None,
    backend: str | Backend = "mock",
    memory: TranslationMemory | None = None,
    on_error: str = "fail",
    cast_non_string: bool = False,
    **run,
) -> DataFrame:
    """Each row once per direction, with ``src_lang`` and ``tgt_lang`` in front.

    The distinct texts are found once for all directions, and the table is
    expanded in place by a literal of at most six directions.
    """
    pairs = check_pairs(pairs)
    refuse_names(df, "src_lang", "tgt_lang")
    backend = make_backend(backend)
    columns = text_columns(df, columns, cast_non_string)
    df = as_text(df, columns)
    pair = F.explode(pair_structs(pairs)).alias("pair")
    segments = distinct_segments(df, columns).select("*", pair).select("pair.*", "segment", "uses")
    lookup = translate_segments(segments, backend, memory, on_error, pairs=pairs, **run)
    wide = df.select(pair, *[ident(c) for c in df.columns]).select(
        "pair.*", *[ident(c) for c in df.columns]
    )
    return apply_lookup_columns(wide, columns, lookup, pair_columns=True)


def table_metrics(df: DataFrame, columns=None) -> DataFrame:
    """One row: cells, missing, blank, non-blank and distinct texts of a table.

    ``distinct_texts`` is the number of calls a run makes. Two counts side by
    side, each combined before its shuffle; no text is collected.
    """
    columns = text_columns(df, columns)
    cell = F.explode(F.array(*[ident(c).cast("string") for c in columns])).alias("segment")
    per_text = df.select(cell).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    live = is_translatable("segment")
    zero = F.lit(0).cast("bigint")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), zero)

    return per_text.agg(
        F.coalesce(F.sum("n"), zero).alias("cells"),
        total(F.col("segment").isNull()).alias("missing"),
        total(F.col("segment").isNotNull() & ~live).alias("blank"),
        total(live).alias("texts"),
        F.count_if(live).alias("distinct_texts"),
    )


SKETCH_BITS = 12  # registers of a sketch as a power of two: a standard error of 1.6 %


def sketch_metrics(df: DataFrame, columns=None) -> DataFrame:
    """As ``table_metrics``, but mergeable: distinct texts as a sketch, which no shuffle of texts is needed for."""
    columns = text_columns(df, columns)
    cell = F.explode(F.array(*[ident(c).cast("string") for c in columns])).alias("segment")
    live = is_translatable("segment")
    return df.select(cell).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("segment").isNull()).alias("missing"),
        F.count_if(F.col("segment").isNotNull() & ~live).alias("blank"),
        F.count_if(live).alias("texts"),
        F.hll_sketch_agg(F.when(live, F.col("segment")), F.lit(SKETCH_BITS)).alias("sketch"),
    )


def merge_metrics(parts: DataFrame) -> DataFrame:
    """One row for any number of rows of ``sketch_metrics``; ``distinct_texts`` is an estimate.

    A text that several parts have counts once, which their numbers of distinct
    texts could not tell.
    """
    zero = F.lit(0).cast("bigint")
    sums = [F.coalesce(F.sum(c), zero).alias(c) for c in ("cells", "missing", "blank", "texts")]
    return parts.agg(*sums, F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), zero).alias("distinct_texts"))
