"""A folder of CSV files, translated into a folder of CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import check_pair
from ..functions.text import is_translatable
from ..operators.backends import Backend, make_backend
from ..operators.memory import TranslationMemory, apply_lookup
from ..operators.segments import count_segments
from ..session import PACKED, new_work_dir
from ..sinks.csv import BOM, OUTPUT, quoted, write_csv_cells
from ..sources.csv_records import (
    DOC, GOOD, NOT_UTF8, POS, UNCLOSED, fitted, is_header_like, names_of, read_csv_records, surplus,
)
from ..sources.files import (
    REJECTED, accepted_files, common_folder, decoded_path, describe_files, rejected_files, relative_output,
)
from .tables import segment_lookup

TABLE_BYTES = 16 << 20  # names and headers of all files, if they are to be broadcast
NO_ROWS = "no rows"
LONG_ROW = "a row longer than its header"
BROKEN = {UNCLOSED: "a quote that is never closed", NOT_UTF8: "not UTF-8"}


def csv_tables(records: DataFrame) -> DataFrame:
    """``(_doc, head_pos, head_problem, names, width)`` of each file: its first record is its header."""
    first = F.min_by(F.struct("problem", "cells"), POS)
    heads = records.where(is_header_like()).groupBy(DOC).agg(F.min(POS).alias("head_pos"), first.alias("head"))
    return heads.select(
        DOC, "head_pos", F.col("head.problem").alias("head_problem"), names_of("head.cells").alias("names"),
        F.size("head.cells").alias("width"))


def meeting(tables: DataFrame) -> DataFrame:
    """A row per file as a written table, marked for how records are to meet it.

    It is broadcast if all of it is small. Records never are: they pack well, and
    what their files take says little of them.
    """
    spark, path = tables.sparkSession, new_work_dir(tables.sparkSession, "csv-tables")
    tables.write.option("compression", PACKED).parquet(path)
    tables = spark.read.schema(tables.schema).parquet(path)
    size = F.sum(F.octet_length(F.to_json(F.struct(*tables.columns))))
    return tables.hint("broadcast" if (tables.agg(size).first()[0] or 0) <= TABLE_BYTES else "merge")


def translate_csv_files(
    spark: SparkSession,
    path,
    out_dir: str,
    src: str,
    tgt: str,
    *,
    backend: str | Backend = "mock",
    memory: TranslationMemory | None = None,
    on_error: str = "fail",
    max_bytes: int | None = None,
    multi_line: bool = True,
    unit: str = "cell",
    mode: str = "errorifexists",
    **run,
) -> str:
    """Translate every cell; headers stay. Result: ``out_dir/_output=<name>/part-*.csv``.

    The name is the input's path below the folder all inputs share. Every file
    keeps its own header, and a text is translated once for all of them. All
    files are read, translated and written together, in as many jobs for one
    header as for ten thousand. Rows keep their order, and even a single huge
    file is spread over many tasks. Short rows are filled up. What is not
    translated is listed in ``out_dir/_rejected`` as ``(path, reason, row)``:
    files that are no CSV, too large where a limit is set, or without rows, rows
    longer than their header, and rows (or with a header, files) that are not
    UTF-8 or whose quote is never closed. No file stops the others. (Files of no
    bytes at all are not listed by Spark.)
    """
    check_pair(src, tgt)
    backend = make_backend(backend)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(F.col("_metadata.file_path").alias(DOC), "length")
        .withColumn("path", decoded_path(F.col(DOC)))
    )
    files = describe_files(listed)
    good = accepted_files(files, max_bytes, ".csv")
    rejects = rejected_files(files, max_bytes, ".csv").select(
        "path", "reason", F.lit(None).cast("string").alias("row"))
    # The folder that the first and the last path share is shared by all between them.
    ends = good.agg(F.min("path").alias("least"), F.max("path").alias("most")).first()
    if ends.least is not None:
        records = read_csv_records(spark, path, multi_line=multi_line, max_bytes=max_bytes)
        output = relative_output(decoded_path(F.col(DOC)), common_folder([ends.least, ends.most]), ".csv", tgt)
        # What is the same for all rows of a file is made once for it, below the join.
        header = F.concat(F.lit(BOM), F.array_join(F.transform("names", quoted), ","))
        tables = meeting(csv_tables(records).select(
            "*", decoded_path(F.col(DOC)).alias("path"), output.alias(OUTPUT), header.alias("header")))
        rows = records.join(tables, DOC).where(F.col(POS) > F.col("head_pos")).select(
            "path", OUTPUT, POS, "header", "width", "cells", "head_problem",
            F.greatest("problem", "head_problem").alias("problem"),
            surplus(F.col("cells"), F.col("width")).alias("long"))
        kept = rows.where((F.col("problem") == GOOD) & ~F.col("long"))
        cells = kept.select(
            OUTPUT, POS, "header", F.posexplode(fitted(F.col("cells"), F.col("width"))).alias("idx", "text"))
        cells = cells.select(OUTPUT, POS, "idx", "text", F.when(F.col("idx") == 0, F.col("header")).alias("header"))
        segments = count_segments(cells.select(F.col("text").alias("segment")).where(is_translatable("segment")))
        lookup = segment_lookup(segments, src, tgt, backend, unit, memory=memory, on_error=on_error, **run)
        write_csv_cells(apply_lookup(cells, "text", lookup), out_dir, mode)
        rejects = rejects.union(rejected_rows(rows)).union(
            rejected_headers(good, tables, rows))
    rejects.write.mode("overwrite").parquet(f"{out_dir}/{REJECTED}")
    return out_dir


def rejected_rows(rows: DataFrame) -> DataFrame:
    """``(path, reason, row)`` of the rows that are no rows of their table, all their cells as JSON."""
    reason = F.when(F.col("problem") == GOOD, F.when(F.col("long"), LONG_ROW))
    for problem, said in BROKEN.items():
        reason = reason.when(F.col("problem") == problem, said)
    listed = rows.where(F.col("head_problem") == GOOD).select("path", reason.alias("reason"), F.to_json("cells").alias("row"))
    return listed.where(F.col("reason").isNotNull())


def rejected_headers(files: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``(path, reason, row)`` of the files without a row, or whose header cannot be read."""
    heads = tables.select("path", "head_problem", F.to_json("names").alias("row"))
    filled = rows.select("path").distinct().withColumn("filled", F.lit(True))
    joined = files.select("path").join(heads, "path", "left").join(filled, "path", "left")
    reason = F.lit(None).cast("string")
    for problem, said in BROKEN.items():
        reason = F.when(F.col("head_problem") == problem, said).otherwise(reason)
    reason = F.coalesce(reason, F.when(F.col("filled").isNull(), NO_ROWS))
    return joined.select("path", reason.alias("reason"), F.when(F.col("head_problem") != GOOD, F.col("row")).alias("row")).where(
        F.col("reason").isNotNull())
