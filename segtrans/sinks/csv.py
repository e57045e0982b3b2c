"""CSV out, UTF-8 with a byte order mark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ident

BOM = "\ufeff"


def write_csv_bom(df: DataFrame, path: str, *, partition_by: list[str] | None = None,
                  single_file: bool = False, mode: str = "errorifexists") -> str:
    """Write the header with a BOM in front and missing values as empty fields.

    Spark repeats the header in every part file, so each of them opens as a
    table. ``single_file`` is for results known to be small.
    """
    partition_by = partition_by or []
    data = [c for c in df.columns if c not in partition_by]
    first = data[0]
    # A lone missing value would be an empty line, which is no row at all.
    lone = len(data) == 1
    if lone:
        df = df.withColumn(first, F.coalesce(ident(first), F.lit("")))
    out = df.select(
        ident(first).alias(BOM + first), *[ident(c) for c in df.columns if c != first]
    )
    if single_file:
        out = out.coalesce(1)
    writer = out.write.mode(mode).options(
        header=True, quote='"', escape='"', nullValue="", emptyValue='""' if lone else "",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


OUTPUT, LINE = "_output", "_line"
LINES = f"{LINE} long, line string, {OUTPUT} string"


def quoted(cell) -> Column:
    """A cell as it stands in a line: in quotes where it must be, empty where it is missing."""
    cell = ident(cell) if isinstance(cell, str) else cell
    inner = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(cell, F.lit('[",\r\n]')), inner).otherwise(F.coalesce(cell, F.lit("")))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines from cells in order, and in front of a file's first line in each task its header."""
    begun: set[str] = set()
    now, cells, out = None, [], []

    def finish() -> None:
        output, pos, header = now
        if output not in begun:
            begun.add(output)
            out.append((-1, header, output))
        # A lone missing value would be an empty line, which is no row at all.
        out.append((pos, ",".join(cells) or '""', output))

    for batch in batches:
        for output, pos, idx, cell, header in zip(*(c.to_pylist() for c in batch.columns)):
            if idx == 0:
                if now is not None:
                    finish()
                now, cells = (output, pos, header), []
            cells.append(cell)
        yield _line_batch(out)
        out.clear()
    if now is not None:
        finish()
        yield _line_batch(out)


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    types = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [LINE, "line", OUTPUT])


def write_csv_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(_output, _pos, idx, text, header)``, a row per cell, as one folder of CSV parts per ``_output``.

    One job, however many headers there are. Cells are ranged by output and
    position, so a single huge file is spread over many tasks and rows keep their
    order. Each part begins with a byte order mark and the header of its file,
    which is ``header`` of the cells with ``idx`` 0. Every row has cells from 0 on.
    """
    formed = cells.select(OUTPUT, "_pos", "idx", quoted("text").alias("cell"), "header")
    ordered = formed.repartitionByRange(OUTPUT, "_pos").sortWithinPartitions(OUTPUT, "_pos", "idx")
    lines = ordered.mapInArrow(_lines, LINES).sortWithinPartitions(OUTPUT, LINE)
    lines.select("line", OUTPUT).write.mode(mode).partitionBy(OUTPUT).text(path)
    name_parts(cells.sparkSession, path, ".txt", ".csv")


def name_parts(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give the part files below ``folder`` another suffix, as Spark's text writer has but one.

    As many renames as the commit of the job makes itself.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True)
    found = []
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith("part-") and file.getName().endswith(old):
            found.append(file)
    for file in found:
        target = file.getName().removesuffix(old) + new
        fs.rename(file, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.getParent(), target))
