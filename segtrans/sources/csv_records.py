"""CSV files of any headers as one table of records: file, position, cells.

One pass over the lines of all files, whatever their headers. Large files are
split by Spark; a split may begin inside a quoted cell, so for files of several
splits a light first pass finds, for each split, whether it ends inside quotes
if it begins outside, and if it begins inside. These are functions of one bit,
and chained in file order they say how each split begins. A record that goes on
in the next split is put together from its pieces.

Cells are told apart as usual: a quote opens a cell only at its beginning, two
quotes inside are one, what follows a closing quote is taken as it stands, and a
record ends at a line feed or carriage return outside quotes. Empty lines are no
records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_missing
from ..session import new_work_dir

DOC, POS, EXTRA = "_doc", "_pos", "_extra"
GOOD, UNCLOSED, NOT_UTF8 = 0, 1, 2
CSV_NAMES = "*.[cC][sS][vV]"
PLAIN_END = re.compile(r"[,\r]")
QUOTE_END = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
PLAIN = re.compile(r"[^,\r\n]*+")

# A record, or a piece of one: OPENS goes on in the next split, GOES_ON began in an earlier one.
WHOLE, OPENS, GOES_ON, CLOSES = 0, 1, 2, 3
COLUMNS = ["_doc", "_pos", "part", "problem", "cells", "piece"]
PLAIN_RUN = 8  # lines without quotes in a row that are split together
ROWS_PER_BATCH = 5_000
PARSED = "_doc string, _pos long, part int, problem int, cells array<string>, piece binary"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``, given whether one is in front of it."""
    at = 0
    if not inside:
        at = line.find('"')
    while at >= 0:
        if inside or at == 0 or line[at - 1] in ",\r":
            closed = QUOTE_END.match(line, at if inside else at + 1)
            if closed is None:
                return True
            inside, at = False, closed.end()
            # What follows the closing quote belongs to the cell, up to its end.
            plain = PLAIN_END.search(line, at)
            at = line.find('"', plain.end()) if plain else -1
        else:
            at = line.find('"', at + 1)
    return inside


def split_records(text: str) -> Iterator[list[str]]:
    """The records of a text that ends outside quotes, or at the end of all."""
    if '"' not in text:
        for record in text.split("\r"):
            if record:
                yield record.split(",")
        return
    cells: list[str] = []
    at, some = 0, False
    while True:
        cell = ""
        if text.startswith('"', at):
            closed = QUOTE_END.match(text, at + 1)
            end = closed.end() - 1 if closed else len(text)
            cell, some, at = text[at + 1:end].replace('""', '"'), True, end + 1
        plain = PLAIN.match(text, at)
        if plain:
            cell, at = cell + plain.group(), max(at, plain.end())
        cells.append(cell)
        if at < len(text) and text[at] == ",":
            at += 1
            continue
        if some or len(cells) > 1 or cells[0]:
            yield cells
        cells, some = [], False
        at += 1
        if at >= len(text):
            return


def decoded(raw: bytes) -> tuple[str, int]:
    try:
        return raw.decode("utf-8"), GOOD
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace"), NOT_UTF8


class Split:
    """Records of one split of one file, as its lines come."""

    def __init__(self, doc: str, start: int, last: bool, inside: bool, multi_line: bool):
        self.doc, self.start, self.last, self.multi_line = doc, start, last, multi_line
        self.inside = self.goes_on = inside
        self.n = 0
        self.lines: list[bytes] = []

    def _row(self, part: int, problem: int, cells: list[str] | None, piece: bytes | None) -> tuple:
        # Each record takes a byte or more, so positions rise from split to split.
        self.n += 1
        return self.doc, self.start + self.n - 1, part, problem, cells, piece

    def add(self, raw: bytes) -> Iterator[tuple]:
        if not self.start and not self.n and not self.lines:
            raw = raw.removeprefix(b"\xef\xbb\xbf")
        if not self.lines and not self.goes_on and b'"' not in raw:
            yield from self._records(raw)
            return
        self.lines.append(raw)
        if self.multi_line:
            self.inside = ends_inside(decoded(raw)[0], self.inside)
        if not self.inside:
            yield from self._close()

    def add_all(self, lines: pa.Array, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Lines to ``rows``; runs of plain ones go as batches, which leave the rows before them first."""
        marked = np.flatnonzero(pc.match_substring_regex(lines, b'["\r]').to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lines):
            plain_to = len(lines) if (i := np.searchsorted(marked, at)) == len(marked) else int(marked[i])
            closed = not self.lines and not self.goes_on and (self.start or self.n)
            if closed and plain_to - at >= PLAIN_RUN and (texts := _as_text(lines.slice(at, plain_to - at))) is not None:
                yield _batch(rows)
                rows.clear()
                yield self._plain(texts)
                at = plain_to
            else:
                rows += self.add(lines[at].as_py())
                at += 1

    def _plain(self, texts: pa.Array) -> pa.RecordBatch:
        """Records of lines without quotes: split at once, without a look at each."""
        texts = texts.filter(pc.greater(pc.binary_length(texts), 0))
        n = len(texts)
        pos = np.arange(self.start + self.n, self.start + self.n + n)
        self.n += n
        return pa.RecordBatch.from_arrays(
            [pa.repeat(self.doc, n), pa.array(pos), pa.repeat(pa.scalar(WHOLE, pa.int32()), n),
             pa.repeat(pa.scalar(GOOD, pa.int32()), n), pc.split_pattern(texts, ","), pa.nulls(n, pa.binary())], COLUMNS)

    def _close(self) -> Iterator[tuple]:
        raw, self.lines = b"\n".join(self.lines), []
        if self.goes_on:
            self.goes_on = False
            yield self._row(CLOSES, GOOD, None, raw)
        else:
            yield from self._records(raw)

    def _records(self, raw: bytes, problem: int = GOOD) -> Iterator[tuple]:
        text, found = decoded(raw)
        for cells in split_records(text):
            yield self._row(WHOLE, problem or found, cells, None)

    def end(self) -> Iterator[tuple]:
        if not self.lines:
            return
        if self.last and not self.goes_on:
            yield from self._records(b"\n".join(self.lines), UNCLOSED)
        else:
            yield self._row(GOES_ON if self.goes_on else OPENS, GOOD, None, b"\n".join(self.lines))


def _as_text(lines: pa.Array) -> pa.Array | None:
    try:
        return lines.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], COLUMNS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """The splits in a batch: number, first row, and lines of each."""
    numbers = batch.column("number").to_numpy()
    cuts = (np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
        if b > a:
            yield int(numbers[a]), a, batch.column("line").slice(a, b - a)


def _parser(begin_inside: frozenset[int], multi_line: bool) -> Callable:
    """``begin_inside``: the numbers of the splits that begin inside quotes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, now = None, None
        for batch in batches:
            rows: list[tuple] = []
            for number, at, lines in _runs(batch):
                if split is None or number != now:
                    if split is not None:
                        rows += split.end()
                    doc, start, length, size = (batch.column(c)[at].as_py() for c in ("doc", "start", "length", "size"))
                    split = Split(doc, start, start + length >= size, number in begin_inside, multi_line)
                    now = number
                yield from split.add_all(lines, rows)
            yield _batch(rows)
        if split is not None:
            yield _batch(list(split.end()))

    return parse


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, whether it ends inside quotes if it begins outside, and if it begins inside."""
    now = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [now], pa.schema([("doc", pa.string()), ("start", pa.int64()), ("number", pa.int64()),
                              ("from_out", pa.bool_()), ("from_in", pa.bool_())]))

    for batch in batches:
        for number, at, lines in _runs(batch):
            if now is None or now["number"] != number:
                if now is not None:
                    yield row()
                now = {"doc": batch.column("doc")[at].as_py(), "start": batch.column("start")[at].as_py(),
                       "number": number, "from_out": False, "from_in": True}
            for raw in lines.to_pylist():
                if b'"' in raw:
                    line = decoded(raw)[0]
                    now["from_out"], now["from_in"] = ends_inside(line, now["from_out"]), ends_inside(line, now["from_in"])
    if now is not None:
        yield row()


def _begin_inside(lines: DataFrame) -> frozenset[int]:
    """Numbers of the splits that begin inside a quoted cell.

    Eight bytes for a split at most, so under 10 MB for 100 TB of input.
    """
    splits = lines.where(F.col("length") < F.col("size")).mapInArrow(
        _ends, "doc string, start long, number long, from_out boolean, from_in boolean")
    walk = F.sort_array(F.collect_list(F.struct("start", "number", "from_out", "from_in")))
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("found"))
    walked = splits.groupBy("doc").agg(F.aggregate(walk, state, lambda s, x: F.struct(
        F.when(s["inside"], x["from_in"]).otherwise(x["from_out"]).alias("inside"),
        F.when(s["inside"], F.array_append(s["found"], x["number"])).otherwise(s["found"]).alias("found"))).alias("end"))
    return frozenset(r[0] for r in walked.select(F.explode("end.found")).collect())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, pos, closed, pieces in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_pos", "closed", "pieces"))):
            text, problem = decoded(b"\n".join(pieces))
            for i, cells in enumerate(split_records(text)):
                rows.append((doc, pos + i, WHOLE, problem if closed else UNCLOSED, cells, None))
        yield _batch(rows)


def _from_pieces(pieces: DataFrame) -> DataFrame:
    """Records that lie in several splits; one without a last piece is never closed."""
    so_far = Window.partitionBy(DOC).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.transform(F.sort_array(F.collect_list(F.struct(POS, "piece"))), lambda x: x["piece"])
    records = (
        pieces.withColumn("record", F.count_if(F.col("part") == OPENS).over(so_far)).groupBy(DOC, "record")
        .agg(F.min(POS).alias(POS), F.bool_or(F.col("part") == CLOSES).alias("closed"), found.alias("pieces"))
    )
    whole = F.when(F.col("closed"), F.col("pieces")).otherwise(F.slice("pieces", 1, 1))
    return records.select(DOC, POS, "closed", whole.alias("pieces")).mapInArrow(_joined, PARSED)


def read_csv_records(spark: SparkSession, path, *, multi_line: bool = True, max_bytes: int | None = None) -> DataFrame:
    """``(_doc, _pos, problem, cells)`` of every record of the CSV files below ``path``, headers included.

    ``_doc`` is the address of the file, ``_pos`` rises in file order. ``problem``
    is 0, 1 for a record whose quote is never closed (of a file of several splits:
    what its first split has of it) or 2 for one that is not UTF-8, its bad bytes
    replaced. Without ``multi_line`` a record ends with its line in any case.
    ``max_bytes`` leaves larger files unread. A record is one row, so below 2 GB.
    The records are a table in the work folder.
    """
    conf = spark._jsparkSession.sessionState().conf()
    split_from = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())
    source = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_NAMES).text(path)
    )
    if max_bytes is not None:
        source = source.where(F.col("_metadata.file_size") <= max_bytes)
    lines = source.select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("doc"),
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_size").alias("size"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("number"))
    # Files no larger than this are never split. Both passes read one listing, and so the same splits.
    large = multi_line and not source.where(F.col("_metadata.file_size") > split_from).limit(1).isEmpty()
    begin_inside = _begin_inside(lines) if large else frozenset()
    parsed = lines.mapInArrow(_parser(begin_inside, multi_line), PARSED)
    table = new_work_dir(spark, "csv-records")
    parsed.write.parquet(table)
    parsed = spark.read.schema(parsed.schema).parquet(table)
    whole = parsed.where(F.col("part") == WHOLE)
    if large:
        whole = whole.union(_from_pieces(parsed.where(F.col("part") != WHOLE)))
    return whole.select(DOC, POS, "problem", "cells")


def column_names(header: list[str]) -> list[str]:
    """Names of columns as pandas gives them: an empty one by its number, a repeated one with a number behind."""
    names: list[str] = []
    taken = {name for name in header if name}
    seen: dict[str, int] = {}
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        again = seen.get(name, 0)
        own = name
        while again and own in taken:
            own = f"{name}.{again}"
            again += 1
        seen[name] = max(again, 1)
        taken.add(own)
        names.append(own)
    return names


def names_of(header: str) -> Column:
    """``column_names`` of an array of cells; for a row per file."""
    @F.pandas_udf("array<string>")
    def names(headers: pd.Series) -> pd.Series:
        return headers.map(lambda cells: column_names(list(cells)))

    return names(header)


def is_header_like(cells: str = "cells") -> Column:
    """False for a line of nothing but white space, which is no header."""
    return (F.size(cells) > 1) | (F.btrim(F.get(F.col(cells), F.lit(0))) != "")


def fitted(cells: Column, width: Column) -> Column:
    """As many cells as there are columns, missing-value spellings as null."""
    own = F.transform(F.slice(cells, F.lit(1), width), normalize_missing)
    return F.concat(own, F.array_repeat(F.lit(None).cast("string"), width - F.size(own)))


def surplus(cells: Column, width: Column) -> Column:
    """Whether a record has any text beyond its columns."""
    return F.exists(F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0))), lambda c: c != "")


def stream_csv_cells(spark: SparkSession, folder: str, columns: list[str], *, files_per_batch: int | None = None) -> DataFrame:
    """CSV files as they arrive in ``folder``: the ``columns`` as strings, ``_doc``, ``_pos`` and ``_extra``.

    The rules are those of the folder reader: every file has its own header, with
    any line breaks; columns are found by name, one that a file lacks is missing
    there, short rows are filled up, and the spellings of a missing value are
    null. ``_extra`` has all cells of a row that is longer than its header, whose
    quote is never closed or that is not UTF-8; else it is null. A file arrives
    whole and is read by one task.
    """
    reserved = sorted({DOC, POS, EXTRA} & set(columns))
    if reserved:
        raise ValueError(f"rename these columns, the result has its own: {reserved}")
    stream = spark.readStream.option("pathGlobFilter", CSV_NAMES)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    files = stream.text(folder, wholetext=True).select(F.col("value").cast("binary").alias("content"), F.col("_metadata.file_path").alias("doc"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, doc in zip(batch.column("content"), batch.column("doc").to_pylist()):
                yield from _file_rows(content.as_py(), doc, columns)

    read = files.mapInArrow(rows, "_doc string, _pos long, cells array<string>, _extra array<string>")
    named = [normalize_missing(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return read.select(*named, DOC, POS, EXTRA)


def _lines_of(content: bytes) -> Iterator[bytes]:
    start = 0
    while (end := content.find(b"\n", start)) >= 0:
        yield content[start:end]
        start = end + 1
    yield content[start:]


def _file_rows(content: bytes, doc: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a file, a batch at a time: beside its bytes, no more than that is held."""
    split = Split(doc, 0, True, False, True)
    found = chain((row for line in _lines_of(content) for row in split.add(line)), split.end())
    texts = pa.list_(pa.string())
    schema = pa.schema([("_doc", pa.string()), ("_pos", pa.int64()), ("cells", texts), ("_extra", texts)])
    head, out = None, []
    for _, pos, _, problem, cells, _ in found:
        if head is None:
            if len(cells) > 1 or cells[0].strip():
                head = problem
                place = {name: i for i, name in enumerate(column_names(cells))}
                at = [place.get(c, -1) for c in columns]
            continue
        good = problem == GOOD and head == GOOD and not any(cells[len(place):])
        named = [cells[i] if 0 <= i < len(cells) else None for i in at]
        out.append({"_doc": doc, "_pos": pos, "cells": named if good else None, "_extra": None if good else cells})
        if len(out) == ROWS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)
