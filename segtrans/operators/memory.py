"""The translation memory, and the lookup a run takes from it."""

from __future__ import annotations

import math
import time
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ident, is_translatable, segment_hash
from ..session import PACKED, new_work_dir, run_id, with_int
from .backends import OK, Backend, run_backend
from .filters import BITS_PER_TEXT, BUCKETS, FILTERS, bucket, buckets_of_share, filters_of, probe, share
from .manifest import Manifest
from .segments import SEGMENT_KEY, new_segments

# A lookup is broadcast up to this many bytes of text; its size is measured
# while it is written, never guessed.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 128  # of a broadcast row in memory, beside its text
COLUMNS_AT_ONCE = 8  # joins in place that may hold a broadcast of that size in one task; with more it must be smaller
DIGEST_BYTES = 32  # of SHA-256, by which longer texts are matched: a shuffle moves them on one side only
# A text filling more cells than this (or than 1/HOT_SHARE of all) is hot.
HOT_ROWS = 1_000_000
HOT_SHARE = 100_000
ROW = "_row"

MEMORY_SCHEMA = (
    "segment string, translation string, status string, attempts int, error string, "
    "src_lang string, tgt_lang string, backend string, batch_id string"
)
PAIR = ["src_lang", "tgt_lang"]
# Sixteen batches of about one size are merged into one, so a text is rewritten
# as often as its memory has grown sixteenfold, and few files hold a bucket.
MERGED_AT = 16
FEW_ROWS = 100_000  # of a batch, counted: no more are read rather than asked by filters
EVERYWHERE = (0, BUCKETS - 1)
TEXTS_PER_FILE = 200_000
TEXTS_PER_TASK = 5_000
FILTER_BYTES = 32 << 20  # of filters in a task that tests texts


class TranslationFailed(RuntimeError):
    """Some segments failed and the policy is to stop."""


class Fenced(RuntimeError):
    """Another run of the same query has taken over."""


class TranslationMemory:
    """Finished calls in files of hash buckets, with a manifest of the files that count.

    A batch is written to a folder of its own and counts from the moment the
    manifest names it, in place of an earlier batch of the same id, so running a
    batch again never doubles its rows. The manifest knows of each file its
    direction and run of buckets: reading some buckets opens only files that
    have them. Beside a large batch lie Bloom filters of its files, by which most
    new texts are told without reading any. Batches are merged as they get many;
    what is no longer named is left to whoever owns the folder. Rows of failed
    calls are kept for the report, but are not translations: ``read`` leaves them
    out, and the next run tries these texts again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, f"{path}/_manifest", {"entries": [], "epochs": {}})

    def exists(self) -> bool:
        return self.manifest.exists()

    def entries(self, backend: str | None = None) -> list[dict]:
        return [e for e in self.manifest.read()[1]["entries"] if backend in (None, e["backend"])]

    def files(self, backend: str | None = None, *, before_batch: str | None = None,
              batches: list[str] | None = None, pairs: list[tuple[str, str]] | None = None,
              buckets: Sequence[int] | None = None, entries: list[dict] | None = None) -> list[str]:
        """The files that can have rows of these batches, directions and (sorted) buckets."""
        found = []
        for entry in self.entries(backend) if entries is None else entries:
            if entry["batch"] == before_batch or (batches is not None and entry["batch"] not in batches):
                continue
            for file, src, tgt, low, high, _ in entry["files"]:
                if pairs is not None and (src, tgt) not in pairs:
                    continue
                if buckets is None or bisect_left(buckets, low) < bisect_right(buckets, high):
                    found.append(f"{self.path}/data/{file}")
        return found

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], MEMORY_SCHEMA)
        rows = self.spark.read.schema(MEMORY_SCHEMA).option("basePath", f"{self.path}/data").parquet(*files)
        return rows.select(*[f.split()[0] for f in MEMORY_SCHEMA.split(", ")])

    def read(self, backend: str | None = None, before_batch: str | None = None,
             pairs: list[tuple[str, str]] | None = None, buckets: list[int] | None = None,
             batches: list[str] | None = None) -> DataFrame:
        """Good translations; ``before_batch`` leaves that batch's own rows out.

        Only files of the backend, the directions and the ``buckets`` are opened.
        """
        files = self.files(backend, before_batch=before_batch, batches=batches, pairs=pairs, buckets=buckets)
        rows = self._good(files, before_batch, pairs)
        return rows if buckets is None else rows.where(bucket("segment").isin(buckets))

    def _good(self, files: list[str], before_batch: str | None, pairs: list[tuple[str, str]] | None) -> DataFrame:
        rows = self._rows(files).where(F.col("status") == OK)
        if before_batch:
            rows = rows.where(F.col("batch_id") != before_batch)
        return rows.where(_of_pairs(pairs)) if pairs else rows

    def failures(self, batch_id: str | None = None) -> DataFrame:
        rows = self._rows(self.files()).where(F.col("status") != OK)
        return rows.where(F.col("batch_id") == batch_id) if batch_id else rows

    def fence(self, query: str) -> int:
        """A new epoch for a query; batches of its earlier epochs are refused from now on."""
        def later(content: dict) -> None:
            content["epochs"][query] = content["epochs"].get(query, 0) + 1

        return self.manifest.change(later)["epochs"][query]

    def write_batch(self, results: DataFrame, backend: str, batch_id: str,
                    epoch: tuple[str, int] | None = None) -> None:
        """Add a batch, in place of an earlier one of its id; ``epoch`` is what ``fence`` gave a query."""
        own = results.select(
            "segment", "translation", "status", "attempts", "error", *PAIR,
            F.lit(backend).alias("backend"), F.lit(batch_id).alias("batch_id"))
        entry = self._write(own, backend, batch_id)

        def publish(content: dict) -> None:
            if epoch is not None and content["epochs"].get(epoch[0]) != epoch[1]:
                raise Fenced(f"{epoch[0]}: epoch {epoch[1]} is over")
            content["entries"] = [
                e for e in content["entries"] if (e["backend"], e["batch"]) != (backend, batch_id)] + [entry]

        self.manifest.change(publish)

    def _write(self, rows: DataFrame, backend: str, batch_id: str) -> dict:
        """Rows, and filters if they are many, in folders of their own, not yet named by the manifest."""
        name = f"entry={run_id()}"
        rows.write.option("compression", PACKED).partitionBy(*PAIR).parquet(f"{self.path}/data/{name}")
        written = self.spark.read.schema(MEMORY_SCHEMA).parquet(f"{self.path}/data/{name}")
        in_file = bucket("segment")
        counted = written.groupBy(F.col("_metadata.file_path").alias("file"), *PAIR).agg(
            F.min(in_file).alias("low"), F.max(in_file).alias("high"), F.count(F.lit(1)).alias("n"))
        # A row for each file that this job has just committed.
        files = [[r.file[r.file.rindex(f"/{name}/") + 1:], *r[1:]] for r in counted.collect()]
        filtered = sum(f[5] for f in files) > FEW_ROWS
        if filtered:
            filters_of(written, F.col("status") == OK).write.parquet(f"{self.path}/filters/{name}")
        return {"id": name, "backend": backend, "batch": batch_id, "files": files, "filtered": filtered}

    def split_known(self, texts: DataFrame, backend: str, *, before_batch: str | None = None,
                    pairs: list[tuple[str, str]] | None = None, between: tuple[int, int] = EVERYWHERE,
                    texts_are_small: bool = False) -> tuple[DataFrame, list[int]]:
        """The texts without a translation, and the buckets in which large batches may have others.

        Filters of the large batches tell most texts that are new to them, and
        their rows are read only of buckets where a text may be known. Small
        batches, of which merging leaves few, are read. ``between``: the buckets
        that the texts are in.
        """
        low, high = between
        entries = [e for e in self.entries(backend) if e["batch"] != before_batch]
        large = [e for e in entries if e["filtered"]]
        held = sum(f[5] for e in large for f in e["files"] if f[3] <= high and f[4] >= low)
        touched: list[int] = []
        if held:
            filters = self.spark.read.schema(FILTERS).parquet(*(f"{self.path}/filters/{e['id']}" for e in large))
            filters = filters.where((F.col("low") <= high) & (F.col("high") >= low) & (F.col("known") > 0))
            if pairs:
                filters = filters.where(_of_pairs(pairs))
            tasks = min(max(-(-held * BITS_PER_TEXT // (8 * FILTER_BYTES)), self.spark.sparkContext.defaultParallelism), BUCKETS)
            path, seen = new_work_dir(self.spark, "probed"), Observation(f"probed-{run_id()}")
            tested = probe(texts, filters, tasks)
            tested.observe(seen, F.collect_set(F.when(F.col("maybe"), bucket())).alias("buckets")).write.option("compression", PACKED).parquet(path)
            tested = self.spark.read.schema(tested.schema).parquet(path)
            touched, columns = sorted(seen.get["buckets"]), texts.columns
            texts = tested.where("not maybe").select(*columns)
            if touched:
                known = self._good(self.files(entries=large, pairs=pairs, buckets=touched), before_batch, pairs)
                maybe = tested.where("maybe").select(*columns)
                missed = new_segments(maybe, known, segments_are_small=texts_are_small)
                texts = texts.union(missed.select(*columns))
        small = self.files(entries=[e for e in entries if not e["filtered"]], pairs=pairs, buckets=range(low, high + 1))
        if small:
            known = self._good(small, before_batch, pairs)
            texts = new_segments(texts, known, segments_are_small=texts_are_small).select(*texts.columns)
        return texts, touched

    def known(self, backend: str, pairs: list[tuple[str, str]] | None, touched: list[int]) -> DataFrame:
        """Translations of the texts that ``split_known`` has found, and others beside them."""
        entries = self.entries(backend)
        files = self.files(entries=[e for e in entries if not e["filtered"]], pairs=pairs)
        if touched:
            files += self.files(entries=[e for e in entries if e["filtered"]], pairs=pairs, buckets=touched)
        return self._good(files, None, pairs)

    def compact(self, backend: str, batch_id: str, files: int | None = None) -> str:
        """Merge all batches of a backend into one, in place: a text has one row, the earliest batch's."""
        return self._merge(self.entries(backend), backend, batch_id, files)

    def merge_small(self, backend: str) -> None:
        """Merge the batches of one size as soon as there are many of them."""
        by_size: dict[int, list[dict]] = {}
        for entry in self.entries(backend):
            rows = sum(f[5] for f in entry["files"])
            by_size.setdefault(int(math.log(max(rows, 1), MERGED_AT)), []).append(entry)
        for entries in by_size.values():
            if len(entries) >= MERGED_AT:
                self._merge(entries, backend, f"merged-{run_id()}")

    def _merge(self, entries: list[dict], backend: str, batch_id: str, files: int | None = None) -> str:
        rows = self._rows(self.files(entries=entries))
        good = one_per_key(rows.where(F.col("status") == OK), "batch_id").withColumn("backend", F.lit(backend))
        names = [f.split()[0] for f in MEMORY_SCHEMA.split(", ")]
        all_rows = good.select(*names).union(rows.where(F.col("status") != OK).select(*names))
        n = sum(f[5] for e in entries for f in e["files"])
        entry = self._write(in_ranges(all_rows, files or -(-n // TEXTS_PER_FILE)), backend, batch_id)
        old = {e["id"] for e in entries}

        def swap(content: dict) -> None:
            there = [e for e in content["entries"] if e["id"] in old]
            if len(there) == len(old):  # else another writer has replaced one of them; both stay as they are
                content["entries"] = [e for e in content["entries"] if e["id"] not in old] + [entry]

        self.manifest.change(swap)
        return self.path


def _of_pairs(pairs: list[tuple[str, str]]) -> Column:
    return reduce(or_, [(F.col("src_lang") == s) & (F.col("tgt_lang") == t) for s, t in pairs])


def in_ranges(texts: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt to ``tasks`` equal ranges of the hash of their text."""
    tasks = max(1, min(tasks, BUCKETS))
    return texts.repartitionById(tasks, share(tasks))


def one_per_key(memory: DataFrame, *more: str) -> DataFrame:
    """The earliest batch wins where two runs translated the same text at once."""
    first = F.min_by(F.struct("translation", "status", "attempts", "error", *more), F.col("batch_id"))
    return memory.groupBy(*SEGMENT_KEY).agg(first.alias("row")).select(*SEGMENT_KEY, "row.*")


def build_memory(segments: DataFrame, backend: Backend, memory: TranslationMemory | None = None,
                 **run) -> DataFrame:
    """Each distinct segment translated once, as a plan; nothing is written."""
    if memory is not None:
        segments = new_segments(segments, memory.read(backend.name))
    return run_backend(segments, backend, **run)


@dataclass(frozen=True)
class Lookup:
    """Written table ``(src_lang, tgt_lang, segment, uses, translation, status, ...)``.

    One row per text the run uses, so joining it never multiplies rows.
    """

    df: DataFrame
    rows: int
    uses: int
    bytes: int
    failed: int
    calls: int

    @property
    def weight(self) -> int:
        """Bytes of the lookup as a broadcast: of short texts the rows outweigh what they hold."""
        return self.bytes + ROW_BYTES * self.rows

    def failures(self) -> DataFrame:
        return self.df.where(F.coalesce(F.col("status"), F.lit("missing")) != OK)


@dataclass
class RunReport:
    """What a run did; pass one as ``report=`` to any translation and read it afterwards."""

    calls: int = 0
    distinct_texts: int = 0
    failed: int = 0
    seconds: float = 0.0
    failures: DataFrame | None = None

    def fill(self, lookup: Lookup, seconds: float) -> None:
        self.calls, self.distinct_texts, self.failed = lookup.calls, lookup.rows, lookup.failed
        self.seconds, self.failures = seconds, lookup.failures()


def text_bytes() -> Column:
    """Of a row of a lookup."""
    return F.octet_length("segment") + F.coalesce(F.octet_length("translation"), F.lit(0))


def write_measured(df: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Write and, in the same job, count rows and bytes of what is written."""
    seen = Observation(f"lookup-{run_id()}")
    df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"),
        F.coalesce(F.sum(text_bytes()), F.lit(0)).alias("bytes"),
        F.count_if(F.coalesce(F.col("status"), F.lit("missing")) != OK).alias("failed"),
    ).write.mode("errorifexists").option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _stop_on_failures(lookup: Lookup, on_error: str) -> None:
    if on_error == "source" or not lookup.failed:
        return
    some = lookup.failures().select("segment", "status", "error").limit(5).collect()
    shown = "; ".join(f"{r.segment[:60]!r}: {r.status} {r.error or ''}".strip() for r in some)
    raise TranslationFailed(f"{lookup.failed} segments failed, for example {shown}")


def translate_segments(
    segments: DataFrame,
    backend: Backend,
    memory: TranslationMemory | None = None,
    on_error: str = "fail",
    *,
    report: RunReport | None = None,
    **run,
) -> Lookup:
    """As :func:`lookup_of`; fills in ``report``, then stops on failures if that is the policy."""
    if on_error not in ("fail", "source"):
        raise ValueError(f"on_error must be 'fail' or 'source', not {on_error!r}")
    start = time.monotonic()
    lookup = lookup_of(segments, backend, memory, **run)
    if report is not None:
        report.fill(lookup, time.monotonic() - start)
    _stop_on_failures(lookup, on_error)
    return lookup


def lookup_of(
    segments: DataFrame,
    backend: Backend,
    memory: TranslationMemory | None = None,
    parallel_calls: int | None = None,
    slices: int = 1,
    batch_id: str | None = None,
    pairs: list[tuple[str, str]] | None = None,
    epoch: tuple[str, int] | None = None,
    calls_per_second: float | None = None,
) -> Lookup:
    """Translate ``(src_lang, tgt_lang, segment, uses)`` and return the run's lookup.

    Results are on disk before anything joins them: a plan that still held the
    backend would call it again for every action and every lost executor. With a
    memory, only new texts are sent; ``slices`` > 1 sends them in that many
    separately committed batches, so a lost run resumes after its last batch.
    ``pairs`` names the directions, where known, so that no others are read. A
    slice is a range of the hash of its texts: it reads the filters of that range,
    and rows only of buckets where one of its texts may be known. ``epoch`` is for
    queries that may be started twice (``TranslationMemory.fence``).
    """
    spark = segments.sparkSession
    work = new_work_dir(spark, "translate")
    if memory is None and slices > 1:
        memory = TranslationMemory(spark, f"{work}/memory")

    if memory is None:
        results = run_backend(segments, backend, parallel_calls, calls_per_second=calls_per_second)
        df, seen = write_measured(results, f"{work}/lookup")
        return Lookup(df, calls=seen["rows"], **seen)

    # Cut the lineage here: the slices and the lookup all start from this table.
    sized = Observation(f"segments-{run_id()}")
    (
        segments.observe(
            sized,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length("segment")), F.lit(0)).alias("bytes"),
        )
        .withColumn("slice", share(slices))
        .write.option("compression", PACKED).partitionBy("slice").parquet(f"{work}/segments")
    )
    rows, small = sized.get["rows"], sized.get["bytes"] <= BROADCAST_BYTES
    written = spark.read.schema(with_int(segments.schema, "slice")).parquet(f"{work}/segments")
    batch_id = batch_id or f"run-{run_id()}"
    fresh = not memory.exists()
    in_jvm = backend.as_column(F.col("segment"), F.col("src_lang"), F.col("tgt_lang")) is not None
    # As many files as their texts need, and enough tasks to make them.
    per_slice, cores = -(-rows // slices), spark.sparkContext.defaultParallelism
    files = max(-(-per_slice // TEXTS_PER_FILE), min(cores, per_slice // TEXTS_PER_TASK))
    calls, batches, hits = 0, [], set()
    for number in range(slices if rows else 0):
        batch = f"{batch_id}-{number:05d}"
        batches.append(batch)
        todo = written.where(F.col("slice") == number).drop("slice")
        if not fresh:
            todo, touched = memory.split_known(
                todo, backend.name, before_batch=batch, pairs=pairs,
                between=buckets_of_share(number, slices), texts_are_small=small)
            hits.update(touched)
        if in_jvm:  # other backends have their texts dealt to ranges of the hash
            todo = in_ranges(todo, files)
        made = Observation(f"calls-{run_id()}")
        memory.write_batch(
            run_backend(todo, backend, parallel_calls, texts=per_slice, calls_per_second=calls_per_second)
            .observe(made, F.count(F.lit(1)).alias("n")),
            backend.name, batch, epoch,
        )
        calls += made.get["n"]

    texts = written.drop("slice")
    known = memory.read(backend.name, pairs=pairs, batches=batches)
    if not fresh:
        earlier = memory.known(backend.name, pairs, sorted(hits))  # small batches of this run among them
        if small:
            earlier = earlier.join(F.broadcast(texts.select(*SEGMENT_KEY)), SEGMENT_KEY, "left_semi")
        known = known.unionByName(earlier)
    result = texts.join(one_per_key(known), SEGMENT_KEY, "left")
    df, seen = write_measured(result, f"{work}/lookup")
    lookup = Lookup(df, calls=calls, **seen)
    if lookup.failed:
        reasons = memory._rows(memory.files(backend.name, batches=batches, pairs=pairs)).where(F.col("status") != OK)
        failed = lookup.df.drop("status", "attempts", "error").join(
            reasons.select(*SEGMENT_KEY, "status", "attempts", "error"), SEGMENT_KEY, "left"
        )
        lookup = Lookup(
            failed.withColumn("status", F.coalesce("status", F.lit(OK))), lookup.rows, lookup.uses,
            lookup.bytes, lookup.failed, calls,
        )
    memory.merge_small(backend.name)
    return lookup


# ------------------------------------------------------------------ map back


def _hot_texts(lookup: Lookup, hot_rows: int, limit: int) -> DataFrame | None:
    """The most used texts, cut off so that they fit a broadcast.

    A text counts as hot from ``uses >= least`` on, so there are at most
    ``lookup.uses / least`` of them; ``least`` is raised until their measured
    bytes are within the limit too. Texts below it stay in the shuffled join.
    """
    least = max(hot_rows, lookup.uses // HOT_SHARE)
    while least <= lookup.uses:
        hot = lookup.df.where(F.col("uses") >= least)
        bytes_ = hot.agg(F.sum(text_bytes()).alias("b")).first()["b"]
        if bytes_ is None:
            return None
        if bytes_ <= limit:
            return hot
        least *= 8
    return None


def _matched_by(text: Column) -> Column:
    """A text shorter than its digest as it is, any other by its digest, which no shorter text equals."""
    digest = F.unhex(F.sha2(F.encode(text, "utf-8"), 256))
    return F.when(F.octet_length(text) < DIGEST_BYTES, F.encode(text, "utf-8")).otherwise(digest)


def apply_lookup(
    df: DataFrame,
    column: str,
    lookup: Lookup,
    *,
    key: Column | None = None,
    out: str | None = None,
    pair_columns: bool = False,
    keep_source: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace ``column`` (or fill ``out``) with the translation of ``key``.

    Missing stays missing and a text without translation stays as it is. A small
    lookup is broadcast and the table is not shuffled at all. A large one is
    joined by shuffle, with the hot texts taken out first by a broadcast of just
    those; rows that need no shuffled match are spread over all partitions
    instead of meeting in the one for NULL.
    """
    key = ident(column) if key is None else key
    out = out or column
    pair = ["src_lang", "tgt_lang"] if pair_columns else []
    source = ident(column) if keep_source else F.lit(None).cast("string")

    def side(rows: DataFrame, tag: str, by: Column = F.col("segment")) -> DataFrame:
        return rows.where(F.col("translation").isNotNull()).select(
            *[F.col(p).alias(f"{tag}_{p}") for p in pair],
            segment_hash("segment").alias(f"{tag}_hash"),
            by.alias(f"{tag}_segment"),
            F.col("translation").alias(f"{tag}_translation"),
        )

    def matches(tag: str, on: Column) -> Column:
        cond = on == F.col(f"{tag}_segment")
        for p in pair:
            cond = cond & (F.col(p) == F.col(f"{tag}_{p}"))
        return cond

    keep = [ident(c) for c in df.columns if c != out]
    # ``out`` takes the place of an existing column of that name.
    order = [ident(c) for c in df.columns] + ([] if out in df.columns else [ident(out)])

    if lookup.weight <= broadcast_bytes:
        joined = df.join(F.broadcast(side(lookup.df, "_all")), matches("_all", key), "left")
        result = joined.select(*keep, F.coalesce("_all_translation", source).alias(out))
        return result.select(*order)

    hot = _hot_texts(lookup, hot_rows, broadcast_bytes)
    if hot is not None:
        df = df.join(F.broadcast(side(hot, "_hot")), matches("_hot", key), "left")
        found = F.col("_hot_translation")
        rest = F.when(found.isNull(), key)
    else:
        found, rest = F.lit(None).cast("string"), key
    # The partition id is the same for every row of a task, so a task run again
    # sends its rows to the same places whatever order it reads them in.
    spread = F.xxhash64(F.lit("no match needed"), F.spark_partition_id())
    df = df.withColumn("_rest", rest).withColumn(
        "_rest_hash", F.when(F.col("_rest").isNotNull(), segment_hash("_rest")).otherwise(spread)
    ).withColumn("_rest", _matched_by(F.col("_rest")))
    # Its file is packed: by that size Spark would broadcast what was weighed as too large.
    joined = df.join(
        side(lookup.df, "_cold", _matched_by(F.col("segment"))).hint("merge"),
        (F.col("_rest_hash") == F.col("_cold_hash")) & matches("_cold", F.col("_rest")),
        "left",
    )
    return joined.select(
        *keep, F.coalesce(found, F.col("_cold_translation"), source).alias(out)
    ).select(*order)


def apply_lookup_columns(
    df: DataFrame,
    columns: list[str],
    lookup: Lookup,
    *,
    pair_columns: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace several columns by their translations; the table is shuffled once at most.

    A small lookup is broadcast, to each column in place. Beyond, the table is
    written once with a number for each row; only (row, column, text) goes
    through the join with the lookup, and what it finds comes back as one map
    per row. Two exchanges, whatever the number of columns.
    """
    if lookup.weight * max(1, len(columns) / COLUMNS_AT_ONCE) <= broadcast_bytes or len(columns) < 2:
        options = {"pair_columns": pair_columns, "broadcast_bytes": broadcast_bytes, "hot_rows": hot_rows}
        return reduce(lambda d, c: apply_lookup(d, c, lookup, **options), columns, df)
    spark = df.sparkSession
    path = new_work_dir(spark, "rows")
    # Written, because a row's number must be the same in both readings.
    df.withColumn(ROW, F.monotonically_increasing_id()).write.option("compression", PACKED).parquet(path)
    rows = spark.read.schema(df.withColumn(ROW, F.lit(0).cast("long")).schema).parquet(path)
    pair = ["src_lang", "tgt_lang"] if pair_columns else []
    cells = rows.select(
        ROW, *pair, F.posexplode(F.array(*[ident(c) for c in columns])).alias("_column", "_text")
    ).where(is_translatable("_text"))
    found = apply_lookup(cells, "_text", lookup, out="_found", pair_columns=pair_columns,
                         keep_source=False, broadcast_bytes=broadcast_bytes, hot_rows=hot_rows)
    per_row = (
        found.where("_found is not null").groupBy(ROW)
        .agg(F.map_from_entries(F.collect_list(F.struct("_column", "_found"))).alias("_new"))
    )
    joined = rows.join(per_row, ROW, "left")
    place = {c: i for i, c in enumerate(columns)}
    return joined.select(*[
        F.coalesce(F.element_at("_new", F.lit(place[c])), ident(c)).alias(c) if c in place else ident(c)
        for c in df.columns
    ])


def apply_memory(df: DataFrame, column: str, memory: DataFrame, out: str | None = None) -> DataFrame:
    """Plain map-back against any ``(segment, translation)`` table with unique segments.

    For tables of unknown size: the join is left to runtime statistics.
    """
    out = out or column
    side = memory.select(F.col("segment").alias("_segment"), F.col("translation").alias("_translation"))
    joined = df.join(side, ident(column) == F.col("_segment"), "left")
    value = F.coalesce("_translation", ident(column)).alias(out)
    keep = [ident(c) for c in df.columns if c != out]
    order = [ident(c) for c in df.columns] + ([] if out in df.columns else [ident(out)])
    return joined.select(*keep, value).select(*order)
