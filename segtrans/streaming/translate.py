"""Translation of rows as they arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.langs import check_pair
from ..operators.backends import Backend, make_backend
from ..operators.manifest import Files
from ..operators.memory import TranslationMemory, apply_lookup_columns
from ..plans.tables import as_text, merge_metrics, refuse_names, sketch_metrics, table_lookup, text_columns

BATCH = "batch_id"


def stream_translate(
    stream: DataFrame,
    src: str,
    tgt: str,
    *,
    memory: TranslationMemory,
    out_path: str,
    checkpoint: str,
    columns=None,
    backend: str | Backend = "mock",
    on_error: str = "source",
    name: str | None = None,
    trigger: dict | None = None,
    metrics_path: str | None = None,
    **run,
) -> StreamingQuery:
    """Start the query: each new text is sent once over the life of the stream.

    Every micro-batch writes its own partition of the memory and of the output,
    both by overwrite. A batch that is run again after a failure sees the memory
    as it was before it, and leaves memory and output as if it had run once.
    Batches carry the id that the checkpoint gives the query, so any number of
    streams can share a memory, named or not. A query started anew fences its
    earlier run: that one's batches are refused should it still be alive.
    With ``metrics_path`` each batch leaves a row of mergeable counts there
    (``stream_metrics``), in place of an earlier one of the same batch.
    There is no event time here and so no watermark, and no state but the memory.
    """
    check_pair(src, tgt)
    refuse_names(stream, BATCH)
    backend = make_backend(backend)
    columns = text_columns(stream, columns)
    run_of: dict[str, int] = {}  # the query and its epoch, from the first batch on

    def epoch() -> tuple[str, int]:
        if not run_of:
            query = json.loads(Files(stream.sparkSession, checkpoint).read("metadata"))["id"]
            run_of[query] = memory.fence(query)
        return next(iter(run_of.items()))

    def translate_batch(batch: DataFrame, number: int) -> None:
        rows = as_text(batch, columns)
        query, number_of_run = epoch()
        lookup = table_lookup(
            rows, src, tgt, columns, backend, memory=memory, on_error=on_error,
            batch_id=f"{name or 'stream'}-{query}-{number:010d}", epoch=(query, number_of_run), **run,
        )
        if metrics_path:
            (
                sketch_metrics(rows, columns).withColumns({"query": F.lit(query), BATCH: F.lit(number)})
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("query", BATCH).parquet(metrics_path)
            )
        done = apply_lookup_columns(rows, columns, lookup)
        (
            done.withColumn(BATCH, F.lit(number))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH).parquet(out_path)
        )

    writer = stream.writeStream.foreachBatch(translate_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """Counts over the life of all streams that leave theirs in ``metrics_path``, merged from their batches."""
    return merge_metrics(spark.read.parquet(metrics_path))
