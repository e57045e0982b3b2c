"""The stream gives what the batch gives, and calls no text twice."""

import sys

from pyspark.sql import functions as F
from test_memory import Counting

from segtrans.operators.memory import TranslationMemory
from segtrans.session import ship_by_value
from segtrans.streaming.translate import stream_translate

ship_by_value(sys.modules[Counting.__module__])
SCHEMA = "id int, v string"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, backend, checkpoint="checkpoint"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    memory = TranslationMemory(spark, f"{folder}/memory")
    stream_translate(stream, "en", "ne", memory=memory, out_path=f"{folder}/out", backend=backend,
                     checkpoint=f"{folder}/{checkpoint}", name="s").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").select("id", "v").collect()
    return memory, sorted(map(tuple, rows))


def test_new_texts_only(spark, tmp_path):
    backend = Counting(spark)
    write(spark, tmp_path, [(1, "a"), (2, "b"), (3, "a"), (4, " "), (5, None)])
    _, rows = run(spark, tmp_path, backend)
    assert backend.seen.value == 2
    write(spark, tmp_path, [(6, "b"), (7, "c")])
    memory, rows = run(spark, tmp_path, backend)
    assert backend.seen.value == 3
    assert rows == [(1, "<ne>a"), (2, "<ne>b"), (3, "<ne>a"), (4, " "), (5, None), (6, "<ne>b"), (7, "<ne>c")]
    assert memory.read().groupBy("segment").count().where(F.col("count") > 1).isEmpty()


def test_batches_run_again_change_nothing(spark, tmp_path):
    backend = Counting(spark)
    write(spark, tmp_path, [(1, "a"), (2, "b")])
    memory, rows = run(spark, tmp_path, backend)
    # A new checkpoint makes the stream start over with the same batch number.
    memory, again = run(spark, tmp_path, backend, "other")
    assert rows == again and memory.read().count() == 2


def test_metrics_are_merged_and_replaced(spark, tmp_path):
    from segtrans.plans.tables import merge_metrics, sketch_metrics, table_metrics
    from segtrans.streaming.translate import stream_metrics

    write(spark, tmp_path, [(1, "a"), (2, "b"), (3, "a"), (4, " "), (5, None)])
    write(spark, tmp_path, [(6, "b"), (7, "c")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_translate(stream, "en", "ne", memory=TranslationMemory(spark, f"{tmp_path}/memory"), out_path=f"{tmp_path}/out",
                     checkpoint=f"{tmp_path}/checkpoint", metrics_path=f"{tmp_path}/metrics").awaitTermination()
    assert tuple(stream_metrics(spark, f"{tmp_path}/metrics").first()) == (7, 1, 1, 5, 3)
    many = spark.range(40_000).selectExpr("concat('t', id % 30000) AS v")
    parts = [sketch_metrics(many.where(f"id % 3 = {i}")) for i in range(3)]
    merged = merge_metrics(parts[0].union(parts[1]).union(parts[2])).first()
    exact = table_metrics(many).first()
    assert merged[:4] == exact[:4] and abs(merged.distinct_texts - exact.distinct_texts) < 0.05 * exact.distinct_texts
    assert tuple(merge_metrics(parts[0].limit(0)).first()) == (0, 0, 0, 0, 0)
