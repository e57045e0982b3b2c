"""Each text once, across columns, runs, slices and batches."""

import sys

import pytest
from pyspark.sql import functions as F

from segtrans.operators import memory as mem
from segtrans.operators.backends import Backend, MockBackend, Result
from segtrans.operators.segments import distinct_segments, with_pair
from segtrans.plans.tables import table_metrics, translate_pairs, translate_table
from segtrans.session import ship_by_value

ship_by_value(sys.modules[__name__])


class Counting(Backend):
    """Marks texts, and counts them in an accumulator."""

    name = "counting"

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def translate_batch(self, texts, src, tgt):
        self.seen.add(len(texts))
        return [Result(f"<{tgt}>{t}") for t in texts]


ROWS = [("a", "b", 1), ("b", None, 2), ("  ", "a", 3), ("", "c", 4), ("a", "a", 5), (None, None, 6)]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "x string, y string, n int")


def expected(mark):
    def one(v):
        return f"{mark}{v}" if v is not None and v.strip() else v
    return sorted(((one(x), one(y), n) for x, y, n in ROWS), key=lambda r: r[2])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("slices", [1, 3])
def test_each_text_once_and_never_again(spark, df, tmp_path, slices):
    backend = Counting(spark)
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    out = translate_table(df, "en", "ne", backend=backend, memory=memory, slices=slices)
    assert rows(out) == rows(out) == expected("<ne>")
    assert backend.seen.value == 3
    again = translate_table(df.repartition(3), "en", "ne", backend=backend, memory=memory)
    assert rows(again) == expected("<ne>") and backend.seen.value == 3
    other = translate_table(df, "en", "tmg", backend=backend, memory=memory)
    assert rows(other) == expected("<tmg>") and backend.seen.value == 6


def test_without_memory_too(spark, df):
    backend = Counting(spark)
    out = translate_table(df, "en", "ne", backend=backend, parallel_calls=2)
    assert rows(out) == rows(out) == expected("<ne>") and backend.seen.value == 3
    sliced = translate_table(df, "en", "ne", backend=backend, slices=2)
    assert rows(sliced) == expected("<ne>") and backend.seen.value == 6


def test_inline_equals_dedup(df):
    inline = translate_table(df, "en", "ne")
    assert rows(inline) == rows(translate_table(df, "en", "ne", dedup=True)) == expected("[MOCK:ne] ")
    assert inline.columns == df.columns


def test_all_columns_as_strings(df):
    out = translate_table(df, "en", "ne", cast_non_string=True, dedup=True)
    assert {r.n for r in out.collect()} == {f"[MOCK:ne] {n}" for n in range(1, 7)}


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", "b")], "`x.y` string, `p``q r` string")
    for dedup in (False, True):
        out = translate_table(df, "en", "ne", dedup=dedup)
        assert out.columns == ["x.y", "p`q r"]
        assert tuple(out.first()) == ("[MOCK:ne] a", "[MOCK:ne] b")


def test_unknown_column_and_table_without_text(spark, df):
    with pytest.raises(ValueError):
        translate_table(df, "en", "ne", columns=["z"])
    numbers = df.select("n")
    assert translate_table(numbers, "en", "ne").count() == 6


def test_same_text_written_by_two_runs_joins_once(spark, df, tmp_path):
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    segments = with_pair(distinct_segments(df, ["x", "y"]), "en", "ne")
    for batch in ("one", "two"):
        memory.write_batch(mem.build_memory(segments, MockBackend()), "mock", batch)
    assert memory.read("mock").count() == 6
    assert rows(translate_table(df, "en", "ne", memory=memory)) == expected("[MOCK:ne] ")


def test_batch_overwrites_itself(spark, df, tmp_path):
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    segments = with_pair(distinct_segments(df, ["x", "y"]), "en", "ne")
    for _ in range(2):
        memory.write_batch(mem.build_memory(segments, MockBackend()), "mock", "one")
    assert memory.read("mock").count() == 3
    assert memory.read("mock", before_batch="one").count() == 0


def test_compact(spark, df, tmp_path):
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    segments = with_pair(distinct_segments(df, ["x", "y"]), "en", "ne")
    for batch in ("one", "two"):
        memory.write_batch(mem.build_memory(segments, MockBackend()), "mock", batch)
    small = mem.TranslationMemory(spark, memory.compact("mock", "all", 1))
    assert small.read("mock").count() == 3


@pytest.mark.parametrize("broadcast_bytes,hot_rows", [(1 << 20, 10), (0, 10), (120, 10), (120, 10**9)])
def test_every_join_path_gives_the_same(spark, broadcast_bytes, hot_rows):
    """One value in a third of the rows, NULLs and blanks in another third."""
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 == 1, F.lit(None).cast("string"))
        .when(F.col("id") % 6 == 4, "  ").otherwise(F.concat(F.lit("t"), (F.col("id") % 97).cast("string")))
        .alias("v"),
    )
    lookup = mem.translate_segments(with_pair(distinct_segments(df, ["v"]), "en", "ne"), MockBackend())
    out = mem.apply_lookup(df, "v", lookup, broadcast_bytes=broadcast_bytes, hot_rows=hot_rows)
    want = translate_table(df, "en", "ne")
    assert out.columns == df.columns and out.count() == 3000
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_hot_texts_fit_the_limit(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, "a").when(F.col("id") < 900, "b").otherwise("c").alias("v"))
    lookup = mem.translate_segments(with_pair(distinct_segments(df, ["v"]), "en", "ne"), MockBackend())
    assert (lookup.rows, lookup.uses, lookup.failed, lookup.calls) == (3, 1000, 0, 3)
    assert {r.segment for r in mem._hot_texts(lookup, 200, 1000).collect()} == {"a", "b"}
    assert {r.segment for r in mem._hot_texts(lookup, 500, 1000).collect()} == {"a"}
    assert mem._hot_texts(lookup, 10, 5) is None


def test_pairs(spark, df):
    backend = Counting(spark)
    out = translate_pairs(df, [("en", "ne"), ("en", "tmg"), ("en", "ne")], backend=backend)
    assert out.columns == ["src_lang", "tgt_lang", "x", "y", "n"] and backend.seen.value == 6
    for tgt in ("ne", "tmg"):
        mine = out.where(F.col("tgt_lang") == tgt).drop("src_lang", "tgt_lang")
        assert rows(mine) == expected(f"<{tgt}>")


def test_sentence_unit(spark, strings):
    backend = Counting(spark)
    df = strings(["One. Two.", "Two.  One.\nThree", "", None, "One."])
    out = translate_table(df, "en", "ne", backend=backend, unit="sentence")
    assert {r.v for r in out.collect()} == {
        "<ne>One. <ne>Two.", "<ne>Two.  <ne>One.\n<ne>Three", "", None, "<ne>One."}
    assert backend.seen.value == 3


def test_metrics(df):
    got = table_metrics(df, ["x", "y"]).first().asDict()
    assert got == {"cells": 12, "missing": 3, "blank": 2, "texts": 7, "distinct_texts": 3}


def test_backend_must_answer_every_text(spark, df):
    class Short(Backend):
        name = "short"

        def translate_batch(self, texts, src, tgt):
            return []

    with pytest.raises(Exception, match="another number of results"):
        translate_table(df, "en", "ne", backend=Short())


def test_only_the_direction_asked_for_is_read(spark, df, tmp_path):
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    translate_pairs(df, [("en", "ne"), ("en", "tmg"), ("ne", "en")], memory=memory)
    rows = memory.read("mock", pairs=[("en", "ne")])
    assert rows.count() == 3 and len(rows.inputFiles()) >= 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "src_lang" in plan.split("PartitionFilters")[1]


def test_calls_are_spread_over_the_cores(spark, strings):
    from segtrans.operators.backends import run_backend

    texts = with_pair(distinct_segments(strings([str(i) for i in range(200)]), ["v"]), "en", "ne")
    assert run_backend(texts, Counting(spark)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert run_backend(texts, Counting(spark), parallel_calls=3).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("values", [[], ["", " ", None]])
def test_nothing_to_translate(spark, strings, tmp_path, values):
    memory = mem.TranslationMemory(spark, str(tmp_path / "memory"))
    df = strings(values)
    for options in ({}, {"memory": memory}, {"memory": memory}, {"unit": "sentence"}):
        out = translate_table(df, "en", "ne", dedup=True, **options)
        assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert memory.read().count() == 0
    assert table_metrics(df).first().texts == 0


def test_long_texts_of_many_sentences_take_linear_time(spark):
    import time

    from segtrans.plans.sentences import sentence_segments

    def seconds(n):
        text = spark.createDataFrame([("One sentence here. " * n,)], "v string")
        start = time.monotonic()
        assert sentence_segments(text, "v").count() == n + 1
        sentence_segments(text, "v").write.format("noop").mode("overwrite").save()
        return time.monotonic() - start

    seconds(1000)
    assert seconds(16_000) < 8 * seconds(4_000) + 2


def test_failures_of_another_batch_stay_out(spark, strings, tmp_path):
    from workload.service import rule_backend

    memory = mem.TranslationMemory(spark, str(tmp_path / "m"))
    segments = with_pair(distinct_segments(strings(["abc", "abcd"], "v"), ["v"]), "en", "ne")
    for batch in ("day10", "day1"):
        lookup = mem.translate_segments(segments, rule_backend(), memory, "source", batch_id=batch)
        assert lookup.failed == lookup.failures().count() == 2


def test_names_the_result_needs_are_refused(spark, df):
    from segtrans.streaming.translate import stream_translate

    with pytest.raises(ValueError, match="rename"):
        translate_pairs(df.withColumn("src_lang", F.lit("x")), [("en", "ne")])
    with pytest.raises(ValueError, match="rename"):
        stream_translate(df.withColumn("Batch_Id", F.lit(1)), "en", "ne", memory=None, out_path="", checkpoint="")


@pytest.mark.parametrize("hot_rows", [1, 3, 10**9])
def test_many_columns_through_one_join(spark, hot_rows):
    rows = [(i, f"t{i % 7}", None if i % 5 else "t1", "  ", 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, `b.c` string, d string, e double")
    segments = with_pair(distinct_segments(df, ["a", "b.c", "d"]), "en", "ne")
    lookup = mem.translate_segments(segments, MockBackend())
    got = mem.apply_lookup_columns(df, ["a", "b.c", "d"], lookup, broadcast_bytes=10, hot_rows=hot_rows)
    assert got.columns == df.columns
    want = [(i, f"[MOCK:ne] {a}", b and f"[MOCK:ne] {b}", d, e) for i, a, b, d, e in rows]
    assert sorted(map(tuple, got.collect())) == want


def test_report(spark, strings):
    from workload.service import rule_backend

    report = mem.RunReport()
    translate_table(strings(["abc", "abcd", "abcde", "abcde"]), "en", "ne", backend=rule_backend(),
                    on_error="source", report=report)
    assert (report.calls, report.distinct_texts, report.failed) == (3, 3, 2) and report.seconds > 0
    assert {r.segment for r in report.failures.collect()} == {"abc", "abcd"}


def test_a_lookup_of_many_short_texts_is_weighed_with_its_rows(spark):
    """Texts of a few bytes take more memory as rows of a broadcast than as texts, once for every column in one task."""
    def plan(n_columns, broadcast_bytes):
        df = spark.range(300).selectExpr(*[f"cast(id as string) as c{i}" for i in range(n_columns)])
        lookup = mem.translate_segments(with_pair(distinct_segments(df, ["c0"]), "en", "ne"), MockBackend())
        out = mem.apply_lookup_columns(df, df.columns, lookup, broadcast_bytes=broadcast_bytes, hot_rows=10**9)
        assert {tuple(r) for r in out.collect()} == {(f"[MOCK:ne] {i}",) * n_columns for i in range(300)}
        return out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast"), lookup

    joins, lookup = plan(2, 1 << 20)
    assert joins == 2 and lookup.rows == 300
    assert plan(2, lookup.bytes + 300)[0] == 0
    assert plan(2, lookup.weight)[0] == 2 and plan(16, lookup.weight)[0] == 1  # of the cells of all columns together


def test_a_lookup_beyond_the_limit_is_not_broadcast_for_its_packed_file(spark):
    df = spark.range(3000).selectExpr("cast(id % 9 as string) as v")
    lookup = mem.translate_segments(with_pair(distinct_segments(df, ["v"]), "en", "ne"), MockBackend())
    out = mem.apply_lookup(df, "v", lookup, broadcast_bytes=0, hot_rows=10**9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
