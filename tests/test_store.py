"""Buckets, filters and manifest of the translation memory."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtrans.operators import filters
from segtrans.operators import memory as mem
from segtrans.operators.backends import MockBackend, run_backend
from segtrans.operators.manifest import Manifest
from segtrans.streaming.translate import stream_translate


def texts(spark, first, last, src="en", tgt="ne"):
    return spark.range(first, last).select(
        F.lit(src).alias("src_lang"), F.lit(tgt).alias("tgt_lang"), F.concat(F.lit("text "), "id").alias("segment"),
        F.lit(1).cast("long").alias("uses"))


def add(memory, batch, first, last, files=1, **options):
    rows = mem.in_ranges(texts(memory.spark, first, last, **options), files)
    memory.write_batch(run_backend(rows, MockBackend()), "mock", batch)


def segments(df):
    return {r.segment for r in df.collect()}


@pytest.fixture()
def memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mem, "FEW_ROWS", 0)  # filters are asked however small the memory is
    return mem.TranslationMemory(spark, str(tmp_path / "memory"))


def test_a_filter_loses_nothing():
    rng = np.random.default_rng(1)
    own, others = (rng.integers(-(2**63), 2**63, 20_000) >> 10 for _ in range(2))  # their first bits are alike
    bits = np.frombuffer(filters.make_filter(own), np.uint8)
    assert filters.may_hold(bits, own).all() and filters.may_hold(bits, others).mean() < 0.03
    assert not filters.may_hold(np.frombuffer(filters.make_filter(own[:0]), np.uint8), own).any()


@pytest.mark.parametrize("slices", [1, 3, 8, 100, 5000])
def test_slices_are_runs_of_buckets(spark, slices):
    got = texts(spark, 0, 3000).select(filters.share(slices).alias("s"), filters.bucket().alias("b")).collect()
    for r in got:
        low, high = filters.buckets_of_share(r.s, slices)
        assert 0 <= r.s < slices and low <= r.b <= high
    assert all(b - a <= filters.BUCKETS // slices + 1 for a, b in (filters.buckets_of_share(s, slices) for s in range(slices)))


def test_a_slice_opens_its_share_of_the_files(memory):
    add(memory, "one", 0, 4000, files=16)
    everything = memory.files("mock")
    assert len(everything) == 16
    for number in range(8):
        low, high = filters.buckets_of_share(number, 8)
        rows = memory.read("mock", buckets=list(range(low, high + 1)))
        assert len(rows.inputFiles()) == 2 == len(everything) / 8
    assert memory.files("mock", pairs=[("en", "tmg")]) == [] and memory.files("other") == []


def test_known_and_new_are_told_exactly(memory):
    add(memory, "one", 0, 3000, files=8)
    add(memory, "two", 2500, 3500, files=2, tgt="tmg")
    wanted = texts(memory.spark, 2000, 6000).union(texts(memory.spark, 2000, 3000, tgt="tmg"))
    new, touched = memory.split_known(wanted, "mock")
    got = {(r.tgt_lang, r.segment) for r in new.collect()}
    assert got == {("ne", f"text {i}") for i in range(3000, 6000)} | {("tmg", f"text {i}") for i in range(2000, 2500)}
    assert new.count() == len(got) and 0 < len(touched) <= filters.BUCKETS


def test_small_batches_are_read_without_filters(memory, monkeypatch):
    add(memory, "large", 0, 300, files=4)
    monkeypatch.setattr(mem, "FEW_ROWS", 1000)
    add(memory, "small", 200, 400, files=2)
    assert [e["filtered"] for e in memory.entries("mock")] == [True, False]
    new, _ = memory.split_known(texts(memory.spark, 100, 600), "mock")
    assert segments(new) == {f"text {i}" for i in range(400, 600)} and new.count() == 200
    lookup = mem.translate_segments(texts(memory.spark, 0, 500), MockBackend(), memory, slices=3)
    assert lookup.calls == 100 and lookup.rows == 500 and lookup.failed == 0
    assert lookup.df.where("translation = concat('[MOCK:ne] ', segment)").count() == 500


def test_new_texts_open_no_file(memory):
    """Filters tell them; of 200 strangers two or so are looked for in the files of their buckets."""
    add(memory, "one", 0, 20_000, files=32)
    new, touched = memory.split_known(texts(memory.spark, 100_000, 100_200), "mock")
    assert new.count() == 200
    assert len(touched) <= 12 and len(memory.files("mock", buckets=touched)) <= len(touched)


def test_many_batches_are_merged(memory):
    """Seventeen batches are read from as few files as two."""
    for number in range(17):
        add(memory, f"b{number:02}", number * 10, number * 10 + 15)
        memory.merge_small("mock")
    assert len(memory.entries("mock")) <= 3 and len(memory.files("mock")) <= 3
    assert memory.read("mock").count() == 180 and len(segments(memory.read("mock"))) == 175  # the last batch is apart
    assert memory.read("mock", before_batch="b00").count() == 180 - 15  # rows keep their batch
    memory.compact("mock", "all", 4)
    assert memory.read("mock").count() == 175 and len(memory.entries("mock")) == 1 and len(memory.files("mock")) == 4


def test_failures_survive_merging(spark, memory):
    bad = texts(spark, 0, 2).select("*", F.lit(None).cast("string").alias("translation"), F.lit("failed").alias("status"),
                                    F.lit(3).alias("attempts"), F.lit("why").alias("error"))
    memory.write_batch(bad, "mock", "bad")
    add(memory, "good", 5, 7)
    memory.compact("mock", "all", 1)
    assert segments(memory.failures()) == segments(memory.failures("bad")) == {"text 0", "text 1"}
    assert segments(memory.read()) == {"text 5", "text 6"}
    new, _ = memory.split_known(texts(spark, 0, 6), "mock")
    assert segments(new) == {f"text {i}" for i in range(5)}  # failed ones are tried again


def test_an_older_run_of_a_query_is_refused(memory):
    rows = run_backend(texts(memory.spark, 0, 3), MockBackend())
    old = memory.fence("q")
    memory.write_batch(rows, "mock", "q-0", ("q", old))
    new = memory.fence("q")
    assert memory.fence("other") == 1 and new == old + 1
    with pytest.raises(mem.Fenced):
        memory.write_batch(rows, "mock", "q-1", ("q", old))
    memory.write_batch(rows, "mock", "q-1", ("q", new))
    assert {e["batch"] for e in memory.entries("mock")} == {"q-0", "q-1"}


def test_two_streams_of_the_default_name_share_a_memory(spark, tmp_path, memory):
    """Both write their batch 0; neither replaces the other's."""
    queries = []
    for name, value in (("a", "x"), ("b", "y")):
        spark.createDataFrame([(1, value), (2, "both")], "id int, v string").write.parquet(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/{name}/in")
        queries.append(stream_translate(stream, "en", "ne", memory=memory, out_path=f"{tmp_path}/{name}/out",
                                        checkpoint=f"{tmp_path}/{name}/checkpoint"))
    for query in queries:
        query.awaitTermination()
    assert segments(memory.read()) == {"x", "y", "both"}
    assert len({e["batch"] for e in memory.entries("mock")}) == 2
    for name, value in (("a", "x"), ("b", "y")):
        rows = spark.read.parquet(f"{tmp_path}/{name}/out").collect()
        assert {r.v for r in rows} == {f"[MOCK:ne] {value}", "[MOCK:ne] both"}


def test_changes_at_once_are_all_kept(spark, tmp_path):
    stores = [Manifest(spark, f"{tmp_path}/m", {"n": []}) for _ in range(4)]
    threads = [threading.Thread(target=lambda s=s, i=i: [s.change(lambda c, k=k: c["n"].append([i, k])) for k in range(8)])
               for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(stores[0].read()[1]["n"]) == [[i, k] for i in range(4) for k in range(8)]
    assert len(stores[0]._versions()) <= 20 and not stores[0].files.create(stores[0]._versions()[-1], "{}")
