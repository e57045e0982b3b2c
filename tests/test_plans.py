"""What the physical plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from segtrans.operators import layout as lay
from segtrans.operators import memory as mem
from segtrans.operators.backends import MockBackend
from segtrans.operators.segments import distinct_segments, with_pair
from segtrans.plans.tables import translate_table
from segtrans.sources.files import accepted_files, list_files
from workload import derived
from workload.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_product_and_no_python(spark, sf):
    allowed = {"retry_outcome", "docx_roundtrip", "docx_folder"}  # opaque service, file bytes
    for name, query in QUERIES.items():
        if name.startswith(("stream", "csv")):
            continue
        text = plan(query(spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        if name not in allowed:
            assert "MapInPandas" not in text and "MapInArrow" not in text and "Python" not in text, name


def test_inline_has_no_shuffle_and_no_join(spark, sf):
    text = plan(translate_table(derived.table(spark, sf, "part"), "en", "ne"))
    assert "Exchange" not in text and "Join" not in text


def test_distinct_reads_text_columns_and_combines_first(spark, sf):
    text = plan(distinct_segments(derived.table(spark, sf, "part"), ["p_name", "p_type"]))
    assert "ReadSchema: struct<p_name:string,p_type:string>" in text
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_small_lookup_is_broadcast_and_the_table_stays(spark, sf):
    text = plan(translate_table(derived.table(spark, sf, "lineitem"), "en", "ne", dedup=True))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_large_lookup_is_shuffled_and_only_hot_texts_are_broadcast(spark, sf):
    df = derived.table(spark, sf, "events").select("event_id", "event_type")
    lookup = mem.translate_segments(with_pair(distinct_segments(df, ["event_type"]), "en", "ne"), MockBackend())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(mem.apply_lookup(df, "event_type", lookup, broadcast_bytes=90, hot_rows=200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("BroadcastHashJoin") == 1 and text.count("SortMergeJoin") == 1
    assert "GreaterThanOrEqual(uses" in text


def test_layout_shuffles_spans_twice(spark, sf, tmp_path):
    """On stored tables, as an extractor leaves them."""
    stored = {}
    for name, df in vars(derived.layout(spark, sf)).items():
        df.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(lay.extract_blocks(lay.Layout(**stored)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    window, lines = text.index("Window"), text.index("ObjectHashAggregate")
    # Page order, boxes and lines share one partitioning by page.
    assert "Exchange" not in text[window:lines]


def test_columns_of_a_large_lookup_share_one_join(spark, sf):
    part = derived.table(spark, sf, "part")
    text_columns = ["p_name", "p_brand", "p_type"]
    lookup = mem.translate_segments(with_pair(distinct_segments(part, text_columns), "en", "ne"), MockBackend())
    exchanges = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (2, 3):
            df = mem.apply_lookup_columns(part, text_columns[:n], lookup, broadcast_bytes=0)
            exchanges.append(plan(df).count("Exchange hashpartitioning"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exchanges[0] == exchanges[1]


def test_preview_limits_before_the_shuffle(spark, sf):
    text = plan(entry.queries()["preview_lines"](spark, sf))
    assert "WindowGroupLimit" in text[text.index("Exchange"):]


def test_file_size_reaches_the_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.PDF").write_text("xx")
    files = list_files(spark, str(tmp_path))
    text = plan(accepted_files(files, 1024 * 1024))
    assert "LessThanOrEqual(length,1048576)" in text and "content" not in text
    assert {r.name: r.suffix for r in files.collect()} == {"a.csv": ".csv", "b.PDF": ".pdf"}


def test_work_folder_needs_to_be_shared(spark):
    from segtrans.session import work_root

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "yarn"})

    with pytest.raises(RuntimeError, match="shared"):
        work_root(Cluster())


def test_rules_and_boxes_are_not_broadcast_by_the_size_of_their_file(spark, sf, tmp_path):
    """A rule is eleven rows, and a file of them packs a hundredfold: what is broadcast would grow with the pages."""
    stored = {}
    for name, df in vars(derived.layout(spark, sf)).items():
        df.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    layout = lay.Layout(**stored)
    styled = lay.underlined_spans(lay.span_style(layout.spans), lay.horizontal_rules(layout.drawings))
    kept = lay.drop_text_in_tables(lay.assemble_lines(styled), layout.table_boxes)
    for df in (styled, kept, lay.extract_blocks(layout)):
        assert "Broadcast" not in plan(df)


def test_stored_tables_deal_out_texts_not_rows(spark, sf):
    text = plan(derived.document_lines(spark, sf, dealt=True))
    assert text.index("Generate") < text.index("Exchange")


def test_tables_of_many_files_are_not_dealt_out(spark, sf, tmp_path):
    derived.table(spark, sf, "documents").select("doc_id").repartition(8).write.parquet(f"{tmp_path}/docs")
    assert "Exchange" not in plan(derived.spread(spark.read.parquet(f"{tmp_path}/docs"), "doc_id"))
