"""Files made of the lines of a table."""

import pytest

from segtrans.sinks.files import export_lines


def test_files_of_lines_in_many_pieces(spark, tmp_path):
    """No row and no group holds a file; its lines come in order, whatever pieces they are written in."""
    rows = [(f"a b/{i % 2} +%.csv", i // 2, f'{i},"x\n{i % 3}"') for i in range(500)] + [("one.csv", 1, "é"), ("one.csv", 1, "é")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "name string, at long, line string").repartition(7)
        export_lines(table, f"{tmp_path}/in", ["at", "line"], "h")
        export_lines(table.where("at < 0"), f"{tmp_path}/none", ["at"], "h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {str(f.relative_to(tmp_path / "in")): f.read_bytes().decode() for f in (tmp_path / "in").rglob("*.csv")}
    assert got == {n: "\n".join(["h", *(line for _, _, line in sorted(r for r in rows if r[0] == n))]) for n in {r[0] for r in rows}}
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        export_lines(table.selectExpr("nullif(name, 'one.csv') as name", "at", "line"), f"{tmp_path}/null", ["at"], "h")


def test_csv_order_collects_no_file_and_numbers_no_file_in_one_task(spark, tmp_path):
    """Rows of one output file are numbered part by part: no window takes them all."""
    from workload.queries import QUERIES

    rows = [(k, "OFP"[k % 3]) for k in range(60)] + [(7, "O"), (8, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    made = QUERIES["csv_order"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_doc" in plan and "row_number() windowspecdefinition(name" not in plan
    keys = sorted(k for k, _ in rows)
    want = [(f"f{n}_translated_ne.csv", f"[MOCK:ne] {k}", i + 1) for n in range(5) for i, k in enumerate(k for k in keys if k % 5 == n)]
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_a_folder_is_listed_and_read_by_tasks(spark, tmp_path):
    """The same files as Spark's own listing, which is kept on the driver; hidden, empty and lost ones are left out."""
    from segtrans.sources.files import folder_files, with_content

    top = tmp_path / "in"
    for name in ("a b/c%20d/x+1.docx", "a b/ü[1]{2}.DOCX", "p=1/one.txt", "_no/x.docx", "_q=1/x.docx", ".h/x.docx",
                 "a b/.x.docx", "a b/_x.docx", "a b/_y=1.docx", "a b/z._COPYING_", "_metadata/in.docx", "_metadata.docx", "top.docx"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(name.encode() * 3)
    (top / "empty.docx").touch()
    (top / "no files" / "inner").mkdir(parents=True)
    (top / "lost.docx").symlink_to(top / "nowhere")
    (top / "linked").symlink_to(top / "a b")
    (tmp_path / "none").mkdir()
    columns = ["path", "modificationTime", "length", "content"]
    for path in (str(top), f"file://{top}/", f"{top}/a*", f"{top}/top.docx", str(tmp_path / "none")):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(*columns)
        got = folder_files(spark, path)
        assert ("content" in got.columns) == path.endswith(("a*", "top.docx"))
        assert sorted(map(tuple, with_content(got).select(*columns).collect())) == sorted(map(tuple, want.collect()))
    listed = folder_files(spark, str(top))
    assert "binaryFile" not in listed._jdf.queryExecution().toString() and listed.count() == 10
    assert not any("part-" not in f for f in listed.inputFiles())
