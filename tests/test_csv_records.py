"""Records of CSV files: any header, any split, any bytes."""

import csv
import glob
import io
import json
import random
from urllib.parse import unquote

import pandas as pd
import pytest

from segtrans.plans.csv_files import translate_csv_files
from segtrans.sinks.csv import BOM
from segtrans.sources.csv_records import (
    GOOD, UNCLOSED, column_names, ends_inside, read_csv_records, split_records, stream_csv_cells,
)

M = "[MOCK:ne] "


def put(folder, files):
    for name, content in files.items():
        path = folder / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder / "in")


def outputs(out):
    found = {}
    for folder in glob.glob(f"{out}/_output=*"):
        rows = []
        for part in sorted(glob.glob(f"{folder}/part-*.csv")):
            with open(part, newline="", encoding="utf-8") as f:
                text = f.read()
            assert text.startswith(BOM)
            header, *body = csv.reader(io.StringIO(text[1:], newline=""))
            rows += body
        found[unquote(folder.rsplit("=", 1)[1])] = [header, *rows]
    return found


def rejected(spark, out):
    return {(r.path.rsplit("/", 1)[1], r.reason, r.row) for r in spark.read.parquet(f"{out}/_rejected").collect()}


def test_no_file_stops_the_others(spark, tmp_path):
    folder = put(tmp_path, {
        "a[1]{2}*.csv": "x,y\n1,2\n", "blank.csv": "\n  \nx,y\n3,4\n", "case.csv": "Name,name\n5,6\n",
        "lines.csv": '"first\nline","a ""b"""\n7,8\n"9\n\n10",11\n', "mac.csv": "x,y\r12,13\r\r14,15\r", "dos.csv": '"x",y\r\n16,"1\r\n7"\r\n',
        "open.csv": 'x,y\n18,19\n20,"21\n22,23\n', "bytes.csv": b"x,y\n\xff,24\n25,\xc3\xa9\n", "head.csv": b"x,\xff\n26,27\n",
        "bom.csv": b"\xef\xbb\xbfx,x,x.1,\n28,29,30,31\n", "only.csv": "x,y\n", "gaps.csv": "\n \n", "UP.CSV": "x\n32\n",
        "literal.csv": 'x,y\na"b,5" pipe\n"c"d,"e""f"\n',
    })
    out = translate_csv_files(spark, folder, f"{tmp_path}/out", "en", "ne")
    got = {k.removesuffix("_translated_ne.csv"): v for k, v in outputs(out).items()}
    want = {
        "a[1]{2}*": [["x", "y"], ["1", "2"]], "blank": [["x", "y"], ["3", "4"]], "case": [["Name", "name"], ["5", "6"]],
        "lines": [["first\nline", 'a "b"'], ["7", "8"], ["9\n\n10", "11"]], "mac": [["x", "y"], ["12", "13"], ["14", "15"]],
        "dos": [["x", "y"], ["16", "1\r\n7"]], "open": [["x", "y"], ["18", "19"]], "bytes": [["x", "y"], ["25", "é"]],
        "bom": [["x", "x.2", "x.1", "Unnamed: 3"], ["28", "29", "30", "31"]], "UP.CSV": [["x"], ["32"]],
        "literal": [["x", "y"], ['a"b', '5" pipe'], ["cd", 'e"f']],
    }
    assert got == {name: [head, *([M + c for c in row] for row in rows)] for name, (head, *rows) in want.items()}
    assert rejected(spark, out) == {
        ("open.csv", "a quote that is never closed", json.dumps(["20", "21\n22,23"], separators=(",", ":"))),
        ("bytes.csv", "not UTF-8", '["�","24"]'), ("head.csv", "not UTF-8", '["x","�"]'),
        ("only.csv", "no rows", None), ("gaps.csv", "no rows", None)}


def test_as_many_jobs_for_many_headers_as_for_few(spark, tmp_path):
    def jobs(n):
        folder = put(tmp_path / str(n), {f"d{i % 7}/f{i}.csv": ",".join(f"c{i}_{j}" for j in range(1 + i % 5)) + f"\nv{i}\n" for i in range(n)})
        spark.sparkContext.setJobGroup(f"headers-{n}", "")
        out = translate_csv_files(spark, folder, f"{tmp_path}/out{n}", "en", "ne")
        spark.sparkContext.setJobGroup("others", "")
        assert len(outputs(out)) == n and outputs(out)[f"d3/f3_translated_ne.csv" if n > 3 else "f1_translated_ne.csv" if n < 2 else "d1/f1_translated_ne.csv"][1][0][len(M)] == "v"
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{n}"))

    few, many = jobs(8), jobs(100)
    assert many <= few + 2  # listing many folders may be a job


def texts(rng, n, most):
    """Files of quotes, separators and line ends in any order."""
    for _ in range(n):
        yield "".join(rng.choices(['"', '""', ",", "\n", "\n", "\r\n", "a", "bc", "é", '"x\n"', ',"', '",'], k=rng.randint(0, most)))


def by_module(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [r for r in rows if r]


def sequential(text):
    """Line after line, as a file of one split."""
    inside, lines = False, []
    for line in text.split("\n"):
        lines.append(line)
        inside = ends_inside(line, inside)
        if not inside:
            yield from split_records("\n".join(lines))
            lines = []
    if lines:
        yield from split_records("\n".join(lines))


def test_records_are_those_of_the_csv_module():
    rng = random.Random(7)
    for text in texts(rng, 3000, 60):
        assert list(sequential(text)) == by_module(text), text


@pytest.mark.parametrize("size,n,most", [(3, 2, 16), (40, 8, 110)])
def test_files_of_many_splits(spark, tmp_path, size, n, most):
    rng = random.Random(size)
    contents = {f"{i:02}.csv": t for i, t in enumerate(texts(rng, n, most)) if t}
    folder = put(tmp_path, contents)
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {}
        for r in read_csv_records(spark, folder).orderBy("_doc", "_pos").collect():
            got.setdefault(r._doc.rsplit("/", 1)[1], []).append((r.cells, r.problem))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in contents.items():
        want, rows = by_module(text), got.get(name, [])
        assert all(p == GOOD for _, p in rows[:-1])
        if rows and rows[-1][1] == UNCLOSED:  # what its first split has of it
            assert [c for c, _ in rows[:-1]] == want[:len(rows) - 1] and len(rows) == len(want)
        else:
            assert [c for c, _ in rows] == want


def test_names_are_those_of_pandas():
    rng = random.Random(1)
    for _ in range(200):
        header = rng.choices(["a", "b", "a.1", "a.2", "", "A"], k=rng.randint(1, 6))
        if any(header):
            text = ",".join(header) + "\n" + ",".join("1" * len(header)) + "\n"
            assert column_names(header) == list(pd.read_csv(io.StringIO(text)).columns), header


def test_stream(spark, tmp_path):
    folder = put(tmp_path, {"a.csv": "id,t\n1,x\n2\n3,NA\n4,5,6\n", "b.csv": '\n"t","extra\ncolumn",id\n"y\nz",q,7\n'})
    put(tmp_path, {"c.csv": b"id,t\n\xff,8\n", "d.txt": "id,t\n9,no\n"})
    stream = stream_csv_cells(spark, folder, ["id", "t", "none"], files_per_batch=1)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(r._doc.rsplit("/", 1)[1], r.id, r.t, r.none, tuple(r._extra or ())) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows == {
        ("a.csv", "1", "x", None, ()), ("a.csv", "2", None, None, ()), ("a.csv", "3", None, None, ()),
        ("a.csv", None, None, None, ("4", "5", "6")), ("b.csv", "7", "y\nz", None, ()), ("c.csv", None, None, None, ("�", "8"))}


def test_a_streamed_file_comes_in_batches():
    from segtrans.sources.csv_records import ROWS_PER_BATCH, _file_rows

    n = ROWS_PER_BATCH + 3
    lines = ["\ufeff", " ", "t,id", *[f'"a\nb",{i}' for i in range(n)], "too,long,row", "", "last"]
    batches = list(_file_rows("\n".join(lines).encode(), "f", ["id", "t", "none"]))
    assert [b.num_rows for b in batches] == [ROWS_PER_BATCH, 5]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["cells"] for r in rows[:n]] == [[str(i), "a\nb", None] for i in range(n)]
    assert [(r["cells"], r["_extra"]) for r in rows[n:]] == [(None, ["too", "long", "row"]), ([None, "last", None], None)]
    assert [r["_pos"] for r in rows] == list(range(2, n + 4))
    assert [b.num_rows for b in _file_rows(b"", "f", ["id"])] == [0]
