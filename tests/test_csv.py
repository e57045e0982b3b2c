"""CSV in, CSV out."""

import csv
import glob
import json
from urllib.parse import unquote

import pytest

from segtrans.plans.csv_files import translate_csv_files
from segtrans.sinks.csv import BOM, write_csv_bom
from segtrans.sources.csv import read_csv_cells

# The sample table: three rows, three columns, three languages.
ENGLISH = "name,description,greeting\nAlice,She is a teacher,Hello how are you\nBob,He is a student,Good morning"
HARD = (
    'id,"text, with comma",note\n007,"said ""hi""","line one\nline two"\n1.50,NA,\n'
    'true,"  ", padded \nnull,<b>,x\n'
)


@pytest.fixture()
def folder(tmp_path):
    for name, content in (("a.csv", HARD), ("b.csv", HARD.replace("said", "BOTH"))):
        (tmp_path / name).write_text(content, encoding="utf-8")
    return tmp_path


def written(path):
    """Rows of the parts in order, read by an independent reader."""
    rows = []
    for part in sorted(glob.glob(f"{path}/*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            text = f.read()
        assert text.startswith(BOM)
        header, *body = csv.reader(text[1:].splitlines(keepends=True))
        rows += body
    return header, rows


def test_read_keeps_texts_and_finds_missing(spark, folder):
    rows = [tuple(r) for r in read_csv_cells(spark, str(folder / "a.csv")).collect()]
    assert rows == [
        ("007", 'said "hi"', "line one\nline two"), ("1.50", None, None),
        ("true", "  ", " padded "), (None, "<b>", "x"),
    ]


def test_bom_of_the_input_is_dropped(spark, tmp_path):
    (tmp_path / "n.csv").write_text("नाम,b\nएक,दुई\n", encoding="utf-8-sig")
    df = read_csv_cells(spark, str(tmp_path / "n.csv"))
    assert df.columns == ["नाम", "b"] and tuple(df.first()) == ("एक", "दुई")


def test_translate_folder(spark, folder):
    out = translate_csv_files(spark, f"{folder}/*.csv", f"{folder}/out", "en", "ne")
    for name, word in (("a", "said"), ("b", "BOTH")):
        header, rows = written(f"{out}/_output={name}_translated_ne.csv")
        assert header == ["id", "text, with comma", "note"]
        m = "[MOCK:ne] "
        assert rows == [
            [m + "007", f'{m}{word} "hi"', m + "line one\nline two"], [m + "1.50", "", ""],
            [m + "true", "  ", m + " padded "], ["", m + "<b>", m + "x"],
        ]


def test_sample_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text(ENGLISH, encoding="utf-8")
    out = translate_csv_files(spark, str(tmp_path / "s.csv"), f"{tmp_path}/out", "en", "tmg")
    header, rows = written(f"{out}/_output=s_translated_tmg.csv")
    assert header == ["name", "description", "greeting"]
    assert rows[1] == ["[MOCK:tmg] Bob", "[MOCK:tmg] He is a student", "[MOCK:tmg] Good morning"]


def test_another_header_fails_loudly(spark, folder):
    (folder / "c.csv").write_text("p,q,r\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_csv_cells(spark, [f"{folder}/a.csv", f"{folder}/c.csv"]).collect()


def test_size_limit_prunes_files(spark, folder):
    (folder / "big.csv").write_text(HARD + "x" * 2000 + ",y,z\n")
    kept = read_csv_cells(spark, f"{folder}/*.csv", with_position=True, max_bytes=1000)
    assert {r._doc.rsplit("/", 1)[1] for r in kept.collect()} == {"a.csv", "b.csv"}


def test_many_rows_stay_in_order(spark, tmp_path, monkeypatch):
    from segtrans.operators import memory

    lines = "\n".join(f"{i},text {i % 50}" for i in range(2000))
    (tmp_path / "m.csv").write_text(f"n,t\n{lines}\n")
    # As if the lookup were beyond the broadcast limit.
    for f in (memory.apply_lookup, memory.apply_lookup_columns):
        monkeypatch.setattr(f, "__kwdefaults__", {**f.__kwdefaults__, "broadcast_bytes": 0, "hot_rows": 10})
    out = translate_csv_files(spark, str(tmp_path / "m.csv"), f"{tmp_path}/out", "en", "ne", multi_line=False)
    _, rows = written(f"{out}/_output=m_translated_ne.csv")
    assert [r[0] for r in rows] == [f"[MOCK:ne] {i}" for i in range(2000)]


def test_writer_single_file(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (" b ", 'q"')], "x string, y string")
    write_csv_bom(df, f"{tmp_path}/o", single_file=True)
    assert written(f"{tmp_path}/o") == (["x", "y"], [["a", ""], [" b ", 'q"']])


def test_nothing_is_lost_in_a_folder(spark, tmp_path):
    """Other headers, equal names, odd names, one column, short, long and missing rows, large files."""
    files = {
        "x/s.csv": "a,File,file.1\n1,2,3\nshort\n", "y/s.csv": "t\none\nNA\n\ntwo\n",
        "y/my file+1.csv": "a,b\n1,2\n3,4,too long\n", "y/header.csv": "a,b\n", "y/notes.txt": "no",
        "big.csv": "t\n" + ("x" * 1000 + "\n") * 1_100,
    }
    for name, content in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(content)
    out = translate_csv_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "en", "ne")
    m = "[MOCK:ne] "
    read = {unquote(p.rsplit("=", 1)[1]): written(p) for p in glob.glob(f"{out}/_output=*")}
    assert set(read) == {f"{n[:-4]}_translated_ne.csv" for n in ("x/s.csv", "y/s.csv", "y/my file+1.csv", "big.csv")}
    assert read["x/s_translated_ne.csv"] == (["a", "File", "file.1"], [[m + "1", m + "2", m + "3"], [m + "short", "", ""]])
    assert read["y/s_translated_ne.csv"] == (["t"], [[m + "one"], [""], [m + "two"]])
    assert read["y/my file+1_translated_ne.csv"] == (["a", "b"], [[m + "1", m + "2"]])
    rejected = {(r.path.rsplit("/", 1)[1], r.reason, r.row) for r in spark.read.parquet(f"{out}/_rejected").collect()}
    assert rejected == {
        ("header.csv", "no rows", None), ("notes.txt", "unknown suffix", None),
        ("my file+1.csv", "a row longer than its header", '["3","4","too long"]')}


@pytest.mark.parametrize("multi_line", [True, False])
def test_rows_longer_than_their_header_are_listed_whole(spark, tmp_path, multi_line):
    long = ['1,title,,stuff', '2,title,too,long,"and ""so"", on"', '3,title,,,far']
    lines = ["id,title", *long, "4,kept", "5", "6,kept,", '"7","a, b"']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.csv").write_text("\n".join(lines) + "\n")
    out = translate_csv_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "en", "ne", multi_line=multi_line)
    m = "[MOCK:ne] "
    assert written(f"{out}/_output=l_translated_ne.csv")[1] == [
        [m + "4", m + "kept"], [m + "5", ""], [m + "6", m + "kept"], [m + "7", m + "a, b"]]
    listed = [json.loads(r.row) for r in spark.read.parquet(f"{out}/_rejected").collect()]
    assert sorted(listed) == list(csv.reader(long))


def test_equal_export_names_are_refused(spark, tmp_path):
    from segtrans.sinks.files import export_files

    files = spark.createDataFrame([("a", b"1"), ("a", b"2")], "output_name string, content binary")
    with pytest.raises(ValueError, match="one name"):
        export_files(files, str(tmp_path / "o"))
