"""Text expressions against the Python behaviour they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from segtrans.functions import files, style, text
from segtrans.functions.langs import LanguageError, check_pair, check_pairs, language_pairs, with_lang_code
from segtrans.plans.sentences import sentence_segments

EDGE = [
    "", "  ", " ", "　 x 　", "\x1c a \x85", "NA", "null", "007", "AT&T <b>", "STRAßE",
    "ABC", "ABC 1", "abc", "Éa", "नमस्ते", "ǅ", "ªA", "123", "A", "​", "﻿ x",
]


def random_texts(n=400):
    rng = random.Random(5)
    pool = "aA zZ\t\n  éÉßǅªº१ँ\x1f　!?.।"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def test_white_space_is_the_set_str_strip_uses():
    assert set(text.WS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_upper_and_blank_agree_with_python(strings):
    rows = strings(EDGE + random_texts()).select(
        "v", text.strip_key("v").alias("s"), text.is_translatable("v").alias("t"),
        text.is_upper("v").alias("u"), F.length("v").alias("n"),
    ).collect()
    for r in rows:
        assert r.s == r.v.strip()
        assert r.t == bool(r.v.strip())
        assert r.u == r.v.isupper(), r.v
        assert r.n == len(r.v)


def test_missing_is_never_translatable(strings):
    row = strings([None]).select(text.is_translatable("v").alias("t"), text.clean_cell("v").alias("c")).first()
    assert row.t is False and row.c == ""


def test_normalize_missing(strings):
    values = [*text.NA_TOKENS, "na", " ", "0", "nil"]
    rows = strings(values).select("v", text.normalize_missing("v").alias("m")).collect()
    assert [r.v for r in rows if r.m is not None] == ["na", " ", "0", "nil"]


def test_escape_markup(strings):
    row = strings(["a & b <c> &lt;"]).select(
        text.escape_markup("v").alias("e"), text.escape_markup("v", F.lit(True)).alias("u")).first()
    assert row.e == "a &amp; b &lt;c&gt; &amp;lt;"
    assert row.u == f"<u>{row.e}</u>"


def test_sentences_put_together_give_the_text(strings):
    values = ["One. Two!\n Three?  ", "एक। दुई।", "no end", "", "a.b. c", " . . ", "x.\n"]
    pieces = sentence_segments(strings(values), "v", "v").collect()
    for v in values:
        mine = sorted((p for p in pieces if p.v == v), key=lambda p: p.sentence_idx)
        assert "".join(p.sentence + p.separator for p in mine) == v
    assert [p.sentence for p in pieces if p.v == values[1]] == ["एक।", "दुई।"]


def test_half_even_sizes(spark):
    sizes = [7.5, 8.5, 9.5, 10.5, 11.5, 10.49, None]
    rows = spark.createDataFrame([(x,) for x in sizes], "size double").select(
        "size", style.span_fontsize().alias("f")).collect()
    for r in rows:
        assert r.f == (10 if r.size is None else round(r.size))


@pytest.mark.parametrize("line,size,bold,expected", [
    ("x", 14, False, True), ("x", 13, False, False), ("x", 11, True, True), ("x", 10, True, False),
    ("ABC", 8, False, True), ("AB", 8, False, False), ("नमस्ते", 8, False, False),
])
def test_heading(spark, line, size, bold, expected):
    df = spark.createDataFrame([(line, size, bold)], "line string, fontsize int, is_bold boolean")
    assert df.select(style.is_heading().alias("h")).first().h is expected


def test_style_bits(spark):
    data = [(16, "X", True, False), (2, "X", False, True), (0, "Semibold", True, False),
            (0, "XBold-Italic", True, True), (None, None, False, False), (0, "BOLD", False, False)]
    df = spark.createDataFrame(data, "flags int, font string, b boolean, i boolean")
    for r in df.select("*", style.span_bold().alias("bold"), style.span_italic().alias("italic")).collect():
        assert (r.bold, r.italic) == (r.b, r.i)


def test_output_names(spark):
    data = [("a.csv", ".csv", "a_translated_ne.csv"), ("X.CSV", ".csv", "X.CSV_translated_ne.csv"),
            ("a.csv.csv", ".csv", "a.csv_translated_ne.csv"), (".pdf", ".pdf", "_translated_ne.pdf"),
            ("a.b.docx", ".docx", "a.b_translated_ne.docx")]
    df = spark.createDataFrame(data, "name string, suffix string, want string")
    for r in df.select("*", files.output_name("name", "suffix", "ne").alias("got")).collect():
        assert r.got == r.want


def test_languages(spark):
    assert language_pairs(spark).count() == 6
    df = spark.createDataFrame([("Nepali",), ("tmg",), ("taj",), (None,)], "v string")
    assert [r.lang_code for r in with_lang_code(df, "v").collect()] == ["ne", "tmg", None, None]
    for bad in (("en", "en"), ("en", "xx"), ("taj", "en")):
        with pytest.raises(LanguageError):
            check_pair(*bad)
    with pytest.raises(LanguageError):
        check_pairs([])


def test_preview_of_table_rows(spark):
    from segtrans.operators.preview import PREVIEW_AFTER, preview, preview_line

    df = spark.range(20).select((F.col("id") % 2).alias("doc"), "id", F.lit(None).cast("string").alias("t"))
    rows = preview(df, ["doc"], ["id"], PREVIEW_AFTER["csv"]).select("doc", "n_shown", preview_line(["id", "t"]).alias("line"))
    got = sorted((r.doc, r.n_shown, r.line) for r in rows.collect())
    assert got == [(d, n, f"{(n - 1) * 2 + d} | ") for d in (0, 1) for n in (1, 2, 3, 4)]
