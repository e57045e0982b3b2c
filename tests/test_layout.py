"""Layout on small made pages, against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from segtrans.operators import layout as lay
from segtrans.operators.ranking import large_groups, number_rows
from segtrans.plans import layout as plan

SPAN = (
    "doc_id string, page_idx int, block_idx int, block_type int, block_x0 double, line_idx int, "
    "line_y0 double, span_idx int, text string, flags int, font string, size double, "
    "x0 double, y0 double, x1 double, y1 double"
)
BOX = "doc_id string, page_idx int, table_idx int, x0 double, y0 double, x1 double, y1 double"
CELLS = "doc_id string, page_idx int, table_idx int, row_idx int, col_idx int, cell string"
DRAW = (
    "doc_id string, page_idx int, path_idx int, item_idx int, path_type string, item_kind string, "
    "x1 double, y1 double, x2 double, y2 double"
)


def span(doc, page, block, line, i, text, y, x=50.0, kind=0, flags=0, font="F", size=10.0):
    return (doc, page, block, kind, 50.0, line, float(y), i, text, flags, font, size, x, float(y), x + 10, y + 12.0)


def make(spark, spans, boxes=(), cells=(), drawings=(), pages=()):
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)
    return lay.Layout(df(spans, SPAN), df(boxes, BOX), df(cells, CELLS), df(drawings, DRAW),
                      df(pages, "doc_id string, page_idx int, width double"))


@pytest.fixture()
def small(spark):
    spans = [
        span("d", 0, 0, 0, 0, "  ", 100), span("d", 0, 0, 0, 1, " one ", 100, x=200.0),
        span("d", 0, 0, 0, 2, "two", 100, x=300.0, flags=16),
        span("d", 0, 1, 0, 0, "top", 20, size=13.5), span("d", 0, 2, 0, 0, " ", 30),
        span("d", 0, 3, 0, 0, "picture", 5, kind=1),
        span("d", 0, 4, 0, 0, "in the table", 205, x=100.0),
        span("d", 0, 5, 0, 0, "tie", 200, x=400.0, flags=2),
        span("d", 2, 0, 0, 0, "NEXT & LAST", 10),
    ]
    boxes = [("d", 0, 0, 90.0, 200.0, 300.0, 300.0), ("d", 0, 1, 0.0, 400.0, 10.0, 410.0)]
    cells = [("d", 0, 0, 0, 0, " head "), ("d", 0, 0, 1, 0, None), ("d", 0, 0, 1, 1, "x<y"), ("d", 0, 0, 2, 0, " ")]
    drawings = [
        ("d", 0, 0, 0, "s", "l", 0.0, 117.5, 9.0, 118.0), ("d", 0, 1, 0, "s", "l", 0.0, 38.4, 9.0, 38.4),
        ("d", 0, 2, 0, "f", "l", 0.0, 213.0, 9.0, 213.0), ("d", 0, 3, 0, "s", "re", 0.0, 213.0, 9.0, 213.0),
        ("d", 0, 4, 0, "s", "l", 0.0, 213.0, 9.0, 215.0),
    ]
    pages = [("d", p, 595.0) for p in range(3)]
    return make(spark, spans, boxes, cells, drawings, pages)


@pytest.mark.parametrize("page_rows", [lay.GROUP_ROWS, 2])
def test_blocks(small, page_rows):
    rows = lay.extract_blocks(small, page_rows).orderBy("page_idx", "seq").collect()
    got = [(r.page_idx, r.seq, r.type, r.line, r.fontsize, r.is_bold, r.is_italic, r.is_underline) for r in rows]
    assert got == [
        (0, 0, "text", "top", 14, False, False, False),  # rule at 38, bottom at 32: 6 apart
        # bottom at 112, rule at round(117.5) = 118; "one" and "two" tie, the first leads
        (0, 1, "text", "one two", 10, False, False, False),
        (0, 2, "text", "tie", 10, False, True, False),
        (0, 3, "table", None, None, None, None, None),
        (2, 0, "text", "NEXT & LAST", 10, False, False, False),
    ]
    assert (rows[3].n_rows, rows[3].n_cols, rows[3].y_top) == (3, 2, 200.0)


def test_underline_reach(spark):
    spans = [span("d", 0, i, 0, 0, "x", 100 + i - 12) for i in range(20)]
    layout = make(spark, spans, drawings=[("d", 0, 0, 0, "s", "l", 0.0, 110.0, 9.0, 110.0)])
    rows = lay.underlined_spans(layout.spans, lay.horizontal_rules(layout.drawings)).collect()
    assert {r.y1: r.is_underline for r in rows} == {100.0 + i: abs(100 + i - 110) < 6 for i in range(20)}


def test_reflow(small):
    done = plan.translate_layout(small, "en", "ne", dedup=True)
    rows = plan.reflow_plan(done).orderBy("page_idx", "seq", "part").collect()
    got = [(r.page_idx, r.kind, r.height_mm, r.text, r.heading, r.bold, r.size, r.leading, r.space_before) for r in rows]
    m = "[MOCK:ne] "
    assert got == [
        (0, "paragraph", None, m + "top", True, True, 14, 18, 6),
        (0, "paragraph", None, m + "one two", False, False, 10, 14, 0),
        (0, "paragraph", None, m + "tie", False, False, 10, 14, 0),
        (0, "spacer", 3, None, None, None, None, None, None),
        (0, "table", None, None, None, None, None, None, None),
        (0, "spacer", 3, None, None, None, None, None, None),
        (1, "page_break", None, None, None, None, None, None, None),
        (1, "spacer", 20, None, None, None, None, None, None),
        (2, "page_break", None, None, None, None, None, None, None),
        (2, "paragraph", None, m + "NEXT &amp; LAST", True, True, 10, 14, 6),
    ]
    assert rows[4].col_width == pytest.approx((210 - 40) * 72 / 25.4 / 2)
    cells = {(r.row_idx, r.col_idx): (r.role, r.text) for r in plan.reflow_cells(done.cells).collect()}
    assert cells == {(0, 0): ("header", m + "head"), (1, 0): ("body_a", ""), (1, 1): ("body_a", m + "x&lt;y"),
                     (2, 0): ("body_b", "")}
    text = {(r.page_idx, r.part): r.text for r in plan.reassemble_text(done).collect()}
    assert text[(0, 0)] == f"{m}top\n{m}one two\n{m}tie\n{m}head\n\t{m}x<y\n"
    parts = plan.reassemble_text(done, lines_per_part=4, page_rows=3).where("page_idx = 0").orderBy("part").collect()
    assert "\n".join(p.text for p in parts) == text[(0, 0)] and [p.part for p in parts] == [0, 1]


def test_inline_equals_dedup(small):
    a = plan.reflow_plan(plan.translate_layout(small, "en", "ne"))
    b = plan.reflow_plan(plan.translate_layout(small, "en", "ne", dedup=True))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of all lines on one page; many equal heights."""
    rng = random.Random(3)
    spans, boxes, drawings = [], [], []
    for page in range(40):
        for line in range(400 if page == 7 else 20):
            y = rng.randint(0, 40) * 20
            for i in range(rng.randint(1, 3)):
                spans.append(span("d", page, line // 3, line, i, rng.choice([" ", "ab", "Abc ", "Q"]), y,
                                  x=float(rng.randint(0, 500)), flags=rng.choice([0, 2, 16])))
        for t in range(5):
            x, y = rng.randint(0, 400), rng.randint(0, 700)
            boxes.append(("d", page, t, float(x), float(y), x + 100.0, y + 80.0))
        drawings += [("d", page, n, 0, "s", "l", 0.0, float(rng.randint(0, 800)), 1.0, 0.0) for n in range(9)]
    drawings = [d[:9] + (d[7],) for d in drawings]
    cells = [(*b[:3], 0, 0, "c") for b in boxes if b[2] % 2]
    return make(spark, spans, boxes, cells, drawings)


@pytest.mark.parametrize("page_rows", [50, 100, 400])
def test_large_page_gives_the_same(crowded, page_rows):
    columns = ["doc_id", "page_idx", "seq", "type", "line", "is_bold", "is_underline", "table_idx", "spans"]
    usual = lay.extract_blocks(crowded).select(*columns)
    split = lay.extract_blocks(crowded, page_rows).select(*columns)
    assert lay.large_pages(crowded, page_rows) is not None
    assert sorted(map(str, usual.collect())) == sorted(map(str, split.collect()))


def test_number_rows_split(spark):
    df = spark.range(5000).select((F.col("id") % 7 % 3).alias("g"), F.xxhash64("id").alias("o"), "id")
    large = large_groups(df, ["g"], 1000)
    assert {r.g: r.n_rows for r in large.collect()} == {0: 2143, 1: 1429, 2: 1428}
    large = large_groups(df, ["g"], 1500)
    a = number_rows(df, ["g"], [F.col("o"), F.col("id")], "n").collect()
    b = number_rows(df, ["g"], [F.col("o"), F.col("id")], "n", large).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(b) == 5000
    assert large_groups(df, ["g"], 3000) is None


def test_numbering_runs_its_input_once(spark):
    """With large groups, what made the rows is behind one table that both ways read."""
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id").repartition(7, "id")
    large = large_groups(rows, ["g"], 33)
    numbered = number_rows(rows, ["g"], [F.col("id")], "n", large)
    text = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in text.replace("RepartitionByRange", "") and large.count() == 1
    assert {(r.g, r.id, r.n) for r in numbered.collect()} == {(i % 3, i, i // 3) for i in range(100)}
