"""The registered queries: every operator over the base tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segtrans.functions import files as fx
from segtrans.functions import langs, style, text
from segtrans.operators import layout as lay
from segtrans.operators import memory as mem
from segtrans.operators import preview as pre
from segtrans.operators import runs as run_ops
from segtrans.operators import segments as seg
from segtrans.operators.backends import MockBackend, parse_response, run_backend
from segtrans.plans import csv_files, docx_files, sentences, tables
from segtrans.plans import layout as plan
from segtrans.plans import runs as run_plan
from segtrans.session import new_work_dir
from segtrans.sinks.csv import write_csv_bom
from segtrans.sinks.files import export_files, export_lines
from segtrans.sources import csv as csv_src
from segtrans.sources import csv_records as csv_rec
from segtrans.sources import docx as docx_src
from segtrans.sources import files as file_src
from segtrans.streaming import translate
from segtrans.streaming.translate import stream_translate

from . import derived as d
from .docx import documents_as_docx
from .service import rule_backend

MOCK = MockBackend()
PARA = ["doc_id", "para_idx"]


# -------------------------------------------------------------------- tables


def _part(spark, sf):
    return d.table(spark, sf, "part")


def translate_table_part(spark: SparkSession, sf: str) -> DataFrame:
    return tables.translate_table(_part(spark, sf), "en", "ne", dedup=True)


def translate_table_inline(spark, sf):
    return tables.translate_table(_part(spark, sf), "en", "ne")


def translate_table_orders(spark, sf):
    return tables.translate_table(d.table(spark, sf, "orders"), "en", "tmg", dedup=True)


def translate_table_lineitem(spark, sf):
    return tables.translate_table(d.table(spark, sf, "lineitem"), "en", "ne", dedup=True)


def translate_table_events(spark, sf):
    events = d.table(spark, sf, "events")
    return tables.translate_table(events, "en", "tmg", dedup=True)


def translate_table_documents(spark, sf):
    docs = d.table(spark, sf, "documents")
    return tables.translate_table(docs, "en", "ne", columns=["text"], dedup=True)


def translate_cast_all(spark, sf):
    customer = d.table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return tables.translate_table(customer, "en", "ne", cast_non_string=True, dedup=True)


def _with_missing(spark, sf):
    """Customer names, some replaced by a spelling of "missing", blank or a number."""
    turn = F.col("c_custkey") % 40
    name = F.col("c_name")
    special = [*text.NA_TOKENS, None, "  ", "007"]
    for i, token in enumerate(special):
        if token is not None:
            name = F.when(turn == i, F.lit(token)).otherwise(name)
    return d.table(spark, sf, "customer").select("c_custkey", name.alias("v"), "c_mktsegment")


def normalize_missing(spark, sf):
    return csv_src.normalize_table(_with_missing(spark, sf), ["v"]).select("c_custkey", "v")


def is_translatable(spark, sf):
    turn = F.col("c_custkey") % 4
    value = (
        F.when(turn == 0, F.lit(None).cast("string"))
        .when(turn == 1, F.concat(F.lit("\u00a0\u3000"), "c_name", F.lit("\t")))
        .when(turn == 2, F.lit("\u2003\n")).otherwise(F.col("c_name"))
    )
    return d.table(spark, sf, "customer").select("c_custkey", value.alias("v")).select(
        "c_custkey", text.is_translatable("v").alias("ok"), text.strip_key("v").alias("stripped"))


def distinct_segments(spark, sf):
    return seg.distinct_segments(_part(spark, sf), ["p_name", "p_brand", "p_type"])


def run_metrics(spark, sf):
    rows = csv_src.normalize_table(_with_missing(spark, sf), ["v", "c_mktsegment"])
    return tables.table_metrics(rows, ["v", "c_mktsegment"])


# -------------------------------------------------------------------- memory


def mock_backend(spark, sf):
    lines = d.document_lines(spark, sf).select(
        "doc_id", "line_idx", F.col("line").alias("segment"), F.lit("en").alias("src_lang"),
        F.lit("tmg").alias("tgt_lang"))
    return run_backend(lines, MOCK).select("doc_id", "line_idx", "translation")


def _line_segments(spark, sf):
    return seg.with_pair(seg.distinct_segments(d.document_lines(spark, sf), ["line"]), "en", "ne")


def memory_build(spark, sf):
    memory = mem.TranslationMemory(spark, new_work_dir(spark, "memory"))
    mem.translate_segments(_line_segments(spark, sf), MOCK, memory)
    return memory.read("mock").select("segment", "translation")


def memory_resume(spark, sf):
    """Lines translated in slices with a memory that knows those of other tables; ``calls`` are for new ones only."""
    memory = mem.TranslationMemory(spark, new_work_dir(spark, "memory"))
    known = d.conversation_lines(spark, sf).select("line").union(d.table(spark, sf, "benchmark").select("text"))
    mem.translate_segments(seg.with_pair(seg.distinct_segments(known, ["line"]), "en", "ne"), MOCK, memory)
    lookup = mem.translate_segments(_line_segments(spark, sf), MOCK, memory, slices=3)
    return lookup.df.select("segment", "uses", "translation", F.lit(lookup.calls).cast("long").alias("calls"))


def _benchmark_memory(spark, sf):
    texts = d.table(spark, sf, "benchmark").select(F.col("text").alias("segment")).distinct()
    pair = texts.select(F.lit("en").alias("src_lang"), F.lit("ne").alias("tgt_lang"), "segment")
    return run_backend(pair, MOCK)


def new_segments(spark, sf):
    known = d.conversation_lines(spark, sf).select(F.col("line").alias("segment")).union(
        d.table(spark, sf, "benchmark").select("text"))
    return seg.new_segments(_line_segments(spark, sf), known, ["segment"]).select("segment")


def apply_memory(spark, sf):
    return mem.apply_memory(d.document_lines(spark, sf), "line", _benchmark_memory(spark, sf))


def apply_lookup_shuffled(spark, sf):
    """The join for a lookup beyond the broadcast limit, forced by a tiny limit."""
    lookup = mem.translate_segments(_line_segments(spark, sf), MOCK)
    return mem.apply_lookup(
        d.document_lines(spark, sf), "line", lookup, broadcast_bytes=20_000, hot_rows=3)


def apply_lookup_columns(spark, sf):
    """Three columns through one shuffled join, forced by a tiny limit."""
    lookup = mem.translate_segments(
        seg.with_pair(seg.distinct_segments(_part(spark, sf), ["p_name", "p_brand", "p_type"]), "en", "ne"), MOCK)
    return mem.apply_lookup_columns(
        _part(spark, sf), ["p_name", "p_brand", "p_type"], lookup, broadcast_bytes=500, hot_rows=50)


def translate_pairs(spark, sf):
    pairs = [(a, b) for a in langs.CODES for b in langs.CODES if a != b]
    return tables.translate_pairs(_part(spark, sf), pairs)


def language_pairs(spark, sf):
    docs = d.table(spark, sf, "documents")
    pairs = F.broadcast(langs.language_pairs(spark))  # six rows
    return docs.join(pairs, F.col("lang") == F.col("src_lang")).select(
        "doc_id", "src_lang", "tgt_lang")


def check_pair(spark, sf):
    targets = F.explode(F.array(*[F.lit(c) for c in langs.CODES])).alias("tgt_lang")
    return d.table(spark, sf, "documents").select("doc_id", "lang", targets).withColumn(
        "ok", langs.pair_ok("lang", "tgt_lang"))


def lang_code(spark, sf):
    return langs.with_lang_code(d.table(spark, sf, "documents").select("doc_id", "lang"), "lang")


def retry_outcome(spark, sf):
    results = mem.build_memory(_line_segments(spark, sf), rule_backend())
    return results.select("segment", "status", "attempts", "error", "translation")


def fallback_to_source(spark, sf):
    turns = d.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return tables.translate_table(turns, "en", "ne", backend=rule_backend(), on_error="source")


def fail_policy_report(spark, sf):
    """The run stops; what failed, and why, is in the memory."""
    memory = mem.TranslationMemory(spark, new_work_dir(spark, "memory"))
    try:
        tables.translate_table(
            d.conversation_lines(spark, sf), "en", "ne", columns=["line"],
            backend=rule_backend(), memory=memory)
    except mem.TranslationFailed:
        pass
    return memory.failures().select("segment", "status", "error")


def run_report(spark, sf):
    """Calls, distinct texts and failures of a run without a memory (and the failed texts)."""
    report = mem.RunReport()
    tables.translate_table(
        d.conversation_lines(spark, sf), "en", "ne", columns=["line"], backend=rule_backend(),
        on_error="source", report=report)
    return report.failures.select(
        F.col("segment"), "attempts", F.lit(report.calls).alias("calls"),
        F.lit(report.distinct_texts).alias("distinct_texts"), F.lit(report.failed).alias("failed"))


def parse_reply_log(spark, sf):
    good = F.col("turn") % 3 != 0
    body = F.to_json(F.struct(
        F.when(good, "SUCCESS").otherwise("ERROR").alias("message_type"),
        F.when(good, F.col("text")).alias("output"), F.col("role").alias("message")))
    return d.table(spark, sf, "conversations").select(
        "conv_id", "turn", parse_response(body).alias("r")).select("conv_id", "turn", "r.*")


# ---------------------------------------------------------------------- runs


def assemble_paragraphs(spark, sf):
    return run_ops.assemble_paragraphs(d.runs(spark, sf)).select("doc_id", "para_idx", "text")


def first_run(spark, sf):
    return run_ops.first_runs(d.runs(spark, sf)).select(
        "doc_id", "para_idx", "run_idx", "text", "bold")


def rewrite_runs(spark, sf):
    paragraphs = run_plan.translated_paragraphs(d.runs(spark, sf), "en", "ne")
    return run_ops.rewrite_runs(paragraphs).select("doc_id", "para_idx", "run_idx", "bold", "text")


def translate_runs(spark, sf):
    return run_plan.translate_runs(d.runs(spark, sf), "en", "tmg", dedup=True)


def _texts(spark, sf):
    return d.spread(d.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@d.stored
def docx_plain(spark, sf):
    return documents_as_docx(_texts(spark, sf))


@d.stored
def docx_with_tables(spark, sf):
    return documents_as_docx(_texts(spark, sf), tables=True)


def docx_roundtrip(spark, sf):
    """Documents to DOCX files, translated, and their paragraphs read again."""
    files = docx_plain(spark, sf)
    paragraphs = run_plan.translated_paragraphs(
        docx_src.read_docx_runs(files), "en", "ne", dedup=True, changes_only=True)
    done = docx_src.read_docx_runs(docx_src.patch_docx(files, paragraphs))
    return run_ops.assemble_paragraphs(done).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "para_idx", "text")


# -------------------------------------------------------------------- layout


def span_style(spark, sf):
    return lay.span_style(lay.text_spans(d.spans(spark, sf))).select(
        "doc_id", "line_idx", "span_idx", "is_bold", "is_italic", "fontsize")


def horizontal_rules(spark, sf):
    return lay.horizontal_rules(d.drawings(spark, sf))


def _styled(spark, sf):
    spans = lay.span_style(lay.text_spans(d.spans(spark, sf)))
    return lay.underlined_spans(spans, lay.horizontal_rules(d.drawings(spark, sf)))


def underlined_spans(spark, sf):
    return _styled(spark, sf).select("doc_id", "page_idx", "line_idx", "span_idx", "is_underline")


def assemble_lines(spark, sf):
    return lay.assemble_lines(_styled(spark, sf)).select(
        "doc_id", "page_idx", "line_idx", "y_top", "x0", "line", "is_bold", "is_italic",
        "is_underline", "fontsize")


def dominant_span(spark, sf):
    return lay.dominant_span(lay.span_style(d.spans(spark, sf))).select(
        "doc_id", "page_idx", "line_idx", "span_idx", "text", "fontsize")


def _kept(spark, sf):
    lines = lay.assemble_lines(_styled(spark, sf))
    return lay.drop_text_in_tables(lines, d.table_boxes(spark, sf))


def drop_text_in_tables(spark, sf):
    return _kept(spark, sf).select("doc_id", "page_idx", "line_idx", "line")


def clean_table_cells(spark, sf):
    return lay.clean_table_cells(d.table_cells(spark, sf))


def table_shape(spark, sf):
    return lay.table_shape(d.table_cells(spark, sf))


def table_row_roles(spark, sf):
    return d.table_cells(spark, sf).select(
        "doc_id", "page_idx", "table_idx", "row_idx", "col_idx",
        style.table_row_role().alias("role"))


def drop_empty_tables(spark, sf):
    return lay.table_blocks(d.table_boxes(spark, sf), d.table_cells(spark, sf))


def merge_blocks(spark, sf):
    merged = lay.merge_blocks(
        _kept(spark, sf), lay.table_blocks(d.table_boxes(spark, sf), d.table_cells(spark, sf)))
    return merged.select("doc_id", "page_idx", "type", "y_top", "line", "n_rows", "n_cols")


ORDER_COLUMNS = ("doc_id", "page_idx", "seq", "type", "line", "table_idx")


def reading_order(spark, sf):
    return lay.extract_blocks(d.layout(spark, sf)).select(*ORDER_COLUMNS)


def reading_order_split(spark, sf):
    """The path for pages of any size, forced by a tiny limit."""
    return lay.extract_blocks(d.layout(spark, sf), page_rows=60).select(*ORDER_COLUMNS)


def is_heading(spark, sf):
    return _kept(spark, sf).select("doc_id", "line_idx", "line", style.is_heading().alias("heading"))


def paragraph_style(spark, sf):
    lines = _kept(spark, sf).withColumn("heading", style.is_heading())
    return lines.select(
        "doc_id", "line_idx", "heading", style.paragraph_style("heading").alias("s")
    ).select("doc_id", "line_idx", "heading", "s.*")


def escape_markup(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", text.escape_markup("html").alias("safe"),
        text.escape_markup("url", F.lit(True)).alias("underlined"))


def distinct_layout_segments(spark, sf):
    blocks = _kept(spark, sf).withColumn("type", F.lit("text"))
    return plan.distinct_layout_segments(blocks, d.table_cells(spark, sf))


def _translated(spark, sf, dedup=False):
    return plan.translate_layout(d.layout(spark, sf), "en", "ne", dedup=dedup)


def translate_layout(spark, sf):
    return _translated(spark, sf, dedup=True).blocks.select(
        "doc_id", "page_idx", "seq", "type", "y_top", "fontsize", "is_bold", "is_italic",
        "is_underline", "table_idx", "translation")


def translate_layout_cells(spark, sf):
    return _translated(spark, sf, dedup=True).cells.select(
        "doc_id", "page_idx", "table_idx", "row_idx", "col_idx", "translation")


def page_breaks(spark, sf):
    return plan.page_breaks(d.layout_pages(spark, sf)).select("doc_id", "page_idx")


def empty_pages(spark, sf):
    blocks = lay.extract_blocks(d.layout(spark, sf))
    return plan.empty_pages(d.layout_pages(spark, sf), blocks).select(
        "doc_id", "page_idx", "height_mm")


def reflow_plan(spark, sf):
    return plan.reflow_plan(_translated(spark, sf, dedup=True)).drop("x0", "n_rows", "col_width")


def reflow_cells(spark, sf):
    return plan.reflow_cells(_translated(spark, sf).cells)


def reassemble_text(spark, sf):
    return plan.reassemble_text(_translated(spark, sf, dedup=True), lines_per_part=8)


# --------------------------------------------------------------------- files


def _files(spark, sf):
    return file_src.describe_files(d.files(spark, sf))


def list_files(spark, sf):
    return _files(spark, sf).select("path", "name", "suffix", "mime")


def size_guard(spark, sf):
    files = _files(spark, sf)
    good = file_src.accepted_files(files, fx.MAX_FILE_BYTES).select("path", F.lit("accepted").alias("reason"))
    return good.unionByName(file_src.rejected_files(files, fx.MAX_FILE_BYTES).select("path", "reason"))


def output_name(spark, sf):
    named = _files(spark, sf).where(F.col("suffix").isNotNull())
    return named.select("name", fx.output_name("name", "suffix", "ne").alias("output_name"))


def preview(spark, sf):
    return pre.preview(
        d.conversation_lines(spark, sf), ["conv_id"], ["turn", "line_idx"],
        pre.PREVIEW_BEFORE["docx"], "line")


def preview_lines(spark, sf):
    return pre.preview(
        d.document_lines(spark, sf), ["doc_id"], ["line_idx"], pre.PREVIEW_BEFORE["pdf"], "line")


def preview_rows(spark, sf):
    """The first five rows of tables, here one for every 50th part."""
    parts = _part(spark, sf).select((F.col("p_partkey") % 50).alias("file"), "p_partkey", "p_name", "p_type")
    return pre.preview(parts, ["file"], ["p_partkey"], pre.PREVIEW_BEFORE["csv"])


def preview_translated(spark, sf):
    """The first rows, paragraphs and lines of what a translation has made, each as one line of text."""
    parts = tables.translate_table(_part(spark, sf), "en", "ne", columns=["p_name", "p_type"])
    rows = pre.preview(parts.withColumn("id", F.col("p_partkey") % 50), ["id"], ["p_partkey"], pre.PREVIEW_AFTER["csv"]).select(
        F.lit("csv").alias("kind"), "id", "n_shown", pre.preview_line(["p_partkey", "p_name", "p_type"]).alias("line"))
    turns = tables.translate_table(d.conversation_lines(spark, sf), "en", "ne", columns=["line"])
    paragraphs = pre.preview(turns, ["conv_id"], ["turn", "line_idx"], pre.PREVIEW_AFTER["docx"], "line").select(
        F.lit("docx"), "conv_id", "n_shown", "line")
    lines = tables.translate_table(d.document_lines(spark, sf), "en", "ne", columns=["line"])
    pages = pre.preview(lines, ["doc_id"], ["line_idx"], pre.PREVIEW_AFTER["pdf"], "line").select(
        F.lit("pdf"), "doc_id", "n_shown", "line")
    return rows.union(paragraphs).union(pages)


def sentence_segments(spark, sf):
    return sentences.sentence_segments(
        d.table(spark, sf, "conversations"), "text", "conv_id", "turn")


def translate_by_sentence(spark, sf):
    turns = d.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return tables.translate_table(turns, "en", "ne", unit="sentence")


def sentence_failures(spark, sf):
    """What became of whole texts whose sentences were refused or throttled."""
    turns = seg.distinct_segments(d.table(spark, sf, "conversations"), ["text"])
    lookup = sentences.translate_by_sentence(
        seg.with_pair(turns, "en", "ne"), rule_backend(), on_error="source")
    return lookup.df.select("segment", "status", "attempts")


def csv_roundtrip(spark, sf):
    """Table to CSV, the CSV files translated into CSV files, and those read."""
    work = new_work_dir(spark, "csv")
    write_csv_bom(_part(spark, sf), f"{work}/in")
    csv_files.translate_csv_files(spark, f"{work}/in/*.csv", f"{work}/out", "en", "ne")
    return csv_src.read_csv_cells(spark, f"{work}/out").drop(csv_files.OUTPUT)


def csv_one_column(spark, sf):
    """A column with missing values, alone in its file."""
    work = new_work_dir(spark, "csv")
    write_csv_bom(_with_missing(spark, sf).select("v"), f"{work}/in")
    csv_files.translate_csv_files(spark, f"{work}/in/*.csv", f"{work}/out", "en", "ne")
    return csv_src.read_csv_cells(spark, f"{work}/out").drop(csv_files.OUTPUT)


def csv_folder(spark, sf):
    """Folders with files of equal names and other headers, short and long rows, and a text file.

    ``x`` has a column ``File``; in ``y`` every seventh row is short and every
    eleventh too long. ``z`` has brackets in its names, an empty first line, names
    that differ in case only, and one with a line break. The result is what comes
    out, by output and first cell.
    """
    work = new_work_dir(spark, "csv-folder")
    key = F.col("p_partkey")
    in_x = key % 2 == 0
    line = F.when(in_x, F.concat_ws(",", key, F.concat(F.lit('"'), "p_name", F.lit(', x"')), "p_type")).otherwise(
        F.when(key % 7 == 0, key.cast("string")).when(key % 11 == 0, F.concat_ws(",", key, "p_name", F.lit("too"), F.lit("long")))
        .otherwise(F.concat_ws(",", key, "p_name")))
    name = F.concat(F.when(in_x, "x").otherwise("y"), F.lit("/my +file "), (key % 6).cast("string"),
                    F.when(key % 6 == 5, ".txt").otherwise(".csv"))
    header = F.when(F.startswith("name", F.lit("x")), "id,File,kind").otherwise("id,title")
    odd_name = F.concat(F.lit("z/a["), (key % 3).cast("string"), F.lit("]{1}.csv"))
    odd_line = F.concat_ws(",", key, F.concat(F.lit('"'), "p_type", F.lit('\n"""')), "p_name")
    odd = _part(spark, sf).select(odd_name.alias("name"), odd_line.alias("line"))
    rows = _part(spark, sf).select(name.alias("name"), line.alias("line")).union(odd)
    header = F.when(F.startswith("name", F.lit("z")), '\nName,"two\nlines",name').otherwise(header)
    content = F.concat(header, F.lit("\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n"))
    export_files(rows.groupBy("name").agg(F.encode(content, "utf-8").alias("content")), f"{work}/in", "name")
    csv_files.translate_csv_files(spark, f"{work}/in", f"{work}/out", "en", "ne")

    def read(folder: str, names: list[str]) -> DataFrame:
        table = spark.read.option("basePath", f"{work}/out").csv(f"{work}/out/_output={folder}*", header=True)
        a, b, c = (F.col(n) if n else F.lit(None).cast("string") for n in [*names, ""][:3])
        return table.select(csv_files.OUTPUT, a.alias("a"), b.alias("b"), c.alias("c"))

    rejected = spark.read.parquet(f"{work}/out/{file_src.REJECTED}").select(
        F.element_at(F.split("path", "/in/"), -1).alias("name"), "reason", F.get_json_object("row", "$[0]"), F.lit(None))
    z = spark.read.option("basePath", f"{work}/out").schema(f"a string, b string, c string, {csv_files.OUTPUT} string").csv(
        f"{work}/out/_output=z*", header=True, multiLine=True, enforceSchema=True, escape='"').select(csv_files.OUTPUT, "a", "b", "c")
    return read("x", ["id", "File", "kind"]).union(read("y", ["id", "title"])).union(z).withColumnRenamed(
        csv_files.OUTPUT, "name").union(rejected)


def csv_order(spark, sf):
    """The place of each row in its output file: the order of the input is kept."""
    work = new_work_dir(spark, "csv-order")
    orders = d.table(spark, sf, "orders")
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), "o_orderstatus", F.lit('\n"')))
    name = F.concat(F.lit("f"), (F.col("o_orderkey") % 5).cast("string"), F.lit(".csv"))
    export_lines(orders.select(name.alias("name"), "o_orderkey", line.alias("line")), f"{work}/in", ["o_orderkey", "line"], "key,status")
    csv_files.translate_csv_files(spark, f"{work}/in", f"{work}/out", "en", "ne")
    records = csv_rec.read_csv_records(spark, f"{work}/out")
    parts = csv_files.meeting(csv_files.csv_tables(records).select(csv_rec.DOC, "head_pos"))
    rows = records.join(parts, csv_rec.DOC).where(F.col(csv_rec.POS) > F.col("head_pos"))
    # An output file is many parts: the place in the part, and the rows of the parts before it.
    name = F.regexp_extract(file_src.decoded_path(F.col(csv_rec.DOC)), "_output=([^/]*)/", 1)
    sizes = rows.groupBy(csv_rec.DOC).agg(F.count(F.lit(1)).alias("n")).select("*", name.alias("name"))
    earlier = Window.partitionBy("name").orderBy(csv_rec.DOC).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(csv_rec.DOC, "name", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy(csv_rec.DOC).orderBy(csv_rec.POS))
    placed = rows.select(csv_rec.DOC, F.get("cells", F.lit(0)).alias("cell"), local.alias("local"))
    return placed.join(before, csv_rec.DOC, "left").select(
        "name", "cell", (F.col("before") + F.col("local")).cast("int").alias("place"))


def docx_folder(spark, sf):
    """A folder of DOCX files with tables, one broken, and equal names in two folders."""
    work = new_work_dir(spark, "docx-folder")
    folder = F.when(F.col("doc_id") % 2 == 0, "x/").otherwise("y/")
    files = docx_with_tables(spark, sf).withColumn("doc_id", F.col("path").cast("long"))
    files = files.select(
        F.concat(folder, F.lit("doc "), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".docx")).alias("name"),
        F.when(F.col("doc_id") % 50 == 3, F.encode(F.lit("no archive"), "utf-8")).otherwise(F.col("content")).alias("content"))
    export_files(files, f"{work}/in", "name")
    docx_files.translate_docx_files(spark, f"{work}/in", f"{work}/out", "en", "ne", dedup=True)
    done = spark.read.parquet(f"{work}/out").select(F.col("output_name").alias("path"), "content")
    paragraphs = run_ops.assemble_paragraphs(docx_src.read_docx_runs(done)).select(
        F.col("doc_id").alias("name"), "table_idx", "row_idx", "col_idx", "para_idx", "text")
    broken = spark.read.parquet(f"{work}/out/{file_src.REJECTED}").select(
        F.element_at(F.split("path", "/in/"), -1), *[F.lit(None).cast("int")] * 4, F.lit("broken"))
    return paragraphs.union(broken)


# ----------------------------------------------------------------- streaming


def _stream_events(spark, sf, work=None, **options):
    """Events arriving as four files, one to a micro-batch."""
    work = work or new_work_dir(spark, "stream")
    events = d.table(spark, sf, "events").select("event_id", "event_type", "props")
    events.repartitionByRange(4, "event_id").write.parquet(f"{work}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    memory = mem.TranslationMemory(spark, f"{work}/memory")
    stream_translate(
        stream.parquet(f"{work}/in"), "en", "ne", memory=memory, out_path=f"{work}/out",
        checkpoint=f"{work}/checkpoint", name=work.rsplit("/", 1)[1], **options,
    ).awaitTermination()
    return memory, spark.read.parquet(f"{work}/out")


def stream_translated(spark, sf):
    return _stream_events(spark, sf)[1].select("event_id", "event_type", "props")


def stream_metrics(spark, sf):
    """Counts of a stream from the sketches of its batches; distinct texts within three standard errors of the exact."""
    work = new_work_dir(spark, "stream")
    _stream_events(spark, sf, work, metrics_path=f"{work}/metrics")
    exact = tables.table_metrics(d.table(spark, sf, "events").select("event_type", "props")).first().distinct_texts
    near = F.abs(F.col("distinct_texts") - exact) <= 0.05 * exact
    return translate.stream_metrics(spark, f"{work}/metrics").select(
        "cells", "missing", "blank", "texts", near.alias("distinct_texts_are_near"))


def stream_csv(spark, sf):
    """Events arriving as CSV files of two headers, translated as they come."""
    work = new_work_dir(spark, "stream-csv")
    events = d.table(spark, sf, "events").select("event_id", "event_type", "props").withColumn("event_id", F.col("event_id").cast("string"))
    odd = F.col("event_id").cast("long") % 2 == 1
    write_csv_bom(events.where(~odd).repartition(2, "event_id"), f"{work}/in")
    write_csv_bom(events.where(odd).select("props", "event_type", "event_id").repartition(2, "event_id"), f"{work}/in", mode="append")
    stream = csv_rec.stream_csv_cells(spark, f"{work}/in", ["event_id", "event_type", "props"], files_per_batch=2)
    stream_translate(
        stream, "en", "ne", memory=mem.TranslationMemory(spark, f"{work}/memory"), out_path=f"{work}/out",
        checkpoint=f"{work}/checkpoint", columns=["event_type"],
    ).awaitTermination()
    return spark.read.parquet(f"{work}/out").where("_extra is null").select("event_id", "event_type", "props")


def stream_memory(spark, sf):
    """Rows of the memory per text: one, however many batches the text is in."""
    memory, _ = _stream_events(spark, sf)
    return memory.read().groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        translate_table_part, translate_table_inline, translate_table_orders,
        translate_table_lineitem, translate_table_events, translate_table_documents,
        translate_cast_all, normalize_missing, is_translatable, distinct_segments, run_metrics,
        mock_backend, memory_build, memory_resume, new_segments, apply_memory, apply_lookup_shuffled, apply_lookup_columns,
        translate_pairs, language_pairs, check_pair, lang_code, retry_outcome,
        fallback_to_source, fail_policy_report, run_report, assemble_paragraphs, first_run, rewrite_runs,
        translate_runs, docx_roundtrip, span_style, horizontal_rules, underlined_spans,
        assemble_lines, dominant_span, drop_text_in_tables, clean_table_cells, table_shape,
        table_row_roles, drop_empty_tables, merge_blocks, reading_order, reading_order_split,
        is_heading, paragraph_style, escape_markup, distinct_layout_segments, translate_layout,
        translate_layout_cells, page_breaks, empty_pages, reflow_plan, reflow_cells,
        reassemble_text, list_files, size_guard, output_name, preview, preview_lines, preview_rows, preview_translated,
        sentence_segments, translate_by_sentence, sentence_failures, csv_roundtrip, csv_one_column,
        csv_folder, csv_order, docx_folder, stream_csv, stream_metrics, stream_memory,
    )
}
QUERIES["parse_response"] = parse_reply_log
QUERIES["stream_translate"] = stream_translated
