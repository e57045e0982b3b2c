"""The registered queries in SQL, for an independent engine."""

from __future__ import annotations

# Fixed values, stated here again: this module takes nothing from the code it checks.
# Languages; the cell texts pandas takes as missing; what Python's str.strip strips.
LANGUAGES = {"english": "en", "nepali": "ne", "tamang": "tmg"}
CODES = ("en", "ne", "tmg")
NA_TOKENS = ["", *"#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null".split("|")]
WS_CODE_POINTS = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

WS = "(" + "||".join(f"chr({c})" for c in WS_CODE_POINTS) + ")"
NA = ", ".join(f"'{t}'" for t in NA_TOKENS)
UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def mock(c: str, tgt: str = "ne") -> str:
    return f"CASE WHEN {strip(c)} <> '' THEN '[MOCK:{tgt}] ' || {c} ELSE {c} END"


def _unnest(src: str, keep: str, text: str, sep: str, idx: str, out: str) -> str:
    parts = f"string_split({text}, {sep})"
    return (
        f"SELECT {keep}, CAST(generate_subscripts({parts}, 1) - 1 AS INT) AS {idx}, "
        f"unnest({parts}) AS {out} FROM {src}"
    )


LINES = "lines AS (" + _unnest("documents", "doc_id", "text", "chr(10)", "line_idx", "line") + ")"
CONV = (
    "conv AS (" + _unnest("conversations", "conv_id, turn", "text", "chr(10)", "line_idx", "line") + ")"
)
PIECES = LINES + ", pieces AS (" + _unnest(
    "lines", "doc_id, line_idx", "line", "', '", "span_idx", "raw") + ")"
SPANS = PIECES + """, spans AS (
  SELECT doc_id, line_idx // 20 AS page_idx, line_idx AS block_idx, 0 AS block_type,
    40.0::DOUBLE + (line_idx % 2) * 250 AS block_x0, line_idx,
    40.0::DOUBLE + ((line_idx % 20) // 2) * 60 AS line_y0, span_idx,
    CASE WHEN (doc_id + line_idx + span_idx) % 17 = 0 THEN '  '
         WHEN (doc_id + line_idx) % 9 = 0 THEN """ + UP.format("raw") + """ ELSE raw END AS text,
    CAST(((doc_id + line_idx + span_idx) % 2) * 16
      + CASE WHEN (doc_id + span_idx) % 3 = 0 THEN 2 ELSE 0 END AS INT) AS flags,
    CASE (doc_id + line_idx + span_idx) % 5 WHEN 0 THEN 'NotoSans-Bold'
      WHEN 1 THEN 'NotoSans-Italic' ELSE 'NotoSans' END AS font,
    (16 + (doc_id * 7 + line_idx * 13 + span_idx * 5) % 24) / 2.0::DOUBLE AS size,
    40.0::DOUBLE + (line_idx % 2) * 250 + span_idx * 60 AS x0,
    40.0::DOUBLE + ((line_idx % 20) // 2) * 60 AS y0,
    40.0::DOUBLE + (line_idx % 2) * 250 + span_idx * 60 + 50 AS x1,
    40.0::DOUBLE + ((line_idx % 20) // 2) * 60 + 12 AS y1
  FROM pieces)"""
_PAGES = """layout_pages AS (SELECT DISTINCT doc_id, line_idx // 20 AS page_idx FROM lines),
boxes AS (SELECT doc_id, page_idx, 0 AS table_idx, 30.0::DOUBLE AS x0, 160.0::DOUBLE AS y0,
    280.0::DOUBLE AS x1, 290.0::DOUBLE AS y1
  FROM layout_pages WHERE (doc_id + page_idx) % 3 = 0),
cells AS (SELECT doc_id, page_idx, table_idx, r.i::INT AS row_idx, c.i::INT AS col_idx,
    CASE WHEN (r.i + c.i + doc_id) % 7 = 0 THEN NULL
      ELSE '  item ' || ((doc_id * r.i + c.i) % 11) || ' ' END AS cell
  FROM boxes, range(3) r(i), range(3) c(i)
  WHERE doc_id % 11 <> 0 AND c.i <= 1 + (r.i + doc_id) % 2),
drawings AS (SELECT doc_id, page_idx, n.i AS path_idx,
    CASE WHEN n.i % 3 = 2 THEN 'f' ELSE 's' END AS path_type,
    CASE WHEN n.i % 4 = 3 THEN 're' ELSE 'l' END AS item_kind,
    52.0::DOUBLE + n.i * 120 + (doc_id % 2) * 0.5 AS y1,
    52.0::DOUBLE + n.i * 120 + (doc_id % 2) * 0.5 + CASE WHEN n.i = 1 THEN 3 ELSE 0 END AS y2
  FROM layout_pages, range(6) n(i)),
rules AS (SELECT DISTINCT doc_id, page_idx, round_even(y1, 0)::INT AS y FROM drawings
  WHERE path_type = 's' AND item_kind = 'l' AND abs(y1 - y2) < 2)"""
PAGES = LINES + ", " + _PAGES
STYLED = SPANS + ", " + _PAGES + """, styled AS (
  SELECT s.*, (flags & 16) <> 0 OR contains(font, 'Bold') OR contains(font, 'bold') AS is_bold,
    (flags & 2) <> 0 OR contains(font, 'Italic') OR contains(font, 'italic') AS is_italic,
    round_even(size, 0)::INT AS fontsize,
    EXISTS (SELECT 1 FROM rules r WHERE r.doc_id = s.doc_id AND r.page_idx = s.page_idx
      AND abs(round_even(s.y1, 0) - r.y) < 6) AS is_underline,
    """ + strip("text") + """ AS stripped
  FROM spans s WHERE block_type = 0)"""
DOMINANT = STYLED + """, dominant AS (
  SELECT * FROM styled WHERE stripped <> '' QUALIFY row_number() OVER (
    PARTITION BY doc_id, page_idx, block_idx, line_idx ORDER BY length(stripped) DESC, span_idx) = 1)"""
TEXT_LINES = DOMINANT + """, joined AS (
  SELECT doc_id, page_idx, block_idx, line_idx, min(line_y0) AS y_top, min(block_x0) AS x0,
    string_agg(stripped, ' ' ORDER BY span_idx) AS line
  FROM styled WHERE stripped <> '' GROUP BY ALL),
text_lines AS (SELECT j.*, d.is_bold, d.is_italic, d.is_underline, d.fontsize
  FROM joined j JOIN dominant d USING (doc_id, page_idx, block_idx, line_idx))"""
KEPT = TEXT_LINES + """, first_spans AS (
  SELECT * FROM spans QUALIFY row_number() OVER (
    PARTITION BY doc_id, page_idx, block_idx, line_idx ORDER BY span_idx) = 1),
kept AS (SELECT t.* FROM text_lines t JOIN first_spans f USING (doc_id, page_idx, block_idx, line_idx)
  WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = f.doc_id AND b.page_idx = f.page_idx
    AND (f.x0 + f.x1) / 2 BETWEEN b.x0 AND b.x1 AND (f.y0 + f.y1) / 2 BETWEEN b.y0 AND b.y1))"""
BLOCKS = KEPT + """, shapes AS (
  SELECT doc_id, page_idx, table_idx, max(row_idx) + 1 AS n_rows, max(col_idx) + 1 AS n_cols
  FROM cells GROUP BY ALL),
merged AS (
  SELECT doc_id, page_idx, 'text' AS type, y_top, block_idx, line_idx, NULL::INT AS table_idx,
    x0, line, fontsize, is_bold, is_italic, is_underline, NULL::INT AS n_rows, NULL::INT AS n_cols
  FROM kept UNION ALL
  SELECT doc_id, page_idx, 'table', y0, NULL, NULL, table_idx, NULL, NULL, NULL, NULL, NULL, NULL,
    n_rows, n_cols FROM boxes JOIN shapes USING (doc_id, page_idx, table_idx)),
blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_idx
    ORDER BY y_top, type = 'table', block_idx, line_idx, table_idx) - 1 AS INT) AS seq FROM merged)"""
HEADING = "(fontsize >= 14 OR (is_bold AND fontsize >= 11) OR (length(line) > 2 AND upper(line) = line AND lower(line) <> line))"
STYLE = f"""CASE WHEN {HEADING} THEN 6 ELSE 0 END AS space_before, 2 AS space_after,
  {HEADING} AS heading, (is_bold OR {HEADING}) AND NOT is_italic AS bold, is_underline AS underline,
  least(greatest(fontsize, 8), 18) AS size, least(greatest(fontsize, 8), 18) + 4 AS leading"""


def escape(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


MARKED = (
    "CASE WHEN is_underline THEN '<u>' || " + escape("'[MOCK:ne] ' || line") + " || '</u>' ELSE "
    + escape("'[MOCK:ne] ' || line") + " END"
)
RUNS = PIECES + """, runs AS (
  SELECT doc_id, CASE WHEN line_idx % 7 = 3 THEN 0 END AS table_idx,
    CASE WHEN line_idx % 7 = 3 THEN line_idx END AS row_idx,
    CASE WHEN line_idx % 7 = 3 THEN 0 END AS col_idx, line_idx AS para_idx, span_idx AS run_idx,
    raw || CASE WHEN span_idx < max(span_idx) OVER (PARTITION BY doc_id, line_idx)
      THEN ', ' ELSE '' END AS text,
    (doc_id + line_idx + span_idx) % 2 = 1 AS bold FROM pieces)"""
# Status by text length, as the stand-in service of the queries behaves.
OUTCOME = """CASE length({0}) % 5 WHEN 3 THEN 'failed' WHEN 4 THEN 'api_error' ELSE 'ok' END"""
FILES = """files AS (SELECT '/in/doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.csv' WHEN 1
  THEN '.docx' WHEN 2 THEN '.PDF' ELSE '.txt' END AS path, 'doc_' || doc_id || CASE doc_id % 4
  WHEN 0 THEN '.csv' WHEN 1 THEN '.docx' WHEN 2 THEN '.PDF' ELSE '.txt' END AS name,
  CASE doc_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' END AS suffix,
  n_chars * 64 AS length FROM documents)"""
LANG = "CASE lower(lang) " + " ".join(
    f"WHEN '{n}' THEN '{c}' WHEN '{c}' THEN '{c}'" for n, c in LANGUAGES.items()) + " END"
SENTENCES = """sentences AS (
  SELECT conv_id, turn, i, sentence, coalesce(seps[i + 1], '') AS separator FROM (
    SELECT conv_id, turn, seps, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS sentence FROM (
      SELECT conv_id, turn, string_split(
        regexp_replace(text, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts,
        regexp_extract_all(text, '[.!?।](\\s+)', 1) AS seps
      FROM conversations)))"""
PAIRS = " UNION ALL ".join(
    f"SELECT '{s}' AS src_lang, '{t}' AS tgt_lang" for s in CODES for t in CODES if s != t)
PART_CELLS = "(SELECT p_name AS segment FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)"


_NAME = """CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END || '/my +file ' || (p_partkey % 6)"""
CSV_FOLDER = f"""SELECT {_NAME} || '_translated_ne.csv' AS name, '[MOCK:ne] ' || p_partkey AS a,
    CASE WHEN p_partkey % 2 = 0 THEN '[MOCK:ne] ' || p_name || ', x'
      WHEN p_partkey % 7 <> 0 THEN '[MOCK:ne] ' || p_name END AS b,
    CASE WHEN p_partkey % 2 = 0 THEN '[MOCK:ne] ' || p_type END AS c
  FROM part WHERE p_partkey % 6 <> 5 AND (p_partkey % 2 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 <> 0)
  UNION ALL SELECT {_NAME} || '.csv', 'a row longer than its header', p_partkey::VARCHAR, NULL
  FROM part WHERE p_partkey % 6 <> 5 AND p_partkey % 2 = 1 AND p_partkey % 7 <> 0 AND p_partkey % 11 = 0
  UNION ALL SELECT DISTINCT {_NAME} || '.txt', 'unknown suffix', NULL, NULL FROM part WHERE p_partkey % 6 = 5
  UNION ALL SELECT 'z/a[' || (p_partkey % 3) || ']{{1}}_translated_ne.csv', '[MOCK:ne] ' || p_partkey,
    '[MOCK:ne] ' || p_type || chr(10) || '"', '[MOCK:ne] ' || p_name FROM part"""
_DOCX = "CASE WHEN doc_id % 2 = 0 THEN 'x/' ELSE 'y/' END || 'doc ' || (doc_id // 2)"
DOCX_FOLDER = f"""WITH {LINES} SELECT {_DOCX} || '_translated_ne.docx' AS name,
    CASE WHEN line_idx % 8 >= 6 THEN (line_idx // 8)::INT END AS table_idx,
    CASE WHEN line_idx % 8 >= 6 THEN 0 END AS row_idx,
    CASE WHEN line_idx % 8 >= 6 THEN (line_idx % 8 - 6)::INT END AS col_idx,
    CASE WHEN line_idx % 8 >= 6 THEN 0 ELSE (line_idx // 8 * 6 + line_idx % 8)::INT END AS para_idx,
    {mock('line')} AS text FROM lines WHERE doc_id % 50 <> 3
  UNION ALL SELECT {_DOCX} || '.docx', NULL, NULL, NULL, NULL, 'broken' FROM documents WHERE doc_id % 50 = 3"""


def missing_name() -> str:
    """Customer names, some of them replaced by a spelling of "missing"."""
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(NA_TOKENS))
    return f"CASE c_custkey % 40 {cases} WHEN 20 THEN '  ' WHEN 21 THEN '007' ELSE c_name END"


def sql() -> dict[str, str]:
    part = ("SELECT p_partkey, " + ", ".join(f"{mock(c)} AS {c}" for c in ("p_name", "p_brand", "p_type"))
            + ", p_size, p_retailprice FROM part")
    line_memory = f"SELECT DISTINCT line AS segment FROM lines WHERE {strip('line')} <> ''"
    return {
        "translate_table_part": part,
        "translate_table_inline": part,
        "translate_table_orders": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, " + ", ".join(
            f"{mock(c, 'tmg')} AS {c}" for c in ("o_orderstatus", "o_orderpriority")) + " FROM orders",
        "translate_table_lineitem": "SELECT * REPLACE (" + ", ".join(
            f"{mock(c)} AS {c}" for c in ("l_returnflag", "l_linestatus")) + ") FROM lineitem",
        "translate_table_events": "SELECT * REPLACE (" + ", ".join(
            f"{mock(c, 'tmg')} AS {c}" for c in ("event_type", "props")) + ") FROM events",
        "translate_table_documents": f"SELECT * REPLACE ({mock('text')} AS text) FROM documents",
        "translate_cast_all": "SELECT '[MOCK:ne] ' || c_custkey AS c_custkey, '[MOCK:ne] ' || c_name "
            "AS c_name, '[MOCK:ne] ' || c_nationkey AS c_nationkey, '[MOCK:ne] ' || c_mktsegment AS "
            "c_mktsegment FROM customer",
        "normalize_missing": f"""SELECT c_custkey, CASE WHEN v IN ({NA}) THEN NULL ELSE v END AS v
            FROM (SELECT c_custkey, {missing_name()} AS v FROM customer)""",
        "is_translatable": f"""SELECT c_custkey, v IS NOT NULL AND {strip('v')} <> '' AS ok,
            {strip('v')} AS stripped FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL
            WHEN 1 THEN chr(160) || chr(12288) || c_name || chr(9) WHEN 2 THEN chr(8195) || chr(10)
            ELSE c_name END AS v FROM customer)""",
        "distinct_segments": f"SELECT segment, count(*) AS uses FROM {PART_CELLS} "
            f"WHERE {strip('segment')} <> '' GROUP BY 1",
        "run_metrics": f"""SELECT count(*) AS cells, count(*) FILTER (v IS NULL) AS missing,
            count(*) FILTER ({strip('v')} = '') AS blank, count(*) FILTER ({strip('v')} <> '') AS texts,
            count(DISTINCT v) FILTER ({strip('v')} <> '') AS distinct_texts
            FROM (SELECT CASE WHEN x IN ({NA}) THEN NULL ELSE x END AS v FROM (
              SELECT {missing_name()} AS x FROM customer UNION ALL SELECT c_mktsegment FROM customer))""",
        "mock_backend": f"SELECT doc_id, line_idx, {mock('line', 'tmg')} AS translation FROM lines".replace(
            "SELECT", f"WITH {LINES} SELECT", 1),
        "memory_build": f"""WITH {LINES} SELECT segment, '[MOCK:ne] ' || segment AS translation
            FROM ({line_memory})""",
        "memory_resume": f"""WITH {LINES}, {CONV}, texts AS (
              SELECT line AS segment, count(*) AS uses FROM lines WHERE {strip('line')} <> '' GROUP BY 1),
            new AS (SELECT segment FROM texts EXCEPT (SELECT line FROM conv UNION SELECT text FROM benchmark))
            SELECT segment, uses, '[MOCK:ne] ' || segment AS translation, (SELECT count(*) FROM new) AS calls FROM texts""",
        "new_segments": f"""WITH {LINES}, {CONV} SELECT segment FROM ({line_memory})
            EXCEPT (SELECT line FROM conv UNION SELECT text FROM benchmark)""",
        "apply_memory": f"""WITH {LINES} SELECT doc_id, line_idx, CASE WHEN line IN
            (SELECT text FROM benchmark) THEN '[MOCK:ne] ' || line ELSE line END AS line FROM lines""",
        "apply_lookup_shuffled": f"""WITH {LINES} SELECT doc_id, line_idx, {mock('line')} AS line
            FROM lines""",
        "apply_lookup_columns": part,
        "translate_pairs": f"""SELECT src_lang, tgt_lang, part.* REPLACE ('[MOCK:' || tgt_lang || '] ' ||
            p_type AS p_type, '[MOCK:' || tgt_lang || '] ' || p_brand AS p_brand,
            '[MOCK:' || tgt_lang || '] ' || p_name AS p_name) FROM part, ({PAIRS})""",
        "language_pairs": f"SELECT doc_id, src_lang, tgt_lang FROM documents JOIN ({PAIRS}) ON lang = src_lang",
        "check_pair": f"""SELECT doc_id, lang, tgt_lang, lang IN {CODES} AND lang <> tgt_lang AS ok
            FROM documents, (SELECT unnest({list(CODES)}) AS tgt_lang)""",
        "lang_code": f"SELECT doc_id, lang, {LANG} AS lang_code FROM documents",
        "retry_outcome": f"""WITH {LINES} SELECT segment, {OUTCOME.format('segment')} AS status,
            CASE length(segment) % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END AS attempts,
            CASE length(segment) % 5 WHEN 3 THEN 'HTTP 503'
              WHEN 4 THEN 'refused: too hard' END AS error,
            CASE WHEN length(segment) % 5 < 3 THEN '[ne] ' || segment END AS translation
            FROM ({line_memory})""",
        "fallback_to_source": f"""SELECT conv_id, turn, CASE WHEN length(text) % 5 < 3 AND
            {strip('text')} <> '' THEN '[ne] ' || text ELSE text END AS text FROM conversations""",
        "fail_policy_report": f"""WITH {CONV} SELECT DISTINCT line AS segment,
            {OUTCOME.format('line')} AS status, CASE length(line) % 5 WHEN 3 THEN
            'HTTP 503' ELSE 'refused: too hard' END AS error
            FROM conv WHERE {strip('line')} <> '' AND length(line) % 5 >= 3""",
        "run_report": f"""WITH {CONV}, texts AS (SELECT DISTINCT line AS segment FROM conv
              WHERE {strip('line')} <> ''), n AS (SELECT count(*)::INT AS calls, count(*)::INT AS distinct_texts,
              count(*) FILTER (length(segment) % 5 >= 3)::INT AS failed FROM texts)
            SELECT segment, CASE length(segment) % 5 WHEN 3 THEN 3 ELSE 1 END AS attempts, n.*
            FROM texts, n WHERE length(segment) % 5 >= 3""",
        "parse_response": """SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN text END AS translation,
            CASE WHEN turn % 3 <> 0 THEN 'ok' ELSE 'api_error' END AS status,
            CASE WHEN turn % 3 = 0 THEN 'refused: ' || role END AS error FROM conversations""",
        "assemble_paragraphs": f"""WITH {LINES} SELECT doc_id, line_idx AS para_idx, line AS text FROM lines""",
        "first_run": f"""WITH {RUNS} SELECT doc_id, para_idx, run_idx, text, bold FROM runs
            WHERE run_idx = 0""",
        "rewrite_runs": f"""WITH {RUNS}, done AS (SELECT r.*, l.line FROM runs r JOIN lines l
              ON r.doc_id = l.doc_id AND r.para_idx = l.line_idx)
            SELECT doc_id, para_idx, run_idx, bold, CASE WHEN {strip('line')} = '' THEN text
              WHEN run_idx = 0 THEN '[MOCK:ne] ' || line ELSE '' END AS text FROM done""",
        "translate_runs": f"""WITH {RUNS}, done AS (SELECT r.*, l.line FROM runs r JOIN lines l
              ON r.doc_id = l.doc_id AND r.para_idx = l.line_idx)
            SELECT doc_id, table_idx, row_idx, col_idx, para_idx, run_idx, bold,
              CASE WHEN {strip('line')} = '' THEN text
              WHEN run_idx = 0 THEN '[MOCK:tmg] ' || line ELSE '' END AS text FROM done""",
        "docx_roundtrip": f"""WITH {LINES} SELECT doc_id, line_idx AS para_idx,
            {mock('line')} AS text FROM lines WHERE line <> ''""",
        "span_style": f"""WITH {STYLED} SELECT doc_id, line_idx, span_idx, is_bold, is_italic, fontsize
            FROM styled""",
        "horizontal_rules": f"WITH {PAGES} SELECT doc_id, page_idx, y FROM rules",
        "underlined_spans": f"WITH {STYLED} SELECT doc_id, page_idx, line_idx, span_idx, is_underline FROM styled",
        "assemble_lines": f"""WITH {TEXT_LINES} SELECT doc_id, page_idx, line_idx, y_top, x0, line, is_bold,
            is_italic, is_underline, fontsize FROM text_lines""",
        "dominant_span": f"""WITH {DOMINANT} SELECT doc_id, page_idx, line_idx, span_idx, stripped AS text,
            fontsize FROM dominant""",
        "drop_text_in_tables": f"WITH {KEPT} SELECT doc_id, page_idx, line_idx, line FROM kept",
        "clean_table_cells": f"""WITH {PAGES} SELECT doc_id, page_idx, table_idx, row_idx, col_idx,
            coalesce({strip('cell')}, '') AS cell FROM cells""",
        "table_shape": f"""WITH {PAGES} SELECT doc_id, page_idx, table_idx, max(row_idx) + 1 AS n_rows,
            max(col_idx) + 1 AS n_cols FROM cells GROUP BY ALL""",
        "table_row_roles": f"""WITH {PAGES} SELECT doc_id, page_idx, table_idx, row_idx, col_idx,
            CASE WHEN row_idx = 0 THEN 'header' WHEN row_idx % 2 = 1 THEN 'body_a' ELSE 'body_b' END
            AS role FROM cells""",
        "drop_empty_tables": f"""WITH {BLOCKS} SELECT doc_id, page_idx, table_idx, y_top, n_rows, n_cols
            FROM merged WHERE type = 'table'""",
        "merge_blocks": f"""WITH {BLOCKS} SELECT doc_id, page_idx, type, y_top, line, n_rows, n_cols
            FROM merged""",
        "reading_order": f"""WITH {BLOCKS} SELECT doc_id, page_idx, seq, type, line, table_idx FROM blocks""",
        "reading_order_split": f"""WITH {BLOCKS} SELECT doc_id, page_idx, seq, type, line, table_idx
            FROM blocks""",
        "is_heading": f"WITH {KEPT} SELECT doc_id, line_idx, line, {HEADING} AS heading FROM kept",
        "paragraph_style": f"WITH {KEPT} SELECT doc_id, line_idx, {STYLE} FROM kept",
        "escape_markup": f"SELECT page_id, {escape('html')} AS safe, '<u>' || {escape('url')} || '</u>' "
            "AS underlined FROM pages",
        "distinct_layout_segments": f"""WITH {BLOCKS} SELECT segment, count(*) AS uses FROM (
            SELECT {strip('line')} AS segment FROM kept UNION ALL SELECT {strip('cell')} FROM cells)
            WHERE segment <> '' GROUP BY 1""",
        "translate_layout": f"""WITH {BLOCKS} SELECT doc_id, page_idx, seq, type, y_top, fontsize,
            is_bold, is_italic, is_underline, table_idx, '[MOCK:ne] ' || line AS translation FROM blocks""",
        "translate_layout_cells": f"""WITH {PAGES} SELECT doc_id, page_idx, table_idx, row_idx, col_idx,
            coalesce({mock(strip('cell'))}, '') AS translation FROM cells""",
        "page_breaks": f"WITH {PAGES} SELECT doc_id, page_idx FROM layout_pages WHERE page_idx > 0",
        "empty_pages": f"""WITH {BLOCKS} SELECT doc_id, page_idx, 20 AS height_mm FROM layout_pages
            WHERE (doc_id, page_idx) NOT IN (SELECT (doc_id, page_idx) FROM blocks)""",
        "reflow_plan": f"""WITH {BLOCKS} SELECT doc_id, page_idx, seq, 0 AS part, 'paragraph' AS kind,
              NULL AS height_mm, {MARKED} AS text, {STYLE}, NULL AS table_idx, NULL AS n_cols
              FROM blocks WHERE type = 'text'
            UNION ALL BY NAME SELECT doc_id, page_idx, seq, i::INT AS part, CASE WHEN i = 1 THEN 'table'
              ELSE 'spacer' END AS kind, CASE WHEN i <> 1 THEN 3 END AS height_mm, table_idx, n_cols
              FROM blocks, range(3) t(i) WHERE type = 'table'
            UNION ALL BY NAME SELECT doc_id, page_idx, -1 AS seq, 0 AS part, 'page_break' AS kind
              FROM layout_pages WHERE page_idx > 0
            UNION ALL BY NAME SELECT doc_id, page_idx, 0 AS seq, 0 AS part, 'spacer' AS kind,
              20 AS height_mm FROM layout_pages
              WHERE (doc_id, page_idx) NOT IN (SELECT (doc_id, page_idx) FROM blocks)""",
        "reflow_cells": f"""WITH {PAGES} SELECT doc_id, page_idx, table_idx, row_idx, col_idx,
            CASE WHEN row_idx = 0 THEN 'header' WHEN row_idx % 2 = 1 THEN 'body_a' ELSE 'body_b' END
            AS role, coalesce({mock(strip('cell'))}, '') AS text FROM cells""",
        "reassemble_text": f"""WITH {BLOCKS}, rows AS (SELECT doc_id, page_idx, table_idx, row_idx,
              string_agg(coalesce({mock(strip('cell'))}, ''), chr(9) ORDER BY col_idx) AS text
              FROM cells GROUP BY ALL),
            flow AS (SELECT doc_id, page_idx, seq, 0 AS row_idx, '[MOCK:ne] ' || line AS text FROM blocks
              WHERE type = 'text' UNION ALL SELECT b.doc_id, b.page_idx, seq, r.row_idx, text
              FROM blocks b JOIN rows r ON b.doc_id = r.doc_id AND b.page_idx = r.page_idx
              AND b.table_idx = r.table_idx WHERE type = 'table'),
            numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx
              ORDER BY seq, row_idx) - 1 AS n FROM flow)
            SELECT doc_id, page_idx, CAST(n // 8 AS INT) AS part,
              string_agg(text, chr(10) ORDER BY n) AS text FROM numbered GROUP BY ALL""",
        "list_files": f"""WITH {FILES} SELECT path, name, suffix, CASE suffix WHEN '.csv' THEN 'text/csv'
            WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN
            'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS mime
            FROM files""",
        "size_guard": f"""WITH {FILES} SELECT path, CASE WHEN suffix IS NULL THEN 'unknown suffix'
            WHEN length > 1048576 THEN 'too large' ELSE 'accepted' END AS reason FROM files""",
        "output_name": f"""WITH {FILES} SELECT name, CASE WHEN contains(name, suffix)
            THEN left(name, length(name) - length(suffix)) ELSE name END || '_translated_ne' || suffix
            AS output_name FROM files WHERE suffix IS NOT NULL""",
        "preview": f"""WITH {CONV} SELECT conv_id, turn, line_idx, line, CAST(row_number() OVER (
            PARTITION BY conv_id ORDER BY turn, line_idx) AS INT) AS n_shown FROM conv
            WHERE {strip('line')} <> '' QUALIFY n_shown <= 6""",
        "preview_lines": f"""WITH {LINES} SELECT doc_id, line_idx, line, CAST(row_number() OVER (
            PARTITION BY doc_id ORDER BY line_idx) AS INT) AS n_shown FROM lines
            WHERE {strip('line')} <> '' QUALIFY n_shown <= 8""",
        "preview_rows": """SELECT p_partkey % 50 AS file, p_partkey, p_name, p_type, CAST(row_number() OVER (
            PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS INT) AS n_shown FROM part QUALIFY n_shown <= 5""",
        "preview_translated": f"""WITH {LINES}, {CONV} SELECT 'csv' AS kind, p_partkey % 50 AS id, CAST(row_number() OVER (
              PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS INT) AS n_shown,
              p_partkey || ' | ' || {mock('p_name')} || ' | ' || {mock('p_type')} AS line FROM part QUALIFY n_shown <= 4
            UNION ALL SELECT 'docx', conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_idx) AS INT)
              AS n_shown, {mock('line')} FROM conv WHERE {strip('line')} <> '' QUALIFY n_shown <= 6
            UNION ALL SELECT 'pdf', doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS INT) AS n_shown,
              {mock('line')} FROM lines WHERE {strip('line')} <> '' QUALIFY n_shown <= 6""",
        "stream_metrics": f"""SELECT 2 * count(*) AS cells, count(*) FILTER (event_type IS NULL) + count(*) FILTER (props IS NULL)
              AS missing, count(*) FILTER ({strip('event_type')} = '') + count(*) FILTER ({strip('props')} = '') AS blank,
              count(*) FILTER ({strip('event_type')} <> '') + count(*) FILTER ({strip('props')} <> '') AS texts,
              TRUE AS distinct_texts_are_near FROM events""",
        "sentence_segments": f"""WITH {SENTENCES} SELECT conv_id, turn, CAST(i AS INT) AS sentence_idx,
            sentence, separator FROM sentences""",
        "sentence_failures": f"""WITH {SENTENCES}, texts AS (SELECT DISTINCT text FROM conversations
              WHERE {strip('text')} <> ''),
            parts AS (SELECT DISTINCT c.text, s.sentence, length(s.sentence) % 5 AS rule FROM sentences s
              JOIN conversations c ON s.conv_id = c.conv_id AND s.turn = c.turn WHERE {strip('s.sentence')} <> ''),
            firsts AS (SELECT c.text, s.i, length(s.sentence) % 5 AS rule FROM sentences s
              JOIN conversations c ON s.conv_id = c.conv_id AND s.turn = c.turn WHERE {strip('s.sentence')} <> '')
            SELECT text AS segment, coalesce((SELECT CASE arg_min(rule, i) WHEN 3 THEN 'failed' ELSE 'api_error' END
                FROM firsts f WHERE f.text = t.text AND rule >= 3 HAVING count(*) > 0), 'ok') AS status,
              (SELECT max(CASE rule WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END)
                FROM parts p WHERE p.text = t.text)::INT AS attempts FROM texts t""",
        "translate_by_sentence": f"""SELECT conv_id, turn, CASE WHEN {strip('text')} = '' THEN text ELSE
            '[MOCK:ne] ' || regexp_replace(text, '([.!?।]\\s+)', '\\1[MOCK:ne] ', 'g') END AS text
            FROM conversations""",
        "csv_roundtrip": "SELECT " + ", ".join(
            f"'[MOCK:ne] ' || {c} AS {c}" for c in
            ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + " FROM part",
        "csv_one_column": f"""SELECT CASE WHEN v IN ({NA}) THEN NULL ELSE {mock('v')} END AS v
            FROM (SELECT {missing_name()} AS v FROM customer)""",
        "csv_folder": CSV_FOLDER,
        "csv_order": """SELECT 'f' || (o_orderkey % 5) || '_translated_ne.csv' AS name, '[MOCK:ne] ' || o_orderkey AS cell,
            CAST(row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS INT) AS place FROM orders""",
        "stream_csv": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {mock('event_type')} AS event_type,
            CASE WHEN props IN ({NA}) THEN NULL ELSE props END AS props FROM events""",
        "docx_folder": DOCX_FOLDER,
        "stream_translate": f"""SELECT event_id, {mock('event_type')} AS event_type,
            {mock('props')} AS props FROM events""",
        "stream_memory": """SELECT segment, count(*) AS n FROM (SELECT DISTINCT event_type AS segment
            FROM events UNION SELECT DISTINCT props FROM events) GROUP BY 1""",
    }
