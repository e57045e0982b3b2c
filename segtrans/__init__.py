"""Bulk translation of text segments on Spark."""

from .functions.langs import LANGUAGES, check_pair, language_pairs, languages
from .operators.backends import Backend, HttpBackend, MockBackend, Result, RetryPolicy
from .operators.layout import Layout
from .operators.memory import RunReport, TranslationFailed, TranslationMemory
from .plans.csv_files import translate_csv_files
from .plans.docx_files import translate_docx_files
from .plans.layout import reassemble_text, reflow_plan, translate_layout
from .plans.runs import translate_runs
from .plans.tables import table_metrics, translate_pairs, translate_table
from .session import get_session, ship_by_value
from .streaming.translate import stream_translate

__all__ = [
    "LANGUAGES", "Backend", "HttpBackend", "Layout", "MockBackend", "Result", "RetryPolicy",
    "RunReport", "TranslationFailed", "TranslationMemory", "check_pair", "get_session", "language_pairs",
    "languages", "reassemble_text", "reflow_plan", "ship_by_value", "stream_translate",
    "table_metrics", "translate_csv_files", "translate_docx_files", "translate_layout",
    "translate_pairs", "translate_runs", "translate_table",
]
