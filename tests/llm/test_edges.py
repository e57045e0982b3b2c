"""Every operator on odd rows, on clashing columns, on an empty table."""

import pytest

from segtrans.llm import (
    decontaminate, html_text, mixing, near_dedup, ngram_trie, packing, passages, quality, secrets, sharding,
)
from segtrans.llm.queries import tokenizer


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def operators(labels, benchmark):
    return {
        "packing": lambda d: packing.pack_tokens(d, **tokenizer(), seq_len=128),
        "leaks": lambda d: decontaminate.leaks(d, benchmark),
        "without_leaks": lambda d: decontaminate.without_leaks(d, benchmark).select("doc_id", "text"),
        "sharding": lambda d: sharding.histogram_sort(d, 4),
        "quality": lambda d: quality.judge(d, labels).drop("doc"),
        "trie": lambda d: ngram_trie.score_texts(d),
        "mixing": lambda d: mixing.mix(d, block=4),
        "mixed": lambda d: mixing.mixed_documents(d, block=4).select("doc_id", "text", "n_chars"),
        "near": lambda d: near_dedup.near_duplicates(d),
        "without_near": lambda d: near_dedup.without_near_duplicates(d).select("doc_id", "text"),
        "secrets": lambda d: secrets.find_secrets(d),
        "passages": lambda d: passages.repeated_passages(d),
    }


NAMES = ("packing", "leaks", "without_leaks", "sharding", "quality", "trie", "mixing", "mixed", "near", "without_near",
         "secrets", "passages")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(operators, odd, crowded, none, name):
    operator = operators[name]
    got = operator(odd.coalesce(1))
    assert got.schema == operator(none).schema
    assert operator(none).count() == 0
    rows = rows_of(got)
    if name in ("sharding", "quality", "trie", "mixing", "near", "secrets"):
        assert len(rows) == 13
    assert rows_of(operator(crowded.coalesce(1))) == rows


def test_pages(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>x"), (2, "u", "<p>x"), (3, "u", "<" * 1000), (4, "u", "a" * 10**6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.text[:9], r.n_chars) for r in html_text.extract_pages(pages.selectExpr("*", "1 as text")).collect()}
    assert got == {(1, "", 0), (None, "", 0), (2, "x", 1), (3, "<" * 9, 1000), (4, "a" * 9, 10**6)}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_what_the_odd_rows_give(odd, labels):
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert near[(1, 76)] == (1, True) and near[(2, 76)] == (1, False) and near[(8, 77)] == (1, False)
    assert near[(None, 76)] == (None, True) and near[(None, 0)] == (None, True) and near[(4, 0)] == (4, True)
    judged = {r.doc.doc_id: r for r in quality.judge(odd, labels).collect() if r.doc.doc_id is not None}
    assert judged[3].n_words == 0 and judged[3].score is None and not judged[3].kept
    assert judged[1].n_words == 80 and judged[1].kept and judged[6].base_failed
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in passages.repeated_passages(odd).collect()}
    assert spans == {1: [(0, 80)], 2: [(0, 80)], None: [(0, 80)], 8: [(0, 80)]}
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in sharding.histogram_sort(odd, 4).collect()}
    assert (3, 1, 0) in sizes and (4, 1, 0) in sizes and (None, 1, 0) in sizes
