"""Packing, page text, secrets and templates."""

import hashlib
import random
import re
import secrets as entropy
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segtrans.llm import decontaminate, packing, secrets
from segtrans.llm.html_text import main_text
from segtrans.llm.queries import op9_randomness_battery, tokenizer


@pytest.fixture(scope="module")
def tok():
    return packing.Tokenizer(tokenizer()["tokenizer"], tokenizer()["pattern"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t .,!'sdtre1"), st.characters(exclude_categories=["Cs"]))))
def test_word_cache_gives_the_same_ids(tok, text):
    assert tok(text) == tok.encode(text) + tok.end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit(lengths):
    packs = packing.best_fit_decreasing(lengths, 40)
    assert sorted(i for p in packs for i in p) == list(range(len(lengths)))
    rooms = []  # the plain algorithm
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 40) - n)
    assert sorted(40 - sum(lengths[i] for i in p) for p in packs) == sorted(rooms)


def test_packing_round_trip(docs, tok):
    rows = packing.pack_tokens(docs, **tokenizer(), seq_len=256, group_tokens=20_000).collect()
    assert len({(r.matrix, r.row) for r in rows}) == len(rows)
    found = {}
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 256 and (ids[r.n_tokens:] == tok.eos).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == [x for x in r.cu_seqlens if x < 256]
        for i, (doc, offset) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            found.setdefault(doc, []).append((offset, ids[r.cu_seqlens[i]:r.cu_seqlens[i + 1]]))
    for doc in docs.collect():
        ids = np.concatenate([x for _, x in sorted(found.pop(doc.doc_id), key=lambda p: p[0])])
        assert ids[-1] == tok.eos and tok.encoding.decode(ids[:-1].tolist()) == doc.text
    assert not found
    used = sum(r.n_tokens for r in rows) / (256 * len(rows))
    assert used > 0.95


def test_main_text():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><a href=/>Site</a></header>
    <nav><ul><li><a href=a>a</a></ul></nav><div id="cookie-notice">We use cookies</div>
    <main><article><h1>Title &amp; more</h1><p>First   paragraph <a href=x>link</a> goes on.<p><b>Second<br>one
    <script>var x = "</p>";</script><aside>aside</aside><div class="ad banner">buy</div>
    <ul><li>point</li><li>other</li></ul></article>
    <section id=comments><article class=comment><p>I was first</p></article></section></main>
    <form><p>Subscribe</p></form><footer>&copy;</footer>"""
    assert main_text(page) == "Title & more\n\nFirst paragraph link goes on.\n\nSecond one\n\npoint\n\nother"
    body = "<p>{}</p>".format("Long text of the article, sentence after sentence. " * 5)
    page = "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div>" + body * 3 + "</div><p>x</p>"
    assert main_text(page).count("Long text") == 15 and "two" not in main_text(page)
    assert main_text(None) == main_text("") == main_text("<br>") == ""
    assert main_text("just text") == "just text"


@pytest.mark.parametrize("names", ["class='page has-sidebar'", "class='layout with-menu'", "class=no-comments",
                                   "class=share-price", "id=related-work"])
def test_names_do_not_drop_the_wrapper_of_the_article(names):
    body = "<p>" + "Long text of the article, sentence after sentence. " * 5 + "</p>"
    side = "<div class=sidebar><p>Latest posts of this site</p></div><div class=comments><p>I was first</p></div>"
    links = "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li><li><a href=3>Source three</a></li></ul>"
    for inner in (f"<article>{body * 2}{links}</article>", f"<main>{body * 2}{links}</main>", f"<div>{body * 2}</div>"):
        for page in (f"<div {names}>{inner}{side}</div>", f"<p>x</p><div class=wrap><div {names}>{inner}{side}</div></div>",
                     f"<div {names}><div class='with-ads'>{inner}</div>{side}</div>"):
            got = main_text(page)
            assert got.count("Long text") == 10 and "first" not in got and "Latest" not in got
            assert ("Source two" in got) == ("<ul>" in inner)


def naive_base(text):
    patterns = (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )
    found = []
    for place, (kind, pattern, group, least) in enumerate(patterns):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def test_secrets_against_plain_patterns(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op9_randomness_battery(spark, sf).collect():
        base = naive_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_assign == base.count("assign:") and r.n_hex == base.count("hex:")


@pytest.mark.parametrize("text", [
    "secret: token:abcdefgh", "paſsword=abcdefgh", "TOKEN = 'ab.cd=ef' passwd:1234567", "AKIAAKIA" + "A" * 13,
    "api_key='x' apikey:\"longer-one\"", "0" * 23 + " " + "f" * 24 + "g" + "0a" * 30,
])
def test_base_spans(text):
    got = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(text))
    assert got == naive_base(text)


def test_randomness_battery(spark):
    rng = random.Random(3)
    words = ["internationalisation", "getElementsByTagName", "some_long_function_name", "aaaaaaaaaaaaaaaaaaaaaaaa",
             "abcdefghijklmnopqrstuvwxyz0123456789", "antidisestablishmentarianism", "path/to/some/source/file"]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(40)]
    rows = [(i, f"the value {k} is here") for i, k in enumerate(keys)]
    rows += [(100 + i, f"see {w} there") for i, w in enumerate(words * 20)]
    got = {r.doc_id: r.added for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [i for i in range(40) if got[i]]
    assert len(caught) >= 38 and all((got[i][0].start, got[i][0].end) == (10, 50) for i in caught)
    assert not any(got[i] for i in got if i >= 100)
    assert sum(secrets.looks_random(entropy.token_urlsafe(40)) for _ in range(300)) > 285


QUESTION = "A farmer sells 12 apples for 3.50 dollars and then buys 12 pears from his friend Marta in the old town market"


def test_templates(spark):
    bench = spark.createDataFrame([(7, QUESTION), (7, QUESTION), (8, "four words make it")], "item_id long, text string")
    clean = "A farmer sells some fruit for money and then goes home to his family in the old town by the river"
    rows = [
        (1, "Intro text. " + QUESTION + ". And the rest."), (2, QUESTION.replace("12", "57").replace("Marta", "Jonas")),
        (3, QUESTION.replace("12 apples", "57 apples").replace("3.50", "9")),  # one value, two meanings
        (4, clean), (5, None), (6, QUESTION.upper()), (7, "and four words make it, too"), (None, QUESTION),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 7), (7, 8), (None, 7)}  # capitals do not hide it
    assert not got[1, 7].changed and got[2, 7].changed
    assert (got[1, 7].first_word, got[1, 7].last_word) == (2, 24) and got[1, 7].n_windows == got[1, 7].item_windows
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert kept == {3, 4, 5}


def test_first_words_are_met_within_a_sentence(spark):
    river = "Which river flows through the city of Paris and Rouen?"
    short = "Name the river of Rouen"
    bench = spark.createDataFrame([(1, river), (2, short), (3, "Rivers of France")], "item_id long, text string")
    rows = [(n, lead + text) for n, (lead, text) in enumerate(
        [(lead, text) for text in (river, short) for lead in ("", "Intro text. ", "Question 5\n", "He asked ")])]
    rows += [(10, "He asked " + river.replace("Paris", "Lyon")), (11, "the rivers of France, again"),
             (12, "the rivers of Spain"), (13, "Three rivers of Francesca")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {*((n, 1) for n in range(4)), *((n, 2) for n in range(4, 8)), (10, 1), (11, 3)}
    assert got[10, 1].changed and not got[3, 1].changed and got[3, 1].n_windows == got[3, 1].item_windows == 3


def test_items_of_mostly_placeholders_are_met_as_they_stand(spark):
    item = "Add 12 34 56 78 90 and 11 13 15 17."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (2, "Please: " + item + " Thanks."), (3, item.replace("34", "35").replace("13", "14"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1].n_windows == got[1].item_windows == 4 and not got[1].changed


def test_every_verbatim_leak_is_found(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text.split() for r in bench.collect()}
    runs = {}
    for item, w in items.items():
        for i in range(len(w) - 12):
            runs.setdefault(tuple(w[i:i + 13]), set()).add(item)
    want = set()
    for r in docs.collect():
        w = r.text.split()
        want |= {(r.doc_id, item) for i in range(len(w) - 12) for item in runs.get(tuple(w[i:i + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= got
    assert not decontaminate.leaks(docs.where("doc_id < 0"), bench).collect()


def test_words_as_they_stand_count_where_values_conflict(spark):
    """One value that does not fit leaves the windows without values, and only those."""
    from segtrans.llm.decontaminate import leaks, without_leaks

    plain = " ".join(f"w{c}{d}" for c in "abcde" for d in "fghi")
    item = f"{plain} sold 12 apples and kept 12 pears for all of us at home"
    benchmark = spark.createDataFrame([(1, item), (2, "sold 12 apples and kept 12 pears, so 12 of them were left, and 12 went away")],
                                      "item_id long, text string")
    docs = spark.createDataFrame([
        (1, item.replace("12 apples", "57 apples")), (2, item.replace("12", "57")), (3, item), (4, plain), (5, plain.split(" ", 10)[-1]),
        (6, "sold 57 apples and kept 12 pears, so 12 of them were left, and 13 went away"),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.changed) for r in leaks(docs, benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert got[2, 1] == (got[3, 1][0], True) and not got[3, 1][1] and not got[4, 1][1]
    assert got[4, 1][0] == 13 and 13 <= got[1, 1][0] < got[3, 1][0] and got[1, 1][1]
    assert {r.doc_id for r in without_leaks(docs, benchmark).collect()} == {5, 6}


def test_hidden_is_an_attribute_not_a_word():
    from segtrans.llm.html_text import main_text

    page = ('<article><p title="a hidden gem">kept words here</p><p hidden>no</p><p class="x" hidden="">no</p>'
            '<p data-note=\'hidden\' >kept, too</p><p Hidden class=y>no</p></article>')
    assert main_text(page) == "kept words here\n\nkept, too"


@pytest.mark.parametrize("piece", ["<a ", "<!", "<!--", "x<", "</", "<a b='"])
def test_a_megabyte_of_broken_tags_is_read_at_once(piece):
    import time

    from segtrans.llm.html_text import main_text

    start = time.monotonic()
    for page in (piece * (10**6 // len(piece)), piece * (10**6 // len(piece)) + ">"):
        main_text(page)
    assert time.monotonic() - start < 20
