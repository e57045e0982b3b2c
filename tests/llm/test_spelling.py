"""Spelling variants against a plain version."""

import re
import zlib
from collections import Counter, defaultdict

from segtrans.llm.spelling import spelling_variants


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            number = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if number % 199 == 0:
                at = number % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    holes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for at in range(len(w)):
            holes[w[:at], w[at + 1:]].add(w)
            shorter = w[:at] + w[at + 1:]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for w in counts:
        for at in range(len(w)):
            near[w] |= holes[w[:at], w[at + 1:]] - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best
    found = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return found


def found(docs):
    rows = [tuple(r) for r in spelling_variants(docs).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(docs):
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert found(docs) == want and any(r[1] for r in want)


def test_chains_ties_and_letters(spark):
    """Chains of several forms, equal counts, letters beyond ASCII, and every place an edit can be in."""
    words = {"abcdef": 20_000, "abcdeg": 3500, "abcdhg": 600, "abcihg": 100, "abjihg": 5, "zbcdef": 3500,
             "Ààÿ×÷ß": 150, "ààÿ×÷ß": 6, "abcdefghijklm": 200}
    base = "abcdefghijklm"
    for at in range(len(base) + 1):
        words[base[:at] + "q" + base[at:]] = 5
        if at < len(base):
            words[base[:at] + base[at + 1:]] = 6
            words[base[:at] + "q" + base[at + 1:]] = 7
    rows, text = [], " ".join(f"{w},{w.upper() if w.isascii() else w};" for w in words)
    for i in range(1, 401):
        rows.append((i, " ".join(f"{w}." for w, n in words.items() for _ in range(n // 400 + (i <= n % 400)))))
    rows += [(None, text), (3, None), (4, ""), (4, "short Ābcdef"), (5, "x" * 100_000 + " "), (6, text), (6, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(docs)
    assert got == plain(rows)
    forms = {r[0]: (r[1], r[2]) for r in got}
    assert forms["abjihg"] == ("abcihg", "abcdef") and forms[base[1:]] == (base, base)
    assert forms["ààÿ×÷ß"][0] == "Ààÿ×÷ß"


def test_odd_rows(odd, crowded, none, odd_rows):
    want = plain([(r[0], r[1]) for r in odd_rows])
    assert found(odd) == want == found(crowded)
    assert spelling_variants(none).count() == 0 and spelling_variants(none).schema == spelling_variants(odd).schema
