"""Secrets: fixed patterns, and a battery of randomness tests for what they miss.

Long tokens are taken for their smallest encoding. A token is reported if three
tests find it consistent with uniform random characters of that encoding
(chi-squared uniformity, runs about the median, serial correlation) and its
mixing of character classes is a discovery against ordinary text, at a
false-discovery rate held over the whole corpus within each length stratum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among those of [0-9a-f]+
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST = {"assign": 6, "access": 20}
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the smallest alphabet up; a token is of the first that holds it.
ENCODINGS = (
    DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", LOWER + "234567",
    DIGITS + LOWER, DIGITS + UPPER, DIGITS + UPPER + LOWER,
    UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_",
)
ALPHABETS = [frozenset(e) for e in ENCODINGS]
RANKS = [{c: i for i, c in enumerate(e)} for e in ENCODINGS]
SWITCH = 0.06  # how often neighbours in a text token differ in class (lower, upper, digit, sign)
ALPHA = 0.001  # a random token fails one of the tests this often, times three
FDR = 0.01
STRATUM = 8  # characters to a length stratum
STEPS = 4  # histogram bins to a power of ten of the p-value
BINS = 41  # up to 1e-10; smaller p-values share the last bin


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared > x), by the Wilson-Hilferty cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _char_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def looks_random(token: str) -> bool:
    """All three tests accept uniform random characters of the token's encoding."""
    chars = frozenset(token)
    code = next((i for i, a in enumerate(ALPHABETS) if chars <= a), None)
    if code is None:
        return False
    size, n = len(ENCODINGS[code]), len(token)
    at = np.fromiter(map(RANKS[code].__getitem__, token), dtype=np.float64, count=n)
    # Uniformity over as many equal cells as leave five expected in each, and over the classes.
    cells = max(2, min(size, n // 5))
    expected = np.bincount(np.arange(size) * cells // size, minlength=cells) * (n / size)
    seen = np.bincount((at * cells // size).astype(int), minlength=cells)
    if _chi2_tail(float(((seen - expected) ** 2 / expected).sum()), cells - 1) < ALPHA:
        return False
    classes = [sum(_char_class(c) == k for c in ENCODINGS[code]) for k in range(4)]
    parts = [(sum(_char_class(c) == k for c in token), n * m / size) for k, m in enumerate(classes) if m]
    if len(parts) > 1 and _chi2_tail(sum((o - e) ** 2 / e for o, e in parts), len(parts) - 1) < ALPHA:
        return False
    above = at >= size / 2
    high = int(above.sum())
    low = n - high
    if not high or not low:
        return False
    runs, mean = 1 + int((above[1:] != above[:-1]).sum()), 1 + 2 * high * low / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    if _two_sided((runs - mean) / spread) < ALPHA:
        return False
    centred = at - at.mean()
    around = float((centred * centred).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / around if around else 1.0
    return _two_sided((serial + 1 / n) * math.sqrt(n)) >= ALPHA


def text_bin(token: str) -> int:
    """Binned p-value of the token's class switches if it were ordinary text: binomial upper tail.

    From a capital to a lower-case letter is no switch: so words begin.
    """
    kinds = [_char_class(c) for c in token]
    n = len(kinds) - 1
    k = sum(a != b and (a, b) != (1, 0) for a, b in zip(kinds, kinds[1:]))
    log_q, log_p = math.log(SWITCH), math.log1p(-SWITCH)
    whole = math.lgamma(n + 1)
    tail = sum(
        math.exp(whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_q + (n - i) * log_p)
        for i in range(k, n + 1))
    return min(BINS - 1, int(-math.log10(min(1.0, max(tail, 1e-300))) * STEPS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted; kind as a number of KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """``(start, end, stratum, bin)`` of the long tokens that touch no base span; bin 0 if not random."""
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, _, e in base):
            continue
        token = m.group().rstrip("=")
        stratum = min(len(token), 512) // STRATUM
        p = text_bin(token) if not token.isalpha() or not (token.islower() or token[1:].islower()) else 0
        yield start, end, stratum, p if p and looks_random(token) else 0


FOUND = ("doc_id long, base array<struct<start:int,kind:int,end:int>>, "
         "more array<struct<start:int,end:int,stratum:int,bin:int>>, tests map<int,int>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_t = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    more_t = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "stratum", "bin")]))
    for batch in batches:
        out_base, out_more, out_tests = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            tests: dict[int, int] = {}
            more = []
            for start, end, stratum, p in candidates(text, base):
                tests[stratum] = tests.get(stratum, 0) + 1
                if p:
                    more.append({"start": start, "end": end, "stratum": stratum, "bin": p})
            out_base.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            out_more.append(more)
            out_tests.append(list(tests.items()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out_base, base_t), pa.array(out_more, more_t),
             pa.array(out_tests, pa.map_(pa.int32(), pa.int32()))],
            ["doc_id", "base", "more", "tests"])


def discovery_bins(found: DataFrame, fdr: float) -> dict[int, int]:
    """Least bin that counts as a discovery, by length stratum (Benjamini-Hochberg over the corpus).

    What comes to the driver is bounded by strata times bins.
    """
    tests = dict(
        found.select(F.explode("tests").alias("stratum", "n")).groupBy("stratum").agg(F.sum("n")).collect())
    hits: dict[int, dict[int, int]] = {}
    for row in (found.select(F.explode("more").alias("m")).groupBy("m.stratum", "m.bin").count().collect()):
        hits.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    least = {}
    for stratum, by_bin in hits.items():
        reached = 0
        for b in sorted(by_bin, reverse=True):
            reached += by_bin[b]
            if 10 ** (-b / STEPS) * tests[stratum] <= fdr * reached:
                least[stratum] = b
    return least


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``(doc_id, base, added)`` of every row of ``docs(doc_id, text)``, spans in code points.

    ``base`` and ``added`` are arrays of ``(start, kind, end)``, sorted; kind is a
    place in ``KINDS``. A null or empty text has none. Added spans touch no base
    span and no other. Repeated rows give equal rows; an empty table none.
    """
    found = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, FOUND), "secrets")
    least = discovery_bins(found, fdr)
    if least:
        bound = F.create_map(*(F.lit(x) for pair in sorted(least.items()) for x in pair))
        more = F.filter("more", lambda m: m["bin"] >= F.coalesce(F.element_at(bound, m["stratum"]), F.lit(BINS)))
    else:
        more = F.filter("more", lambda m: F.lit(False))
    added = F.transform(more, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), m["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
