"""Sharding, quality, mixing, model, near duplicates, passages and the pipeline against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from segtrans.llm import mixing, near_dedup, ngram_trie, passages, quality, sharding
from segtrans.llm.elias_fano import EliasFano

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_even_and_gapless(docs):
    rows = sharding.histogram_sort(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    by_shard, by_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by_shard[r.shard].append(r)
        by_text[texts[r.doc_id]].add(r.shard)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert set(by_shard) == set(range(16))
    for shard in by_shard.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r.size for r in shard) - total / 16) <= largest + 0.004 * total / 16
    assert all(len(s) <= 2 for s in by_text.values())


def test_a_group_that_fits_stays_in_one_shard(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abc ", k=rng.randint(1, 90)))) for i in range(3000)]
    rows += [(i, "the very same text, over and over") for i in range(3000, 6000)]  # more than any shard holds
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), 8, 0.01).collect()
    sizes, shards = collections.Counter(), collections.defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8
    straddling = [s for s in shards.values() if len(s) > 1]
    assert len(straddling) == 1 and sorted(straddling[0]) == list(range(min(straddling[0]), max(straddling[0]) + 1))


def naive_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("block", [8, 64])
def test_mixture(docs, block):
    rows = mixing.mix(docs, block=block).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert sum(p.n * p.times for p in r.pieces or ()) == r.taken
    want = naive_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
    for source, n in taken.items():
        assert abs(n - want[source]) <= 2 * block
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(5), block=block).collect()))


def test_targets_of_uneven_sources(spark):
    for sizes in ({"a": 1, "b": 100, "c": 1000, None: 3}, {"a": 0, "b": 7}, {"x": 10}, {"a": 5, "b": 5, "c": 0, "d": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(naive_targets(sizes))


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
        assert n < 100 or sum(a.x == b for b, a in enumerate(got)) < n / 10


def test_mixed_documents(docs):
    taken = {r.doc_id: r for r in mixing.mix(docs, block=16).collect()}
    words = {r.doc_id: SPACE.findall(r.text) for r in docs.collect()}
    got = collections.Counter()
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len(SPACE.findall(r.text))
        assert set(SPACE.findall(r.text)) <= set(words[r.doc_id])
    assert got == {k: v.taken for k, v in taken.items() if v.taken}


def naive_quality(rows, good, buckets):
    def h(*ws):
        seed = 42
        for w in ws:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % buckets

    raw, target, grams = collections.Counter(), collections.Counter(), {}
    for r in rows:
        w = SPACE.findall(r.text)
        grams[r.doc_id] = [h(x) for x in w] + [h(a, b) for a, b in zip(w, w[1:])]
        raw.update(grams[r.doc_id])
        if r.doc_id in good:
            target.update(grams[r.doc_id])
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + quality.PRIOR) / (raw[b] * scale + quality.PRIOR)) for b in raw}
    return {d: sum(ratio[b] for b in g) / len(g) if g else None for d, g in grams.items()}


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    rows = docs.collect()
    scores = naive_quality(rows, good, 500)
    got = {r.doc.doc_id: r for r in quality.judge(docs, labels, buckets=500).collect()}
    for r in rows:
        w, g = SPACE.findall(r.text), got[r.doc_id]
        assert g.n_words == len(w) and g.word_chars == sum(map(len, w))
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in r.text)
        lines = [x for x in r.text.split("\n") if SPACE.search(x)]
        assert g.n_dup_lines == len(lines) - len(set(lines))
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert g.n_repeat_words == len(covered)
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert g.score == pytest.approx(scores[r.doc_id], abs=1e-5)
        assert g.kept == (not g.base_failed and g.score >= quality.THRESHOLD)


@pytest.mark.parametrize("size, scarce", [("sf0.001", None), ("sf0.01", None), ("sf0.01", "de"), ("sf0.01", "en")])
def test_quality_keeps_clean_documents_at_every_size(spark, size, scarce):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
    if scarce:
        few = docs.where(f"lang = '{scarce}'").select("doc_id")
        labels = labels.join(few, "doc_id", "left_anti").union(labels.join(few, "doc_id").orderBy("doc_id").limit(3))
    rows = quality.judge(docs, labels, threshold=None).where("not base_failed").collect()
    clean = [r for r in rows if r.n_symbols < 0.02 * len(r.doc.text)]
    lost = [(r.doc.doc_id, r.doc.lang) for r in clean if not r.kept]
    assert len(lost) <= 0.005 * len(clean) and not any(lang == scarce for _, lang in lost), lost
    if size == "sf0.01" and scarce != "en":
        junk = [r for r in rows if r.n_symbols >= 0.02 * len(r.doc.text)]
        assert sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_a_language_without_trusted_documents_is_not_cut_by_smaller_ones():
    fitted = {"a": [(0.01 * (i % 40), -0.5 - 0.01 * (i % 40)) for i in range(1000)], "b": [(-0.2, -0.9)]}
    cuts, others = quality.language_cuts(fitted, {"a": 5000, "b": 20, "c": 9000, "d": 10})
    assert cuts == {"a": 0, "b": pytest.approx(-0.89), "c": -math.inf} and others == pytest.approx(-0.89)


def test_every_trusted_document_counts(spark):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60)), "en" if i % 200 else "fr") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    counts = [quality.ngram_counts(docs, quality.trusted_ids(labels, n), 50) for n in (0, 10_000)]  # by shuffle, by broadcast
    assert counts[0] == counts[1] and counts[0][0] == [sum(x) for x in zip(*counts[0][1].values())]
    fitted = quality.cross_fitted(docs, quality.trusted_ids(labels), *counts[0])
    passed = {(r.doc.doc_id, r.doc.lang) for r in quality.measured(docs, 50).where("not base_failed").collect()}
    found = collections.defaultdict(list)
    for r in fitted.collect():
        found[r.lang].append((r.near, r.far))
    assert {k: len(v) for k, v in found.items()} == collections.Counter(lang for _, lang in passed)
    assert len(found["en"]) > 1000 > quality.ENOUGH > len(found["fr"]) > 0
    sizes = {"en": 1194, "fr": 6, "de": 3}
    cuts, others = quality.table_cuts(fitted, sizes)
    plain, plain_others = quality.language_cuts(found, sizes)
    assert cuts == pytest.approx(plain) and others == pytest.approx(plain_others)


def test_cross_fitted_scores_shuffle_no_ngrams(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{(i * k * k) % 89}" for k in range(60 + i % 7)), "en" if i % 3 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = quality.trusted_ids(docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    raw, good = quality.ngram_counts(docs, ids, 50)
    raw = [r + 3 for r in raw]  # as if there were other documents
    plans, write = [], quality.written
    monkeypatch.setattr(quality, "written", lambda df, label: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    got = sorted((r.lang, r.near, r.far) for r in quality.cross_fitted(docs, ids, raw, good).collect())
    assert plans and not any("Exchange hashpartitioning" in p for p in plans)
    target, size = [sum(x) for x in zip(*good.values())], sum(raw)
    total, want = sum(target), []
    for r in quality.fenced(quality.measured(docs, 50)).where("not base_failed").collect():
        own, lang = collections.Counter(r.grams), good[r.doc.lang]

        def score(less, total_less):
            return sum(n * math.log((target[b] - less[b] + quality.PRIOR) / (raw[b] * (total - total_less) / size + quality.PRIOR))
                       for b, n in own.items()) / len(r.grams)

        want.append((r.doc.lang, score(own, len(r.grams)), score(lang, sum(lang))))
    assert len(got) == len(want) > 40 and {lang for lang, _, _ in got} == {"en", "fr"}
    for g, w in zip(got, sorted(want), strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=1e-9)


def test_documents_out_of_a_join_are_judged(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id")
    assert quality.judge(docs, labels, threshold=None).count() == docs.count() > 0


def test_words_are_hashed_together():
    from segtrans.llm.word_hashes import LONG, split_hashes

    rng = np.random.default_rng(3)
    texts = [b"", b" ", "\x1cé x\x85y\u3000z\0 \0\0 \0".encode(), b"a" * LONG + b" " + b"a" * (LONG + 1) + b"\t" + b"a" * (LONG + 2)]
    texts += [bytes(rng.choice(list(b"ab \n\x0b\x0c\r\t"), n)) for n in range(60)]
    texts += [b" ".join(b"w" * n for n in range(1, 40)), *(b"x" * n + b"y" for n in range(20)), b"z "]
    hashes, n = split_hashes(texts)
    split = [text.split() for text in texts]
    assert n.tolist() == [len(words) for words in split]
    words = [word for some in split for word in some]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    alone = [split_hashes([b"-" * (i % 9) + b" " + word])[0][-1] for i, word in enumerate(words)]
    assert alone == hashes.tolist()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 2000), (3000, 1 << 40), (3000, 1 << 63)):
        near = rng.integers(0, max(1, top >> 20), n // 2, dtype=np.uint64)
        values = np.unique(np.concatenate([rng.integers(0, top, n - n // 2, dtype=np.uint64), near]))
        sequence = EliasFano(EliasFano.encode(values))
        keys = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 50, dtype=np.uint64)]))
        at = np.searchsorted(values, keys)
        there = np.isin(keys, values)
        assert (sequence.find(keys) == np.where(there, at, -1)).all()
        if len(values):
            assert (sequence.successor(keys) == at).all()
            assert (sequence.get(np.arange(len(values))) == values).all()


def test_model(docs):
    got = {r.doc_id: r for r in ngram_trie.score_texts(docs).collect()}
    rows = docs.collect()
    tokens = {r.doc_id: [" begin", *(w.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
                                     for w in SPACE.findall(r.text)), " end"] for r in rows}
    one, two, three = (collections.Counter() for _ in range(3))
    train = [t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    for t in train:
        one.update(t[1:])
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    p = {w: (one[w] + 0.5) / (n + 0.5 * (v + 1)) for t in tokens.values() for w in t}
    one[" begin"] = len(train)
    held = [0.0, 0.0]
    for doc, t in tokens.items():
        g, score = got[doc], 0.0
        assert g.held_out == (zlib.crc32(str(doc).encode()) % 5 == 1) and g.train_tokens == n
        assert g.n_tokens == len(t) - 1 and g.n_known == sum(one[w] > 0 for w in t[1:])
        base = sum(math.log10(p[w]) for w in t[1:])
        assert g.base_score == pytest.approx(base)
        for i in range(1, len(t)):
            q = (two[t[i - 1], t[i]] + ngram_trie.PRIOR2 * p[t[i]]) / (one[t[i - 1]] + ngram_trie.PRIOR2)
            if i > 1:
                q = (three[t[i - 2], t[i - 1], t[i]] + ngram_trie.PRIOR3 * q) / (two[t[i - 2], t[i - 1]] + ngram_trie.PRIOR3)
            score += math.log10(q)
        assert abs(g.score - score) <= 0.021 * len(t)  # half a quantisation step a token
        if g.held_out:
            held[0] += g.score
            held[1] += base
    assert held[0] > held[1]  # better than single words on texts it has not seen


def test_shards_of_the_trie_do_not_change_scores(docs):
    all_rows = docs.selectExpr("doc_id", "text", "false held_out")
    scores = []
    for shard_tokens in (2000, 10**9):
        trie = ngram_trie.train(docs.where("doc_id % 3 < 2"), shard_tokens)
        scores.append({r.doc_id: r.score for r in all_rows.mapInArrow(ngram_trie.scorer(trie), ngram_trie.SCORED).collect()})
    assert scores[0] == scores[1]


def naive_components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < percent * large:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in texts}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    want = naive_components({r.doc_id: r.text for r in docs.collect()}, k, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, k).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_links_that_miss_the_centre(spark):
    """Copies of copies: chains whose ends are unlike, and a large group around one text."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    texts, now = {}, list(base)
    for i in range(40):
        texts[i] = " ".join(now)
        for _ in range(5):
            now[rng.randrange(120)] = word()
    for i in range(100, 250):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(120)] = word()
        texts[i] = " ".join(copy)
    want = {d: c for d, (_, c) in naive_components(texts, 2, 80).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 2).collect()} == want


def test_passages(docs):
    words = {r.doc_id: r.text.encode().split() for r in docs.collect()}
    owners = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            owners[tuple(w[i:i + 50])].add(d)
    want = {}
    for d, w in words.items():
        spans = []
        for i in range(len(w) - 49):
            if len(owners[tuple(w[i:i + 50])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = spans[-1][0], i + 50
                else:
                    spans.append((i, i + 50))
        if spans:
            want[d] = spans
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in passages.repeated_passages(docs).collect()}
    assert want and got == want


def test_pipeline(spark, sf, docs):
    df, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.written(stage(spark, df, sf), "test")
        assert df.dtypes == docs.dtypes
        sizes.append(df.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.run(spark, sf)
    held = {d for r in packed.collect() for d in r.doc_ids}
    assert held == {r.doc_id for r in df.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, sf, odd, none):
    for rows in (odd, none):
        df = rows
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.written(stage(spark, df, sf), "test")
        assert df.count() == 0 or rows is odd
