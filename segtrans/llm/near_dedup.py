"""Near duplicates by MinHash with banding, signature verification and connected components.

1. One scan gives each text its signature: the minima of many universal hash
   functions over its set of word shingles. Equal sets become one class.
2. Bands of the signature are bucket keys. In a bucket every class is paired with
   the bucket's centre only, the class met most often over all its buckets, so a
   group of any size makes a star, not all pairs.
3. Pairs whose signatures agree enough are confirmed on their full sets.
4. Components come from alternating large-star and small-star steps.
5. Where buckets still hold several components, a link may have missed every
   centre. Classes that such buckets join form clusters; the members outside a
   cluster's largest component are compared with all of it, in blocks of rows:
   signatures first, as matrices, then full sets. Only links come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .word_hashes import WordHashes, mixed, runs

BANDS, ROWS = 40, 6  # a pair of similarity 0.8 shares no band with probability 5e-6
SLACK = 0.15  # a signature may fall short of the threshold by so much: six standard deviations
SMALL = 250_000  # ids that may be broadcast
_RNG = np.random.default_rng(20240607)
FACTORS = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
CHUNK = 1024


def shingles(text: str, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters, ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(cache.of(words), min(k, len(words))))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(x), CHUNK):
        values = np.multiply.outer(FACTORS, x[at:at + CHUNK])
        values += SHIFTS[:, None]
        part = values.min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of minima."""
    parts = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, minis binary"


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, sums, least = [], [], []
                for text in batch.column("text"):
                    found = shingles(text.as_py() or "", k, cache)
                    n.append(len(found))
                    one, two = mixed(found).sum(dtype=np.uint64), mixed(~found).sum(dtype=np.uint64)
                    sums.append((one, two))
                    least.append(minima(found) if len(found) else np.zeros(BANDS * ROWS, np.uint32))
                least = np.array(least).reshape(-1, BANDS * ROWS)
                keys = band_keys(least).astype(np.int64)
                sums = np.array(sums, np.uint64).reshape(-1, 2).astype(np.int64)
                n = np.array(n, np.int64)
                # An empty set has no bands: it meets nothing.
                offsets = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                small = (least & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel())),
                     pa.array([row.tobytes() for row in small], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "minis"])

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py() or "", k, cache).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    return sets


def _agreement(threshold: int) -> int:
    """How many minima of a pair near the threshold agree at least."""
    low = threshold / 100 - SLACK
    return math.ceil(BANDS * ROWS * (low + (1 - low) / 256))  # minima are kept to a byte


def _agreeing(threshold: int):
    needed = _agreement(threshold)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                    for c in ("minis_a", "minis_b"))
            good = pa.array((a == b).sum(axis=1) >= needed)
            yield batch.select(["a", "b"]).filter(good)

    return agree


def _confirmed(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= threshold * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is among ``ids``: broadcast if these are few by count, else shuffled."""
    few = ids.count() <= SMALL
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` that agree in signature and then on their full sets."""
    minis = signed.select("id", "minis")
    likely = written(
        pairs.join(minis.select(F.col("id").alias("a"), F.col("minis").alias("minis_a")), "a")
        .join(minis.select(F.col("id").alias("b"), F.col("minis").alias("minis_b")), "b")
        .select("a", "b", "minis_a", "minis_b").mapInArrow(_agreeing(threshold), "a long, b long"),
        "near-likely")
    ids = written(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "near-ids")
    texts = _semi(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id")
    sets = written(texts.mapInArrow(_setter(k), "id long, shingles binary"), "near-sets")
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return written(
        likely.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        .mapInArrow(_confirmed(threshold), "a long, b long"), "near-links")


BLOCK = 256  # classes to a block, about
BLOCKED = "cluster long, i int, j int, outside boolean, id long, c long, minis binary, shingles binary"


def _compared(threshold: int):
    """Links between the two sides of each block pair, of rows sorted by pair."""
    needed = _agreement(threshold)
    key = ("cluster", "i", "j")

    def links(rows: list[dict]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        minis = np.frombuffer(b"".join(r["minis"] for r in rows), np.uint8).reshape(-1, BANDS * ROWS)
        ids, comps = (np.array([r[c] for r in rows], np.int64) for c in ("id", "c"))
        sizes = np.array([len(s) for s in sets])
        all_of = np.flatnonzero([not r["outside"] for r in rows])
        for x in np.flatnonzero([r["outside"] for r in rows]):
            near = all_of[(comps[all_of] != comps[x])
                          & (100 * np.minimum(sizes[all_of], sizes[x]) >= threshold * np.maximum(sizes[all_of], sizes[x]))]
            near = near[(minis[near] == minis[x]).sum(axis=1) >= needed]
            for y in near:
                common = int(np.isin(sets[x], sets[y], assume_unique=True).sum())
                if 100 * common >= threshold * (sizes[x] + sizes[y] - common):
                    yield int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def found() -> pa.RecordBatch:
            pairs = list(links(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in key):
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    return compare


def links_between(open_rows: DataFrame, signed: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links between the components ``c`` of ``open_rows(bucket, id, c)`` that share buckets.

    Clusters are what shared buckets connect. With m of a cluster's n members
    outside its largest component, m * n / BLOCK rows are sent, twice; a pair of
    blocks is a task's unit, whatever the size of the cluster.
    """
    first = open_rows.groupBy("bucket").agg(F.min("id").alias("b"))
    joined = open_rows.join(first, "bucket").select(F.col("id").alias("a"), "b")
    clusters = components(joined).withColumnRenamed("component", "cluster")
    members = written(open_rows.select("id", "c").distinct().join(clusters, "id"), "clustered")
    sizes = members.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", F.struct("n", "c")).alias("main"))
    blocks = sizes.select(
        "cluster", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("of_all"),
        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("of_outside"))
    texts = _semi(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), members.select("id"), "id")
    sets = texts.mapInArrow(_setter(k), "id long, shingles binary")
    full = written(
        members.join(blocks, "cluster").join(signed.select("id", "minis"), "id").join(sets, "id"), "blocks")
    h = F.xxhash64("id")
    every = full.select(
        "*", F.pmod(h, "of_all").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("of_outside") - 1)).alias("i"),
        F.lit(False).alias("outside"))
    outside = full.where("c != main").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"), F.pmod(h, "of_outside").cast("int").alias("i"),
        F.lit(True).alias("outside"))
    columns = [c.split()[0] for c in BLOCKED.split(", ")]
    rows = outside.select(*columns).union(every.select(*columns))
    return written(
        rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_compared(threshold), "a long, b long"), "near-missed").distinct()


def _unchanged(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``: the least id it is connected to.

    Large-star hangs the larger neighbours of each node on its least one,
    small-star the smaller ones, in turn until the edges form stars. Each round
    is written, so no lineage grows.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "star")
    state = _unchanged(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.where("u > v").distinct(), "small-star")
        before, state = state, _unchanged(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Texts are linked whose k-word shingle sets have a Jaccard similarity of at
    least ``threshold`` percent, letters A-Z in lower case. ``component_id`` is
    the least ``doc_id`` reachable. A null or empty text, or one without words,
    has an empty set and is linked with nothing. A row with a null ``doc_id``
    stands alone, with a null component, and is kept. Ids name documents: rows
    that repeat id and text get the same result each. An empty table gives none.
    """
    signed = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signer(k), SIGNED), "signed")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["s1", "s2", "n_shingles"]
    classes = written(linkable.groupBy(*key).agg(F.min("doc_id").alias("id")), "classes")
    # One row per class: that of its least id.
    distinct = written(
        linkable.join(classes, key).where("doc_id = id").select("id", "bands", "minis").dropDuplicates(["id"]),
        "distinct")
    banded = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(banded.join(shared, "bucket"), "met")
    score = met.groupBy("id").agg(F.sum("n").alias("score"))
    ranked = met.join(score, "id").select("bucket", "id", F.struct(F.col("score"), (-F.col("id")).alias("no")).alias("r"))
    centres = ranked.groupBy("bucket").agg((-F.max("r")["no"]).alias("centre"))
    stars = written(
        met.join(centres, "bucket").where("id != centre").select(*_pair("id", "centre")).distinct(), "stars")
    links = verified(stars, distinct, docs, k, threshold)
    found = written(components(links), "components")

    # Buckets of several components may hold links that no star has had.
    placed = met.select("bucket", "id").join(found, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    open_rows = written(placed.join(mixed_buckets.select("bucket"), "bucket"), "open")
    missed = links_between(open_rows, distinct, docs, k, threshold)
    if not missed.isEmpty():
        found = written(components(links.union(missed)), "components")

    by_class = classes.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    # Sets that nothing else has, and those without words, are their own component.
    return signed.select("doc_id", *key).join(by_class, key, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group, that of the least id; all columns as they are.

    Rows with a null id, and texts without words, all stay.
    """
    dropped = written(
        near_duplicates(docs, k, threshold).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct(),
        "near-dropped")
    few = dropped.count() <= SMALL
    return docs.join(F.broadcast(dropped) if few else dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
