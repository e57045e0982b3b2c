"""The trie of conversation prefixes against a plain version, and its parentheses."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from segtrans.llm import prefix_trie as trie
from segtrans.llm.balanced_parens import BalancedParens

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    return sorted((
        min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in members)


def found(conversations, **options):
    df = trie.prefix_trie(conversations, **options)
    assert tuple(df.columns) == trie.COLUMNS
    return sorted(tuple(r) for r in df.collect())


def talks(seed, n, most, words=3):
    """Conversations that begin alike, many of them equal, few turns or many."""
    rng = random.Random(seed)
    for c in rng.sample(range(n * 3), n):
        steps = rng.randint(0, most) if rng.random() < 0.9 else most * 4
        for turn in range(steps):
            yield c, turn, "ab"[turn % 2], "ü" * rng.randint(0, words if turn else 1)


def test_whole_table(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()])
    assert found(conversations) == want


@pytest.mark.parametrize("seed", range(4))
def test_spines_of_many_shards(spark, seed, monkeypatch):
    """Shards of some tens of turns, with prefixes, groups of copies and long paths across them."""
    monkeypatch.setattr(trie, "PIECE", 2)
    rows = list(talks(seed, 600, (2, 5, 9, 3)[seed], (1, 2, 40, 0)[seed]))
    rows += [(c, t, "a", "the same") for c in range(10_000, 10_300) for t in range(4)]
    random.Random(seed).shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA), turns_per_shard=40) == plain(rows)


def test_shards_of_one_task():
    """Every node is in its shard once, and only the first and last path are spine."""
    rows = [(str(i).zfill(3).encode() * 16, [1] * 3, i) for i in range(300)]
    shard, parts = None, []
    for path, sizes, c in sorted(rows):
        if shard is None or len(shard.size) > 50:
            parts += [shard.parts()] if shard else []
            shard = trie.Shard(len(parts), path, sizes)
        shard.add(path, sizes, c)
    parts.append(shard.parts())
    assert len(parts) > 10 and sum(p.column("depth").to_pylist().count(3) for p in parts) == 300
    for p in parts:
        assert p.column("chain").null_count == p.column("node").null_count == p.num_rows - 7 == p.column("ids").null_count
        assert p.column("ends_sha256").null_count == 7


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (100, None, None, None), (100, None, None, None), (100, 0, "user", ""), (100, 2, "a", "z"),
        (100, 2, "a", "z"), (101, 5, "user", "\U0001f600é"), (102, 1, "user", "x" * 300_000), (199, 0, None, "q"),
        (-5, 0, "u", "minus"), (300, 0, "u", "alone"), (7, 1, "role:", "x"), (7, 2, "role", ":x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    by_truncation = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark.createDataFrame(by_truncation, SCHEMA)) == plain(by_truncation)
    clashing = ("path", "sizes", "step", "base", "node", "chain", "shard", "depth", "n_convs", "pre", "own")
    assert found(df.selectExpr("*", *(f"'x' as {c}" for c in clashing))) == found(df)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_turnless_conversations(spark):
    """Conversations with fewer turns than are replaced, where the first of the hundred is not there."""
    ids = [c for c in range(500, 600) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 0]
    rows = [(c, 0, "u", f"t{c}") for c in ids]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) == [(ids[0], 0, None, len(ids), 0, 1, 0, trie.members_hash(ids))]


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500, 5000])
def test_parentheses(n):
    rng = random.Random(n)
    bits, stack, open_at, close = [1], [0], 1, {}
    while stack:
        if open_at < n and (rng.random() < 0.52 or len(stack) == 1):
            stack.append(len(bits))
            bits.append(1)
            open_at += 1
        else:
            close[stack.pop()] = len(bits)
            bits.append(0)
    bits = np.array(bits, np.uint8)
    tree, opens = BalancedParens(bits), np.flatnonzero(bits)
    assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
    at = np.arange(len(bits))
    leaf = np.r_[(bits[:-1] == 1) & (bits[1:] == 0), False]
    assert (tree.excess(at) == np.cumsum(np.where(bits == 1, 1, -1))).all()
    assert (tree.rank_open(at) == np.cumsum(bits) - bits).all() and (tree.rank_leaf(at) == np.cumsum(leaf) - leaf).all()
