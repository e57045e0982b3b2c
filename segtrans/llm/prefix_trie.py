"""The trie of conversation prefixes, in balanced parentheses by shard.

1. Turns become digests of 128 bits, and each conversation is rebuilt from the
   beginning of the first of its hundred and its own later turns: one shuffle, by
   hundreds. Its path is the string of its digests, so a prefix of turns is a
   prefix of bytes.
2. Conversations are ranged over shards by path and id. A task reads them in
   order, writes its tree as balanced parentheses, and takes subtrees from it:
   ``find_close`` bounds them, the rank of leaf pairs counts leaves, and running
   sums give members and savings.
3. A node can lie in several shards only if it is on the first or last path of
   each: its spine. Spine nodes are merged by the digest of their path. What is
   only known after merging, whether the node is a leaf and what it saves by
   itself, is added to its ancestors along the spine of one shard that has it.

So a first turn or a conversation that a third of all share is spread over as
many shards as its rows need, and only its spine is merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .balanced_parens import BalancedParens
from .common import written

HUNDRED = 100  # conversations that share the beginning of the first of them
HEADS = 6  # the number of shared turns is less
DIGEST = 16  # bytes of a turn in a path
TURNS = 400_000  # of a shard, on average
MOST = 1_000_000  # nodes or conversations after which a task begins another shard
PIECE = 16_384  # ids in a piece of the list of a spine node's members

PARTS = (
    "shard long, pre int, parent_pre int, chain int, node binary, parent_node binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, "
    "ends_sha256 string, ids array<struct<first: long, text: string>>"
)
BOTH, FIRST, LAST = 0, 1, 2  # the paths of its shard that a spine node is on
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(path, sizes, conv_id)``: digests of the turns of each rebuilt conversation, and code points of their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv_id - conv_id % HUNDRED).alias("base"), conv_id.alias("conv_id"),
        F.struct(
            "turn", role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            F.length(text).cast("long").alias("size"),
        ).alias("step"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("step")).alias("own"))
    beginning = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))
    shared = F.coalesce(F.max(beginning).over(Window.partitionBy("base")), F.slice("own", 1, 0))
    head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    later = F.slice("own", head + 1, F.greatest(F.size("own") - head, F.lit(0)))
    steps = own.withColumn("shared", shared).select(
        "conv_id", F.concat(F.slice("shared", F.lit(1), head), later).alias("steps"))
    return steps.select(
        F.unhex(F.array_join(F.transform("steps", lambda s: s["digest"]), "")).alias("path"),
        F.transform("steps", lambda s: s["size"]).alias("sizes"), "conv_id")


def common_steps(a: bytes, b: bytes) -> int:
    """Digests that two paths begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    at = 0
    while a[at:at + DIGEST] == b[at:at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def members_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


NONE_HASH = members_hash([])


class Shard:
    """The trie of conversations that arrive in order of path and id."""

    def __init__(self, number: int, path: bytes, sizes: list[int]):
        self.number, self.path, self.first_path, self.rows = number, b"", path, 0
        self.bits = bytearray()
        self.parent: list[int] = []
        self.size: list[int] = []
        self.ends: list[int] = []
        self.least: list[int | None] = []  # the smallest member
        self.hashes: list[str | None] = []
        self.open: list[tuple[int, list[int]]] = []  # nodes on the way to the present path, with the ids that end there
        self.kept: dict[int, list[int]] = {}  # ids that end at spine nodes
        self._push(0)
        for size in sizes:
            self._push(size)
        self.path = path

    def _push(self, size: int) -> None:
        self.parent.append(self.open[-1][0] if self.open else -1)
        self.open.append((len(self.size), []))
        self.bits.append(1)
        self.size.append(size)
        self.ends.append(0)
        self.least.append(None)
        self.hashes.append(None)

    def _pop(self, spine: bool) -> None:
        node, ids = self.open.pop()
        self.bits.append(0)
        self.ends[node] = len(ids)
        low = min((x for x in (self.least[node], *ids[:1]) if x is not None), default=None)
        self.least[node] = low
        if self.open and low is not None:
            above = self.open[-1][0]
            self.least[above] = low if self.least[above] is None else min(low, self.least[above])
        if spine or node * DIGEST <= len(self.first_path):  # the first path was opened first
            self.kept[node] = ids
        else:
            self.hashes[node] = members_hash(ids)

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        shared = common_steps(self.path, path)
        while len(self.open) > shared + 1:
            self._pop(False)
        for size in sizes[shared:]:
            self._push(size)
        self.open[-1][1].append(conv_id)
        self.path = path
        self.rows += 1

    def parts(self) -> pa.RecordBatch:
        """All nodes. Of spine nodes: what this shard has of them, without the nodes of the spine themselves."""
        n = len(self.size)
        last = [node for node, _ in self.open]
        while self.open:
            self._pop(True)
        steps = len(self.first_path) // DIGEST
        on_first = np.arange(n) <= steps
        on_last = np.zeros(n, bool)
        on_last[last] = True
        spine = on_first | on_last
        bits = np.frombuffer(bytes(self.bits), np.uint8)
        tree, pre = BalancedParens(bits), np.arange(n)
        opens = np.flatnonzero(bits)
        close = tree.find_close(opens)
        end = tree.rank_open(close)  # the preorder number behind the subtree

        def below(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[end] - sums[pre]

        size, parent = np.array(self.size, np.int64), np.array(self.parent, np.int64)
        n_convs = below(np.array(self.ends, np.int64))
        leaves = tree.rank_leaf(close) - tree.rank_leaf(opens) - below(spine & (end == pre + 1))
        saved = below(np.where(spine, 0, (n_convs - 1) * size))
        children = np.bincount(parent[1:][~spine[1:]], minlength=n)
        depth = tree.excess(opens) - 1
        least = np.array(self.least, np.int64)
        nodes: list[bytes | None] = [None] * n
        above: list[bytes | None] = [None] * n
        for path, way in ((self.first_path, range(steps + 1)), (self.path, last)):
            digest = hashlib.md5()
            for at, node in enumerate(way):
                digest.update(path[(at - 1) * DIGEST:at * DIGEST] if at else b"")
                nodes[node] = digest.copy().digest()
                above[node] = nodes[parent[node]] if at else None
        ids = [None] * n
        for node, found in self.kept.items():
            ids[node] = [{"first": found[at], "text": ",".join(map(str, found[at:at + PIECE]))}
                         for at in range(0, len(found), PIECE)]
        chain = np.where(on_first & on_last, BOTH, np.where(on_first, FIRST, LAST))
        inner = (parent >= 0) & ~spine[parent]  # its parent is no spine node, so it is complete here
        number = pa.array(np.full(n, self.number))
        columns = [
            number, pa.array(pre, pa.int32()), pa.array(parent, pa.int32(), mask=inner), pa.array(chain, pa.int32(), mask=~spine),
            pa.array(nodes, pa.binary()), pa.array(above, pa.binary()), pa.array(depth), pa.array(least),
            pa.array(least[parent], mask=~inner), pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved),
            pa.array(size), pa.array(self.hashes, pa.string()),
            pa.array(ids, pa.list_(pa.struct([("first", pa.int64()), ("text", pa.string())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PARTS.split(", ")[:15]] + ["ids"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, begun = None, 0
    first = TaskContext.get().partitionId() << 20
    for batch in batches:
        for path, sizes, conv_id in zip(*(batch.column(c) for c in ("path", "sizes", "conv_id"))):
            path, sizes, conv_id = path.as_py(), sizes.as_py(), conv_id.as_py()
            if shard is not None and (len(shard.size) >= MOST or shard.rows >= MOST):
                yield shard.parts()
                shard = None
            if shard is None:
                shard = Shard(first + begun, path, sizes)
                begun += 1
            shard.add(path, sizes, conv_id)
    if shard is not None:
        yield shard.parts()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece at a time."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        found: list[tuple[bytes, str]] = []
        for key, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
            if key != node:
                if node is not None:
                    found.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        nodes, hashes = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def merged_spines(spine: DataFrame) -> DataFrame:
    """The spine nodes, each whole: ``(node, parent_node)`` and the columns of the result but the parent's id."""
    whole = spine.groupBy("node").agg(
        F.max("parent_node").alias("parent_node"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("size").alias("size"), F.min("shard").alias("shard"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    children = whole.groupBy(F.col("parent_node").alias("node")).agg(F.count(F.lit(1)).alias("n_spine"))
    whole = written(
        whole.join(children, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_spine", F.lit(0)))
        .withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "save": (F.col("n_convs") - 1) * F.col("size")}),
        "spines")
    # What a node is by itself goes to itself and its ancestors, along the paths of the first shard that has it.
    own = spine.select("shard", "pre", "chain", "node").join(whole.select("node", "shard", "leaf", "save"), ["node", "shard"], "left")
    onward = Window.partitionBy("shard").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = F.when(F.col("chain") == LAST, 1).otherwise(0)

    def below(c: str):
        value = F.coalesce(F.col(c), F.lit(0))
        other = F.sum(value * beside).over(Window.partitionBy("shard"))  # nodes of the last path only are not below those of the first only
        return F.sum(value).over(onward) - F.when(F.col("chain") == FIRST, other).otherwise(0)

    added = own.select("node", below("leaf").alias("more_leaves"), below("save").alias("more_saved"))
    added = added.groupBy("node").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    pieces = spine.select("node", F.inline("ids")).repartition("node").sortWithinPartitions("node", "first").select("node", "text")
    hashes = pieces.mapInArrow(_hash, "node binary, ends_sha256 string")
    return written(
        whole.join(added, "node").join(hashes, "node", "left").select(
            "node", "parent_node", "conv_id", "depth", "n_convs", "n_children",
            (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
            (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NONE_HASH)).alias("ends_sha256")),
        "spines")


def prefix_trie(conversations: DataFrame, turns_per_shard: int = TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Turns are ordered by ``turn``, null first; of equal ones by role, then by the
    digest of role and text. A null role or text is empty. Rows without a
    ``conv_id`` belong to no conversation. Repeated rows are turns of their own.
    A conversation is one row of 24 bytes a turn while it is rebuilt and met.
    The smallest member and the depth tell nodes apart. An empty table has no
    members and gives no rows.
    """
    spark = conversations.sparkSession
    convs = written(rebuilt(conversations), "conversations")
    rows, turns = convs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("sizes").cast("long")), F.lit(0))).first()
    shards = max(-(-turns // turns_per_shard), min(2 * spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    ordered = convs.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = written(ordered.mapInArrow(_build, PARTS), "trie")
    spine = parts.where("chain is not null")
    whole = merged_spines(spine)
    parents = whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"))
    local = parts.where("chain is null")
    above = spine.select("shard", F.col("pre").alias("parent_pre"), F.col("node").alias("parent_node")).join(parents, "parent_node")
    below_spine = local.where("parent_pre is not null").drop("parent_conv_id", "parent_node").join(
        above.drop("parent_node"), ["shard", "parent_pre"])
    return (
        local.where("parent_pre is null").select(*COLUMNS)
        .union(below_spine.select(*COLUMNS))
        .union(whole.join(parents, "parent_node", "left").select(*COLUMNS))
    )
