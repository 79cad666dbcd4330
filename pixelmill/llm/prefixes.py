"""The trie of conversation prefixes, by vertical bitmaps.

Conversations are dealt into shards of at most ``SHARD`` of them. A shard indexes which of its conversations have a turn at a
position: (position, turn) to a bitset of conversation numbers. A depth-first walk starts with the set of all; the children of
a node are what is left of its set in the postings of the next position, so a child costs one intersection, its count of conversations
is a popcount, and the conversations that end at the node are those without a next turn. Turns and nodes are named by digests
(a node's from its parent's and its last turn's), so that the same node has one name in all shards, and Spark merges shards by sums and least
ids. Texts never leave the scan's tasks: a digest and a count of words stand for them.

What depends on a whole subtree needs no walk over levels. A node is owned by its smallest member, and a conversation owns a
lower end of its own path; so each conversation sums what it owns from its end upwards, and a node's total is the sum of its members'
values at its depth.

Defined cases: rows without a conversation id belong to none and are left out; null roles and texts are empty; turns
come in order of ``turn``, null first, those with equal ones in order of the SHA-256 of role and text, and rows that repeat are turns of their own;
an empty table gives an empty result (no root); texts of any length are whole; a conversation of over ``LONG`` turns passes through memory in
parts; other columns are not read, so their names cannot clash. A node where very many conversations end has their ids hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

#: Conversations of a shard, and turns of all of them together or of one of them after which a shard is walked.
SHARD, LONG = 4096, 1 << 16
ROOT = b""
#: Prefixes of a family's first conversation are put before the others; a family is so many ids.
FAMILY, HEADS = 20, 4

_NODE = "node binary, parent binary, depth bigint, words bigint, n bigint, least bigint, members array<bigint>, ends array<bigint>"


def _child(node: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(node + turn, digest_size=16).digest()


class _Path:
    """A conversation, or a later part of one: the node it goes on from, its turns and their words."""

    __slots__ = ("conv", "node", "depth", "turns", "words", "ended")

    def __init__(self, conv: int, node: bytes = ROOT, depth: int = 0):
        self.conv, self.node, self.depth, self.ended = conv, node, depth, True
        self.turns: list[bytes] = []
        self.words: list[int] = []


def walk(paths: list[_Path]) -> Iterator[tuple]:
    """The trie of paths that go on from one node: (node, parent, depth, words, n, least, members, ends).

    The first node is part of it only if it is the root, whose members are not listed.
    """
    postings: dict[tuple[int, bytes], int] = {}
    longer: list[int] = []
    for k, path in enumerate(paths):
        for i, turn in enumerate(path.turns):
            postings[i, turn] = postings.get((i, turn), 0) | 1 << k
            if i == len(longer):
                longer.append(0)
            longer[i] |= 1 << k
    convs = np.array([p.conv for p in paths], dtype=np.int64)
    ended = sum(1 << k for k, p in enumerate(paths) if p.ended)
    size = (len(paths) + 7) // 8

    def ids(bits: int) -> np.ndarray:
        if bits & (bits - 1) == 0:
            return convs[bits.bit_length() - 1 : bits.bit_length()] if bits else convs[:0]
        return convs[np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little"))]

    stack = [(paths[0].node, ROOT, 0, (1 << len(paths)) - 1)]
    while stack:
        node, parent, i, bits = stack.pop()
        rest = bits & longer[i] if i < len(longer) else 0
        if i or node == ROOT:
            members, first = ids(bits), (bits & -bits).bit_length() - 1
            yield node, parent, paths[0].depth + i, paths[first].words[i - 1] if i else 0, bits.bit_count(), int(members.min()), members if i else convs[:0], ids(bits & ~rest & ended)
        while rest:
            turn = paths[(rest & -rest).bit_length() - 1].turns[i]
            below = bits & postings[i, turn]
            rest &= ~below
            stack.append((_child(node, turn), node, i + 1, below))


def _batch(nodes: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*nodes, strict=True))
    cells = [pa.array(columns[0], pa.binary()), pa.array([None if d == 0 else p for p, d in zip(columns[1], columns[2], strict=True)], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[2:6])]
    for lists in columns[6:]:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        cells.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))))
    return pa.record_batch(cells, names=["node", "parent", "depth", "words", "n", "least", "members", "ends"])


def _shards(shard: int, long: int):
    """Shards of conversations whose turns come together and in order; a row with a null turn begins each."""

    def walked(paths: list[_Path]) -> Iterator[pa.RecordBatch]:
        nodes, held = [], 0
        for node in walk(paths):
            nodes.append(node)
            held += len(node[6]) + len(node[7]) + 1
            if held >= 1 << 16:
                yield _batch(nodes)
                nodes, held = [], 0
        if nodes:
            yield _batch(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, turns = [], 0
        for batch in batches:
            for conv, turn, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if turn is None:
                    if paths and (len(paths) >= shard or turns >= long or paths[0].depth):
                        yield from walked(paths)
                        paths, turns = [], 0
                    paths.append(_Path(conv))
                    continue
                last = paths[-1]
                if len(last.turns) >= long:  # the rest of a very long one goes on alone from where it is
                    last.ended = False
                    node = last.node
                    for t in last.turns:
                        node = _child(node, t)
                    yield from walked(paths)
                    paths, turns = [_Path(conv, node, last.depth + len(last.turns))], 0
                    last = paths[-1]
                last.turns.append(turn)
                last.words.append(words)
                turns += 1
        if paths:
            yield from walked(paths)

    return run


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, turn, words): every turn's place in its conversation from 0, digest of role and text, and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("at"), digest.alias("turn"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "turn")
    return rows.where("conv IS NOT NULL").select("conv", (F.row_number().over(order) - 1).cast("bigint").alias("place"), "turn", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, part, place, turn, words) of conversations whose first h turns are those of their family's first one, h = crc32(id) % 4.

    Part -1 is a row for each conversation, even one that is left without turns.
    """
    shared = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    family = F.col("conv") - F.expr(f"conv % {FAMILY}")
    convs = turns.groupBy("conv").agg(F.lit(1).alias("one")).select("conv", shared.alias("h"), family.alias("family"))
    heads = turns.where((F.expr(f"conv % {FAMILY}") == 0) & (F.col("place") < HEADS - 1)).select(F.col("conv").alias("family"), "place", "turn", "words")
    lead = convs.where("h > 0").join(heads, "family").where("place < h").select("conv", F.lit(0).alias("part"), "place", "turn", "words")
    own = turns.where(F.col("place") >= shared).select("conv", F.lit(1).alias("part"), "place", "turn", "words")
    begin = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("words"))
    return begin.unionByName(lead).unionByName(own)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, which come in order, node by node; ids are not held."""
    node, digest = None, None
    for batch in batches:
        names, hashes = [], []
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if digest:
                    names.append(node)
                    hashes.append(digest.hexdigest())
                node, digest = own, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def trie(paths: DataFrame, shard: int = SHARD, long: int = LONG) -> DataFrame:
    """One row per node of the conversations in ``paths`` (conv, part, place, turn, words), stored: the node's and its parent's smallest member,
    depth, members, children, leaves and saved words of its subtree, and the hash of the ids that end there."""
    with scratch(paths.sparkSession, "trie") as keep:
        family = F.col("conv") - F.expr(f"conv % {FAMILY}")
        dealt = paths.withColumn("family", family).repartition("family").sortWithinPartitions("family", "conv", "part", "place")
        shards = keep(dealt.select("conv", "turn", "words").mapInArrow(_shards(shard, long), _NODE), "shards")
        nodes = shards.groupBy("node", "parent", "depth", "words").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
        children = shards.where("depth > 0").select("parent", "node").distinct().groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        nodes = keep(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")

        leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("words")
        owned = nodes.select(F.col("conv_id").alias("conv"), "depth", F.lit(None).cast("binary").alias("node"), leaf.alias("leaf"), saved.alias("saved"))
        nothing = F.lit(0).cast("bigint")
        passed = shards.select(F.explode("members").alias("conv"), "depth", "node", nothing.alias("leaf"), nothing.alias("saved"))
        upwards = Window.partitionBy("conv").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = owned.unionByName(passed).select("node", F.sum("leaf").over(upwards).alias("leaf"), F.sum("saved").over(upwards).alias("saved")).where("node IS NOT NULL")
        sums = sums.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        # all of them pass the root
        top = owned.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).where("n_leaves IS NOT NULL").select(F.lit(ROOT).alias("node"), "n_leaves", "saved_tokens")
        ends = shards.select("node", F.explode("ends").alias("conv")).repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_hashed, "node binary, ends_sha256 string")
        above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(sums.unionByName(top), "node").join(ends, "node", "left").join(above, "parent", "left")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return stored(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "node", "parent"), "trie")


def report(conversations: DataFrame) -> DataFrame:
    """The contract's columns for every node of the rebuilt conversations."""
    return trie(rebuilt(turns(conversations))).drop("node", "parent")
