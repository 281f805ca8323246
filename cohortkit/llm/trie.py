"""Prefix trie of conversations by vertical bitmaps.

The nodes of the trie are the distinct sequences of first d turns.  A segment is
a block of a conversation's turns (``turns``) with the depth and the hash of
the prefix before it; a long conversation has many, none is gathered whole.
Segments are range-partitioned by their path and cut into shards of ``SHARD``.

In a shard, every (position, turn) has a bitset of the segments that hold this
turn there; position 0 is the prefix that a segment starts from.  Depth first,
a parent's bitset is intersected with the postings of the next position: the
lowest member left names a posting, the intersection is a child, and its
members are done, so there is one intersection per child.  A child's popcount
and the conversations that end in it are the shard's part of a node; parts of
one node meet by (depth, prefix hash) with partial sums.

Subtree figures need no walk over the tree.  Each node belongs to its smallest
member, so a conversation owns its nodes from some depth on, or none:

* leaves below v = members of v that own a childless last node;
* tokens saved below v: a turn counts once for each member that does not own
  it.  With ``base(c)`` = code points of c before the first node it owns,
  saved(v) = sum of base over the members of v - base(owner of v)
  - (n - 1) * code points before v.

So a second pass over the shards adds up two numbers per conversation.

A prefix is hashed as a polynomial modulo 2**127 - 1 over 128-bit turn hashes,
which can be put together from blocks; equal hashes stand for equal prefixes.

Edge cases: rows without conv_id belong to no conversation and are left out;
null role or text is empty; null turns come first; rows of the same turn are
ordered by the hash of role and text, so repeated rows are repeated turns; a
conversation that has no turns after rebuilding is a member of the root; very
long texts leave as a hash and a length; further columns are ignored, whatever
their names; an empty table gives an empty result (no root).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm import turns as T
from cohortkit.llm.common import cut

SHARD = 1024              # segments in a shard, so bits of a bitset
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1F3A2B9C4E7F60718293A4B % PRIME
HEAD = 5                  # most turns taken over from another conversation
FAMILY = 100


def _to_bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def extend(h: int, turn: bytes) -> int:
    """Hash of a prefix with one more turn."""
    return (h * BASE + int.from_bytes(turn, "big") + 1) % PRIME


def takeover(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family of a hundred."""
    return (F.crc32(conv.cast("string")) % (HEAD + 1)).cast("int")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, turn, t, chars): t is a 128-bit hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), name.alias("t"),
        F.length(text).cast("long").alias("chars"))


_TURNS = "array<struct<t:binary,chars:bigint>>"


def own_blocks(conversations: DataFrame, least_block: int = T.LEAST_BLOCK) -> DataFrame:
    """(conv, block, skipped, rows): a conversation's own turns in blocks, ``skipped`` turns lie before the block."""
    numbered = T.number(turn_rows(conversations), ["turn", "t"], drop=("turn",))
    blocks = T.blocks(numbered, T.block_size(numbered, least_block), ["t", "chars"]).withColumn("n", F.size("rows").cast("long"))
    # the blocks of one conversation, near the square root of its turns
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block")) - F.col("n")
    return blocks.select("conv", "block", before.alias("skipped"),
                         F.transform("rows", lambda r: F.struct(r["t"], r["chars"])).cast(_TURNS).alias("rows")).transform(cut)


def rebuilt_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the rebuilt conversations: the first turns come from the first conversation of the family."""
    conv, rows = F.col("conv"), F.col("rows")
    first = (blocks.where((conv % FAMILY == 0) & (F.col("skipped") < HEAD))
             .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", F.slice(rows, 1, HEAD).alias("r")))).alias("p"))
             .select(conv.alias("_family"), F.slice(F.flatten(F.transform("p", lambda x: x["r"])), 1, HEAD).alias("_head")))
    h = takeover(conv)
    kept = F.slice(rows, (F.greatest(h - F.col("skipped"), F.lit(0)) + 1).cast("int"), F.size(rows))
    head = F.when(F.col("skipped") == 0, F.slice(F.coalesce("_head", F.array().cast(_TURNS)), F.lit(1), h)).otherwise(F.array().cast(_TURNS))
    return (blocks.withColumn("_own", conv - conv % FAMILY).join(first, F.col("_own") == F.col("_family"), "left")
            .select("conv", "block", F.concat(head, kept).alias("rows")))


def plain_blocks(blocks: DataFrame) -> DataFrame:
    """The conversations as they are."""
    return blocks.select("conv", "block", "rows")


def _block_sums(batches):
    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            h = 0
            for r in rows:
                h = extend(h, r["t"])
            out.append((len(rows), _to_bytes(h), sum(r["chars"] for r in rows)))
        cols = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64()))]],
            names=["conv", "block", "n", "h", "chars"])


_START = "array<struct<block:bigint,depth:bigint,h:binary,chars:bigint,last:boolean>>"


def _starts(batches):
    """Per conversation: depth, prefix hash and code points before each of its blocks, and its code points in all."""
    kind = pa.list_(pa.struct([("block", pa.int64()), ("depth", pa.int64()), ("h", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())]))
    for batch in batches:
        starts, totals = [], []
        for parts in batch.column("parts").to_pylist():
            depth = h = chars = 0
            got = []
            for p in [p for p in parts if p["n"]] or parts[:1]:  # so one segment of a conversation starts at the root
                got.append({"block": p["block"], "depth": depth, "h": _to_bytes(h), "chars": chars, "last": False})
                depth += p["n"]
                h = (h * pow(BASE, p["n"], PRIME) + int.from_bytes(p["h"], "big")) % PRIME
                chars += p["chars"]
            got[-1]["last"] = True
            starts.append(got)
            totals.append(chars)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(totals, pa.int64()), pa.array(starts, kind)],
                                         names=["conv", "total", "starts"])


def segments(blocks: DataFrame):
    """(segments, conversations): every block with what lies before it; code points of every conversation."""
    convs = (blocks.mapInArrow(_block_sums, "conv bigint, block bigint, n bigint, h binary, chars bigint")
             .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "n", "h", "chars"))).alias("parts"))
             .mapInArrow(_starts, f"conv bigint, total bigint, starts {_START}").transform(cut))
    return blocks.drop("conv").join(convs.select("conv", F.inline("starts")), "block"), convs.select("conv", "total")


def _sorted_by_path(segs: DataFrame) -> DataFrame:
    path = F.aggregate(F.slice("rows", 1, 8), F.lit(b""), lambda p, r: F.concat(p, r["t"]))
    keys = ["depth", "h", "_path", "conv", "block"]
    return segs.withColumn("_path", path).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_path")


class Shard:
    """Nodes of some segments, parents before children.

    ``starts``: (depth, hash, code points) before each segment; ``rows``: its turns.
    Per node: depth, hash, code points with it, of its last turn, parent's hash, index of the parent (-1: none),
    members (bitset), members whose segment stops here (bitset); ``own`` is false for a node that an earlier block counts.
    """

    def __init__(self, starts: list, rows: list):
        index: list = [{}]
        for i, (start, turns) in enumerate(zip(starts, rows)):
            index[0][start] = index[0].get(start, 0) | (1 << i)
            for p, r in enumerate(turns, 1):
                if p == len(index):
                    index.append({})
                index[p][r["t"]] = index[p].get(r["t"], 0) | (1 << i)
        reach = []  # members that have a turn at a position
        for postings in index:
            every = 0
            for bits in postings.values():
                every |= bits
            reach.append(every)
        self.nodes = nodes = []
        for start, bits in index[0].items():
            depth, h, chars = start
            nodes.append((depth, h, chars, 0, None, -1, bits, bits & ~reach[1] if len(reach) > 1 else bits, depth == 0))
            stack = [(len(nodes) - 1, 0)]
            while stack:
                at, p = stack.pop()
                depth, h, chars, _, _, _, bits, stopped, _ = nodes[at]
                left, p = bits & ~stopped, p + 1
                hash_int = int.from_bytes(h, "big")
                while left:
                    turn = rows[(left & -left).bit_length() - 1][p - 1]
                    child = left & index[p][turn["t"]]
                    left &= ~child
                    ends = child & ~reach[p + 1] if p + 1 < len(reach) else child
                    nodes.append((depth + 1, _to_bytes(extend(hash_int, turn["t"])), chars + turn["chars"], turn["chars"], h, at, child, ends, True))
                    stack.append((len(nodes) - 1, p))


def members(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _shards(batch):
    cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    for i in range(0, batch.num_rows, SHARD):
        part = {c: v[i:i + SHARD] for c, v in cols.items()}
        yield part, Shard(list(zip(part["depth"], part["h"], part["chars"])), part["rows"]).nodes


_PARTS = "depth bigint, h binary, parent binary, n bigint, least bigint, chars bigint, before bigint, ends array<bigint>"


def _parts(batches):
    """A shard's part of each node: members, smallest member, those that end here."""
    types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]
    for batch in batches:
        out = []
        for part, nodes in _shards(batch):
            conv, last = part["conv"], part["last"]
            for depth, h, chars, own_chars, parent, _, bits, stopped, own in nodes:
                if own:
                    out.append((depth, h, parent, bits.bit_count(), min(conv[i] for i in members(bits)), own_chars, chars - own_chars,
                                [conv[i] for i in members(stopped) if last[i]]))
        cols = list(zip(*out)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["depth", "h", "parent", "n", "least", "chars", "before", "ends"])


def _sums(batches):
    """A shard's part of the sums over the members of each node, children first."""
    types = [pa.int64(), pa.binary(), *[pa.int64()] * 4]
    for batch in batches:
        out = []
        for part, nodes in _shards(batch):
            conv, base, leaf = part["conv"], part["base"], part["leaf"]
            sums = [[0, 0, None] for _ in nodes]
            for at in range(len(nodes) - 1, -1, -1):
                depth, h, _, _, _, up, _, stopped, own = nodes[at]
                s = sums[at]
                for i in members(stopped):
                    s[0] += base[i]
                    s[1] += leaf[i]
                    s[2] = (conv[i], base[i]) if s[2] is None or conv[i] < s[2][0] else s[2]
                if up >= 0:
                    u = sums[up]
                    u[0] += s[0]
                    u[1] += s[1]
                    u[2] = s[2] if u[2] is None or s[2] < u[2] else u[2]
                if own:
                    out.append((depth, h, s[0], s[1], *s[2]))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["depth", "h", "base", "leaves", "least", "least_base"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, h, conv) -> (depth, h, ends_sha256): the ids of a node stream through one hash in order."""
    names = ["depth", "h", "ends_sha256"]

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for depth, h, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "h", "conv")]):
                if state is None or state[:2] != (depth, h):
                    if state is not None:
                        done.append((*state[:2], state[2].hexdigest()))
                    state = (depth, h, hashlib.sha256(str(conv).encode()))
                else:
                    state[2].update(f",{conv}".encode())
            cols = list(zip(*done)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string()))], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1]], pa.binary()),
                                              pa.array([state[2].hexdigest()], pa.string())], names=names)

    return ends.repartition("depth", "h").sortWithinPartitions("depth", "h", "conv").mapInArrow(run, "depth bigint, h binary, ends_sha256 string")


def trie(blocks: DataFrame) -> DataFrame:
    """Nodes of the trie of ``blocks`` (of ``rebuilt_blocks`` or ``plain_blocks``).

    Columns: conv_id (smallest member), depth, h (prefix hash), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    segs, convs = segments(blocks)
    segs = _sorted_by_path(segs).transform(cut)
    parts = segs.mapInArrow(_parts, _PARTS).transform(cut)
    nodes = parts.groupBy("depth", "h").agg(
        F.sum("n").alias("n"), F.min("least").alias("conv_id"), F.first("parent").alias("parent"), F.first("chars").alias("chars"),
        F.first("before").alias("before"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("h")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "h"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).transform(cut)
    owners = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("_base"),
                                          (F.max_by("n_children", "depth") == 0).cast("long").alias("_leaf"))
    scalars = convs.join(owners, F.col("conv") == F.col("conv_id"), "left").select(
        "conv", F.coalesce("_base", "total").alias("base"), F.coalesce("_leaf", F.lit(0).cast("long")).alias("leaf"))
    # a conversation has as many segments as its turns have square roots, so the join on it is even
    sums = (_sorted_by_path(segs.join(scalars, "conv")).mapInArrow(
        _sums, "depth bigint, h binary, base bigint, leaves bigint, least bigint, least_base bigint").groupBy("depth", "h").agg(
        F.sum("base").alias("bases"), F.sum("leaves").alias("n_leaves"), F.min_by("least_base", "least").alias("own_base")))
    ends = end_digests(parts.select("depth", "h", F.explode("ends").alias("conv")))
    up = nodes.select((F.col("depth") + 1).alias("_depth"), F.col("h").alias("_h"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("bases") - F.col("own_base") - (F.col("n") - 1) * F.col("before")
    return (nodes.join(sums, ["depth", "h"]).join(ends, ["depth", "h"], "left")
            .join(up, (F.col("depth") == F.col("_depth")) & (F.col("parent") == F.col("_h")), "left")
            .select("conv_id", "depth", "h", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
                    saved.alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def rebuilt_trie(conversations: DataFrame, least_block: int = T.LEAST_BLOCK) -> DataFrame:
    return trie(rebuilt_blocks(own_blocks(conversations, least_block)))
