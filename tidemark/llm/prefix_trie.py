"""The trie of conversations' prefixes, with totals of every subtree by parallel tree contraction.

A node's key is the exclusive or of 128-bit hashes of (position, turn) over its prefix, so the keys of
all prefixes of a conversation are running exclusive ors. They are taken within blocks of positions
and carried over blocks of blocks, which cuts a conversation of any length into even parts; positions
themselves come from one range partitioning by conversation and turn, not from a window that would
hold a conversation together.

Subtree totals are found in rounds of joins over the nodes that are left. Each round splices nodes
with a single child out of their chains (those whose hash is above their parent's and their child's,
so no two neighbours go at once), and rakes the leaves into their parents. A leaf's sum is its
subtree's total when it goes; a spliced node remembers its sum and its child then, and its total is
found in re-expansion by following those links, whose length doubles with each join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Turns of a block, blocks of a block of blocks, and so on.
FAN = 1024
#: Conversation ids whose decimals are packed into one string before a node's hash streams over them.
PACK = 4096
#: Rounds of contraction at most; each leaves a constant share of the nodes, so a thousand billion take some seventy.
MAX_ROUNDS = 200

_KEY = ["k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, h1, h2, bytes, n_turns)``: each conversation's turns, numbered from 0 by turn (null first), and of equal turns by hash.

    Rows without a conv_id take no part; a null role or text is empty. Rows are sorted over the
    cluster by conversation and turn; a row's number is its place within the partition plus what
    earlier partitions hold of its conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "h1", "h2"]
    # Stored, since places are only good while the partitioning is.
    placed = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), "h1", "h2", "bytes"), "turns").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    return placed.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "h1", "h2", "bytes", "n_turns")


def rebuild(turns: DataFrame, source: Callable[[Column], Column], n_head: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first ``n_head(c)`` turns (``most`` at most) replaced by those of conversation ``source(c)``.

    Gives the turns ``(conv_id, pos, h1, h2, bytes, last)`` and all conversations ``(conv_id,
    length)``. A source with fewer turns gives what it has, an absent one none.
    """
    lengths = turns.where("i = 0").select("conv_id", "n_turns")
    wanted = lengths.select("conv_id", "n_turns", source(F.col("conv_id")).alias("from"), n_head(F.col("conv_id")).cast("long").alias("h"))
    heads = lengths.select(F.col("conv_id").alias("from"), F.col("n_turns").alias("n_from"))
    tail = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    plan = wanted.join(heads, "from", "left").withColumn("shift", F.least("h", F.coalesce("n_from", F.lit(0)))).withColumn("length", F.col("shift") + tail)
    plan = stored(plan.select("conv_id", "from", "h", "shift", "length"), "rebuilt")
    pick = lambda df, pos: df.select("conv_id", pos.alias("pos"), "h1", "h2", "bytes", (pos == F.col("length") - 1).alias("last"))
    own = pick(turns.drop("n_turns").join(plan, "conv_id").where("i >= h"), F.col("i") - F.col("h") + F.col("shift"))
    given = turns.where(F.col("i") < most).select(F.col("conv_id").alias("from"), "i", "h1", "h2", "bytes")
    head = pick(given.join(plan, "from").where("i < h"), F.col("i"))
    return own.unionByName(head), plan.select("conv_id", "length")


def _running(df: DataFrame, longest: int, fan: int) -> DataFrame:
    """``df(conv_id, pos, k1, k2, ...)`` with k1 and k2 as exclusive ors over a conversation's positions up to the row's."""
    over = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("block", F.floor(F.col("pos") / fan)).withColumns({k: F.bit_xor(k).over(over) for k in _KEY})
    if longest <= fan:
        return own.drop("block")
    # A block's sum is what its successor starts from; blocks are summed in the same way.
    sums = df.groupBy("conv_id", F.floor(F.col("pos") / fan).alias("pos")).agg(*(F.bit_xor(k).alias(k) for k in _KEY))
    before = _running(sums, -(-longest // fan), fan).select("conv_id", (F.col("pos") + 1).alias("block"), *(F.col(k).alias(f"_{k}") for k in _KEY))
    both = own.join(before, ["conv_id", "block"], "left").withColumns({k: F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0))) for k in _KEY})
    return both.drop("block", "_k1", "_k2")


def prefixes(turns: DataFrame, longest: int, fan: int = FAN) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, bytes, last)``: a row for each prefix with a turn, with its key and its parent's."""
    hashed = turns.withColumns({"k1": F.xxhash64("pos", "h1", "h2"), "k2": F.xxhash64("h2", "pos", "h1")}).drop("h1", "h2")
    hashed = hashed.withColumns({"p1": F.col("k1"), "p2": F.col("k2")})
    # Without its own turn's hash, a prefix's key is its parent's.
    found = _running(hashed, longest, fan)
    return found.select("conv_id", (F.col("pos") + 1).alias("depth"), *_KEY, F.col("k1").bitwiseXOR(F.col("p1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("p2")).alias("p2"), "bytes", "last")


def _hash_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's packs, in order, joined by commas; rows are sorted by key and pack."""
    key, sha, out = None, None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"k1": k[0], "k2": k[1], "ends_sha256": s} for k, s in out], pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

    for b in batches:
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                sha.update(b"," + ids.encode())
                continue
            if key:
                out.append((key, sha.hexdigest()))
            key, sha = (k1, k2), hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield packed()
                out = []
    if key:
        out.append((key, sha.hexdigest()))
    if out:
        yield packed()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the conversations ``(k1, k2, conv_id)`` that end at a node, their ids ascending.

    Ids are packed in Spark; one hash is one stream of bytes, so a node's packs pass one task, which
    holds a batch of them at a time.
    """
    packs = ends.groupBy(*_KEY, F.floor(F.col("conv_id") / PACK).alias("pack")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return packs.repartition(*_KEY).sortWithinPartitions(*_KEY, "pack").mapInArrow(_hash_packs, "k1 long, k2 long, ends_sha256 string")


def contract(tree: DataFrame, weights: list[str], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Subtree totals: ``(id, *weights)`` summed over each node's subtree, of a forest ``(id, parent, *weights)`` of longs; a root's parent is null.

    No node's children are ever gathered: joins meet one row a key on one side, and what children
    give their parent is summed before it is shuffled. An empty tree gives no rows; ids must be
    unique and parents must be ids.
    """
    sums = lambda df: df.groupBy("to").agg(*(F.sum(w).alias(f"add_{w}") for w in weights))
    active, rounds = tree.select("id", "parent", *weights), []
    while not active.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"the tree is not contracted after {max_rounds} rounds")
        kids = active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("only"))
        coin = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: B023, E731
        splice = (F.col("kids") == 1) & (coin("id") > coin("parent")) & (coin("id") > coin("only"))
        now = stored(active.join(kids, "id", "left").withColumn("spliced", F.coalesce(splice, F.lit(False))), f"round{len(rounds)}")
        rounds.append(now)
        gone = now.where("spliced")
        # The child takes the place of its spliced parent before leaves are raked.
        moved = gone.select(F.col("only").alias("id"), F.col("parent").alias("above"))
        kept = now.where("NOT spliced").join(moved, "id", "left").withColumn("parent", F.coalesce("above", "parent")).drop("above")
        given = kept.where("kids IS NULL AND parent IS NOT NULL").select(F.col("parent").alias("to"), *weights).unionByName(gone.select(F.col("parent").alias("to"), *weights))
        left = kept.where("kids IS NOT NULL").join(sums(given).withColumnRenamed("to", "id"), "id", "left")
        active = stored(left.select("id", "parent", *((F.col(w) + F.coalesce(f"add_{w}", F.lit(0))).alias(w) for w in weights)), "active")
    if not rounds:
        return active.select("id", *weights)
    both = lambda frames: reduce(DataFrame.unionByName, frames)
    settled = both([r.where("kids IS NULL").select("id", *weights) for r in rounds])
    links = both([r.where("spliced").select("id", F.col("only").alias("next"), *weights) for r in rounds])
    # A node's child goes in a later round, or as a leaf, so links are no more than there are rounds.
    for _ in range(math.ceil(math.log2(max(len(rounds), 2)))):
        further = links.select(F.col("id").alias("next"), F.col("next").alias("then"), *(F.col(w).alias(f"add_{w}") for w in weights))
        met = links.join(further, "next", "left")
        links = stored(met.select("id", F.coalesce("then", "next").alias("next"), *((F.col(w) + F.coalesce(f"add_{w}", F.lit(0))).alias(w) for w in weights)), "links")
    ends = settled.select(F.col("id").alias("next"), *(F.col(w).alias(f"add_{w}") for w in weights))
    expanded = links.join(ends, "next").select("id", *((F.col(w) + F.col(f"add_{w}")).alias(w) for w in weights))
    return settled.unionByName(expanded)


def trie(turns: DataFrame, convs: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of conversations ``turns(conv_id, pos, h1, h2, bytes, last)``, of which ``convs(conv_id, length)`` has all.

    Gives a row for each distinct prefix: ``(conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)``. No conversations have no nodes, not even the root.
    """
    longest = convs.agg(F.max("length")).first()[0]
    rows = stored(prefixes(turns, longest or 0, fan), "prefixes")
    inner = rows.groupBy(*_KEY).agg(*(F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "bytes")), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), "n_convs")
    nodes = stored(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, ["p1", "p2"], "left").drop("p1", "p2"), "tree")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    ends = rows.where("last").select(*_KEY, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    weighed = nodes.select("id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    found = nodes.join(contract(stored(weighed, "weights"), ["n_leaves", "saved_tokens"]), "id").join(end_hashes(ends), _KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, source: Callable[[Column], Column] | None = None, n_head: Callable[[Column], Column] | None = None, most: int = 0, fan: int = FAN) -> DataFrame:
    """:func:`trie` of ``conversations(conv_id, turn, role, text)``, rebuilt by :func:`rebuild` where a source and a number of turns are given.

    Turns of a null conv_id take no part; null roles and texts are empty; null turns come first, and
    turns of one number are ordered by the hash of role and text, so repeated rows are turns of
    their own in any order. Other columns are not read.
    """
    turns = stored(ordered_turns(conversations), "ordered")
    return trie(*rebuild(turns, source or (lambda c: c), n_head or (lambda c: F.lit(0)), most), fan)
