"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its word
shingles. Two fingerprints that differ in at most two bits agree in one of their two halves up to
one bit, so every distinct fingerprint is indexed under its 64 one-wildcard half variants; an
equality join brings candidates together and the whole distance verifies them.

Where the fingerprints are so many that a variant of 31 bits fills with chance members, the other
half joins the key: it differs in at most two bits, so of its three pieces one is equal, and each
variant is indexed once with each piece. Both forms give the same links.

A key that many fingerprints share is not paired out. Its members are keyed once more with the
remaining differing bits as wildcards: fingerprints that agree on all but two masked bits are
linked by construction, so each goes to the smallest of its group and the work stays linear.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected, discard, shield, stored

SEED = 42
#: Keys with more fingerprints than this are linked through second wildcards instead of pairs.
PAIR_LIMIT = 48
#: Distinct fingerprints from which on a piece of the other half joins each variant: below, a variant meets a sixteenth of a chance member.
LONG_KEYS = 1 << 27
#: Keys that are broadcast at most (about 40 bytes each in a hash table).
BROADCAST_KEYS = 500_000
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the A-Z-lowered text; one of the whole text where it is shorter, none without words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(w) - k + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; a text that is null, empty or without words has fingerprint zero. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _half(fp: F.Column, which: F.Column) -> F.Column:
    return F.when(which == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


#: Masks of the three pieces of a half.
PIECES = (0xFFE00000, 0x001FFC00, 0x000003FF)


def variants(fps: DataFrame, long_keys: bool = False) -> DataFrame:
    """``(key, piece, fp)``: 64 keys a fingerprint, each a half with one bit cleared, tagged with half and bit; with ``long_keys`` once for each piece of the other half, which ``piece`` then holds (else 0)."""
    slot = F.col("slot")
    bit = F.expr("shiftleft(1L, cast(slot % 32 as int))")
    keyed = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
        .withColumn("half", _half(F.col("fp"), F.floor(slot / 32)))
        .withColumn("key", F.expr("shiftleft(cast(slot as long), 32)") + F.col("half") - F.col("half").bitwiseAND(bit))
    )
    if not long_keys:
        return keyed.select("key", F.lit(0).cast("long").alias("piece"), "fp")
    other = _half(F.col("fp"), 1 - F.floor(slot / 32))
    pieces = F.array(*[other.bitwiseAND(F.lit(mask)) + F.lit(i << 32) for i, mask in enumerate(PIECES)])
    return keyed.select("key", F.explode(pieces).alias("piece"), "fp")


def _crowded_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links among the fingerprints of crowded keys, by wildcards in place of pairs.

    A pair within two bits either has at most one differing bit in each half, which the crowded keys
    of the high half cover with one more wildcard in the low half; or it has one half equal and two
    differing bits in the other, which the key of that half's bit 0 covers with two wildcards.
    """
    if max_distance != 2:
        raise ValueError("crowded keys are linked for a distance of two")
    slot = F.expr("cast(shiftright(key, 32) as int)")
    m = members.select("key", "fp", slot.alias("slot"))
    one = m.where("slot < 32").select("fp", F.expr("shiftleft(1L, 32 + slot)").alias("bit"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    one = one.select("fp", (F.col("bit").bitwiseOR(F.expr("shiftleft(1L, j)"))).alias("mask"))
    pairs = F.array(*[F.lit((1 << i) | (1 << j)) for i in range(32) for j in range(i)])
    two = m.where("slot % 32 = 0").select("fp", "slot", F.explode(pairs).alias("p"))
    two = two.select("fp", F.expr("if(slot = 0, p, shiftleft(p, 32))").alias("mask"))
    keyed = one.unionByName(two).select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    least = keyed.groupBy("mask", "rest").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["mask", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, max_distance: int = 2, pair_limit: int = PAIR_LIMIT, long_keys: int = LONG_KEYS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints at most ``max_distance`` bits apart.

    All such pairs where a key holds at most ``pair_limit`` fingerprints; within crowded keys, edges
    that connect the same fingerprints.
    """
    key = ["key", "piece"]
    keyed = variants(fps, max_distance == 2 and fps.count() >= long_keys)
    groups = stored(keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    found = groups.where("n = 2").where(near).select("a", "b").distinct()
    fuller = groups.where("n > 2").select(*key, "n")
    many = fuller.count()
    if not many:
        return found
    members = stored(keyed.join(F.broadcast(fuller) if many <= broadcast_keys else fuller, key), "members")
    few = members.where(F.col("n") <= pair_limit)
    pairs = few.select(*key, F.col("fp").alias("a")).join(few.select(*key, F.col("fp").alias("b")), key).where("a < b").where(near).select("a", "b")
    found = found.unionByName(pairs)
    crowded = members.where(F.col("n") > pair_limit)
    if not crowded.isEmpty():
        found = found.unionByName(_crowded_links(crowded.select("key", "fp").distinct(), max_distance))
    return found.distinct()


def components(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over linked fingerprints. Exact copies share a
    fingerprint and meet as one node. Null doc_ids keep their row and never become a component_id
    unless a component has no other; repeated rows stay repeated; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(links(nodes.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(first, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates of a stated shingle similarity.
#
# At a shingle similarity of 0.8 two 64-bit fingerprints differ in about ten bits, out of reach of
# any selective variant index. So the fingerprints' links are joined by candidates from a bottom
# sketch of the same shingle hashes. The sketches only find candidates: every one of them is
# verified by the exact similarity of the two sets of shingle hashes.
#
# No group is paired out. A band's texts are held against its most widely shared one, then against
# such ones of random parts of the band. What is still apart in a band is settled through the rarest
# shingles, exactly, between texts of different components alone.

#: Cells of a sketch (half a byte each), coarse cells, coarse cells of one band.
FINE, COARSE, ROWS = 512, 128, 4
#: Candidates whose estimate is further below the stated similarity than this are not verified: four times the estimate's deviation.
MARGIN = 0.12
#: Rounds in which a band is led in parts, and the texts of a part.
ROUNDS, PART = 3, 8


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half a byte of the smallest hash in each of the fine cells (0: empty) as bit planes, four longs for each 64 cells, and a key for each band with a coarse cell that is not empty."""
    h = np.unique(hashes * np.uint64(0x9E3779B97F4A7C15))
    cell = (h >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(h) else np.empty(0, np.int64)
    fine = np.zeros(FINE, np.uint8)
    fine[cell[first]] = 1 + (h[first] & np.uint64(0xFFFF)) % np.uint64(15)
    planes = np.packbits((fine[None, :] >> np.arange(4, dtype=np.uint8)[:, None]) & 1, axis=1).view(np.int64)
    lows = np.zeros(COARSE, np.uint64)
    coarse = cell // (FINE // COARSE)
    first = np.flatnonzero(np.concatenate(([True], coarse[1:] != coarse[:-1]))) if len(h) else first
    lows[coarse[first]] = h[first]
    rows = lows.reshape(-1, ROWS)
    used = np.flatnonzero(rows.any(axis=1))
    keys = [xxhash.xxh64_intdigest(rows[i].tobytes(), int(i)) for i in used]
    return np.ascontiguousarray(planes.T).ravel(), np.array(keys, np.uint64).view(np.int64)


def _likely(similarity: float) -> F.Column:
    """Whether the sketches ``p`` and ``q`` may be of sets that alike: the share of equal cells among those that either uses, less what chance makes equal."""
    either = both = equal = F.lit(0)
    for word in range(FINE // 64):
        p, q = ([F.get(c, F.lit(4 * word + i)) for i in range(4)] for c in ("p", "q"))
        used = [functools.reduce(lambda x, y: x.bitwiseOR(y), v) for v in (p, q)]
        apart = functools.reduce(lambda x, y: x.bitwiseOR(y), [x.bitwiseXOR(y) for x, y in zip(p, q, strict=True)])
        either = either + F.bit_count(used[0].bitwiseOR(used[1]))
        both = both + F.bit_count(used[0].bitwiseAND(used[1]))
        equal = equal + F.bit_count(used[0].bitwiseAND(F.bitwise_not(apart)))
    return 15 * equal - both >= 14 * (similarity - MARGIN) * either


def _digest(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def _shingle_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``(node, shingles)``: the distinct shingle hashes of the wanted nodes, made anew from one text of each."""
    keys = ["_sh_null", "_sh_doc", "_sh_text"]
    row = F.struct(F.col("_sh_doc").isNull().alias("_sh_null"), F.coalesce("_sh_doc", F.lit(0).cast("long")).alias("_sh_doc"), "_sh_text")
    one = marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(row).alias("k")).select("k.*")
    id_ = F.col("doc_id").cast("long")
    texts = docs.select(id_.isNull().alias("_sh_null"), F.coalesce(id_, F.lit(0).cast("long")).alias("_sh_doc"), F.xxhash64("text").alias("_sh_text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(0).slice(lo, 200)]
                nodes = pa.array([_digest(s) for s in sets], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    found = texts.join(one, keys, "left_semi").select("text").mapInArrow(run, "node long, shingles array<long>")
    return found.dropDuplicates(["node"])


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with ``s``, the exact similarity of their sets of shingle hashes."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
    common = F.size(F.array_intersect("p", "q"))
    return both.select("a", "b", (common / (F.size("p") + F.size("q") - common)).alias("s"))


def _size_allows(similarity: float) -> F.Column:
    """The smaller set's share of the larger one bounds the similarity."""
    return F.least("m", "n") / F.greatest("m", "n") >= similarity


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the candidates ``(a, b)`` whose sets of shingle hashes are ``similarity`` alike or more."""
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("p"), F.col("size").alias("m")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("q"), F.col("size").alias("n")), "b")
    likely = stored(both.where(_size_allows(similarity) & _likely(similarity)).select("a", "b"), "likely")
    return _scored(likely, sets).where(F.col("s") >= similarity).select("a", "b")


def _held_against_leaders(members: DataFrame, *key: str) -> DataFrame:
    """``(a, b)``: each member of a key with the key's leader, which is the member that shares most bands, if it is of another component."""
    led = members.groupBy(*key).agg(F.max_by(F.struct("node", "root"), F.struct("fame", "node")).alias("first"), F.count("*").alias("k")).where("k > 1")
    pairs = members.join(led, list(key)).where(F.col("root") != F.col("first.root"))
    return pairs.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()


def _still_apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of bands that hold more than one component, with their components."""
    rooted = stored(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    apart = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    out = stored(rooted.join(apart, "band"), "apart")
    discard(rooted)
    return out


def _rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``(h, node, size, others, own, left)``: shingles of which two sets that are alike enough share one at least; how many of a set's shingles any other set has, and how many of those come at h or behind it; all of these rare shingles of the set, rarest first.

    Such sets share ``similarity`` of either's shingles or more, so of any one order of all
    shingles, rarest first, they meet within the first ``size - ceil(similarity * size) + 1``.
    """
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    often = stored(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    own = Window.partitionBy("node")
    ranked = each.join(often, "h", "left").withColumn("others", F.count("df").over(own)).withColumn("at", F.row_number().over(own.orderBy(F.coalesce("df", F.lit(1)), "h")))
    rare = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1).where("df > 1")
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda x: x["h"])
    kept = rare.groupBy("node", "size", "others").agg(sorted_.alias("own"))
    # Shingles that no other set has come first in the order, so a rare one's place leaves this many to share.
    return kept.select(F.posexplode("own").alias("pos", "h"), "node", "size", "others", "own").withColumn("left", F.col("others") - F.col("pos")).drop("pos")


def _pairs_apart(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: all pairs of the members' nodes of different components that may be alike: they share a rare shingle, and their sizes, the shingles that others have too, and their sketches allow it."""
    roots = members.select("node", "root").distinct()
    rare = _rare_shingles(sets.join(roots, "node", "left_semi"), similarity)
    held = stored(rare.join(roots, "node").join(nodes.select("node", "sketch"), "node"), "rare")
    once = held.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    wider, held = held, stored(held.join(once, "h"), "rare")
    discard(wider)
    left = held.select("h", F.col("node").alias("a"), F.col("root").alias("x"), F.col("size").alias("m"), F.col("others").alias("c"), F.col("sketch").alias("p"), F.col("own").alias("f"), F.col("left").alias("i"))
    right = held.select("h", F.col("node").alias("b"), F.col("root").alias("y"), F.col("size").alias("n"), F.col("others").alias("d"), F.col("sketch").alias("q"), F.col("own").alias("g"), F.col("left").alias("j"))
    # What both have is at most what either has from their first common shingle on, and at most the
    # rare ones that both have and what is behind the rare ones of the set whose rare ones end first.
    enough = lambda most: most * (1 + similarity) >= similarity * (F.col("m") + F.col("n")) - 1e-6
    common = enough(F.least("i", "j"))
    rare_ones = enough(F.size(F.array_intersect("f", "g")) + F.greatest(F.col("c") - F.size("f"), F.col("d") - F.size("g")))
    apart = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y"))
    # A pair meets once: at the rarest shingle of both.
    once = F.get(F.array_intersect("f", "g"), F.lit(0)) == left["h"]
    return left.join(right, (left["h"] == right["h"]) & apart & _size_allows(similarity) & common & _likely(similarity) & once & rare_ones).select("a", "b")


def near_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """``(_sh_doc, _sh_text, group)`` of every row: its doc_id, a hash of its text, and the number of its group of near-duplicates.

    Two texts are linked if their sets of shingle hashes are ``similarity`` alike or more; groups
    are connected over links. Candidates are fingerprints within two bits, and texts that share a
    band: each is held against leaders of the band until it is connected to the others or, through
    its rarest shingles, shown to be unlike them. Texts without words are one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                hashes = [shingle_hashes(t.as_py(), shingle_words) for t in some.column(2)]
                sets = list(map(np.unique, hashes))
                nodes = pa.array([_digest(s) for s in sets], pa.uint64()).view(pa.int64())
                sketches, keys = zip(*map(sketch, sets), strict=True)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), nodes, pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(majority, hashes)), pa.int64()), pa.array(sketches, longs), pa.array(keys, longs)], ["_sh_doc", "_sh_text", "node", "size", "fp", "sketch", "bands"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("_sh_doc"), F.xxhash64("text").alias("_sh_text"), "text")
    marked = stored(keyed.mapInArrow(run, "_sh_doc long, _sh_text long, node long, size int, fp long, sketch array<long>, bands array<long>"), "sketches")
    # A node is a set of shingle hashes; texts of the same set are alike in full.
    nodes = stored(marked.select("node", "size", "fp", "sketch", "bands").dropDuplicates(["node"]), "nodes")
    banded = stored(nodes.select("node", F.explode("bands").alias("band")), "bands")
    counted = stored(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    shared = stored(banded.join(counted, "band"), "shared")
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    plain, shared = shared, stored(shared.join(fame, "node"), "shared")
    discard(banded, counted, plain)
    close = stored(links(nodes.select("fp").distinct()), "close")
    one = nodes.groupBy("fp").agg(F.min("node").alias("m"))
    same_fp = nodes.join(one, "fp").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    by_bits = close.join(one.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    by_band = _held_against_leaders(shared.withColumn("root", F.col("node")), "band")
    pairs = stored(by_band.unionByName(by_bits).unionByName(same_fp).distinct(), "pairs")
    wanted = shared.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_shingle_sets(docs, marked, wanted, shingle_words), "shingles")
    linked = stored(_verified(pairs, nodes, sets, similarity), "linked")
    discard(pairs, close)
    roots = connected(linked)
    apart = _still_apart(shared, roots)
    discard(shared)
    for turn in range(rounds):
        at = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / part)).alias("at")
        more = stored(_verified(_held_against_leaders(apart.select("*", at), "band", "at"), nodes, sets, similarity), "linked")
        if more.isEmpty():
            break
        linked = linked.unionByName(more)
        discard(roots)
        roots = connected(linked)
        wider, apart = apart, _still_apart(apart.select("band", "node", "n", "fame"), roots)
        discard(wider)
    more = stored(_verified(_pairs_apart(apart, nodes, sets, similarity), nodes, sets, similarity), "linked")
    if not more.isEmpty():
        discard(roots)
        roots = connected(linked.unionByName(more))
    rows = marked.select("_sh_doc", "_sh_text", "node")
    out = stored(rows.join(roots, "node", "left").select("_sh_doc", "_sh_text", F.coalesce("root", "node").alias("group")), "groups")
    discard(marked, nodes, sets, linked, more, apart, roots)
    return out


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id (null last), then the least hash of its text.

    Of rows that repeat an id and a text one stays. Null texts count as empty. An empty table gives
    no rows; all columns come through.
    """
    docs, back = shield(docs, "_sh_")
    found = near_groups(docs, shingle_words, similarity)
    key = F.struct(F.col("_sh_doc").isNull(), F.coalesce("_sh_doc", F.lit(0).cast("long")), F.col("_sh_text"))
    kept = found.groupBy("group").agg(F.min(key).alias("k")).select(F.col("k.col2").alias("_sh_doc"), F.col("k._sh_text").alias("_sh_text"), F.col("k.col1").alias("_sh_null"))
    marks = {"_sh_null": F.col("doc_id").isNull(), "_sh_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_sh_text": F.xxhash64("text")}
    names = ["_sh_doc", "_sh_text", "_sh_null"]
    one = Window.partitionBy(*names).orderBy("text")
    out = docs.withColumns(marks).join(kept, names, "left_semi").withColumn("_sh_n", F.row_number().over(one)).where("_sh_n = 1")
    return out.select(*docs.columns).withColumnsRenamed(back)
