"""Alignment of two tokenizers' tokens over a corpus.

Both tokenizers are run over each text, and the byte offsets where both end a token cut it into
groups. Neither has a token that crosses from a non-blank character to a space, so texts are cut
there into segments, and a segment is encoded and aligned once while a task remembers it.

The identity map gives for each id of A the id of B with the same bytes. A group of one token of each
that the map names is counted in a vector as long as A's vocabulary, one vector a task; only other
groups' pairs are shuffled, counted by block first. Counts go back to the blocks that hold a pair by a
join, and each document's figures are sums over its segments' places in the block's dictionary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_codec import piece_bytes
from tidemark.llm.common import stored

#: Documents and code points of a block at most, though a longer document is a block alone.
BLOCK, BLOCK_CHARS = 500, 4_000_000
#: Segments that a task remembers.
MEMO = 300_000
#: Counts of a row of a vector.
SLICE = 4096
#: A segment begins at each space that no kind of white space precedes.
SEGMENT = re.compile("(?: [^ ]*)(?:(?<=[\\s\u180e\u200b\ufeff]) [^ ]*)*")
_BLOCKS = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, places binary, sizes binary, exact binary, exact_sizes binary, irregular binary, irregular_sizes binary, pairs array<long>, pair_counts array<long>, lo int, vector array<long>"


@dataclass
class Pieces:
    """The bytes of the ids of both vocabularies, the identity map (for each id of A an id of B, or -1), and what is written of ids."""

    a: list[bytes]
    b: list[bytes]
    identity: np.ndarray = field(init=False)
    size_a: np.ndarray = field(init=False)
    size_b: np.ndarray = field(init=False)
    decimal: list[str] = field(init=False)
    said: list[str] = field(init=False)

    def __post_init__(self) -> None:
        # Byte tokens come first in B's vocabulary, so a piece's own id replaces them.
        by_bytes = {p: i for i, p in enumerate(self.b)}
        self.identity = np.array([by_bytes.get(p, -1) if p else -1 for p in self.a], np.int64)
        self.size_a, self.size_b = (np.array([len(p) for p in x], np.int64) for x in (self.a, self.b))
        self.decimal = [str(i) for i in range(max(len(self.a), len(self.b)))]
        self.said = [f"{a}|{b}" for a, b in enumerate(self.identity.tolist())]


def load_pieces(path_a: str, path_b: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    b = SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError(f"{path_b} has pieces that cross from a word to a space")
    if len(pieces) > 1 << 16:
        raise ValueError(f"{path_b} has ids of more than 16 bits")
    return Pieces(piece_bytes(path_a), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


def _pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.asarray(a).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, which may be zero."""
    upto, ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _ragged(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of runs of the given sizes and starts, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Aligned:
    """What segments add to their documents: counts of A's and B's tokens, groups and links; groups as text; ids of A in exact groups, and pairs (a * 65536 + b) of other groups, each with how many a segment has."""

    figures: np.ndarray
    groups: list[str]
    exact: np.ndarray
    exact_sizes: np.ndarray
    pairs: np.ndarray
    pair_sizes: np.ndarray


def align(ids_a: list[list[int]], ids_b: list[list[int]], pieces: Pieces) -> Aligned:
    """Groups and links of segments whose tokens have the same bytes, all at once.

    Between two neighbouring token ends of either side lies a part of one token of each: a link. A
    group closes at an end of both.
    """
    n = len(ids_a)
    n_a, n_b = (np.array([*map(len, x)], np.int64) for x in (ids_a, ids_b))
    ta, tb = ([*chain.from_iterable(x)] for x in (ids_a, ids_b))
    a, b = np.array(ta, np.int64), np.array(tb, np.int64)
    end_a, end_b = np.cumsum(pieces.size_a[a]), np.cumsum(pieces.size_b[b])
    # Two sorted runs, which a stable sort merges.
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])[: len(ends)]]
    i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    closes = (end_a[i] == ends) & (end_b[j] == ends)
    segment, last = np.repeat(np.arange(n), n_a)[i], np.flatnonzero(closes)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
    one_to_one = np.repeat(last == first, last - first + 1)
    exact = one_to_one & (pieces.identity[a[i]] == b[j])
    of = lambda links: np.bincount(segment[links], minlength=n)
    figures = np.stack([n_a, n_b, of(closes), np.bincount(segment, minlength=n)], axis=1)

    decimal, said = pieces.decimal, pieces.said
    rows = zip(exact[last].tolist(), i[first].tolist(), i[last].tolist(), j[first].tolist(), j[last].tolist(), strict=True)
    texts = [said[ta[i0]] if x else f"{','.join([decimal[t] for t in ta[i0 : i1 + 1]])}|{','.join([decimal[t] for t in tb[j0 : j1 + 1]])}" for x, i0, i1, j0, j1 in rows]
    upto = np.concatenate([[0], np.cumsum(figures[:, 2])]).tolist()
    groups = [";".join(texts[lo:hi]) for lo, hi in zip(upto, upto[1:])]  # noqa: B905
    return Aligned(figures, groups, a[i][exact], of(exact), (a[i] << 16 | b[j])[~exact], of(~exact))


class Memo:
    """Segments encoded and aligned so far, by place; it is emptied when it holds more than ``MEMO``."""

    def __init__(self, path_a: str, path_b: str, pieces: Pieces):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b, self.pieces = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), pieces
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.space = [self.b.piece_to_id("▁")]
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.held, self.whole = align([], [], self.pieces), np.zeros(0, bool)

    def _add(self, new: list[str]) -> None:
        of_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B sets a space before a text by itself, and drops a text that is nothing else.
        of_b = [x or self.space for x in self.b.encode([s[1:] for s in new], num_threads=1)]
        bytes_a, bytes_b, raw = self.pieces.a, self.pieces.b, [s.encode() for s in new]
        size = np.array([*map(len, raw)], np.int64)
        joined = lambda of, ids: b"".join([of[t] for t in chain.from_iterable(ids)])
        sized = lambda sizes, ids: _sums(sizes[np.array([*chain.from_iterable(ids)], np.int64)], np.array([*map(len, ids)], np.int64))
        if joined(bytes_a, of_a) == b"".join(raw) == joined(bytes_b, of_b) and (sized(self.pieces.size_a, of_a) == size).all() and (sized(self.pieces.size_b, of_b) == size).all():
            whole = [True] * len(new)
        else:
            whole = [joined(bytes_a, [x]) == r == joined(bytes_b, [y]) for r, x, y in zip(raw, of_a, of_b, strict=True)]
            of_a, of_b = ([x if ok else [] for x, ok in zip(ids, whole, strict=True)] for ids in (of_a, of_b))
        found, old = align(of_a, of_b, self.pieces), self.held
        old.groups.extend(found.groups)
        both = lambda name: np.concatenate([getattr(old, name), getattr(found, name)])
        self.held = Aligned(both("figures"), old.groups, *map(both, ("exact", "exact_sizes", "pairs", "pair_sizes")))
        self.whole = np.concatenate([self.whole, np.array(whole, bool)])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def of(self, distinct: list[str]) -> tuple[Aligned, np.ndarray]:
        """The segments' alignments, and whether both tokenizers give their bytes back; one of which they do not has no tokens."""
        if len(self.place) > MEMO:
            self._empty()
        new = [s for s in distinct if s not in self.place]
        if new:
            self._add(new)
        at, held = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct)), self.held

        def taken(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return values[_ragged(sizes[at], (np.cumsum(sizes) - sizes)[at])]

        groups = held.groups
        return Aligned(held.figures[at], [groups[k] for k in at.tolist()], taken(held.exact, held.exact_sizes), held.exact_sizes[at], taken(held.pairs, held.pair_sizes), held.pair_sizes[at]), self.whole[at]


def segments(text: str | None) -> list[str]:
    """The segments of a space and the text; a text without tokens has none."""
    return SEGMENT.findall(f" {text}") if text else []


def _cut(b: pa.RecordBatch) -> Iterator[tuple[int, list[int | None], list[str | None]]]:
    rows, ids, texts, size = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), 0
    lo, held = 0, []
    for i in range(b.num_rows):
        t = texts[i].as_py()
        if held and (len(held) == BLOCK or size + len(t or "") > BLOCK_CHARS):
            yield rows[lo], ids[lo:i], held
            lo, held, size = i, [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield rows[lo], ids[lo:], held


def _align_blocks(path_a: str, path_b: str, shared):
    """A row for each block of documents, and the task's vector of exact groups in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        memo, vector = Memo(path_a, path_b, pieces), np.zeros(len(pieces.a), np.int64)
        for name, ids, texts in chain.from_iterable(map(_cut, batches)):
            cut = [segments(t) for t in texts]
            distinct = list(dict.fromkeys(chain.from_iterable(cut)))
            own, whole = memo.of(distinct)
            if not whole.all():
                bad = {s for s, ok in zip(distinct, whole.tolist(), strict=True) if not ok}
                cut = [[] if bad.intersection(x) else x for x in cut]
            place = {s: i for i, s in enumerate(distinct)}
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            places = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
            times = np.bincount(places, minlength=len(distinct))
            figures = own.figures[places]
            exact, exact_sizes, pairs, pair_sizes = own.exact, own.exact_sizes, own.pairs, own.pair_sizes
            np.add.at(vector, exact, np.repeat(times, exact_sizes))
            kinds, irregular = np.unique(pairs, return_inverse=True)
            counts = np.zeros(len(kinds), np.int64)
            np.add.at(counts, irregular, np.repeat(times, pair_sizes))
            said, groups, upto = [], own.groups, np.concatenate([[0], np.cumsum(sizes)]).tolist()
            each = places.tolist()
            for lo, hi in zip(upto, upto[1:]):  # noqa: B905
                said.append(hashlib.sha256(";".join([groups[k] for k in each[lo:hi]]).encode()).hexdigest() if hi > lo else "")
            row = {"block": name, "ids": ids, "groups_sha256": said, "places": _pack(places), "sizes": _pack(sizes), "exact": _pack(exact), "exact_sizes": _pack(exact_sizes), "irregular": _pack(irregular), "irregular_sizes": _pack(pair_sizes), "pairs": kinds.tolist(), "pair_counts": counts.tolist()}
            row |= {c: _sums(figures[:, k], sizes).tolist() for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)
        slices = [{"lo": lo, "vector": vector[lo : lo + SLICE].tolist()} for lo in range(0, len(vector), SLICE) if vector[lo : lo + SLICE].any()]
        if slices:
            yield pa.RecordBatch.from_pylist(slices, _SCHEMA)

    return run


def _schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_SCHEMA = _schema_of(_BLOCKS)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT_SCHEMA = _schema_of(_OUT)


def _score(shared):
    """Each document's sums from its block's dictionary, the vectors of exact counts and best counts, and the counts of the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, exact_counts, best = shared.value
        for r in (r for b in batches for r in b.to_pylist()):
            exact, irregular = _unpack(r["exact"]), _unpack(r["irregular"])
            pairs, counts = np.array(r["pairs"], np.int64), np.zeros(len(r["pairs"]), np.int64)
            for x in r["found"] or ():
                counts[x["place"]] = x["n"]
            per_exact, per_pair = exact_counts[exact], counts[irregular]
            is_best = per_exact == best[identity[exact]], (counts == best[pairs & 0xFFFF])[irregular]
            sizes, places = _unpack(r["sizes"]), _unpack(r["places"])
            total = _sums(per_exact, n := _unpack(r["exact_sizes"])) + _sums(per_pair, m := _unpack(r["irregular_sizes"]))
            bests = _sums(is_best[0], n) + _sums(is_best[1], m)
            yield pa.RecordBatch.from_pydict({"doc_id": r["ids"], **{c: r[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": _sums(bests[places], sizes), "count_sum": _sums(total[places], sizes), "groups_sha256": r["groups_sha256"]}, schema=_OUT_SCHEMA)

    return run


@dataclass
class Counted:
    """The blocks of a corpus, the corpus counts ``(pair, n, exact)`` of its id pairs (a * 65536 + b), and the vocabularies."""

    blocks: DataFrame
    totals: DataFrame
    pieces: Pieces

    def pairs(self) -> DataFrame:
        """``(a, b, n)``: how many links of the corpus hold the pair."""
        return self.totals.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "n")


def count_pairs(docs: DataFrame, path_a: str, path_b: str) -> Counted:
    """Align the texts of ``docs(doc_id, text)`` and count the linked id pairs."""
    spark, pieces = docs.sparkSession, load_pieces(path_a, path_b)
    shared = spark.sparkContext.broadcast(pieces)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    both = stored(rows.mapInArrow(_align_blocks(path_a, path_b, shared), _BLOCKS), "aligned")
    blocks = both.where("block IS NOT NULL").drop("lo", "vector")
    vectors = both.where("lo IS NOT NULL").select("lo", F.posexplode("vector").alias("at", "n")).where("n > 0").groupBy((F.col("lo") + F.col("at")).alias("a")).agg(F.sum("n").alias("n"))
    # The map is as long as A's vocabulary.
    identity = spark.createDataFrame([(a, a << 16 | int(b)) for a, b in enumerate(pieces.identity) if b >= 0], "a int, pair long")
    exact = vectors.join(F.broadcast(identity), "a").select("pair", "n", F.lit(True).alias("exact"))
    irregular = blocks.select(F.inline(F.arrays_zip("pairs", "pair_counts"))).select(F.col("pairs").alias("pair"), F.col("pair_counts").alias("n"), F.lit(False).alias("exact")).where("n > 0")
    totals = irregular.unionByName(exact).groupBy("pair").agg(F.sum("n").alias("n"), F.max("exact").alias("exact"))
    return Counted(blocks, stored(totals, "pairs"), pieces)


def document_scores(counted: Counted) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    ``count_sum`` sums the corpus counts of a document's links, ``n_best`` counts the links whose
    count is the highest of their B id's, ties included.
    """
    spark, pieces = counted.totals.sparkSession, counted.pieces
    # Both vectors are as long as a vocabulary.
    exact_counts, best = np.zeros(len(pieces.a), np.int64), np.zeros(1 << 16, np.int64)
    for r in counted.totals.where("exact").select("pair", "n").collect():
        exact_counts[r.pair >> 16] = r.n
    for r in counted.totals.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r.b] = r.n
    shared = spark.sparkContext.broadcast((pieces.identity, exact_counts, best))
    asked = counted.blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(counted.totals.select("pair", "n"), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n")).alias("found"))
    return counted.blocks.drop("pair_counts").join(found, "block", "left").mapInArrow(_score(shared), _OUT)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """:func:`document_scores` of the texts of ``docs`` against the counts of the same texts.

    A text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens:
    zeros and an empty string. Rows that repeat count each; null doc_ids stay null; other columns are
    not read; an empty table gives no rows. A text's length has no bound but its task's memory.
    """
    return document_scores(count_pairs(docs, path_a, path_b))
