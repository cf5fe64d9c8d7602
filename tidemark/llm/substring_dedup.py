"""Repeated passages by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Each window has a minimiser: the smallest hash
among its runs of ``seed_words`` words. Consecutive windows with the same minimiser form a
super-k-mer: a stretch of text that travels once, as one packed string, to the bucket of its
minimiser. Equal windows have equal minimisers, so a bucket that sorts its windows counts them
exactly. A super-k-mer goes on where the minimiser comes again, so a text of one word over and over
is cut into stretches of ``width`` windows, twice its size in all; such a stretch may hold equal
windows itself and counts as two.

Texts travel only where they may matter: references to all super-k-mers (a hash, a place) are counted
by minimiser first, and those whose minimiser occurs once in the corpus are settled by that.
A minimiser that occurs more often than ``bucket_rows`` is dealt over several buckets: a bucket
settles what repeats inside it and passes one copy of each of its windows on, and a grouped count
over those settles what repeats between buckets. So no task holds a passage that is everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shield, stored

#: Words that a window's minimiser hashes; super-k-mers that a bucket takes of one minimiser.
SEED_WORDS, BUCKET_ROWS = 6, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words that are hashed at once; longer texts go in overlapping stretches.
_STRETCH = 1 << 18


def _runs(words: list[bytes], width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window, last window, and whether the minimiser comes more than once, of every super-k-mer of one text's words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, n)
    seeds = n - m + 1
    g = h[:seeds].copy()
    for i in range(1, m):
        g = g * _MIX + h[i : i + seeds]
    g ^= g >> np.uint64(32)
    g *= _MIX
    g ^= g >> np.uint64(29)
    # Leftmost smallest of each stretch of `span` seeds, by doubling.
    span, at, have = width - m + 1, np.arange(seeds), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        have += step
    key, window = g[at], np.arange(len(at))
    starts = np.concatenate(([True], key[1:] != key[:-1]))
    into = window - np.maximum.accumulate(np.where(starts, window, 0))
    first = np.flatnonzero(starts | (into % width == 0))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    # Equal windows of one stretch hold the minimiser at two places, so their leftmost places differ.
    return key[first], first, last, at[first] != at[last]


def super_kmers(words: list[bytes], width: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_runs` of a whole text, in stretches that overlap by one window, so memory is bounded; stretches may cut a super-k-mer in two."""
    if len(words) <= _STRETCH:
        yield _runs(words, width, m)
        return
    for lo in range(0, len(words) - width + 1, _STRETCH):
        key, first, last, again = _runs(words[lo : lo + _STRETCH + width - 1], width, m)
        yield key, first + lo, last + lo, again


def references(keyed: DataFrame, width: int, m: int) -> DataFrame:
    """``(_sd_doc, _sd_text, key, at, n, weight)``: minimiser, first window and count of windows of every super-k-mer, and 2 where its minimiser comes again in it, else 1.

    A stretch cut makes two references of one minimiser position, which only raises a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                found, row = [], []
                for i, t in enumerate(part.column(2)):
                    for x in super_kmers((t.as_py() or "").encode().split(), width, m):
                        found.append(x)
                        row.append(np.full(len(x[0]), i))
                if found:
                    key, first, last, again = (np.concatenate(c) for c in zip(*found, strict=True))
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(key.view(np.int64)), pa.array(first), pa.array((last - first + 1).astype(np.int32)), pa.array(1 + again.astype(np.int32))], ["_sd_doc", "_sd_text", "key", "at", "n", "weight"])

    return keyed.select("_sd_doc", "_sd_text", "text").mapInArrow(run, "_sd_doc long, _sd_text long, key long, at long, n int, weight int")


def _windows(text: bytes, width: int) -> list[bytes]:
    """The windows of a packed string, in order, as slices of it."""
    starts, at = [0], text.find(b" ")
    while at >= 0:
        starts.append(at + 1)
        at = text.find(b" ", at + 1)
    ends = [s - 1 for s in starts[1:]] + [len(text)]
    return [text[s:e] for s, e in zip(starts, ends[width - 1 :])]  # noqa: B905


def _emit(width: int):
    """Pack the referenced super-k-mers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                row, refs, packed = [], [], []
                for i, (t, asked) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    words, at, n = t.as_py().encode().split(), asked.values.field("at").to_pylist(), asked.values.field("n").to_pylist()
                    packed += [b" ".join(words[s : s + k + width - 1]) for s, k in zip(at, n, strict=True)]
                    refs.append(asked.values)
                    row.append(np.full(len(at), i))
                if packed:
                    row, refs = pa.array(np.concatenate(row)), pa.concat_arrays(refs)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *(refs.field(c) for c in ("key", "salt", "dealt", "at")), pa.array(packed, pa.binary())], ["_sd_doc", "_sd_text", "key", "salt", "dealt", "at", "packed"])

    return run


def _settle(width: int):
    """Sort the windows of each bucket; ranges of those that repeat in it, and one copy of each window of a dealt bucket."""
    schema = pa.schema([("_sd_doc", pa.int64()), ("_sd_text", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("passed", pa.binary()), ("n", pa.int32())])

    def bucket(held: list[tuple]) -> list[tuple]:
        seen = sorted((w, doc, text, at + i) for _, doc, text, at, packed in held for i, w in enumerate(_windows(packed, width)))
        dealt, hits, out, lo = held[0][0], [], [], 0
        for hi in range(1, len(seen) + 1):
            if hi == len(seen) or seen[hi][0] != seen[lo][0]:
                if hi - lo > 1:
                    hits += [x[1:] for x in seen[lo:hi]]
                if dealt:
                    w, doc, text, at = seen[lo]
                    out.append((doc, text, at, at + width, w, min(2, hi - lo)))
                lo = hi
        hits.sort()
        for doc, text, at in hits:
            if out and out[-1][4] is None and out[-1][:2] == (doc, text) and at <= out[-1][3]:
                out[-1] = (doc, text, out[-1][2], at + width, None, 0)
            else:
                out.append((doc, text, at, at + width, None, 0))
        return out

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            for doc, text, key, salt, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, salt) != now:
                    if held:
                        out += bucket(held)
                    if len(out) > 5000:
                        yield pack(out)
                        out = []
                    now, held = (key, salt), []
                dealt, at, packed = rest
                held.append((dealt, doc, text, at, packed))
        if held:
            out += bucket(held)
        if out:
            yield pack(out)

    return run


def repeated_ranges(keyed: DataFrame, width: int, seed_words: int, bucket_rows: int) -> DataFrame:
    """``(_sd_doc, _sd_text, _sd_ranges)`` of the texts of ``keyed(_sd_doc, _sd_text, text)`` that hold a window which starts more than once in the table; ranges are ``(lo, hi)`` of words and may touch."""
    refs = stored(references(keyed, width, min(seed_words, width)), "references")
    # Stored, so that the join reads plain exchanges on both sides and a frequent key can be split.
    counts = stored(refs.groupBy("key").agg(F.sum("weight").alias("total")).where("total > 1"), "counts")
    deals = F.ceil(F.col("total") / bucket_rows)
    shared = refs.join(counts, "key").select(
        "_sd_doc",
        "_sd_text",
        F.struct("key", F.pmod(F.xxhash64("_sd_doc", "_sd_text", "at"), deals).cast("int").alias("salt"), (F.col("total") > bucket_rows).alias("dealt"), "at", "n").alias("ref"),
    )
    asked = shared.groupBy("_sd_doc", "_sd_text").agg(F.collect_set("ref").alias("_sd_refs"))
    # All columns come along, so that this join and the caller's read one and the same exchange.
    rest = [c for c in keyed.columns if c not in ("_sd_doc", "_sd_text", "text")]
    texts = keyed.join(asked, ["_sd_doc", "_sd_text"]).select("_sd_doc", "_sd_text", "text", "_sd_refs", *rest)
    travel = texts.mapInArrow(_emit(width), "_sd_doc long, _sd_text long, key long, salt int, dealt boolean, at long, packed binary")
    buckets = travel.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = buckets.mapInArrow(_settle(width), "_sd_doc long, _sd_text long, lo long, hi long, passed binary, n int")
    # Windows of dealt buckets meet by their words; a settled range stands alone.
    meet = Window.partitionBy(F.coalesce("passed", F.encode(F.concat_ws(" ", "_sd_doc", "_sd_text", "lo"), "UTF-8")))
    repeats = found.withColumn("total", F.sum("n").over(meet)).where("passed IS NULL OR (n = 1 AND total > 1)")
    return repeats.groupBy("_sd_doc", "_sd_text").agg(F.collect_list(F.struct("lo", "hi")).alias("_sd_ranges"))


def kept_words(words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words outside the ranges, and how many are inside."""
    out, at = [], 0
    for lo, hi in sorted(ranges):
        out += words[at:lo]
        at = max(at, hi)
    out += words[at:]
    return out, len(words) - len(out)


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and the blanks behind them."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, at = [], 0
    for lo, hi in sorted(ranges):
        out.append(raw[at : max(at, spans[lo][0])])
        at = max(at, spans[hi][0] if hi < len(spans) else len(raw))
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, width: int = 35, seed_words: int = SEED_WORDS, bucket_rows: int = BUCKET_ROWS, out: str = "ranges") -> DataFrame:
    """``docs`` with ``out``: the word ranges (null: none) that windows found twice or more cover.

    Every occurrence of such a window counts, in the same text too. Null and empty texts and texts
    shorter than a window have none; rows that repeat an id and text are each other's copies; null
    doc_ids are no obstacle. An empty table gives no rows. Columns of ``docs`` come through
    unchanged, but one of the name ``out`` is replaced.
    """
    docs, back = shield(docs.drop(out), "_sd_")
    keyed = docs.withColumns({"_sd_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_sd_text": F.xxhash64("text")})
    found = repeated_ranges(keyed, width, seed_words, bucket_rows)
    return keyed.join(found, ["_sd_doc", "_sd_text"], "left").drop("_sd_doc", "_sd_text").withColumnsRenamed({"_sd_ranges": out, **back})


def digest(docs: DataFrame, width: int = 35) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, r in zip(b.column(1), b.column(2), strict=True):
                words = (t.as_py() or "").encode().split()
                kept, n = kept_words(words, [(x["lo"], x["hi"]) for x in r.as_py() or ()])
                rows.append((len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = remove_repeats(docs.select(F.col("doc_id").cast("long"), "text"), width)
    return found.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
