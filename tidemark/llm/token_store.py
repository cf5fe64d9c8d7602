"""Token ids as ORC files in ascending document order.

Documents are range-partitioned by id and sorted, encoded inside their partition, and written as
ORC: the ids are an integer list, so the writer run-length encodes them per stripe; doc_id has a
Bloom filter and row indexes, and the ascending order makes stripe and row-group minima and maxima
disjoint, so a lookup of a document or a range touches few row groups and stripes are read in
parallel. ``part`` and ``at`` place a row in the whole order without reading its ids.

Texts are cut before encoding at ASCII blanks and beside ASCII marks, which no token of the
tokenizer crosses. A group of texts is cut and put together again in vectors; each worker keeps the
ids of the pieces it has met, and the new ones of a group are encoded in one call.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path

#: Pieces that a worker remembers in a generation, of which it holds two at most; and how many new words one call of the tokenizer takes.
PIECES, WORDS = 300_000, 5_000
#: Bytes of the longest piece that is remembered; longer ones are encoded whenever a group has them.
LONGEST = 64
#: Bytes of text that are cut and encoded together; a longer text is alone.
GROUP = 1 << 20
#: Characters of a text that join the doc_id in the range bounds.
HEAD = 128
#: ASCII marks that end a word for the tokenizer (the apostrophe doesn't).
_MARKS = b".,;:!?|%&*#$()\"-+=@"
# Lower-case Latin letters: a-z and those of two bytes up to y with diaeresis.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
# What a byte is: a blank, a mark, an A-Z or a-z letter or a digit, the second byte of a Latin letter, or anything else.
_BLANK, _MARK, _ALNUM, _SECOND, _ELSE = range(5)
_KIND = np.full(256, _ELSE, np.uint8)
for _kind, _of in ((_BLANK, b" \t\n\v\f\r"), (_MARK, _MARKS), (_ALNUM, bytes(b for b in range(128) if chr(b).isalnum())), (_SECOND, bytes([*range(0x9F, 0xB7), *range(0xB8, 0xC0)]))):
    _KIND[list(_of)] = _kind
_LOW = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# Byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 up. Of a Latin letter's bytes, only these do.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_MOVED = [(chr(b), chr(letter)) for b, letter in _BYTE_LETTERS.items() if b >= 0x9F]
_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def check_tokenizer(path: str) -> None:
    """Only a tokenizer that drops white space before its merges can be fed piece by piece."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if not any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps) or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} keeps white space, so texts can't be encoded piece by piece")


class Memo:
    """What ``make`` gives for each key, remembered in two generations of ``limit`` keys: what was used since the older one was closed stays."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], limit: int) -> None:
        self.make, self.limit, self.now, self.old = make, limit, {}, {}

    def __len__(self) -> int:
        return len(self.now)

    def get(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys. A generation outgrows ``limit`` only by keys of one call."""
        found = list(map(self.now.get, keys))
        holes = [i for i, x in enumerate(found) if x is None]
        if len(self.now) + len(holes) > self.limit:
            self.now, self.old, holes = {}, self.now, range(len(keys))
        for i in holes:
            found[i] = self.old.get(keys[i])
        unmet = [i for i in holes if found[i] is None]
        for i, x in zip(unmet, self.make([keys[i] for i in unmet]), strict=True):
            found[i] = x
        self.now.update({keys[i]: found[i] for i in holes if len(keys[i]) <= LONGEST})
        return found


def cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts that lie end to end in ``raw``, A-Z lowered, and how many come before each of ``bounds``.

    Texts are cut at blanks, and on both sides of all the marks between a Latin letter or a digit
    and a blank, an end, A-Z or a digit: there the tokenizer cuts too. A blank-separated piece that
    may hold a special token stays as it is, and so does one with accents of their own, which may
    join a capital otherwise than its small letter.
    """
    kind, low, size = _KIND[raw], _LOW[raw], len(raw)
    first = np.zeros(size + 1, bool)
    first[bounds] = True
    filled = kind != _BLANK
    start = filled.copy()
    start[1:] &= first[1:-1] | ~filled[:-1]
    mark = kind == _MARK
    edge = np.ones(size + 1, bool)  # the kind changes from or to a mark, or the text
    edge[1:-1] = first[1:-1] | (mark[1:] != mark[:-1])
    lo, hi = np.flatnonzero(mark & edge[:-1]), np.flatnonzero(mark & edge[1:]) + 1
    before, after = kind[lo - 1], kind[np.minimum(hi, size - 1)]
    cuts = ~first[lo] & ((before == _ALNUM) | ((before == _SECOND) & (raw[np.maximum(lo - 2, 0)] == 0xC3)))
    cuts &= first[hi] | (after == _BLANK) | (after == _ALNUM)
    odd = (raw == 0xCC) | (raw == 0xCD)
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    if odd.any():
        whole = np.append(np.flatnonzero(start), size)
        at = np.unique(np.searchsorted(whole, np.flatnonzero(odd), "right"))
        keep = np.zeros(size + 1, np.int8)
        keep[whole[at - 1]] += 1
        keep[whole[at]] -= 1
        kept = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        low[kept] = raw[kept]
        cuts &= ~kept[lo]
    start[lo[cuts]] = True
    start[hi[cuts & ~first[hi]]] = True
    start &= filled
    offsets = np.append(np.flatnonzero(start[filled]), np.count_nonzero(filled)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[filled])])
    return pieces, np.searchsorted(np.flatnonzero(start), bounds)


class PieceEncoder:
    """Encodes texts through the ids of their pieces.

    The tokenizer parts marks from words and lowers letters, and so do the pieces: a word is encoded
    once whatever its case and what follows it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The merges alone, over words parted by blanks.
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        for t in (self.tokenizer, self.merges):
            t.no_truncation()
            t.no_padding()
        # The ids that a word ends with, where the model marks them.
        suffix, vocab = spec["model"].get("end_of_word_suffix"), self.merges.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.pieces = Memo(self.make, PIECES)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of lower-case Latin letters: the steps before the merges leave those as they are, so they go to the merges at once."""
        letters = b" ".join(words).decode("latin-1")
        for byte, letter in _MOVED:
            letters = letters.replace(byte, letter)
        ids = np.array(self.merges.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self.others(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def others(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in found]

    def make(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as unsigned 32-bit bytes; a call of the tokenizer takes at most ``WORDS`` of them."""
        plain = [p for p in pieces if _PLAIN(p)]
        other = list(set(pieces).difference(plain))
        found: dict[bytes, bytes] = {}
        for own, encode in ((plain, self.words), (other, self.others)):
            for lo in range(0, len(own), WORDS):
                some = own[lo : lo + WORDS]
                found.update(zip(some, encode(some), strict=True))
        return [found[p] for p in pieces]

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By groups of texts: how many, all their ids, and the ids before each text and in all."""
        if not len(texts):
            return
        texts = texts.cast(pa.binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP, "right")) - 1)
            a, b = bounds[lo], bounds[hi]
            if a == b:
                yield hi - lo, np.zeros(0, np.int32), np.zeros(hi - lo + 1, np.int64)
            else:
                pieces, before = cut(np.frombuffer(texts.buffers()[2], np.uint8)[a:b], bounds[lo : hi + 1] - a)
                coded = pieces.dictionary_encode()
                ids = self.pieces.get(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))
                found = lists.take(coded.indices)
                yield hi - lo, found.flatten().to_numpy(), found.offsets.to_numpy()[before].astype(np.int64)
            lo = hi

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit bytes."""
        found = self.groups(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for _, ids, at in found for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One a worker: what it has met serves the worker's later tasks."""
    return PieceEncoder(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Encode every row's text, append ``end_id`` and write ORC files in ascending doc_id order.

    Null and empty texts get the end id alone; null doc_ids come first; rows that repeat a doc_id
    are kept in the order of their texts; an empty table writes files without rows. Other columns
    are ignored.
    """
    check_tokenizer(tokenizer_path)
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        groups, part, at = encoder(tokenizer_path).groups, TaskContext.get().partitionId(), 0
        for b in batches:
            lo = 0
            for k, ids, before in groups(b.column(1)):
                n = np.diff(before) + 1
                flat = np.insert(ids, before[1:], end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k), pa.array(np.full(k, part, np.int32)), pa.array(np.arange(at, at + k)), pa.array(n), lists], ["doc_id", "part", "at", "n_tokens", "ids"])
                lo, at = lo + k, at + k

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The head of the text parts rows that share an id, in the order that their whole texts have.
    head = F.substring("text", 1, HEAD)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", head).sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(run, _SCHEMA)
    (
        out.write.option("orc.compress", "ZSTD")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "2000")
        .option("orc.stripe.size", str(16 << 20))
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id are pushed to stripes, row groups and Bloom filters."""
    return spark.read.schema(_SCHEMA).orc(path)


def digest(stored: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of stored rows; start counts the ids of all rows before, in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, off = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            view = memoryview(flat).cast("B")
            crc = pa.array([zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off).astype(np.int64)), crc], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "part", "at", "ids").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    # The part sums come from the stored counts alone; the files' other columns are not read for them.
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    run_in_part = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(run_in_part), F.lit(0)))
    return placed.join(bases, "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write to a new folder of the shared scratch space, and digest what is read back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return digest(read(docs.sparkSession, path))
