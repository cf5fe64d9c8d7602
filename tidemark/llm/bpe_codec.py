"""Byte-level BPE through a table of distinct words.

Spark splits the texts into the tokenizer's words and stores them, unless they come straight from files. Each block of documents becomes
a dictionary of its words and, per document, the dictionary places of its words in order. The
dictionaries' words are dealt by hash into one distinct-word table, so each word is encoded once in
the corpus however often it occurs; its ids are joined back to the blocks' places, and a block with
its dictionary yields the ids of its documents by position. Decoding joins every id of a dictionary
to the id-to-piece table where the block lies: the table's size is the vocabulary's, so it is
broadcast, and a dictionary's ids are looked up once a block.

What is shuffled is a word once a block, and places in a packed form, never a row per token.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Stands between packed words; no UTF-8 text has this byte.
_BETWEEN = b"\xff"
_WORDS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])
_CODES = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])
#: Documents of a block at most, and words unless one document has more. A word is shuffled once a block, so larger blocks shuffle less.
BLOCK, BLOCK_WORDS = 2000, 1 << 20


def added_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not spec["pre_tokenizer"].get("use_regex") or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} does not split words as byte-level BPE does")
    return [t["content"] for t in spec["added_tokens"]]


def split_words(text: Column, added: list[str]) -> Column:
    """The words the tokenizer merges within, in order; together they are the text. Added tokens are words, and end the text before them."""
    s = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) or "(?!)"
    # The word pattern of byte-level BPE, with added tokens set apart. Its choices
    # begin with different letters but for the last three, so the frequent ones stand first.
    pattern = rf"(?U) ?\p{{L}}++| ?\p{{N}}++|(?:{s})|'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?!{s})[^\s\p{{L}}\p{{N}}])++|\s+(?!(?!{s})\S)|\s+"
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id's piece."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 up.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max(ids.values()))
    for piece, i in ids.items():
        out[i] = bytes(byte[c] for c in piece)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of the stored words, each with the row number of its first row as its name."""
    for b in batches:
        ends, lo = b.column(2).offsets.to_numpy(), 0
        while lo < b.num_rows:
            fit = int(np.searchsorted(ends, ends[lo] + BLOCK_WORDS, side="right")) - 1 - lo
            part = b.slice(lo, max(1, min(BLOCK, fit)))
            yield part.column(0)[0].as_py(), part
            lo += part.num_rows


def _pack(places: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _dictionaries(parts: int):
    """The distinct words of each block by hash: a row for each part with its words and their places in the block's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches):
            words = b.column(2).flatten().unique().cast(pa.binary()).to_pylist()
            part = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            rows = []
            for seg in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(seg):
                    packed = zstandard.ZstdCompressor(level=3).compress(_BETWEEN.join([words[i] for i in seg.tolist()]))
                    rows.append({"part": int(part[seg[0]]), "block": block, "places": _pack(seg), "words": packed})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _WORDS)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its name, its documents, their counts of words and the packed places of the words."""
    for block, b in _blocks(batches):
        counts = np.diff(b.column(2).offsets.to_numpy()).astype(np.int32)
        places = b.column(2).flatten().dictionary_encode().indices.to_numpy()
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        yield pa.RecordBatch.from_arrays([pa.array([block]), one(b.column(1)), one(pa.array(counts)), pa.array([_pack(places)], pa.binary())], ["block", "ids", "counts", "places"])


def _encode(path: str):
    """Codes of the words of sorted parts. A part's distinct-word table lasts while its rows pass, so a word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        now, table = None, {}
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != now:
                    now, table = row["part"], {}
                words = zstandard.ZstdDecompressor().decompress(row["words"]).split(_BETWEEN)
                new = [w for w in words if w not in table]
                found = t.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                table.update((w, array("I", e.ids)) for w, e in zip(new, found, strict=True))
                own = [table[w] for w in words]
                sizes = np.fromiter(map(len, own), np.uint32, len(own))
                codes = np.frombuffer(b"".join(own), "<u4")
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "places": row["places"], "sizes": _pack(sizes), "codes": _pack(codes)}], _CODES)

    return run


def blocks(docs: DataFrame, path: str, from_files: bool = False) -> DataFrame:
    """One row for each block of documents: ``(block, ids, counts, places, dictionary)``.

    ``dictionary`` lists packed (places, sizes, codes) of the block's words. The words are read
    twice, and both readings must cut the same blocks, also where a task is computed again. So they
    are stored with a number for each row first, unless ``from_files`` says that ``docs`` are rows
    of files as they are read: those come in the same order each time, and are split twice instead.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), split_words(F.col("text"), added_tokens(path)).alias("words"))
    words = words if from_files else stored(words, "words")
    dictionaries = words.mapInArrow(_dictionaries(4 * parts), "part int, block long, places binary, words binary")
    placed = words.mapInArrow(_placed, "block long, ids array<long>, counts array<int>, places binary")
    coded = dictionaries.repartition("part").sortWithinPartitions("part").mapInArrow(_encode(path), "block long, places binary, sizes binary, codes binary")
    coded = coded.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("places", "sizes", "codes")).alias("dictionary"))
    return placed.repartition(parts, "block").join(coded, "block", "left")


def round_trip(docs: DataFrame, path: str, from_files: bool = False) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row's whole text: its token ids, and the text they decode to.

    Null and empty texts have no ids and decode to an empty text. Rows that repeat stay; null
    doc_ids stay null; other columns are not read; an empty table gives no rows. ``from_files`` is as for :func:`blocks`.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(piece_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        for b in batches:
            for ids, counts, packed, dictionary in zip(*b.columns, strict=True):
                places, counts, dictionary = _unpack(packed.as_py()), counts.values.to_numpy(), dictionary.as_py() or []
                size = sum(len(_unpack(d["sizes"])) for d in dictionary)
                if len(places) and places.max() >= size:
                    raise ValueError("a block has words that its dictionary lacks")
                coded, decoded = [b""] * size, [b""] * size
                for d in dictionary:
                    at, n, codes = _unpack(d["places"]).tolist(), _unpack(d["sizes"]), _unpack(d["codes"])
                    raw, each, end = codes.tobytes(), codes.tolist(), np.cumsum(n).tolist()
                    for p, lo, hi in zip(at, [0, *end], end):  # noqa: B905
                        coded[p], decoded[p] = raw[4 * lo : 4 * hi], b"".join([table[i] for i in each[lo:hi]])
                ends = np.cumsum(counts).tolist()
                own = [places[lo:hi].tolist() for lo, hi in zip([0, *ends], ends)]  # noqa: B905
                flat = [b"".join(map(coded.__getitem__, x)) for x in own]
                offsets = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(flat))]))
                text = pa.array([b"".join(map(decoded.__getitem__, x)).decode(errors="replace") for x in own], pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, lists, text], ["doc_id", "ids", "decoded"])

    found = blocks(docs, path, from_files).select("ids", "counts", "places", "dictionary")
    return found.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, from_files: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of :func:`round_trip`, of the decimal ids joined by commas and of the decoded text."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, path, from_files).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
