from __future__ import annotations

import random
import struct
import sys
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_store
from tidemark.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, part int, at long, ids string"
ODD = [
    None, "", " ", "\n\t", "a", "It's he'll THE'S", "***", "a,,b ,c..", "x ,̈ y", "Ünï Ü ẞ İ ſ K", "<|endoftext|> <|startoftext|>x", "<|ENDOFTEXT|>,",
    "a b c d", "x\x1cy\x85z", "42,7 3½ Ⅷ.", "日本語、テスト。", "🙂🙂,", "é, É.", "a…,b…,", "don't,' ''s, 's.", "٣٤,", "q" * 5000,
]


def texts():
    rng = random.Random(4)
    alphabet = list("abcABC'.,!|<> \n\té́ß3½中🙂-_") + ["the ", "<|", "|>", " "]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_pieces_encode_as_whole_texts():
    whole, pieces = Tokenizer.from_file(PATH), token_store.PieceEncoder(PATH)
    for t in (texts()[:300], texts()):
        for text, got in zip(t, pieces.encode(t), strict=True):
            want = whole.encode(text or "", add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_memo_forgets_in_generations(monkeypatch):
    monkeypatch.setattr(token_store, "PIECES", 50)
    monkeypatch.setattr(token_store, "WORDS", 20)
    whole, pieces = Tokenizer.from_file(PATH), token_store.PieceEncoder(PATH)
    for text in texts()[:400] + ["Élève élève ÉLÈVE naïve, façon. straße; ÿ × ÷ Ø ø"]:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert pieces.encode([text])[0] == struct.pack(f"<{len(want)}I", *want), repr(text)
        assert len(pieces.pieces) <= 50 and len(pieces.pieces.old) <= 50


def test_white_space_keeping_tokenizer_is_refused():
    with pytest.raises(ValueError):
        token_store.check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip_and_pruned_read(spark):
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts())] + [(5, "again", 1, 2, None), (None, "no id", 1, 2, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    whole, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = token_store.round_trip(df, PATH, 2).collect()
    assert sorted(got, key=lambda r: r.start) == want

    path = new_path(spark, "test-tokens")
    token_store.write(df, path, PATH, 2, partitions=3)
    one = token_store.read(spark, path).where("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    assert len(one.collect()) == 1


def test_files_hold_what_pruning_needs(spark):
    """Row groups with minima and maxima, and Bloom filters, as the files' footers state them; and what a lookup skips."""
    path = new_path(spark, "test-orc")
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('w', id) AS text")
    token_store.write(docs, path, PATH, 2, partitions=2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    files = [f.getPath() for f in fs.Path(path).getFileSystem(conf).listStatus(fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    assert len(files) == 2
    seen = []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, batch_rows = reader.rows(), []
        assert reader.getRowIndexStride() == 2000 and reader.getNumberOfRows() > 6000
        column = next(i for i, n in enumerate(reader.getSchema().getFieldNames()) if n == "doc_id")
        kind = reader.getSchema().getChildren().get(column).getId()
        wanted = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
        wanted[kind] = True
        index = rows.readRowIndex(0, wanted, wanted)
        group = index.getRowGroupIndex()[kind]
        bounds = [(e.getStatistics().getIntStatistics().getMinimum(), e.getStatistics().getIntStatistics().getMaximum()) for e in group.getEntryList()]
        assert len(bounds) >= 3 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))  # noqa: B905
        bloom = index.getBloomFilterIndex()[kind]
        assert bloom.getBloomFilterCount() == len(bounds)
        seen.append((bounds[0][0], bounds[-1][1]))
    assert sorted(seen)[0][1] < sorted(seen)[1][0]
    # 17 lies within the bounds of a row group, but no document has it: the Bloom filter lets no row through.
    scan = token_store.read(spark, path).where("doc_id = 17")
    assert scan.count() == 0 and token_store.read(spark, path).where("doc_id = 18").count() == 1


def test_repeated_ids_spread(spark):
    docs = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat(id, ' word') AS text")
    path = new_path(spark, "test-null-ids")
    token_store.write(docs, path, PATH, 2, partitions=4)
    parts = [r["count"] for r in token_store.read(spark, path).groupBy("part").count().collect()]
    assert len(parts) == 4 and max(parts) < 10_000


def test_empty_table(spark):
    assert token_store.round_trip(spark.createDataFrame([], DOCS), PATH, 2).count() == 0


def test_capitals_with_accents_of_their_own():
    """h and a line below are one letter, but H and that line have none: a capital may only be lowered after the two were joined."""
    whole, pieces = Tokenizer.from_file(PATH), token_store.PieceEncoder(PATH)
    for text in ("H̱", "ẖ", "aH̱, b", "T̈,W̊ Y̊.", "J̌≠ J̌", "Å å Bc,D̸"):
        want = whole.encode(text, add_special_tokens=False).ids
        assert pieces.encode([text])[0] == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_texts_cut_together_encode_as_one_by_one(monkeypatch):
    whole, pieces = Tokenizer.from_file(PATH), token_store.PieceEncoder(PATH)
    alone = ["*", "<", "é", "|", "é,", ",é", "a,b;C--d 1,2", "A,'s b'.", "x*×y ÷,", "İ,K", "<|endoftext|>,A H̱ B,C", "a..'b", "ß.ß"]
    for group in (1, 40, 1 << 20):
        monkeypatch.setattr(token_store, "GROUP", group)
        for texts_ in ([t] for t in alone):
            assert pieces.encode(texts_)[0] == struct.pack(f"<{len(w := whole.encode(texts_[0], add_special_tokens=False).ids)}I", *w), texts_
        for t, got in zip(alone + texts(), pieces.encode(alone + texts()), strict=True):
            want = whole.encode(t or "", add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(want)}I", *want), repr(t)


def test_new_words_cost_few_calls():
    """Words are cut and encoded together: a new one costs two or three calls, not a chain of them."""
    rng, pieces, calls = random.Random(8), token_store.PieceEncoder(PATH), 0
    docs = [" ".join("".join(rng.choices("aeinorst", k=9)) + rng.choice(["", "", ",", "."]) for _ in range(100)) for _ in range(200)]

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        pieces.encode(docs)
    finally:
        sys.setprofile(None)
    assert calls < 4 * 20_000


def test_long_pieces_are_not_remembered():
    """The memory is bounded in bytes, too: texts without blanks are long pieces."""
    pieces = token_store.PieceEncoder(PATH)
    pieces.encode(["中文" * 500, "word"])
    assert max(map(len, pieces.pieces.now)) <= token_store.LONGEST
