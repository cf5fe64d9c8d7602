from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, common

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, block long, word string"
ODD = [
    None, "", " ", "  ", "\n\t \n", "a", " a  b   c ", "It's he'll THE'S I'd've", "!!<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|> x", "<|endoftext", " <|endoftext|>!<|",
    "Ünï ß İ ſ", "3½ Ⅷ 42", "日本語、テスト。", "🙂🙂 👩‍👩‍👧", "a\x1cb\x85c d  e　　f", "x" * 9000, "' 's''s '", "́a é", "﻿a​b", "the the the " * 500,
]


def texts():
    rng = random.Random(6)
    alphabet = list("abAB'.,!|<> \n\t\xa0é3½中🙂-_") + ["<|endoftext|>", "  ", "the", "'ll"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(1500)]


def test_matches_the_library_on_whole_texts(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts())] + [(None, "no id", "", 0, ""), (3, "twice", "", 0, ""), (3, "twice", "", 0, "")]
    t = Tokenizer.from_file(PATH)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    got = bpe_codec.digest(spark.createDataFrame(rows, DOCS).repartition(5), PATH).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rows_without_a_fixed_order(spark):
    """The texts come in another order each time they are computed; ids still belong to their documents."""
    t = Tokenizer.from_file(PATH)
    base = [(i, f"word{i % 97} {'the ' * (i % 5)}né{i}!") for i in range(4000)]
    docs = spark.createDataFrame(base, "doc_id long, text string").repartition(6).orderBy(F.rand())
    texts_of = dict(base)
    for r in bpe_codec.round_trip(docs, PATH).collect():
        assert r.decoded == texts_of[r.doc_id] and r.ids == t.encode(r.decoded, add_special_tokens=False).ids


def test_empty_and_wordless_tables(spark):
    assert bpe_codec.digest(spark.createDataFrame([], DOCS), PATH).count() == 0
    got = bpe_codec.digest(spark.createDataFrame([(1, None, "", 0, ""), (2, "", "", 0, "")], DOCS), PATH).collect()
    assert [r.n_tokens for r in got] == [0, 0] and {r.decoded_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe_codec.added_tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_rows_of_files_are_not_stored_again(spark, tmp_path):
    rows = [(i, f"word{i % 7} and  l'été {i}", "", 0, "") for i in range(1300)] + [(3, None, "", 0, ""), (3, "again", "", 0, "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "d"))
    docs, before = spark.read.parquet(str(tmp_path / "d")), common.written()
    got = bpe_codec.digest(docs, PATH, from_files=True).collect()
    assert common.written() == before
    assert sorted(got) == sorted(bpe_codec.digest(docs, PATH).collect())


def test_blocks_are_bounded_in_documents_and_words():
    """A word is shuffled once a block: 2,000 short documents are one. Long ones are cut by their words, so a block stays small."""
    batch = lambda counts: pa.record_batch([pa.array(range(len(counts))), pa.array(range(len(counts))), pa.array([["a"] * n for n in counts])], ["row", "doc_id", "words"])
    short = [(at, b.num_rows) for at, b in bpe_codec._blocks(iter([batch([3] * 2500)]))]
    assert short == [(0, 2000), (2000, 500)]
    half, most = bpe_codec.BLOCK_WORDS // 2, bpe_codec.BLOCK_WORDS
    given = batch([1, half, half, 0, most + 5, 2, half])
    for b in (given, given.slice(1)):  # a slice's offsets do not begin at zero
        cut = [x for _, x in bpe_codec._blocks(iter([b]))]
        assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([b]))
        assert all(len(x.column(2).flatten()) <= most or x.num_rows == 1 for x in cut)
    assert [x.num_rows for _, x in bpe_codec._blocks(iter([given]))] == [2, 2, 1, 2]
