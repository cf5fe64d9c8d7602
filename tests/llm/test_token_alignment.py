from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n\t \n", "a", " a  b   c ", "It's he'll THE'S I'd've ", "!!<|endoftext|>", "a  <|endoftext|>  b", "<s>x</s> <unk> <0x0A>", "Ünï ß İ ſ", "3½ Ⅷ 42 ", "日本語、テスト。", "🙂🙂 👩‍👩‍👧",
    "a▁b c", "▁", "a\x1cb\x85c d  e　　f \x00 g", "x" * 9000, "aaaa aaaaa aaaaaa", "​  x ﻿  y", "a \n b \r\n  c\r d", "́ ", "the the the " * 500,
]


def brute(rows):
    """Whole texts through both libraries, all pairs of tokens held against each other."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    pieces = ta.load_pieces(A, B)
    docs, count = [], Counter()
    for i, text in rows:
        raw = f" {text}".encode()
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(pieces.a[t] for t in x) != raw or b"".join(pieces.b[t] for t in y) != raw:
            x, y = [], []

        def spans(ids, of):
            at, out = 0, []
            for t in ids:
                out.append((at, at + len(of[t]), t))
                at += len(of[t])
            return out

        sx, sy = spans(x, pieces.a), spans(y, pieces.b)
        cuts = sorted({e for _, e, _ in sx} & {e for _, e, _ in sy})
        groups, lo = [], 0
        links = []
        for hi in cuts:
            gx, gy = ([s for s in side if lo <= s[0] and s[1] <= hi] for side in (sx, sy))
            sx, sy = sx[len(gx) :], sy[len(gy) :]
            groups.append(",".join(str(t) for *_, t in gx) + "|" + ",".join(str(t) for *_, t in gy))
            links += [(p[2], q[2]) for p in gx for q in gy if p[0] < q[1] and q[0] < p[1]]
            lo = hi
        count.update(links)
        docs.append((i, len(x), len(y), groups, links))
    best = defaultdict(int)
    for (_, t), n in count.items():
        best[t] = max(best[t], n)
    return sorted(((i, n, m, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for i, n, m, g, k in docs), key=str), count


def corpus():
    rng = random.Random(5)
    letters = list(" \n\t  abcé  　\xa0!<s></s>'s12​日本語😀\x1c\x85") + ["<s>", "<unk>", "<|endoftext|>", "  ", "\r\n", "\r", "ing", " the"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    return [*rows, *((1000 + i, t) for i, t in enumerate(ODD)), (None, "the end"), rows[0], rows[0]]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK", 50)
    rows = corpus()
    counted = ta.count_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    wanted, count = brute(rows)
    assert sorted(map(tuple, ta.document_scores(counted).collect()), key=str) == wanted
    assert {(r.a, r.b): r.n for r in counted.pairs().collect()} == dict(count)


def test_identity_map_holds_one_to_one_groups(spark):
    """What the map names is counted by vector alone; a pair may still be in other groups too."""
    pieces = ta.load_pieces(A, B)
    counted = ta.count_pairs(spark.createDataFrame([(1, "the cat sat on the mat")], SCHEMA), A, B)
    exact = {(r.pair >> 16, r.pair & 0xFFFF) for r in counted.totals.where("exact").collect()}
    assert exact and all(pieces.identity[a] == b and pieces.a[a] == pieces.b[b] for a, b in exact)
    shuffled = {p for r in counted.blocks.collect() for p in r.pairs}
    assert not shuffled & {a << 16 | b for a, b in exact}


def test_memo_forgets_without_changing_results(monkeypatch):
    pieces = ta.load_pieces(A, B)
    texts = [s for _, t in corpus() for s in ta.segments(t)]

    def flat(found):
        own, whole = found
        return own.figures.tolist(), own.groups, own.exact.tolist(), own.exact_sizes.tolist(), own.pairs.tolist(), own.pair_sizes.tolist(), whole.tolist()

    monkeypatch.setattr(ta, "MEMO", 7)
    small = ta.Memo(A, B, pieces)
    for lo in range(0, 600, 5):
        part = list(dict.fromkeys(texts[lo : lo + 5]))
        assert flat(small.of(part)) == flat(ta.Memo(A, B, pieces).of(part)) if lo < 40 else len(small.of(part)[0].groups) == len(part)


def test_empty_table_and_extra_columns(spark):
    assert ta.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    got = ta.align_documents(spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, pairs string, block string"), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.first().n_a == 2
