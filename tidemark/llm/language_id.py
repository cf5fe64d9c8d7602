"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one linear classifier per bit predicts it from the hashed
character n-grams of a text. Decoding charges each language the exponential loss of every bit
against its codeword, weighted by how well the bit did on training texts kept back from its fit,
and takes the language with the least; texts whose two least losses are close are flagged.

The classifiers are fitted by ridge regression on a sample of labelled texts that is bounded per
language by a parameter; every text of the table is then scored whole, in the tasks that read it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts that each language teaches with at most; hashed n-gram dimensions; ridge penalty.
SAMPLE, DIMS, RIDGE = 1500, 1024, 1e-3
#: Labelled texts that teach in all (each 4 * DIMS bytes on the driver), and languages, at most.
ROWS, LANGUAGES = 12_000, 1000
#: Bits of a code where the two-way splits of the languages are too many to take all.
MIN_BITS, ALL_SPLITS = 15, 31
#: A text is ambiguous if its least loss is more than this share of the next.
AMBIGUOUS = 0.7
UNKNOWN = "und"
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Relative frequencies of hashed 1-, 2- and 3-grams of the lower-cased letters, words parted by one mark; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.concatenate(([np.uint32(0)], np.where(letter, c, np.uint32(0)), [np.uint32(0)])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    one = c * _PRIMES[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _PRIMES[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _PRIMES[2] + c[2:]
    places = np.concatenate((one[c != 0], two * _PRIMES[0], three * _PRIMES[0])) >> np.uint32(32 - dims.bit_length() + 1)
    return np.bincount(places, minlength=dims) / len(places)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one a language: every two-way split of the languages where they are few, else a seeded random code whose closest rows are far apart."""
    splits = 2 ** (n - 1) - 1
    if splits <= ALL_SPLITS:
        return np.array([[1.0, *(1.0 if s >> i & 1 else -1.0 for i in range(n - 1))] for s in range(splits)]).T.reshape(n, -1)
    rng, bits = np.random.default_rng(11), max(MIN_BITS, int(np.ceil(10 * np.log2(n))))
    draws = [np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0) for _ in range(100)]
    return min(draws, key=lambda m: np.max(m @ m.T - 2 * bits * np.eye(n)))


@dataclass(frozen=True)
class Model:
    """``weights`` and ``bias`` give a margin for each bit; ``trust`` is the weight of its loss."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, its share of the inverse losses, and whether it is ambiguous."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = np.clip(x @ self.weights + self.bias, -8, 8)
        loss = (np.exp(-self.codes * margin) * self.trust).sum(axis=1)
        best, second = np.argsort(loss, kind="stable")[:2]
        inverse = 1 / np.maximum(loss, 1e-12)
        return self.languages[best], float(inverse[best] / inverse.sum()), bool(loss[best] > AMBIGUOUS * loss[second])


def fit(languages: list[str], x: np.ndarray) -> Model:
    """Fit the bits on rows of features with their languages."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    if len(names) == 1:
        return Model(names, codes, np.zeros((x.shape[1], 0)), np.zeros(0), np.zeros(0))
    y = codes[[names.index(v) for v in languages]]
    per = np.bincount([names.index(v) for v in languages])
    share = np.array([1 / per[names.index(v)] for v in languages])
    share *= len(share) / share.sum()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-5)
    z = (x - mean) / scale

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zs, ys, s = z[rows], y[rows], share[rows][:, None]
        offset = (ys * s).sum(axis=0) / s.sum()
        return np.linalg.solve(zs.T @ (zs * s) + RIDGE * len(z) * np.eye(z.shape[1]), zs.T @ ((ys - offset) * s)), offset

    back = np.arange(len(z)) % 4 == 3
    w, offset = solve(~back) if (~back).any() else solve(back)
    wrong = (((z[back] @ w + offset) * y[back] <= 0) * share[back][:, None]).mean(axis=0) if back.any() else np.zeros(codes.shape[1])
    trust = 0.5 * np.log((1 - np.clip(wrong, 0.005, 0.45)) / np.clip(wrong, 0.005, 0.45))
    w, offset = solve(np.ones(len(z), bool))
    w = w / scale[:, None]
    return Model(names, codes, 3 * w, 3 * (offset - mean @ w), trust / trust.sum())


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, dims: int = DIMS, rows: int = ROWS) -> Model | None:
    """A model of the rows with ``may_learn``, a language and a letter. None if there is no such row.

    A language teaches with at most ``sample`` documents and its share of ``rows``, the first by a
    hash of their id. In each language that an id's rows have, the id counts once, however many rows
    repeat it: the row of the least hash of its text teaches. Rows without an id teach nothing. More
    than ``LANGUAGES`` languages are an error.
    """
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    hashed = usable.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.xxhash64("doc_id", F.lit("language")).alias("h"))
    # About how many ids a language has: ids whose hash is beyond twice the sample's share of them can't be among the first.
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = min(sample, max(1, rows // len(sizes)))
    known = docs.sparkSession.createDataFrame([(r.lang, r.n) for r in sizes], "lang string, n long")
    low = hashed.join(F.broadcast(known), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * each + 100)
    one = low.groupBy("doc_id", "lang", "h").agg(F.min("t").alias("t"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = one.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each).select("doc_id", "lang", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, v, x.astype(np.float32).tobytes()) for i, v, x in ((i, v, features(t, dims)) for i, v, t in zip(*(c.to_pylist() for c in b.columns), strict=True)) if x is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["doc_id", "lang", "x"])

    # At most each * LANGUAGES ids, so they are broadcast; rows that repeat one come down to one before the driver sees them.
    chosen = usable.withColumn("t", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "t"]).select("doc_id", "lang", "text")
    taught = sorted(chosen.mapInArrow(run, "doc_id long, lang string, x binary").dropDuplicates(["doc_id", "lang"]).collect())
    if not taught:
        return None
    return fit([r.lang for r in taught], np.array([np.frombuffer(r.x, np.float32) for r in taught], np.float64))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """``(<id_col>, lang_pred, score, ambiguous)`` of every row's whole text; texts that are null or have no letter are ``und`` with score 0, as is all without a model. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = []
            for t in b.column(1):
                x = features(t.as_py(), m.weights.shape[0]) if m else None
                found.append((UNKNOWN, 0.0, False) if x is None else m.decode(x))
            names, scores, flags = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, f"{id_col} long, lang_pred string, score double, ambiguous boolean")
