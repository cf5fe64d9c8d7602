"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a TF-IDF vector over hashed terms: its words, the n-grams of its character classes
(which show symbol noise, shouting and tables), and terms that count repetition. A truncated
singular value decomposition of a bounded sample of labelled documents gives the latent space.
The sample's vectors are broadcast; every document's cosines with all of them are computed exactly,
in blocks, and its nearest neighbours vote with their similarities as weights.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents in the space at most (each 4 * RANK bytes when broadcast); latent dimensions; voters; documents multiplied at once.
SAMPLE, RANK, VOTERS, BLOCK = 4000, 48, 15, 256
#: Hashed dimensions of words, of class n-grams, and terms of repetition, with their weight.
WORD_DIMS, CLASS_DIMS, REPEATS, REPEAT_WEIGHT = 1024, 1024, 3, 4.0
DIMS = WORD_DIMS + CLASS_DIMS + REPEATS
#: Similarity below which a neighbour has no say.
_FLOOR = 1e-6


@functools.cache
def _classes() -> np.ndarray:
    """Lower-case letters, upper-case letters, digits and blanks are one class each; every ASCII mark is its own, other characters share one."""
    out = np.full(0x110000, 5, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 1 if x.isalpha() and not x.isupper() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x.isspace() else 16 + c if c < 128 else 5
    out[10] = 6
    return out


def features(text: str | None) -> np.ndarray:
    """Relative term frequencies, damped; zero for a text without words."""
    counts = np.zeros(DIMS, np.float64)
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return counts
    n = len(words)
    h = np.fromiter(map(xxhash.xxh32_intdigest, words, repeat(5)), np.uint32, n)
    counts[:WORD_DIMS] = np.bincount(h >> np.uint32(32 - 10), minlength=WORD_DIMS)
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = c[np.concatenate(([True], c[1:] != c[:-1]))]  # runs of a class are one
    grams = [c]
    for _ in range(3):
        last = grams[-1]
        if len(last) < 2:
            break
        grams.append(last[:-1] * np.uint32(2654435761) + c[len(c) - len(last) + 1 :])
    places = (np.concatenate(grams) * np.uint32(2246822519)) >> np.uint32(32 - 10)
    counts[WORD_DIMS : WORD_DIMS + CLASS_DIMS] = np.bincount(places, minlength=CLASS_DIMS)
    pairs = (h[1:].astype(np.uint64) << np.uint64(32)) | h[:-1]
    twice = [int((h[1:] == h[:-1]).sum()), len(pairs) - len(np.unique(pairs)), max(0, 20 - n)]
    counts[WORD_DIMS + CLASS_DIMS :] = twice
    return np.sqrt(counts / n)


@dataclass(frozen=True)
class Space:
    """``project`` takes TF-IDF terms to the latent space; ``vectors`` are the sample's, of length one, and ``labels`` theirs."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x @ self.project).astype(np.float32)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """The similarity-weighted mean label of each row's nearest neighbours; the prior where none is similar."""
        near = self.latent(x) @ self.vectors.T
        k = min(VOTERS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0) ** 4
        total = weight.sum(axis=1)
        return np.where(total > _FLOOR, (weight * self.labels[at]).sum(axis=1) / np.maximum(total, _FLOOR), self.prior)


def fit(x: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """The latent space of the rows of ``x``."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.5
    idf[WORD_DIMS + CLASS_DIMS :] *= REPEAT_WEIGHT
    z = x * idf
    rank = min(rank, *z.shape)
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(z @ rng.standard_normal((z.shape[1], min(rank + 16, *z.shape))))
    for _ in range(4):
        q, _ = np.linalg.qr(z @ (z.T @ q))
    _, _, vt = np.linalg.svd(q.T @ z, full_matrices=False)
    project = idf[:, None] * vt[:rank].T
    space = Space(project, np.zeros((0, rank), np.float32), labels, float(labels.mean()))
    return Space(project, space.latent(x), labels.astype(np.float64), float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE, rank: int = RANK) -> Space | None:
    """A space of at most ``sample`` rows with ``may_learn`` and a label, the first by a hash of their id; None if there is none.

    A document with contradicting labels, or none, teaches nothing. An id that several rows repeat
    teaches once, with the row of the least hash of its text.
    """
    sure = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may_learn).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").drop("most")
    ids = sure.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([features(t.as_py()).astype(np.float32).tobytes() for t in b.column(3)], pa.binary())], ["doc_id", "label", "t", "x"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("label").cast("int"), "t", "text")
    taught = chosen.mapInArrow(run, "doc_id long, label int, t long, x binary").groupBy("doc_id", "label").agg(F.min_by("x", "t").alias("x"))
    rows = sorted(taught.collect())
    if not rows:
        return None
    return fit(np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64), np.array([r.label for r in rows], np.float64), rank)


def classify(docs: DataFrame, space: Space | None, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """``(<id_col>, score, predicted)`` of every row's whole text; score is the weighted vote for label 1.

    Null and empty texts are scored by their lack of words like any other. Without a space every
    score is 0.5. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                score = s.vote(np.array([features(t.as_py()) for t in part.column(1)])) if s else np.full(part.num_rows, 0.5)
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, f"{id_col} long, score double, predicted int")
