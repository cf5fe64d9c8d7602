"""Exact top-k inner products by columnar branch and bound.

Vectors are quantised to integers and packed into blocks in vertical layout: one row of a block's
matrix is one dimension of all its vectors. For a query, scores accumulate dimension block by
dimension block, largest query mass first. After each, what a vector can still gain is bounded by
the product of the remaining norms; vectors whose best case is under the k-th best worst case are
dropped, and the survivors are compacted.

The stated queries go in waves of a bounded size: a wave is broadcast, and the tasks that read the
vectors hold each of their blocks against it where it lies, so vectors are never shuffled and a
query is sent once to an executor. What a task has found for a query bounds its search in the
task's next blocks. A task yields at most k rows a query, merged by one grouped sort.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Vectors in a block, bytes of the queries of a wave, and dimensions accumulated between two prunings.
VECTOR_BLOCK, WAVE_BYTES, STEP = 8192, 64 << 20, 8
_EXACT = 1 << 53


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with v = floor(scale * x) as longs; rows whose id, vector or a component is null, or not finite, are left out."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _by_length(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as rows of a matrix, for each length that occurs."""
    flat, off = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    sizes, ids = np.diff(off), ids.to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], flat[off[rows][:, None] + np.arange(n)]


def search_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its row and its k best ``(-score, id)`` in one vertical block, best first, ties to the smaller id, without the query's own id.

    ``least`` is what a query's k-th best of other blocks scores (None or -inf: nothing known);
    vectors that can't reach it may be left out.
    """
    dim, n = columns.shape
    largest = max(1, int(np.abs(columns).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, dim)
    exact = np.float64 if largest < _EXACT else object
    cols, real = columns.astype(exact), columns.astype(np.float64)
    for row, (q, own) in enumerate(zip(queries, query_ids, strict=True)):
        order = np.argsort(-np.abs(q), kind="stable")
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), exact)
        rest = (real * real).sum(axis=0)[alive]
        q_rest = float((q.astype(np.float64) ** 2).sum())
        floor = -np.inf if least is None else least[row]
        for lo in range(0, dim, STEP):
            dims = order[lo : lo + STEP]
            part = cols[np.ix_(dims, alive)]
            score = score + q[dims].astype(exact) @ part
            rest = rest - (real[np.ix_(dims, alive)] ** 2).sum(axis=0)
            q_rest -= float((q[dims].astype(np.float64) ** 2).sum())
            if lo + STEP < dim and len(alive):
                reach = np.sqrt(np.maximum(rest, 0) * max(q_rest, 0)) * (1 + 1e-9) + 1
                now = score.astype(np.float64)
                worst = np.partition(now - reach, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf
                worst = max(worst, floor)
                keep = now + reach >= worst - (np.abs(worst) * 1e-9 if np.isfinite(worst) else 0)
                if keep.sum() < len(alive):
                    alive, score, rest = alive[keep], score[keep], rest[keep]
        yield row, sorted(zip((-score).tolist(), ids[alive].tolist(), strict=True))[:k]


def _search_wave(wave: list[tuple[np.ndarray, np.ndarray]], k: int):
    """Holds every block of vectors against the wave's queries; yields each query's k best of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[[] for _ in ids] for ids, _ in wave.value]
        for b in batches:
            for lo in range(0, b.num_rows, VECTOR_BLOCK):
                part = b.slice(lo, VECTOR_BLOCK)
                for ids, v in _by_length(part.column(0), part.column(1)):
                    for (query_ids, q), own in zip(wave.value, best, strict=True):
                        if q.shape[1] != v.shape[1]:
                            continue
                        least = np.array([-float(x[-1][0]) if len(x) == k else -np.inf for x in own])
                        for row, found in search_block(q, query_ids, np.ascontiguousarray(v.T), ids, k, least):
                            own[row] = sorted(own[row] + found)[:k]
        clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, -int(s)))
        rows = [(int(q), int(i), clamp(s)) for (ids, _), own in zip(wave.value, best, strict=True) for q, x in zip(ids, own, strict=True) for s, i in x]
        found = np.array(rows, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's k best integer inner products over all other rows.

    Fewer than k rows where there are fewer candidates. Vectors of another length than the query's
    are no candidates of it. Rows that repeat an id are all candidates, and none of them is a
    candidate of the query of that id; a repeated query id is searched once, with its least vector.
    Scores outside the range of a long are clamped to it. Empty tables and tables without queries
    give no rows. Other columns are ignored.

    A wave holds at most about ``wave_bytes`` of queries, which pass the driver; the vectors are
    read once a wave, and only each task's best are shuffled.
    """
    ints = stored(quantise(vectors, id_col, vec_col, scale), "ints")
    asked = stored(ints.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "asked")
    counts = ints.agg(F.count("*").alias("n")).first()
    size = asked.agg(F.sum(16 + 8 * F.size("v").cast("long")).alias("n")).first().n or 0
    waves = 1 + size // max(1, wave_bytes // 2)
    tasks = 1 + counts.n // VECTOR_BLOCK
    sc, found = vectors.sparkSession.sparkContext, []
    for w in range(waves):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).toArrow().combine_chunks()
        blocks = [x for b in mine.to_batches() for x in _by_length(b.column(0), b.column(1))]
        if blocks or not w:
            found.append(ints.coalesce(tasks).mapInArrow(_search_wave(sc.broadcast(blocks), k), "query_id long, vec_id long, score long"))
    local = functools.reduce(DataFrame.unionByName, found)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
