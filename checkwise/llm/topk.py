"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and deviation. For a segment
of w components, sum((q-x)^2) >= w * ((mq-mx)^2 + (sq-sx)^2), so the squared
distance has a lower bound that gets tighter with more, shorter segments. As
<q, x> = (|q|^2 + |x|^2 - |q-x|^2) / 2, a distance bound is a score bound:
<q, x> <= sum over segments of w * (mq*mx + sq*sx), one small matrix product
per level. Candidates go through the levels coarse to fine against the query's
k-th best score so far; only survivors get the exact integer product.

The queries are sent to the tasks in chunks of QUERY_BYTES at most; each chunk
meets every block of candidates once, and a task returns k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take
no part; only vectors of equal length are compared; a query is not compared
with rows of its own id; fewer than k candidates give fewer rows; equal scores
go to the smaller id; rows that repeat an id are separate candidates. Scaled
components must stay below 2^24 in magnitude, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkwise.llm.common import ship

SCALE = 1024
#: Bound of the queries in one broadcast.
QUERY_BYTES = 32 << 20
#: Segments per level, coarse to fine (fewer where a vector is shorter).
LEVELS = (1, 4, 16)
_BLOCK = 2048


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): sqrt(w) * mean and sqrt(w) * deviation of each segment."""
    edges = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(np.int64)
    x = x.astype(np.float64)
    width = np.maximum(np.diff(edges), 1)
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / width
    deviation = np.sqrt(np.maximum(square / width - mean * mean, 0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((width, width)))


class Best:
    """The k best (score, id) seen so far for each query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -(1 << 62))
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates given as parallel arrays (query index, score, id)."""
        rows = np.unique(q)
        old = np.repeat(rows, self.k)
        q = np.concatenate((old, q))
        score = np.concatenate((self.score[rows].ravel(), score))
        ids = np.concatenate((self.id[rows].ravel(), ids))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = place < self.k
        self.score[q[top], place[top]] = score[top]
        self.id[q[top], place[top]] = ids[top]


def search_block(best: Best, queries: np.ndarray, query_ids: np.ndarray, levels: list[np.ndarray],
                 x: np.ndarray, ids: np.ndarray) -> None:
    """Take a block of candidates into ``best``: bounds first, exact scores for survivors."""
    floor = best.floor().astype(np.float64)
    alive_q = np.arange(len(queries))
    alive = None
    for n, stats in zip(LEVELS, levels, strict=True):
        own = statistics(x, n)
        if alive is None:
            bound = stats[alive_q] @ own.T
            slack = 1e-9 * np.abs(bound) + 1e-3  # floating-point error of the bound
            alive = np.argwhere(bound + slack >= floor[alive_q][:, None])
        elif len(alive) > bound.size // 4:
            bound = stats @ own.T
            fine = bound[alive[:, 0], alive[:, 1]]
            alive = alive[fine + 1e-9 * np.abs(fine) + 1e-3 >= floor[alive[:, 0]]]
        else:
            fine = np.einsum("ij,ij->i", stats[alive[:, 0]], own[alive[:, 1]])
            alive = alive[fine + 1e-9 * np.abs(fine) + 1e-3 >= floor[alive[:, 0]]]
    q, c = alive[:, 0], alive[:, 1]
    other = query_ids[q] != ids[c]
    q, c = q[other], c[other]
    for lo in range(0, len(q), 1 << 16):
        qs, cs = q[lo:lo + (1 << 16)], c[lo:lo + (1 << 16)]
        score = np.einsum("ij,ij->i", queries[qs], x[cs])
        near = score >= best.floor()[qs]
        if near.any():
            best.add(qs[near], score[near], ids[cs][near])


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column without nulls."""
    at = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id_col, score): the k best inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    asked = good.filter(queries).select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).alias("v"))
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.sum(8 * F.size("v")).alias("bytes")).first()
    chunks = max(1, -(-(size["bytes"] or 0) // query_bytes))
    found = None
    for i in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(chunks)) == i)
        found_i = _search(good, spark.sparkContext.broadcast(
            [(r.q, np.array(r.v, np.float64)) for r in part.collect()]), k)
        found = found_i if found is None else found.unionByName(found_i)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _search(good: DataFrame, sent, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple] = {}
        for dim in {len(v) for _, v in sent.value}:
            rows = [(i, v) for i, v in sent.value if len(v) == dim]
            q = scaled(np.array([v for _, v in rows]).reshape(len(rows), dim))
            by_size[dim] = (np.array([i for i, _ in rows]), q, [statistics(q, n) for n in LEVELS], Best(len(rows), k))
        for batch in batches:
            values, at = _vectors(batch.column(1))
            ids, length = batch.column(0).to_numpy(), np.diff(at)
            for dim in np.unique(length).tolist():
                if dim not in by_size:
                    continue
                rows = np.flatnonzero(length == dim)
                query_ids, q, levels, best = by_size[dim]
                for lo in range(0, len(rows), _BLOCK):
                    some = rows[lo:lo + _BLOCK]
                    x = scaled(values[at[some][:, None] + np.arange(dim)])
                    for a in range(0, len(q), _BLOCK):
                        b = Best.__new__(Best)
                        b.k, b.score, b.id = k, best.score[a:a + _BLOCK], best.id[a:a + _BLOCK]
                        search_block(b, q[a:a + _BLOCK], query_ids[a:a + _BLOCK], [s[a:a + _BLOCK] for s in levels],
                                     x, ids[some])
        for query_ids, _, _, best in by_size.values():
            row, place = np.nonzero(best.id != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(best.id[row, place]),
                                              pa.array(best.score[row, place])], ["query_id", "id", "score"])

    return good.mapInArrow(run, "query_id long, id long, score long")
