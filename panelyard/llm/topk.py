"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks, queries into blocks of their own, and every pair of blocks meets in one task.  There each
dimension's list of the candidate block is sorted once; a query goes down its lists together (from the top where its
component is positive, from the bottom where it is negative), scores what it meets for the first time, and stops when the
sum of the components last met cannot reach its kth score, so equal scores with smaller ids are never missed.  The blocks'
answers, k rows for each query and block, are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import kept

#: Candidates of a block, queries of a block; a block of each meets in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 32_768, 8192
#: Fewer candidates make no block of their own for the sake of more tasks.
LEAST_BLOCK = 4096
_FIRST_DEPTH = 16
#: Fixed value: scores beyond it either way are reported as it; the largest double that a long can hold.
_MOST_SCORE = 2**63 - 1024


def threshold_search(lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best by score, then smaller id.  lists: argsort of each column of ``vectors``; own: rows to pass over."""
    n = len(vectors)
    dims = np.flatnonzero(query)
    up = query[dims] < 0
    seen, done = own.copy(), 0
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    if not len(dims):  # all scores are 0: the smallest ids
        first = np.sort(ids[~seen])[:k]
        return first, np.zeros(len(first))
    depth = min(_FIRST_DEPTH, n)
    while True:
        met = np.concatenate([lists[done:depth][:, dims[up]].ravel(), lists[n - depth : n - done][:, dims[~up]].ravel()])
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, vectors[rows] @ query])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        if depth == n:
            return best_ids, best
        at = np.where(up, lists[depth - 1, dims], lists[n - depth, dims])
        if len(best) == k and best[-1] > vectors[at, dims] @ query[dims]:
            return best_ids, best  # a row not met yet scores less than the kth
        done, depth = depth, min(2 * depth, n)


def _padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def exact_search(vectors: list[list[int]], ids: np.ndarray, query: list[int], own: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Score, id of the k best where components are too large for doubles: whole numbers, clipped to +-_MOST_SCORE."""
    found = [(max(-_MOST_SCORE, min(_MOST_SCORE, sum(a * b for a, b in zip(v, query, strict=True)))), int(i)) for v, i, o in zip(vectors, ids, own, strict=True) if not o]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def top_k(vectors: DataFrame, query_modulus: int = 50, k: int = 5, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``query_modulus``, against all other rows.

    A vector's components are floor(256 * x), x as double (doubles of 2**53 and more are whole already); the score is their
    inner product, exact whatever its size, and clipped to +-(2**63 - 1024) before the ranking.  Vectors that are null or hold null or
    non-finite components (256 * x included) take no part, nor do rows without an id; a shorter vector is filled up with zeros.
    Rows are told apart, not ids: a repeated row is a candidate of its twin, and as a query has its own k rows.  Equal scores
    go to the smaller id; a query with fewer than k candidates gets all; an empty table gives no rows.
    """
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    finite = F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("w", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    numbered = given.select("vec_id", scaled.alias("w")).where(finite).select("vec_id", F.monotonically_increasing_id().alias("row_id"), whole.alias("v"))
    valid = kept(numbered, "top-k-rows")  # both sides must see the same numbers
    n = valid.count()
    n_blocks = max(1, -(-n // block_vectors), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    n_query_blocks = max(1, -(-n // (query_modulus * block_queries)))
    deal = lambda count: F.pmod(F.xxhash64("vec_id", "row_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = valid.select("vec_id", "row_id", "v", deal(n_blocks).alias("block"), every(n_query_blocks).alias("query_block"))
    queries = valid.where(F.col("vec_id") % query_modulus == 0).select(F.col("vec_id").alias("query_id"), F.col("row_id").alias("query_row"), F.col("v").alias("q"), deal(n_query_blocks).alias("query_part"), every(n_blocks).alias("part"))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(asked) and len(held):
            width = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for column in (asked["q"], held["v"]) for c in column.chunks)
            q, x, ids, own = _padded(asked["q"], width), _padded(held["v"], width), held["vec_id"].to_numpy(), held["row_id"].to_numpy()
            most = np.sqrt(2.0**53 / max(width, 1))  # up to here sums of products are exact in doubles
            plain = np.abs(x).max(1, initial=0) <= most
            large = [list(map(int, v)) for v in x[~plain]]
            near, near_ids, near_rows = x[plain], ids[plain], own[plain]
            lists = np.argsort(near, axis=0, kind="stable").astype(np.int32)
            for query_id, row_id, query in zip(asked["query_id"].to_pylist(), asked["query_row"].to_pylist(), q, strict=True):
                mine = list(map(int, query)) if large or np.abs(query).max(initial=0) > most else []
                if np.abs(query).max(initial=0) <= most:
                    found, scores = threshold_search(lists, near, near_ids, query, near_rows == row_id, k) if len(near) else ([], [])
                    best = [(int(s), int(i)) for i, s in zip(found, scores, strict=True)]
                else:
                    best = exact_search([list(map(int, v)) for v in near], near_ids, mine, near_rows == row_id, k)
                if large:
                    best = sorted(best + exact_search(large, ids[~plain], mine, own[~plain] == row_id, k), key=lambda y: (-y[0], y[1]))[:k]
                rows += [(query_id, row_id, i, s) for s, i in best]
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(("query_id", "query_row", "vec_id", "score"))})

    both = queries.groupBy("part", "query_part").cogroup(candidates.groupBy("block", "query_block"))
    found = both.applyInArrow(meet, "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
