"""Exact top-k inner products by block-at-a-time pruning.

Candidates are stored in blocks of BLOCK consecutive ids, each with the forward index of its rows (the components, as one
matrix) and the largest and smallest value of every component. A query bounds each block by the sum of its term maxima:
per component, the larger of its products with the block's largest and smallest value. Blocks are scored from the highest
bound down, until the bound falls below the query's k-th score so far; bounds equal to it are still scored, for ties.

Blocks and query blocks meet on a grid of cells (block group, query group), each a task of bounded size; a cell gives its
k best for each query, and the best k of all cells are the result.

Left out: vectors that are null or hold null or non-finite components. Vectors meet only those of equal length. Rows that
share the query's id are its own and no candidates; a query row repeated with the same vector is answered once. Scores are
exact integers as long as they fit 64 bits. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE = 5, 256
#: Rows in a block, blocks in a cell, queries in a cell.
BLOCK, CELL_BLOCKS, CELL_QUERIES = 256, 64, 2048


def vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, key of the vector, its length and its integer components."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return df.filter(good).select(F.col(id_col).alias("id"), F.size(vec_col).alias("dim"), v.alias("v"))


def _matrix(rows) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray, most_q: float, most_x: float) -> np.ndarray:
    """Exact integer products of rows; as doubles where they are exact in them, which uses the fast routines."""
    if most_q * most_x * max(1, q.shape[1]) < 2**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[-k])
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_cell(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of each query within a cell: query places, candidate ids, scores; and the blocks scored.

    Queries that want the same block next are scored against it together.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(x, starts, axis=0)
    most_q, most_x = float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = _products(up, high, most_q, most_x) + _products(down, low, most_q, most_x)
    turn = np.argsort(-bound, axis=1, kind="stable")
    floor = np.iinfo(np.int64).min
    top_s, top_i = np.full((len(q), k), floor), np.full((len(q), k), np.iinfo(np.int64).max)
    filled, step, scored = np.zeros(len(q), dtype=np.int64), 0, 0
    live = np.arange(len(q))
    while len(live) and step < len(starts):
        want = turn[live, step]
        live = live[(filled[live] < k) | (bound[live, want] >= top_s[live, k - 1])]
        want = turn[live, step]
        for b in np.unique(want):
            who = live[want == b]
            lo, hi = starts[b], min(starts[b] + block, len(ids))
            s = _products(q[who], x[lo:hi], most_q, most_x)
            scored += len(who)
            for j, w in enumerate(who):
                own = ids[lo:hi] != q_ids[w]
                cs, ci = np.concatenate((top_s[w, : filled[w]], s[j][own])), np.concatenate((top_i[w, : filled[w]], ids[lo:hi][own]))
                at = best(cs, ci, k)
                filled[w] = len(at)
                top_s[w, : len(at)], top_i[w, : len(at)] = cs[at], ci[at]
        step += 1
    take = np.arange(k)[None, :] < filled[:, None]
    return np.nonzero(take)[0], top_i[take], top_s[take], scored


def search(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query."""
    q, x = (vectors(df, id_col, vec_col, scale) for df in (queries, candidates))
    q = q.distinct()
    n_q, n_x = q.count(), x.count()
    rows, cols = max(1, -(-n_x // (BLOCK * CELL_BLOCKS))), max(1, -(-n_q // CELL_QUERIES))
    low, high = x.agg(F.min("id"), F.max("id")).first()
    # document ranges: equal ranges of ids would be uneven where ids are, so ids are dealt by a hash of small id ranges
    group = F.pmod(F.xxhash64(F.floor((F.col("id") - F.lit(low or 0)) / BLOCK)), F.lit(rows)).cast("int")
    x = x.withColumn("row", group).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    q = q.withColumn("col", F.pmod(F.xxhash64("id"), F.lit(cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        at, ids, scores, _ = search_cell(left["id"].to_numpy(np.int64), _matrix(left["v"]), right["id"].to_numpy(np.int64), _matrix(right["v"]), k)
        return pd.DataFrame({"query_id": left["id"].to_numpy()[at], "q": left["v"].to_numpy()[at], "vec_id": ids, "score": scores})

    keys = ["row", "col", "dim"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(cell, "query_id long, q array<long>, vec_id long, score long")
    found = found.withColumn("q", F.xxhash64("q"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
