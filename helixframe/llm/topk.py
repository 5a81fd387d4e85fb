"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt to blocks by a hash of their id. In a block each dimension has its list sorted by
value. Sorted access goes down all lists together, from the end that helps the query (high values for
positive weights, low for negative ones); a row that is met for the first time is scored by random access. The
bound on any row not yet met is the sum over dimensions of weight times the list's value at this depth. A
query stops when its kth best score beats that bound. Scoring exactly needs whole numbers, so components are
turned into ``floor(scale * x)`` first and a tie at the bound does not stop a query.

There are two passes. The first searches one block only, which gives each query a kth score that is a floor for its kth
score over all blocks. In the second pass a query starts every other block with that floor, so that it stops as soon as the
bound falls below it, even in a block that holds none of its best rows.

Queries of a batch go down the lists together: the rows met by any of them are scored for all that still run in one
matrix product, which only adds rows to a query and so keeps its bound valid. Blocks and batches are sized by
``block_rows`` and ``batch_queries``; each pair is one task's work. The best k of each block are merged by a
ranked window.

How much the stop spares is a matter of the data: a query meets the more rows the more dimensions carry weight
alike. On vectors spread evenly over many dimensions (64 of unit length, say) the bound stays above every score until all rows
have been met, and the work is that of the full product; few or unequal dimensions stop early. ``search_work`` counts it.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do ids that
are null; ties go to the smaller id; repeated ids are rows of their own, and a query's own rows (all with its
id) are no candidates; vectors of different lengths never meet; fewer than k candidates are all returned; an empty
table gives an empty table; other columns are not read. Scores must stay within a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, v) with v the whole numbers floor(scale * x), of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)
    return rows.select("vec_id", F.size("x").alias("dims"), F.transform("x", lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def threshold_topk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, first_depth: int = 64, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row id, score) of each query's k best rows, by the threshold algorithm, and (rows scored, depth) of each query; whole numbers.

    ``floors``: a score for each query below which no row is wanted; rows below it may be left out.
    """
    n, dims = rows.shape
    work = np.zeros((len(queries), 2), dtype=np.int64)
    if not n or not len(queries):
        return *(np.zeros(0, np.int64) for _ in range(3)), work
    by_id = np.argsort(ids, kind="stable")  # positions then stand in the order of ids
    ids, rows = ids[by_id], rows[by_id]
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, dims)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # exact in each case
    nothing = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    x, q = rows.astype(kind), queries.astype(kind)
    up = np.argsort(rows, axis=0, kind="stable")  # each dimension's list, ascending
    values = np.take_along_axis(rows, up, axis=0)
    uses = ((queries > 0).any(axis=0), (queries < 0).any(axis=0))
    floor = np.full(len(queries), np.iinfo(np.int64).min) if floors is None else floors
    best, at = np.full((len(queries), k), nothing, dtype=kind), np.zeros((len(queries), k), dtype=np.int64)
    met, live, depth, step = np.zeros(n, dtype=bool), np.arange(len(queries)), 0, first_depth
    while len(live) and depth < n:
        end = min(n, depth + step)
        touched = np.zeros(n, dtype=bool)
        touched[up[n - end : n - depth, uses[0]].ravel()] = True
        touched[up[depth:end, uses[1]].ravel()] = True
        # at the end of the lists also the rows that only lists of weight 0 hold
        new = np.flatnonzero(~met) if end == n else np.flatnonzero(touched & ~met)
        met[new] = True
        work[live] += (len(new), end - depth)
        if len(new):
            scored = q[live] @ x[new].T
            scored[query_ids[live][:, None] == ids[new][None, :]] = nothing
            best[live], at[live] = _best(np.concatenate([best[live], scored], axis=1), np.concatenate([at[live], np.broadcast_to(new, scored.shape)], axis=1), k)
        depth, step = end, step * 2
        if depth < n:
            w = queries[live]
            bound = np.where(w > 0, w * values[n - depth], w * values[depth - 1]).sum(axis=1)
            full = best[live, k - 1] != nothing
            live = live[~((floor[live] > bound) | (full & (best[live, k - 1] > bound)))]
    row, col = np.nonzero(best != nothing)
    return row, ids[at[row, col]], best[row, col].astype(np.int64), work


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to smaller places; a partition first where there are many."""
    if scores.shape[1] > 4 * k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        few = scores >= cut
        width = int(few.sum(axis=1).max())
        if width < scores.shape[1] // 2:
            pick = np.argsort(~few, axis=1, kind="stable")[:, :width]
            scores, places = np.take_along_axis(scores, pick, axis=1), np.take_along_axis(places, pick, axis=1)
    order = np.lexsort((places, ~scores if scores.dtype == np.int64 else -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(places, order, axis=1)


NEAR = "query_id long, vec_id long, score long, seen long, depth long, held long"


def _search(asked: DataFrame, held: DataFrame, k: int, first_depth: int) -> DataFrame:
    """NEAR: the best rows of each query of ``asked`` (with ``floor``) in its blocks, and a row without vec_id that counts the work."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="Int64") for c in NEAR.split(", ")})
        q, x = (np.array(side["v"].tolist(), dtype=np.int64).reshape(len(side), -1) for side in (left, right))
        floors = left["floor"].fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64)
        who = left["vec_id"].to_numpy()
        at, ids, score, work = threshold_topk(who, q, right["vec_id"].to_numpy(), x, k, first_depth, floors)
        want = score >= floors[at]
        best = pd.DataFrame({"query_id": who[at[want]], "vec_id": ids[want], "score": score[want]})
        count = pd.DataFrame({"query_id": who, "seen": work[:, 0], "depth": work[:, 1], "held": len(right)})
        return pd.concat([best, count])[[c.split()[0] for c in NEAR.split(", ")]].astype("Int64")

    keys = ["batch", "block", "dims"]
    held = held.select(*[F.col(c).alias(c) for c in held.columns])  # columns of its own, as both sides come from one table
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, NEAR)


def _passes(vectors: DataFrame, is_query: Column, k: int, scale: int, block_rows: int, batch_queries: int, first_depth: int, id_col: str, vec_col: str) -> DataFrame:
    rows = quantised(vectors, scale, id_col, vec_col)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, batches = max(1, -(-sizes["n"] // block_rows)), max(1, -(-sizes["q"] // batch_queries))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda lo, n: F.explode(F.sequence(F.lit(lo), F.lit(n - 1)))
    asked = rows.where(is_query).withColumn("batch", deal(batches, 1))
    held = rows.withColumn("block", deal(blocks, 2)).withColumn("batch", every(0, batches))
    first = _search(asked.withColumns({"block": F.lit(0), "floor": F.lit(None).cast("long")}), held.where("block = 0"), k, first_depth)
    if blocks == 1:
        return first
    first = write_table(first, "first_block")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = first.where("vec_id IS NOT NULL").withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = _search(asked.join(floor, "vec_id", "left").withColumn("block", every(1, blocks)), held.where("block > 0"), k, first_depth)
    return first.unionByName(rest)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 8192, batch_queries: int = 4096, first_depth: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with the other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    near = _passes(vectors, is_query, k, scale, block_rows, batch_queries, first_depth, id_col, vec_col).where("vec_id IS NOT NULL")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_work(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 8192, batch_queries: int = 4096, first_depth: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: queries, the share of candidates that were scored and the mean share of the lists' depth that was walked."""
    near = _passes(vectors, is_query, k, scale, block_rows, batch_queries, first_depth, id_col, vec_col).where("vec_id IS NULL")
    return near.agg(F.countDistinct("query_id").alias("queries"), (F.sum("seen") / F.sum("held")).alias("scored"), (F.sum("depth") / F.sum("held")).alias("walked"))
