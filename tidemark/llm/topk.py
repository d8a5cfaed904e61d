"""Exact top-k by inner product without random access.

Every component is a list of the candidates sorted by it.  A query reads each list sequentially, from the
top where its own component is positive and from the bottom where it is negative, so that contributions only
fall.  What it has read of a candidate, plus the list's front value for what it has not, bounds the
candidate's score from above; the list's far end instead of the front bounds it from below.  Reading goes on
by DEPTHS, the last of which is the end of the lists.  It stops for a query when no candidate outside those
that remain, and none still unseen, can reach the k-th lower bound; the scores of those that remain are then
resolved by reading on for them alone.  Candidates that no query of a pass can use any more are dropped.

The bounds of a block of queries against a block of candidates are matrix products: a component that is not
yet read is below the front, so reading to a depth clips the candidates' matrix at the fronts.  A pass of
queries tests its bounds from one depth before that at which half of the pass before had stopped; what lies
above is read without a test.  In few dimensions queries stop early; in 64 they read some nine tenths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: candidates and queries of one block, and queries of one pass
CANDIDATES, QUERIES, PASS = 8192, 8192, 128
#: shares of the lists read before each test of the bounds
DEPTHS = (0.125, 0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)


def block_topk(queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, stops: list | None = None):
    """For each query: (query index, candidate index, score) of its k best rows, ties to smaller ids.

    queries and rows are matrices of integers (as doubles); a row with the query's own id is no candidate.
    stops gets the share of the lists that each query read.
    """
    n = len(rows)
    if not n:
        return []
    exact = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) < 2**53
    lists = np.sort(rows, 0)
    found: list[tuple[int, int, int]] = []

    def best(query: int, index: np.ndarray, scores: np.ndarray) -> None:
        if len(index) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            index, scores = index[near], scores[near]
        order = np.lexsort((ids[index], -scores))[:k]
        found.extend((query, j, int(s)) for j, s in zip(index[order].tolist(), scores[order].tolist()))

    begin = 0
    for at in range(0, len(queries), PASS):
        q, own = queries[at : at + PASS], qids[at : at + PASS, None] == ids[None, :]
        if not exact:  # beyond doubles: every list is read to its end, in whole numbers
            whole_numbers = np.frompyfunc(int, 1, 1)
            scores = whole_numbers(q).astype(object) @ whole_numbers(rows).astype(object).T
            for i in range(len(q)):
                order = sorted((j for j in range(n) if not own[i, j]), key=lambda j: (-scores[i, j], ids[j]))[:k]
                found += [(at + i, j, scores[i, j]) for j in order]
            continue
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        open_, left = np.arange(len(q)), np.arange(n)
        stopped = []
        for step in range(begin, len(DEPTHS)):
            depth = max(1, int(DEPTHS[step] * n))
            u, d, x = up[open_].T, down[open_].T, rows[left]
            skip = own[np.ix_(open_, left)].T
            if depth == n or step == len(DEPTHS) - 1:  # the ends: both bounds are the score
                scores = x @ u + x @ d
                for i, o in enumerate(open_):
                    fit = ~skip[:, i]
                    best(at + o, left[fit], scores[fit, i])
                stopped += [len(DEPTHS) - 1] * len(open_)
                break
            top, bottom = lists[n - depth], lists[depth - 1]
            upper = np.maximum(x, top) @ u + np.minimum(x, bottom) @ d
            lower = np.where(x >= top, x, lists[0]) @ u + np.where(x <= bottom, x, lists[-1]) @ d
            lower[skip], upper[skip] = -np.inf, -np.inf
            kth = np.partition(lower, len(left) - k, 0)[len(left) - k] if len(left) > k else np.full(len(open_), -np.inf)
            may = upper >= kth
            # few enough candidates remain, and what no list has shown yet is out of reach
            done = (may.sum(0) <= max(4 * k, n // 50)) & (top @ u + bottom @ d < kth)
            for i in np.flatnonzero(done):
                index = left[may[:, i] & ~skip[:, i]]
                best(at + open_[i], index, rows[index] @ q[open_[i]])
            stopped += [step] * int(done.sum())
            open_, may = open_[~done], may[:, ~done]
            if not len(open_):
                break
            left = left[may.any(1)]
        if stops is not None:
            stops += [DEPTHS[x] for x in stopped]
        begin = max(0, sorted(stopped)[len(stopped) // 2] - 1)
    return found


def _integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(256 * flat.astype(float)).reshape(len(column), -1)


def _cell(k: int):
    def f(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            q, rows = (_integers(t.column("x").combine_chunks()) for t in (left, right))
            qids, ids = (t.column("vec_id").to_numpy() for t in (left, right))
            keys = left.column("qkey").to_pylist()
            out = [(int(qids[i]), keys[i], int(ids[j]), min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, j, s in block_topk(q, qids, rows, ids, k)]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "qkey", "vec_id", "score"), columns)})

    return f


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """vectors (vec_id, embedding array<float or double>, ...) -> query_id, rank, vec_id, score.

    Components x become floor(256 * x).  Queries are the rows whose vec_id is divisible by `every`; each gets
    its k highest inner products (all, if fewer) with rows of another vec_id, ties to the smaller vec_id.
    Vectors that are null, empty, or hold null or non-finite components, and rows without a vec_id, take no
    part; vectors of another length than the query's are no candidates of it.  Repeated candidate rows each
    take a rank; repeated equal queries count once; different queries of one vec_id are ranked apart.
    A score beyond the range of a long is given as the end of that range.
    Queries and candidates meet block by block, each pair of blocks in a task of its own.
    """
    ws = Workspace(vectors.sparkSession, "topk")
    x = F.col("embedding").cast("array<double>")
    good = F.size(x) > 0
    good &= ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & good)
    rows = ws.keep(rows.withColumn("dims", F.size("x")))
    total, chosen = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n, m = max(1, -(-total // CANDIDATES)), max(1, -(-chosen // QUERIES))
    qkey = F.xxhash64("vec_id", "x")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("qkey", qkey).dropDuplicates(["vec_id", "qkey"])
    left = queries.select("dims", F.pmod("qkey", F.lit(m)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cb"), "vec_id", "qkey", "x")
    spread = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    right = rows.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("qb"), spread.alias("cb"), "vec_id", "x")
    cell = ["dims", "qb", "cb"]
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, qkey long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
