"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integer impacts, floor(1024 * x). A shard of the index keeps, for each
dimension, its rows in order of impact, cut into posting segments of equal quantised impact.
For a query, all segments of all dimensions are processed by descending quantised
contribution; a row's accumulator is a lower bound, and adding the best unprocessed segment
of each dimension gives an upper bound. Processing stops only on proof: when so few rows
have an upper bound that reaches the k-th best lower bound that these, the only possible
members, are rescored exactly.

Queries are a stated set (vec_id divisible by 100), met with all rows in blocks: rows are
dealt to shards of about ``SHARD_ROWS``, queries to blocks of ``QUERY_ROWS``; each pair of
shard and block returns k rows a query.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part;
vectors of another length than the query's are no candidates; equal scores go to the smaller
vec_id; rows that repeat a query's vec_id count as its own; fewer than k candidates are all
returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 32768
QUERY_ROWS = 2048
LEVELS = 16
CHECK_EVERY = 64
FOUND = "query_id long, vec_id long, score long"


def impacts(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and integer components of the valid vectors."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return v.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


class ImpactIndex:
    """Segments of a shard: rows (in impact order), their impacts, and each segment's dimension and bounds."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        n, dims = x.shape
        self.rows, self.values, self.starts, self.dim, self.low, self.high = [], [], [], [], [], []
        for d in range(dims):
            order = np.argsort(x[:, d], kind="stable")
            v = x[order, d]
            width = max(1, -(-(int(v[-1]) - int(v[0]) + 1) // levels))
            level = (v - v[0]) // width
            cut = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [n]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                self.rows.append(order[a:b])
                self.values.append(v[a:b])
                self.dim.append(d)
                self.low.append(int(v[a]))
                self.high.append(int(v[b - 1]))
        self.dim, self.low, self.high = np.array(self.dim), np.array(self.low, np.int64), np.array(self.high, np.int64)

    def possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best."""
        n, dims = self.x.shape
        w = q[self.dim]
        top, floor = np.maximum(w * self.low, w * self.high), np.minimum(w * self.low, w * self.high)
        least = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(least, self.dim, floor)
        gain = top - least[self.dim]
        order = np.lexsort((self.dim, -gain))
        acc = np.full(n, int(least.sum()), np.int64)
        # Each dimension's segments come in its own descending order, so its best unprocessed one is its next.
        per_dim = [[] for _ in range(dims)]
        for s in order.tolist():
            per_dim[self.dim[s]].append(int(gain[s]))
        nxt = [0] * dims
        ahead = sum(g[0] for g in per_dim if g)
        for step, s in enumerate(order.tolist(), 1):
            d = int(self.dim[s])
            acc[self.rows[s]] += w[s] * self.values[s] - least[d]
            mine, i = per_dim[d], nxt[d]
            ahead += (mine[i + 1] if i + 1 < len(mine) else 0) - mine[i]
            nxt[d] = i + 1
            if step % CHECK_EVERY == 0 and n > k:
                bar = np.partition(acc, n - k)[n - k]
                if ahead <= 0 or int((acc + ahead >= bar).sum()) <= max(4 * k, n >> 8):
                    return np.flatnonzero(acc + ahead >= bar)
        if n <= k:
            return np.arange(n)
        return np.flatnonzero(acc >= np.partition(acc, n - k)[n - k])

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.possible(q, k)
        return rows, self.x[rows] @ q


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``."""
    v = impacts(vectors).withColumn("dims", F.size("v"))
    queries = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    n, nq = v.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / query_rows))

    def numbers(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    spread = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    rows = v.withColumn("shard", spread(shards)).withColumn("block", numbers(blocks))
    asked = queries.withColumn("block", spread(blocks)).withColumn("shard", numbers(shards))

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(have) or not len(want) or not have["dims"].iat[0]:
            return empty
        ids = have["vec_id"].to_numpy()
        index = ImpactIndex(np.stack(have["v"].to_numpy()))
        out = []
        for qid, q in zip(want["vec_id"].tolist(), want["v"], strict=True):
            # One more than k for each row of the query's own.
            hit, score = index.search(np.asarray(q), k + int((ids == qid).sum()))
            other = ids[hit] != qid
            hit, score = hit[other], score[other]
            best = np.lexsort((ids[hit], -score))[:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[hit][best], "score": score[best]}))
        return pd.concat(out)

    key = ["dims", "shard", "block"]
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
