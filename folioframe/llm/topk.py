"""Exact top-k inner products by the threshold algorithm over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import finite_vector

# Candidates and queries in a block: no task holds more than one of each (hashing adds a few).
CANDIDATES, QUERIES = 16_384, 4_096
# Places read from each list at first; each step doubles what has been read.
FIRST = 16


class SortedLists:
    """One list for each dimension with the rows in order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        turn = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[turn], rows[turn]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but `own`, best first, ties to the smaller id.

        Lists are read from the end that the query favours, all to the same
        depth; every row met is scored whole. No unmet row can score more than
        the sum of what the lists hold at that depth. Reading stops when that
        bound is below the k-th score. If fewer rows are unmet than the next step
        would read, they are scored at once.
        """
        count = len(self.ids)
        up = np.flatnonzero(query > 0)
        down = np.flatnonzero(query < 0)
        if not len(up) + len(down):
            up = np.arange(len(query))
        met = np.zeros(count, bool)
        best, score = np.empty(0, np.int64), np.empty(0, self.rows.dtype)
        depth, left = 0, count
        while left:
            until = min(count, max(FIRST, 2 * depth))
            if left <= (until - depth) * (len(up) + len(down)) // 4:
                new = np.flatnonzero(~met)
            else:
                new = np.concatenate([self.order[up, count - until : count - depth].ravel(), self.order[down, depth:until].ravel()])
                new = np.unique(new[~met[new]])
            met[new] = True
            left -= len(new)
            depth = until
            new = new[self.ids[new] != own]
            best, score = np.concatenate([best, new]), np.concatenate([score, _held(self.rows[new] @ query)])
            first = np.lexsort((best, -score))[:k]  # rows stand in order of ids
            best, score = best[first], score[first]
            bound = query[up] @ self.values[up, count - depth] + query[down] @ self.values[down, depth - 1]
            if len(best) == k and score[-1] > _held(bound):
                break
        return self.ids[best], score


def _held(score):
    """Scores at the ends of the range of long if they lie beyond it; doubles never do, see `scaled`."""
    return np.clip(score, -(2**63), 2**63 - 1) if isinstance(score, int) or getattr(score, "dtype", None) == object else score


def scaled(rows: list, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; doubles if all inner products are exact in them, else Python integers."""
    x = np.floor(scale * np.array(rows, np.float64))
    if len(x) and np.abs(x).max() ** 2 * x.shape[1] >= 2.0**52:
        return np.array([[int(c) for c in row] for row in x.tolist()], object)
    return x


def top_products(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row whose key is divisible by `every`, its k best other rows: query_id, rank (from 1), key, score.

    Components are taken as floor(scale * x); the score is their integer inner
    product; ties go to the smaller key. Vectors that are null, empty or hold null
    or non-finite components, and rows with a null key, take no part; vectors of
    different length do not meet. Fewer than k other rows give fewer results.
    Scores beyond the range of long are held at its ends. Rows that repeat a key
    with the same vector count once. Other columns are not kept.

    Queries and candidates are dealt into blocks by hash and every pair of blocks
    is a task with its own sorted lists; each gives k rows a query, and the best
    of these are the result. A row travels once for each block of the other side.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), finite_vector(F.col(vector)).alias("sound"), F.col(vector).alias("v")).where("sound is not null and id is not null")
    rows = rows.select("id", "v", F.size("v").alias("length")).dropDuplicates(["id", "v"])
    counts = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    parts, query_parts = max(1, -(-counts[0] // CANDIDATES)), max(1, -(-counts[1] // QUERIES))
    candidates = rows.select(
        "length", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part"), F.lit(False).alias("asks"), "id", "v",
    )
    queries = rows.where(F.col("id") % every == 0).select(
        "length", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int").alias("query_part"), F.lit(True).alias("asks"), "id", "v",
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        ids, rows_ = group["id"].to_numpy(), scaled(list(group["v"]), scale)
        out: list[tuple[int, int, int]] = []
        if asks.any() and not asks.all():
            lists = SortedLists(ids[~asks], rows_[~asks])
            for own, query in zip(ids[asks].tolist(), rows_[asks], strict=True):
                for i, s in zip(*lists.top(query, own, k), strict=True):
                    out.append((own, int(i), int(s)))
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = candidates.union(queries).groupBy("length", "part", "query_part").applyInPandas(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
