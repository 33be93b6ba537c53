"""Hard-negative mining by a secondary sort.

Scores of (anchor, row) pairs are shuffled by anchor and sorted by a key of
anchor, falling score, kind and id. One pass over each sorted partition then sees,
anchor by anchor, first a positive and later the rows that score less: a
positive opens a window of scores, and rows of other labels that fall into it
come out until it has enough. The pass holds the open windows of one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut, finite_vector
from folioframe.llm.topk import _held, scaled

# Candidates and anchors in a block: no task holds more than one of each (hashing adds a few).
CANDIDATES, ANCHORS = 16_384, 2_048
# Anchors whose scores stand in memory at once.
STRIP = 128
POSITIVE, NEGATIVE = 0, 1


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; equal ones in their order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")][:k]


def _pairs(rows: DataFrame, anchors: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], list[tuple[int, int, int]]]) -> DataFrame:
    """anchor, id, score of what `work` finds in every block of anchors and block of `rows`.

    Both have length, id, label, v and known (array of scores, for anchors). A row
    travels once for each block of the other side.
    """
    parts = max(1, -(-rows.count() // CANDIDATES))
    anchor_parts = max(1, -(-anchors.count() // ANCHORS))

    def dealt(side: DataFrame, of: str, asks: bool, own: tuple[str, int], others: tuple[str, int]) -> DataFrame:
        return side.select(
            "length", F.pmod(F.xxhash64("id"), F.lit(own[1])).cast("int").alias(own[0]), F.explode(F.sequence(F.lit(0), F.lit(others[1] - 1))).alias(others[0]),
            F.lit(asks).alias("asks"), "id", "label", "v", of,
        )

    both = dealt(rows.withColumn("known", F.lit(None).cast("array<long>")), "known", False, ("part", parts), ("anchor_part", anchor_parts)).unionByName(
        dealt(anchors, "known", True, ("anchor_part", anchor_parts), ("part", parts)))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        asks = group["asks"].to_numpy()
        found = work(group[asks], group[~asks]) if asks.any() and not asks.all() else []
        return pd.DataFrame(found, columns=["anchor", "id", "score"]).astype("int64")

    return both.groupBy("length", "part", "anchor_part").applyInPandas(block, "anchor long, id long, score long")


def _strips(anchors: pd.DataFrame, rows: pd.DataFrame, scale: int, same: bool) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """(anchor, its known scores, ids, scores) over the rows of its own label, or of all others; rows rise by id."""
    ids, labels, matrix = rows["id"].to_numpy(), rows["label"].to_numpy(), scaled(list(rows["v"]), scale)
    for label, some in anchors.groupby("label", sort=True):
        chosen = np.flatnonzero((labels == label) == same)
        other = matrix[chosen].T
        for at in range(0, len(some) if len(chosen) else 0, STRIP):
            strip = some.iloc[at : at + STRIP]
            scores = _held(scaled(list(strip["v"]), scale) @ other)
            for own, known, line in zip(strip["id"].tolist(), strip["known"], scores, strict=True):
                yield own, known, ids[chosen], line if line.dtype == object else line.astype(np.int64)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, every: int = 100,
         key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of components floor(scale * x); higher
    ones come first, ties by smaller key. Anchors are the rows whose key is
    divisible by `every`, their positives the first `positives` other rows of the
    same label. For each positive the first `negatives` rows of other labels come
    out whose score is between `low` and `high` hundredths of the positive's
    (fewer rows give fewer results; a positive below zero has no such row).

    Rows with a null key, label or vector, an empty one or one with a null or
    non-finite component take no part; vectors of different length do not meet.
    Rows that share a key count as one, that of the least (label, vector). Scores
    beyond the range of long are held at its ends. Other columns are not kept.

    Anchors meet all rows in pairs of blocks, twice: first for their positives,
    then for the rows in each positive's window. A block sends on its first
    `negatives` of every window, so the shuffle grows with anchors times blocks
    and no row that can come out is lost.
    """
    sound = vectors.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                           finite_vector(F.col(vector)).alias("sound"), F.col(vector).alias("v")).where("sound is not null and id is not null and label is not null")
    rows = cut(sound.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v", F.size("row.v").alias("length")))
    anchors = rows.where(F.col("id") % every == 0)

    def likes(own: pd.DataFrame, others: pd.DataFrame) -> list[tuple[int, int, int]]:
        out = []
        for anchor, _, ids, scores in _strips(own, others, scale, True):
            rest = ids != anchor
            ids, scores = ids[rest], scores[rest]
            out += [(anchor, int(ids[p]), int(scores[p])) for p in _best(scores, positives)]
        return out

    def inside(own: pd.DataFrame, others: pd.DataFrame) -> list[tuple[int, int, int]]:
        out = []
        for anchor, known, ids, scores in _strips(own, others, scale, False):
            chosen: set[int] = set()
            for score in {int(s) for s in known}:
                # Scores of doubles stay below 2**52 (see `scaled`), so these products fit; others are Python integers.
                window = np.flatnonzero((100 * scores >= low * score) & (100 * scores <= high * score))
                chosen.update(window[_best(scores[window], negatives)].tolist())
            out += [(anchor, int(ids[p]), int(scores[p])) for p in sorted(chosen)]
        return out

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = _pairs(rows, anchors.withColumn("known", F.array().cast("array<long>")), likes)
    best = cut(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    known = best.groupBy("anchor").agg(F.collect_list("score").alias("known"))
    asking = cut(anchors.join(known.withColumnRenamed("anchor", "id"), "id").select("id", "label", "v", "length", "known"))
    near = _pairs(rows, asking, inside)
    pairs = best.withColumn("kind", F.lit(POSITIVE)).union(near.withColumn("kind", F.lit(NEGATIVE)))
    packed = F.struct("anchor", (-F.col("score")).alias("below"), "kind", "id")
    keys = pairs.select(packed.alias("key")).repartition("key.anchor").sortWithinPartitions("key").select("key.*")
    return keys.mapInArrow(_windows(positives, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _windows(positives: int, negatives: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over sorted keys."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in rows:
            out = []
            for anchor, below, kind, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != now:
                    now, windows = anchor, []
                if kind == POSITIVE:
                    if len(windows) < positives:
                        windows.append([other, -below, 0])
                    continue
                for window in windows:
                    positive, score, count = window
                    if count < negatives and low * score <= -100 * below <= high * score:
                        window[2] = count + 1
                        out.append((anchor, positive, count + 1, other, score, -below))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return work
