"""Exact range join of vectors by pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import batches, cut, finite_vector
from folioframe.llm.components import connected_components

# Vectors to a cell, about; the number of pivots is bounded, beyond that cells grow and are split into blocks.
CELL, MOST_PIVOTS = 2048, 4096
# Rows of a block: no task holds more than two of them.
BLOCK = 8192
# Distances are rounded; this much is added before anything is ruled out.
ROUNDING = 1e-9


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links of cosine `least` or more: key, n_links, component_id, kept, one row for each row of `vectors`.

    Cosines are taken in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null key, link with
    nothing; so do vectors of different length with each other. n_links counts
    the other rows linked directly, copies included; the component is the
    smallest key reachable. Other columns are not kept.

    Equal vectors are reduced to one first. On the unit sphere the cosine is a
    metric: at most r = sqrt(2 - 2 * least) apart. Each vector lives in the cell
    of its nearest pivot p; a partner with nearest pivot q lies on q's side of
    the plane between them, so a vector visits the cell of q only if
    (|x - q|^2 - |x - p|^2) / (2 |p - q|) <= r, which follows from the triangle
    inequality in the plane of the three and is never weaker than
    |x - q| <= |x - p| + 2 r. Of two cells only one visits the other, and which
    one turns around the circle of cells. Cells are joined in pairs of blocks of
    bounded size. A pair of blocks gives link counts and, for each vector that has
    links, one edge to the least vector of its group there - never the pairs.
    """
    radius = float(np.sqrt(2 - 2 * least)) + ROUNDING
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sound = rows.where(F.col("id").isNotNull() & F.exists(finite_vector(F.col("v")), lambda x: x != 0)).withColumn("same", F.md5(F.col("v").cast("string")))
    classes = cut(sound.groupBy("same").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")))
    nodes = classes.select("node", "copies", "v")
    pivots_wanted = min(MOST_PIVOTS, -(-nodes.count() // CELL))
    by_length: dict[int, np.ndarray] = {}
    chosen = [r.v for r in nodes.orderBy(F.xxhash64("node"), "node").limit(pivots_wanted).select("v").collect()]
    for length in {len(v) for v in chosen}:
        pivots = _unit([v for v in chosen if len(v) == length])
        by_length[length] = pivots[np.unique(pivots.round(12), axis=0, return_index=True)[1]]  # one of each direction

    def assign(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            lengths = np.array([len(v) for v in batch.column(2).to_pylist()])
            taken, cells, homes = [], [], []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                pivots = by_length.get(length)
                if pivots is None:  # no pivot of this length: one cell for them all
                    taken.append(at), cells.append(np.full(len(at), -1)), homes.append(np.ones(len(at), bool))
                    continue
                x = _unit([batch.column(2)[i].as_py() for i in at.tolist()])
                square = np.maximum(2 - 2 * x @ pivots.T, 0)
                home = square.argmin(1)
                between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
                reach = square - square[np.arange(len(x)), home][:, None] <= 2 * between * radius + ROUNDING
                number = np.arange(len(pivots))
                ahead = (number - home[:, None]) % len(pivots)
                half = len(pivots) / 2
                row, cell = np.nonzero(reach & (((ahead > 0) & (ahead < half)) | ((ahead == half) & (number > home[:, None]))))
                taken += [at, at[row]]
                cells += [home, cell]
                homes += [np.ones(len(at), bool), np.zeros(len(row), bool)]
            take = np.concatenate(taken) if taken else np.empty(0, np.int64)
            chosen_rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(cells) if cells else [], pa.int64()), pa.array(np.concatenate(homes) if homes else [], pa.bool_()),
                    pa.array(lengths[take], pa.int64()), *chosen_rows.columns,
                ],
                ["cell", "home", "length", "node", "copies", "v"],
            )

    kind = nodes.schema["v"].dataType.simpleString()
    members = cut(batches(nodes, assign, f"cell long, home boolean, length long, node long, copies long, v {kind}"))
    sizes = members.groupBy("length", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("home_blocks"), F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).alias("guest_blocks"),
    )
    # Guests of a cell without home rows have nobody to meet there; their own links count in their home cells.
    spread = members.join(sizes.where("home_blocks > 0"), ["length", "cell"])
    block = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("home_blocks"))).otherwise(F.col("home_blocks") + F.pmod(F.xxhash64("node"), F.col("guest_blocks")))
    # A home block meets every block of its cell, a guest block the home blocks.
    partner = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("home_blocks") + F.col("guest_blocks")).otherwise(F.col("home_blocks")).cast("int") - 1))
    dealt = spread.withColumn("block", block.cast("int")).select("*", partner.alias("partner")).select(
        "length", "cell", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"), "block", "node", "copies", "v",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = int(group["one"].iloc[0]), int(group["two"].iloc[0])
        left, right = group[group["block"] == one], group[group["block"] == two]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        a, b = _unit(list(left["v"])), _unit(list(right["v"]))
        ids_a, ids_b = left["node"].to_numpy(), right["node"].to_numpy()
        copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        edges: list[np.ndarray] = []
        step = max(1, 8_000_000 // len(b))
        for at in range(0, len(a), step):
            hit = a[at : at + step] @ b.T >= least
            if one == two:
                hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
            rows_, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(rows_):
                continue
            hit = hit[np.ix_(rows_, columns)]
            links_a[at + rows_] += hit @ copies_b[columns]
            if one != two:
                links_b[columns] += copies_a[at + rows_] @ hit
            low_a, low_b = ids_a[at + rows_].copy(), ids_b[columns].copy()
            most = np.iinfo(np.int64).max
            while True:  # the least vector reachable inside this strip
                new_a = np.minimum(low_a, np.where(hit, low_b, most).min(1))
                new_b = np.minimum(low_b, np.where(hit, new_a[:, None], most).min(0))
                if (new_a == low_a).all() and (new_b == low_b).all():
                    break
                low_a, low_b = new_a, new_b
            edges.append(np.array([np.concatenate([ids_a[at + rows_], ids_b[columns]]), np.concatenate([low_a, low_b])]))
        pair = np.unique(np.concatenate(edges, axis=1), axis=1) if edges else np.empty((2, 0), np.int64)
        pair = pair[:, pair[0] != pair[1]]
        counted = pd.DataFrame({"a": np.concatenate([ids_a, ids_b]), "links": np.concatenate([links_a, links_b])})
        counted = counted[counted["links"] > 0]
        return pd.DataFrame({
            "a": np.concatenate([pair[0], counted["a"]]).astype(np.int64), "b": pd.array([*pair[1].tolist(), *[None] * len(counted)], "Int64"),
            "links": np.concatenate([np.zeros(pair.shape[1], np.int64), counted["links"]]).astype(np.int64),
        })

    found = cut(dealt.groupBy("length", "cell", "one", "two").applyInPandas(compare, "a long, b long, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.select("same", "node", "copies").join(counts, "node", "left").join(labels, "node", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
    )
    linked = sound.select("id", "same").join(known, "same").select("id", "n_links", "component_id")
    alone = rows.where(F.col("id").isNull() | ~F.coalesce(F.exists(finite_vector(F.col("v")), lambda x: x != 0), F.lit(False)))
    every = linked.union(alone.select("id", F.lit(0).cast("long"), F.col("id")))
    return every.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
