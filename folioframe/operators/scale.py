"""Ordered work that no single task has to do alone.

A plain window sorts each key in one task, so one key with a third of all rows
would stall the job. The functions here cut the order of keys and rows into ranges, total
each key's part of a range with a combining aggregate and add what came before
to a window inside the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import cut

def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows sorted by keys and order, cut into ranges of about equal size; adds `_range` and `_spot` (rising within it).

    The bounds are Spark's own sampled quantiles, so a key with most of the rows, hashed
    ids and epoch seconds spread alike. Only rows equal in keys and order are never parted.
    The rows are written, so every later step sees the same ranges.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    written = cut(dealt.sortWithinPartitions(*by).withColumn("_spot", F.monotonically_increasing_id()))
    return written.withColumn("_range", F.shiftright("_spot", 33))


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, output: str,
    ties: Sequence[str] = (), ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sum of `value` per key by `order`.

    Null keys are keys like others and a null order comes first. `ties` makes the
    order total. Each range of the order is summed up by a window of its own; what
    stands in the ranges before it comes from one total for each key and range.
    """
    rows = in_ranges(df.withColumn("_value", value), keys, [order, *ties], ranges)
    totals = rows.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    offsets = totals.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_range").alias("_its"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_spot").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_value").over(inside))
    same = F.col("_range") == F.col("_its")
    for key, name in names.items():
        same &= F.col(key).eqNullSafe(F.col(name))
    return local.join(offsets, same).select(*df.columns, (F.col("_local") + F.col("_before")).alias(output))


def as_of(targets: DataFrame, log: DataFrame, keys: Sequence[str], order: str, value: str, output: str, inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """`targets` with the `value` of the last row of `log` that has the same keys and a smaller `order` (or an equal one, if inclusive).

    Both sides have the keys and `order`; without an earlier row `output` is null.
    Among log rows of equal order the greatest value counts. Rows of both sides
    are sorted together in ranges: inside a range a window carries the last value
    on, and one value for each key and range carries it into the next ones. No pair of rows
    is compared, and a key with most of the rows is spread.
    """
    held = F.struct(F.col(value).alias("v"))
    asked = targets.select(*keys, order, F.lit(1 if inclusive else 0).alias("_kind"), F.struct(*targets.columns).alias("_row"), F.lit(None).cast(log.select(held.alias("x")).schema["x"].dataType).alias("_held"))
    said = log.groupBy(*keys, order).agg(F.max(value).alias(value)).select(*keys, order, F.lit(0 if inclusive else 1).alias("_kind"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    rows = in_ranges(asked.union(said), keys, [order, "_kind"], ranges)
    ends = rows.filter("_held is not null").groupBy(*keys, "_range").agg(F.max_by("_held", "_spot").alias("_end"))
    # Every range that has targets of a key asks for the last value in front of it.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.select(*keys, "_range").distinct()
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    both = spans.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).unionByName(ends).groupBy(*keys, "_range").agg(F.max("_end").alias("_end"))
    carried = both.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_range").alias("_its"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_spot").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_last", F.last("_held", ignorenulls=True).over(inside)).filter("_row is not null")
    same = F.col("_range") == F.col("_its")
    for key, name in names.items():
        same &= F.col(key).eqNullSafe(F.col(name))
    return local.join(carried, same).select("_row.*", F.coalesce("_last", "_carried")["v"].alias(output))


def numbered(df: DataFrame, keys: Sequence[str], order: str, output: str, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Row number per key by `order`, from 1."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), output, ties, ranges)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One whole row per key: the first by `order`.

    Spark turns the rank filter into a limit per task ahead of the shuffle, so
    each task sends at most one row per key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first `n` rows per key, with their rank; limited per task ahead of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def within_limit(df: DataFrame, value: str, levels: Sequence[str], limit: int, tie: str) -> DataFrame:
    """Flag (`kept`) the rows whose running total from the newest stays within `limit`.

    `levels` are ever finer monotone columns, e.g. hour, time, key range. At each
    level groups wholly inside or outside the limit are settled by their totals;
    only the one group that crosses the limit goes on to the next level.
    """
    open_rows = df.withColumn("_before", F.lit(0).cast("bigint"))
    settled: list[DataFrame] = []
    prefix: list[str] = []
    for level in levels:
        newer = Window.partitionBy(*prefix).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
        prefix = [*prefix, level]
        totals = open_rows.groupBy(*prefix).agg(F.sum(value).alias("_total"), F.first("_before").alias("_offset"))
        totals = totals.select(
            *prefix, "_total", (F.col("_offset") + F.coalesce(F.sum("_total").over(newer), F.lit(0))).alias("_start")
        )
        placed = open_rows.drop("_before").join(totals, prefix).withColumnRenamed("_start", "_before")
        end = F.col("_before") + F.col("_total")
        crossing = (F.col("_before") <= limit) & (end > limit)
        settled.append(placed.filter(~crossing).withColumn("kept", end <= limit).drop("_before", "_total"))
        open_rows = placed.filter(crossing).drop("_total")
    inside = Window.partitionBy(*prefix).orderBy(F.asc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("_before") + F.sum(value).over(inside)
    settled.append(open_rows.withColumn("kept", running <= limit).drop("_before"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out
