"""Helpers the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.session import configure, cut, discard

__all__ = ["batches", "cut", "discard", "finite_vector", "free_name", "numbered", "read", "worker_keep"]

# Rows that travel to a Python worker at once. Texts may be long, so batches are short.
BATCH_ROWS = 256


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table, with the settings the results rely on."""
    return configure(spark).read.parquet(f"{folder}/{table}.parquet")


def worker_keep(key: Any, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker and kept there for later tasks (functions travel by value, modules do not)."""
    home = sys.modules.setdefault("folioframe_worker_keep", types.ModuleType("folioframe_worker_keep"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with short batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def finite_vector(vector: Column) -> Column:
    """A vector of doubles, or null if it is null, empty or holds a null or non-finite component."""
    doubles = vector.cast("array<double>")
    sound = (F.size(vector) > 0) & ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, doubles)


def free_name(name: str, columns: Sequence[str]) -> str:
    """`name`, longer where a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds each row's `number` among the rows of its keys, from 0, and their `count`; nulls come first and are keys like others.

    Rows are sorted by ranges, so a key with most of the rows is spread over many
    tasks; each range's share of a key is counted, and the counts before it added.
    The table must not have the columns number, count, at or range.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    counts = dealt.groupBy(*keys, "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {k: free_name(f"{k} of range", rows.columns) for k in keys}
    counts = counts.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("range").alias("its range"), F.col("first"), before.alias("before"), F.sum("n").over(whole).alias("count"))
    same = F.col("range") == F.col("its range")
    for key, name in names.items():
        same &= F.col(key).eqNullSafe(F.col(name))
    return dealt.join(counts, same).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("number"), "count")
