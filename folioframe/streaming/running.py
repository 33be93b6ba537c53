"""Running totals and intake with Structured Streaming.

Each job takes a streaming DataFrame and a sink folder; state and offsets live
under the session's shared checkpoint folder, so a lost executor or driver
resumes where it stopped. Results are written by `foreachBatch`, never gathered
on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from folioframe.functions import naming
from folioframe.functions.text import title_key
from folioframe.operators.scale import first_per_key, numbered
from folioframe.session import checkpoint_dir, cut, hadoop_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """A parquet table of a folder as a stream, whether the table is one file or a folder of files."""
    # The name as a pattern: a plain path must be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{{{name}}}.parquet")


def running_usage(usage: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Characters per provider and day as events come in; positive amounts only. A day's state goes once the watermark has passed it."""
    return usage.withWatermark("ts", lateness).filter("chars > 0").groupBy("provider", F.window("ts", "1 day")).agg(
        F.sum("chars").alias("chars")
    ).select("provider", F.col("window.start").alias("day"), "chars")


def running_sessions(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Messages, first and last time per session and day. A day's state goes once the watermark has passed it."""
    return messages.withWatermark("ts", lateness).groupBy("session_id", F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("message_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    ).select("session_id", F.col("window.start").alias("day"), "message_count", "created_at", "updated_at")


def keep_changes(totals: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the totals that a trigger changed to a partition of its own, replaced whole when the trigger is repeated."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest total of every key."""
    return first_per_key(spark.read.parquet(out), keys, F.desc("batch")).drop("batch")


def usage_by_month(spark: SparkSession, out: str) -> DataFrame:
    """provider, month, chars from what `keep_changes` wrote of `running_usage`."""
    return latest(spark, out, ["provider", "day"]).groupBy("provider", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("chars").alias("chars"))


def session_totals(spark: SparkSession, out: str) -> DataFrame:
    """Message count, first and last time per session from what `keep_changes` wrote of `running_sessions`."""
    return latest(spark, out, ["session_id", "day"]).groupBy("session_id").agg(
        F.sum("message_count").alias("message_count"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )


class _FirstSeen(StatefulProcessor):
    """Per key (a DOI or a title) the first document that had it; every row learns it. Only numbers of a key's rows are held."""

    def __init__(self, ttl_ms: int | None):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "ord bigint, entry_id bigint", self._ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kind = key[0].partition(":")[0]
        if kind == "self":
            for part in rows:
                yield pd.DataFrame({"entry_id": part["entry_id"], "kind": kind, "first_id": part["entry_id"], "payload": part["payload"]})
            return
        parts = [part[["ord", "entry_id"]].astype("int64") for part in rows]
        first = self._first.get()
        if first is None:
            first = min(min(zip(part["ord"], part["entry_id"], strict=True)) for part in parts)
            self._first.update((int(first[0]), int(first[1])))
        for part in parts:
            yield pd.DataFrame({"entry_id": part["entry_id"], "kind": kind, "first_id": int(first[1]), "payload": None})

    def close(self) -> None:
        pass


def intake(
    files: DataFrame, identify: Callable[[DataFrame], DataFrame], plan: str, checkpoint: str, template: str | None = None, ttl_days: int | None = None, available_now: bool = False
) -> StreamingQuery:
    """Identify new files, mark those whose DOI or title has been seen, name and place the rest; append all to the plan.

    `identify` maps new rows to entry_id, ord, doi, title, creators and year; it runs on the stream. The
    first document of a DOI and of a title is keyed state (kept for `ttl_days`, or
    for good), so a trigger reads its own rows and not the plan: the earlier one
    wins, of one trigger the smaller ord. A repeated DOI comes before a
    repeated title. Names are counted on: the n-th document of a name is placed in `name (n)`.

    The plan has entry_id, ord, doi, title, status, match_id, reason and target.
    Every trigger writes a partition of its own, and the totals of the names it
    used below `plan`-names; both are replaced whole when the trigger is repeated.
    """
    found = identify(files)
    pair = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    title = title_key(F.coalesce("title", F.lit("")))
    keys = F.array_compact(F.array(
        pair("self", F.col("entry_id").cast("string")), F.when(F.col("doi").isNotNull(), pair("doi", F.col("doi"))), F.when(title != "", pair("title", title)),
    ))
    packed = F.to_json(F.struct(*found.columns))
    keyed = found.select("entry_id", "ord", packed.alias("_payload"), F.explode(keys).alias("key")).select(
        "entry_id", "ord", "key", F.when(F.col("key").startswith("self:"), F.col("_payload")).alias("payload"))
    seen = keyed.groupBy("key").transformWithStateInPandas(
        _FirstSeen(ttl_days * 86_400_000 if ttl_days else None), "entry_id long, kind string, first_id long, payload string", "append", "ProcessingTime" if ttl_days else "None")
    schema, counters = found.schema, f"{plan}-names"

    def place(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch)  # the state is asked once
        documents = rows.filter("kind = 'self'").select(F.from_json("payload", schema).alias("_d")).select("_d.*")
        earlier = rows.filter("kind <> 'self' and first_id <> entry_id")
        matches = earlier.groupBy("entry_id").agg(F.min(F.struct("kind", "first_id")).alias("_m"))  # doi sorts before title
        status = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "failed").when(F.col("_m").isNotNull(), "duplicate").otherwise("organized")
        judged = cut(naming.with_name(documents.join(matches, "entry_id", "left").withColumn("status", status), template))
        new = numbered(judged.filter("status = 'organized'").select("entry_id", "name", "ord"), ["name"], "ord", "_n", ["entry_id"])
        folder, files_there = hadoop_folder(spark, counters)
        known = spark.createDataFrame([], "name string, total long")
        if files_there.exists(folder):
            before = spark.read.parquet(counters).filter(F.col("batch") != number)
            known = before.groupBy("name").agg(F.max("total").alias("total"))
        numbers = cut(new.join(known, "name", "left").select("entry_id", "name", (F.col("_n") + F.coalesce("total", F.lit(0))).alias("_n")))
        numbers.groupBy("name").agg(F.max("_n").alias("total")).write.mode("overwrite").parquet(f"{counters}/batch={number}")
        own = F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name"))
        out = judged.drop("name").join(numbers, "entry_id", "left").withColumn("_own", own)
        out.select(
            "entry_id", "ord", "doi", "title", "status", F.col("_m.first_id").alias("match_id"), F.col("_m.kind").alias("reason"),
            F.when(F.col("status") == "organized", F.concat("_own", F.lit("/"), "_own", F.lit(".pdf"))).alias("target"),
        ).write.mode("overwrite").parquet(f"{plan}/batch={number}")

    writer = seen.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(place)
    spark = files.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query keeps the setting it has started with
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(setting, usual)
