"""Aggregates: usage, coverage, workspace and job summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.scale import top_per_key


def usage_monthly(usage: DataFrame) -> DataFrame:
    """Characters per provider and month; only positive amounts count."""
    return usage.filter("chars > 0").groupBy("provider", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.sum("chars").alias("chars")
    )


def month_total(usage: DataFrame, provider: str, month: str) -> DataFrame:
    return usage_monthly(usage).filter((F.col("provider") == provider) & (F.col("month") == month))


def field_coverage(rows: DataFrame, over_all: Sequence[str], over_text: Sequence[str], scanned: str = "scanned") -> DataFrame:
    """Filled share per field in one pass: some fields count over all rows, some over rows with text."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    has_text = ~F.col(scanned)
    counts: list[Column] = [F.count(F.lit(1)).alias("total"), F.count_if(has_text).alias("with_text")]
    counts += [F.count_if(filled(c)).alias(f"n_{c}") for c in over_all]
    counts += [F.count_if(filled(c) & has_text).alias(f"n_{c}") for c in over_text]
    one = rows.agg(*counts)
    lines = [F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("n"), F.col("total").alias("base")) for c in over_all]
    lines += [F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("n"), F.col("with_text").alias("base")) for c in over_text]
    lines.append(F.struct(F.lit("scanned").alias("field"), (F.col("total") - F.col("with_text")).alias("n"), F.col("total").alias("base")))
    out = one.select(F.inline(F.array(*lines)))
    return out.withColumn("percent", F.when(F.col("base") > 0, F.round(100.0 * F.col("n") / F.col("base"), 4)))


def enrich_rate(merged: DataFrame, filled: str = "filled") -> DataFrame:
    """Rows that gained something, and how often each field was filled."""
    per_field = merged.select(F.explode(filled).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    total = merged.agg(F.count_if(F.size(filled) > 0).alias("n")).select(F.lit("(any)").alias("field"), "n")
    return total.unionByName(per_field)


def workspace_summary(documents: DataFrame, states: DataFrame, actions: DataFrame) -> DataFrame:
    """Documents, processed (some category complete) and errors (some error)."""
    done = states.groupBy("rel").agg(F.bool_or(F.col("state") == "complete").alias("_done"))
    failed = actions.groupBy("rel").agg(F.bool_or(F.col("status") == "error").alias("_failed"))
    return documents.select("rel").join(done, "rel", "left").join(failed, "rel", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("_done").alias("processed"), F.count_if("_failed").alias("errors")
    )


def estimate_job(segments: DataFrame, doc: str = "doc_id", per_second: float = 1.0, token: str = r"\[\[KEEP_\d{6}\]\]") -> DataFrame:
    """Segments, characters without tokens, and seconds at the given rate, per document."""
    chars = F.length(F.regexp_replace("text", token, ""))
    return segments.filter("translatable").groupBy(doc).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(chars).alias("chars")
    ).withColumn("seconds", F.col("segments") / F.lit(per_second))


def session_stats(messages: DataFrame, session: str = "session_id") -> DataFrame:
    """Message count, first and last time, and messages with a role outside the known three."""
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("message_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("bad_roles"),
    )


def batch_outcome(plan: DataFrame, order: str = "ord", limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """Counts by outcome, and the first messages of the failures."""
    ok = F.col("reason").isNull()
    counts = plan.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))
    messages = plan.filter(~ok).orderBy(order).limit(limit).select(order, "reason")
    return counts, messages


def first_messages(plan: DataFrame, group: str, order: str = "ord", limit: int = 12) -> DataFrame:
    """The first failure messages of every batch."""
    return top_per_key(plan.filter("reason is not null"), [group], limit, F.asc(order)).select(group, "rank", order, "reason")


def results_per_doc(results: DataFrame) -> DataFrame:
    return results.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("stored"))
