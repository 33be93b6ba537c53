"""Snapshots, undo, diffs and path sets.

Tables: history(seq, group_id, ts), history_paths(seq, rel, existed),
snapshots(seq, rel, content_hash), listings(seq, rel), files(rel, content_hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import paths
from folioframe.operators.scale import as_of, first_per_key, running_total, top_per_key

# Kinds of change and conflict.
CREATE, MODIFY, DELETE = "create", "modify", "delete"


def group_of(group_id: Column, seq: Column) -> Column:
    """Rows without a group are groups of their own."""
    return F.coalesce(group_id.cast("string"), seq.cast("string"))


def undo_step(history: DataFrame) -> DataFrame:
    """The trailing run of rows of the last row's group.

    Two aggregates and a filter; the log is never sorted as a whole.
    """
    keyed = history.withColumn("_gid", group_of(F.col("group_id"), F.col("seq")))
    last = keyed.agg(F.max_by("_gid", "seq")).scalar()
    boundary = keyed.filter(F.col("_gid") != last).agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    return keyed.filter(F.col("seq") > boundary).drop("_gid")


def step_labels(history_paths: DataFrame, n: int = 4) -> DataFrame:
    """Label per history row. Only the first paths of a row travel to its label."""
    counts = history_paths.groupBy("seq").agg(F.count(F.lit(1)).alias("_total"))
    top = top_per_key(history_paths, ["seq"], n, F.asc("pos"), rank="_r")
    labels = top.groupBy("seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "rel"))), lambda x: x["rel"]), "，").alias("_l"))
    return labels.join(counts, "seq").select("seq", F.concat("_l", F.when(F.col("_total") > n, "…").otherwise("")).alias("label"))


def latest_backup(backups: DataFrame) -> DataFrame:
    """Newest backup that has a manifest, by name."""
    return backups.filter("has_manifest").agg(F.max("name").alias("name"))


def orphans(current: DataFrame, listing: DataFrame) -> DataFrame:
    """Current paths that a captured listing does not know, deepest first."""
    return current.select("rel").join(listing.select("rel"), "rel", "left_anti").withColumn("depth", paths.depth(F.col("rel"))).orderBy(
        F.desc("depth"), "rel"
    )


def minimal_paths(df: DataFrame) -> DataFrame:
    """The paths that lie below no other path of the set.

    Each path brings its ancestors to an equi join; no pair of paths is compared.
    """
    distinct = df.select("rel").distinct()
    ladder = distinct.select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("_up"))
    covered = ladder.join(distinct.select(F.col("rel").alias("_up")), "_up", "left_semi").select("rel").distinct()
    return distinct.join(covered, "rel", "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """create / modify / delete between two file tables (rel, content_hash)."""
    b = before.select("rel", F.col("content_hash").alias("before_hash"))
    a = after.select("rel", F.col("content_hash").alias("after_hash"))
    kind = F.when(F.col("before_hash").isNull(), CREATE).when(F.col("after_hash").isNull(), DELETE).otherwise(MODIFY)
    return b.join(a, "rel", "full_outer").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash"))).withColumn("kind", kind)


def conflict_check(pending: DataFrame, current: DataFrame) -> DataFrame:
    """Reason why a pending change cannot be written, NULL when it can."""
    now = current.select("rel", F.col("content_hash").alias("_now"))
    needs_file = F.col("kind").isin(MODIFY, DELETE)
    reason = (
        F.when((F.col("kind") == CREATE) & F.col("_now").isNotNull(), "the file has appeared meanwhile")
        .when(needs_file & F.col("_now").isNull(), "the file is gone")
        .when(needs_file & (F.col("_now") != F.col("before_hash")), "the file was changed meanwhile")
    )
    return pending.join(now, "rel", "left").withColumn("conflict", reason).drop("_now")


def append_snapshot(
    history: DataFrame, files: DataFrame, affected: DataFrame, group_id: str | None, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New history row, its snapshot rows and its listing, to append before a change.

    The first snapshot is a full baseline; later ones keep the affected paths and
    what lies below them. The listing always holds every visible path.
    """
    hidden = F.exists(paths.parts(F.col("rel")), lambda p: p.startswith("."))
    visible = files.filter(~hidden)
    head = history.agg((F.count(F.lit(1)) + 1).alias("seq"), (F.count(F.lit(1)) == 0).alias("baseline"))
    row = head.select("seq", F.coalesce(F.lit(group_id), F.col("seq").cast("string")).alias("group_id"), "baseline", now.alias("ts"))
    roots = minimal_paths(affected.filter(~hidden))
    ladder = visible.select("rel", "content_hash", F.explode(paths.self_and_ancestors(F.col("rel"))).alias("_up"))
    touched = ladder.join(roots.select(F.col("rel").alias("_up")), "_up", "left_semi").select("rel", "content_hash")
    gone = roots.join(visible.select(F.explode(paths.self_and_ancestors(F.col("rel"))).alias("rel")).distinct(), "rel", "left_anti")
    later = touched.withColumn("existed", F.lit(True)).unionByName(
        gone.select("rel", F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("existed"))
    )
    seq, baseline = head.select("seq").scalar(), head.select("baseline").scalar()
    # One of the two branches is empty: the number of earlier snapshots decides.
    full = visible.select("rel", "content_hash", F.lit(True).alias("existed")).filter(baseline)
    snapshot = full.unionByName(later.filter(~baseline)).select(seq.alias("seq"), "rel", "content_hash", "existed")
    listing = visible.select(seq.alias("seq"), "rel")
    return row, snapshot, listing


def undo_state(history: DataFrame, snapshots: DataFrame, listings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File table and history after undoing the last step.

    Per path the oldest snapshot among the undone rows is restored; paths that
    the oldest undone listing does not know are removed.
    """
    undone = undo_step(history).select("seq")
    restored = first_per_key(snapshots.join(undone, "seq", "left_semi"), ["rel"], F.asc("seq"))
    oldest = listings.filter(F.col("seq") == undone.agg(F.min("seq")).scalar()).select("rel")
    kept = files.join(restored.select("rel"), "rel", "left_anti").join(oldest, "rel", "left_semi").select("rel", "content_hash")
    back = restored.filter("existed").select("rel", "content_hash")
    return kept.unionByName(back), history.join(undone, "seq", "left_anti")


def undo_every_step(history: DataFrame, snapshots: DataFrame, listing_log: DataFrame) -> DataFrame:
    """What undoing each step of the log does: step, first_seq, rel, action, content_hash.

    A step is a run of rows of one group, numbered from 1. `listing_log` (seq, rel,
    present) holds the baseline listing and its changes. Per step and path the
    oldest snapshot comes back, if the listing as of the step's first row
    knows the path; otherwise the path goes. One as-of join serves all steps.
    """
    keyed = history.select("seq", group_of(F.col("group_id"), F.col("seq")).alias("_gid"))
    marked = as_of(keyed, keyed.withColumnRenamed("_gid", "_before"), [], "seq", "_before", "_last")
    starts = F.when(F.col("_gid").eqNullSafe(F.col("_last")), 0).otherwise(1)
    steps = running_total(marked, [], "seq", starts, "step").select("seq", "step")
    touched = snapshots.join(steps, "seq").groupBy("step", "rel").agg(F.min_by(F.struct("content_hash", "existed"), "seq").alias("_old"))
    firsts = steps.groupBy("step").agg(F.min("seq").alias("seq"))
    known = as_of(touched.join(firsts, "step"), listing_log, ["rel"], "seq", "present", "_known")
    back = F.coalesce("_known", F.lit(False)) & F.col("_old.existed")
    return known.select(
        "step", F.col("seq").alias("first_seq"), "rel", F.when(back, "restore").otherwise("remove").alias("action"), F.when(back, F.col("_old.content_hash")).alias("content_hash"),
    )


def undo_backup(changes: DataFrame, saved: DataFrame) -> DataFrame:
    """What to do with each written file: created ones go, the others come back; a missing copy is an error."""
    copies = saved.select("rel", F.lit(True).alias("_saved")).distinct()
    action = (
        F.when(F.col("kind") == CREATE, "delete").when(F.col("kind").isin(MODIFY, DELETE) & F.col("_saved"), "restore")
        .when(F.col("kind").isin(MODIFY, DELETE), "error: backup copy missing")
    )
    return changes.join(copies, "rel", "left").withColumn("action", action).drop("_saved")
