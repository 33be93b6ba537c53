"""History, undo, diffs and path sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import history
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs

GID = "coalesce(group_id, CAST(seq AS VARCHAR))"
STEP = f"""st AS (SELECT * FROM v_history WHERE seq > (SELECT coalesce(max(seq), -1) FROM v_history WHERE {GID} <> (SELECT arg_max({GID}, seq) FROM v_history)))"""


@query("undo_step", f"WITH {STEP} SELECT seq, group_id FROM st")
def undo_step(t: Inputs) -> DataFrame:
    return history.undo_step(t.v_history).select("seq", "group_id")


@query("undo_label", """
WITH p AS (SELECT user_id AS seq, rel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, event_id, event_type || CAST(event_id AS VARCHAR) AS rel FROM events) q)
SELECT seq, string_agg(rel, '，' ORDER BY r) || CASE WHEN max(n) > 4 THEN '…' ELSE '' END AS label FROM p WHERE r <= 4 GROUP BY seq""")
def undo_label(t: Inputs) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), F.concat("event_type", F.col("event_id").cast("string")).alias("rel")
    )
    return history.step_labels(rows)


@query("latest_backup", "SELECT max(strftime(ts, '%Y%m%d-%H%M%S')) AS name FROM events WHERE event_type = 'purchase' OR event_type = 'click'")
def latest_backup(t: Inputs) -> DataFrame:
    named = t.events.select(
        F.date_format("ts", "yyyyMMdd-HHmmss").alias("name"), F.col("event_type").isin("purchase", "click").alias("has_manifest")
    )
    return history.latest_backup(named)


@query("orphans", """
SELECT rel, (length(rel) - length(replace(rel, '/', '')))::INTEGER AS depth FROM v_paths WHERE rel NOT IN (SELECT rel FROM v_mappings)""")
def orphans(t: Inputs) -> DataFrame:
    return history.orphans(t.v_paths, t.v_mappings)


@query("minimal_paths", """
WITH s AS (SELECT rel FROM v_paths UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE source < 'src5' UNION SELECT DISTINCT source FROM documents WHERE length(source) = 4),
a AS (SELECT rel, array_to_string(list_slice(string_split(rel, '/'), 1, n), '/') AS up FROM (SELECT rel, unnest(range(1, len(string_split(rel, '/')))) AS n FROM s) q)
SELECT rel FROM s WHERE rel NOT IN (SELECT rel FROM a WHERE up IN (SELECT rel FROM s))""")
def minimal_paths(t: Inputs) -> DataFrame:
    mixed = t.v_paths.select("rel").unionByName(
        t.documents.filter("source < 'src5'").select(F.concat_ws("/", "source", "lang").alias("rel"))
    ).unionByName(t.documents.filter("length(source) = 4").select(F.col("source").alias("rel")))
    return history.minimal_paths(mixed)


AFTER = "SELECT CASE WHEN size % 7 = 0 THEN rel || '.new' ELSE rel END AS rel, CASE WHEN size % 3 = 0 THEN upper(content_hash) ELSE content_hash END AS content_hash FROM v_paths"
DIFF = f"af AS ({AFTER}), df AS (SELECT coalesce(b.rel, a.rel) AS rel, b.content_hash AS before_hash, a.content_hash AS after_hash, CASE WHEN b.rel IS NULL THEN 'create' WHEN a.rel IS NULL THEN 'delete' ELSE 'modify' END AS kind FROM v_paths b FULL JOIN af a ON a.rel = b.rel WHERE b.content_hash IS DISTINCT FROM a.content_hash)"


def changed(t: Inputs) -> DataFrame:
    size = F.col("size")
    return t.v_paths.select(
        F.when(size % 7 == 0, F.concat("rel", F.lit(".new"))).otherwise(F.col("rel")).alias("rel"),
        F.when(size % 3 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
    )


@query("snapshot_diff", f"WITH {DIFF} SELECT rel, kind, before_hash, after_hash FROM df")
def snapshot_diff(t: Inputs) -> DataFrame:
    return history.snapshot_diff(t.v_paths, changed(t))


@query("conflict_check", f"""
WITH {DIFF}, c AS (SELECT rel, CASE WHEN size % 4 = 0 THEN 'x' ELSE content_hash END AS h FROM v_paths WHERE size % 5 > 0 UNION ALL SELECT rel, 'y' FROM df WHERE kind = 'create' AND length(rel) % 2 = 0)
SELECT df.rel, kind, CASE WHEN kind = 'create' AND c.h IS NOT NULL THEN 'the file has appeared meanwhile' WHEN kind <> 'create' AND c.h IS NULL THEN 'the file is gone' WHEN kind <> 'create' AND c.h <> before_hash THEN 'the file was changed meanwhile' END AS conflict FROM df LEFT JOIN c ON c.rel = df.rel""")
def conflict_check(t: Inputs) -> DataFrame:
    pending = history.snapshot_diff(t.v_paths, changed(t))
    current = t.v_paths.filter("size % 5 > 0").select(
        "rel", F.when(F.col("size") % 4 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash")
    ).unionByName(pending.filter("kind = 'create' and length(rel) % 2 = 0").select("rel", F.lit("y").alias("content_hash")))
    return history.conflict_check(pending, current).select("rel", "kind", "conflict")


@query("history_append", """
WITH v AS (SELECT rel, content_hash FROM v_paths WHERE NOT contains(rel, '/.library/')), n AS (SELECT count(*) + 1 AS seq FROM v_history)
SELECT n.seq, v.rel, v.content_hash, true AS existed FROM v, n WHERE starts_with(rel, 'src1/') OR starts_with(rel, 'src5/en/') UNION ALL SELECT n.seq, 'gone/x', NULL, false FROM n""")
def history_append(t: Inputs) -> DataFrame:
    roots = t.documents.select(F.explode(F.array(F.lit("src1"), F.lit("src1/en"), F.lit("src5/en"), F.lit("gone/x"))).alias("rel"))
    _, snapshot, _ = history.append_snapshot(t.v_history, t.v_paths, roots, None, F.current_timestamp())
    return snapshot


@query("history_baseline", """
SELECT 1::BIGINT AS seq, rel, content_hash, true AS existed FROM v_paths WHERE NOT contains(rel, '/.library/')""")
def history_baseline(t: Inputs) -> DataFrame:
    _, snapshot, _ = history.append_snapshot(t.v_history.filter("seq < 0"), t.v_paths, t.v_paths.select("rel"), "g1", F.current_timestamp())
    return snapshot


@query("undo_state", f"""
WITH {STEP}, fs AS (SELECT DISTINCT rel, 'now' AS content_hash FROM v_history), sn AS (SELECT seq, rel, 'v' || CAST(seq AS VARCHAR) AS h, value > 3 AS existed FROM v_history),
re AS (SELECT rel, arg_min(h, seq) AS h, arg_min(existed, seq) AS existed FROM sn WHERE seq IN (SELECT seq FROM st) GROUP BY rel),
ls AS (SELECT DISTINCT rel FROM v_history WHERE seq < (SELECT min(seq) FROM st) AND value < 900)
SELECT rel, content_hash FROM fs WHERE rel NOT IN (SELECT rel FROM re) AND rel IN (SELECT rel FROM ls) UNION ALL SELECT rel, h FROM re WHERE existed""")
def undo_state(t: Inputs) -> DataFrame:
    h = t.v_history
    files = h.select("rel", F.lit("now").alias("content_hash")).distinct()
    snapshots = h.select("seq", "rel", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("content_hash"), (F.col("value") > 3).alias("existed"))
    # The listing of a step holds every path of an earlier row.
    first = history.undo_step(h).agg(F.min("seq")).scalar()
    listings = h.filter("value < 900").filter(F.col("seq") < first).select(first.alias("seq"), "rel").distinct()
    return history.undo_state(h, snapshots, listings, files)[0]


@query("undo_every_step", """
WITH g AS (SELECT *, coalesce(group_id, seq::VARCHAR) AS gid FROM v_history),
st AS (SELECT *, sum(starts) OVER (ORDER BY seq)::BIGINT AS step FROM (SELECT *, CASE WHEN gid = lag(gid) OVER (ORDER BY seq) THEN 0 ELSE 1 END AS starts FROM g)),
tc AS (SELECT step, rel, arg_min('v' || CAST(seq AS VARCHAR), seq) AS h, arg_min(value > 3, seq) AS existed FROM st GROUP BY ALL),
fs AS (SELECT step, min(seq) AS first_seq FROM st GROUP BY step)
SELECT step, first_seq, tc.rel, CASE WHEN existed AND coalesce(l.value < 900, false) THEN 'restore' ELSE 'remove' END AS action, CASE WHEN existed AND coalesce(l.value < 900, false) THEN h END AS content_hash
FROM tc JOIN fs USING (step) ASOF LEFT JOIN v_history l ON l.rel = tc.rel AND fs.first_seq > l.seq""")
def undo_every_step(t: Inputs) -> DataFrame:
    """The effect of undoing each step of the whole log, against the listing as of its start."""
    h = t.v_history
    snapshots = h.select("seq", "rel", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("content_hash"), (F.col("value") > 3).alias("existed"))
    return history.undo_every_step(h, snapshots, h.select("seq", "rel", (F.col("value") < 900).alias("present")))


@query("undo_backup", f"""
WITH {DIFF} SELECT rel, kind, CASE WHEN kind = 'create' THEN 'delete' WHEN rel IN (SELECT rel FROM v_paths WHERE size % 2 = 0) THEN 'restore' ELSE 'error: backup copy missing' END AS action FROM df""")
def undo_backup(t: Inputs) -> DataFrame:
    changes = history.snapshot_diff(t.v_paths, changed(t))
    return history.undo_backup(changes, t.v_paths.filter("size % 2 = 0")).select("rel", "kind", "action")
