"""Usage, coverage, workspace, job and session aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.operators import quality, stats
from folioframe.plans.checks import STATES, actions_of
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs


@query("usage_monthly", "SELECT provider, strftime(ts, '%Y-%m') AS month, sum(chars)::BIGINT AS chars FROM v_usage WHERE chars > 0 GROUP BY ALL")
def usage_monthly(t: Inputs) -> DataFrame:
    return stats.usage_monthly(t.v_usage)


@query("usage_month_total", "SELECT provider, strftime(ts, '%Y-%m') AS month, sum(chars)::BIGINT AS chars FROM v_usage WHERE chars > 0 AND provider = 'p3' AND strftime(ts, '%Y-%m') = '1995-05' GROUP BY ALL")
def usage_month_total(t: Inputs) -> DataFrame:
    return stats.month_total(t.v_usage, "p3", "1995-05")


COVERED = """r AS (SELECT e.*, l.toxic = 1 AS t, l.doc_id IS NULL OR l.toxic = 1 AS scanned FROM v_entries e LEFT JOIN labels l ON l.doc_id = e.entry_id)"""


def covered_rows(t: Inputs) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("entry_id"), "toxic")
    return t.v_entries.join(labels, "entry_id", "left").withColumn("scanned", F.col("toxic").isNull() | (F.col("toxic") == 1))


@query("field_coverage", f"""
WITH {COVERED}, c AS (
SELECT 'title' AS field, count(*) FILTER (title <> '') AS n, count(*) AS base FROM r
UNION ALL SELECT 'year', count(*) FILTER (year IS NOT NULL), count(*) FROM r
UNION ALL SELECT 'authors', count(*) FILTER (authors <> '' AND NOT scanned), count(*) FILTER (NOT scanned) FROM r
UNION ALL SELECT 'issue', count(*) FILTER (issue IS NOT NULL AND NOT scanned), count(*) FILTER (NOT scanned) FROM r
UNION ALL SELECT 'publication_title', count(*) FILTER (publication_title IS NOT NULL AND NOT scanned), count(*) FILTER (NOT scanned) FROM r
UNION ALL SELECT 'publisher', count(*) FILTER (publisher IS NOT NULL AND NOT scanned), count(*) FILTER (NOT scanned) FROM r
UNION ALL SELECT 'scanned', count(*) FILTER (scanned), count(*) FROM r)
SELECT field, n, base, CASE WHEN base > 0 THEN round(100.0 * n / base, 4)::DOUBLE END AS percent FROM c""")
def field_coverage(t: Inputs) -> DataFrame:
    return stats.field_coverage(covered_rows(t), ["title", "year"], ["authors", "issue", "publication_title", "publisher"])


@query("workspace_summary", f"""
WITH {STATES} SELECT count(*) AS documents, count(*) FILTER (state = 'complete') AS processed, count(*) FILTER (status = 'error') AS errors FROM st WHERE regexp_matches(rel, '(?i)\\.(md|tex|png|pdf)$') AND NOT contains(rel, '/.library/')""")
def workspace_summary(t: Inputs) -> DataFrame:
    from folioframe.sources.files import list_documents

    actions = actions_of(t)
    no_outputs = actions.select("rel", "category", F.array().cast("array<string>").alias("outputs"))
    documents = list_documents(t.v_paths, no_outputs)
    return stats.workspace_summary(documents, quality.action_status(actions, t.v_paths), actions)


@query("session_stats", """
SELECT session_id, count(*) AS message_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) AS bad_roles FROM v_messages GROUP BY session_id""")
def session_stats(t: Inputs) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return stats.session_stats(t.v_messages).withColumns({"created_at": shown("created_at"), "updated_at": shown("updated_at")})


@query("batch_outcome", """
WITH b AS (SELECT source, doc_id, CASE WHEN length(text) % 3 = 0 THEN 'failed ' || CAST(doc_id AS VARCHAR) END AS reason FROM documents),
m AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, reason FROM b WHERE reason IS NOT NULL)
SELECT source, rank, doc_id, reason FROM m WHERE rank <= 12""")
def batch_outcome(t: Inputs) -> DataFrame:
    reason = F.when(F.length("text") % 3 == 0, F.concat(F.lit("failed "), F.col("doc_id").cast("string")))
    return stats.first_messages(t.documents.select("source", "doc_id", reason.alias("reason")), "source", "doc_id").select(
        "source", F.col("rank").cast("bigint").alias("rank"), "doc_id", "reason"
    )


@query("batch_counts", """
SELECT count(*) FILTER (length(text) % 3 <> 0) AS ok, count(*) FILTER (length(text) % 3 = 0) AS errors FROM documents""")
def batch_counts(t: Inputs) -> DataFrame:
    plan = t.documents.select(F.col("doc_id").alias("ord"), F.when(F.length("text") % 3 == 0, "failed").alias("reason"))
    return stats.batch_outcome(plan)[0]


@query("results_per_doc", """
SELECT left(sha256('n' || chr(0) || text), 20) AS doc_hash, sum(len(string_split(text, chr(10))))::BIGINT AS stored FROM documents GROUP BY ALL""")
def results_per_doc(t: Inputs) -> DataFrame:
    key = text.content_key(F.col("text"), F.lit("n"))
    return stats.results_per_doc(t.documents.select(key.alias("doc_hash"), F.explode(F.split("text", "\n")).alias("result")))
