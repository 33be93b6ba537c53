"""Citation keys, unique names, eviction, search, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import paths
from folioframe.operators import rank, search
from folioframe.plans.registry import query
from folioframe.plans.scalars import creators_of
from folioframe.plans.views import Inputs

CITE_BASE = r"""lower(coalesce(nullif(regexp_replace(family, '[^A-Za-z0-9]+', '', 'g'), ''), 'anon') || CAST(year AS VARCHAR) || coalesce(list_filter(regexp_extract_all(title, '[A-Za-z0-9]+'), lambda w: length(w) > 2)[1], 'work'))"""


@query("cite_keys", f"""
WITH b AS (SELECT entry_id, ord, {CITE_BASE} AS base FROM v_entries), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM b)
SELECT entry_id, base || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END AS cite_key FROM n""")
def cite_keys(t: Inputs) -> DataFrame:
    df = t.v_entries.select("entry_id", "ord", rank.cite_base(F.col("family"), F.col("year"), F.col("title")).alias("base"))
    return rank.cite_keys(df).select("entry_id", "cite_key")


@query("unique_names", r"""
WITH w AS (SELECT entry_id, ord, family || ' ' || item_type AS base FROM v_entries),
e AS (SELECT DISTINCT CASE WHEN source < 'src5' THEN family || ' ' || item_type ELSE family || ' ' || item_type || ' (3)' END AS name FROM v_entries),
u AS (SELECT name AS base, 1 AS u FROM e UNION SELECT regexp_extract(name, '^(.*) \(([0-9]+)\)$', 1), CAST(regexp_extract(name, '^(.*) \(([0-9]+)\)$', 2) AS INT) FROM e WHERE regexp_matches(name, '^(.*) \(([0-9]+)\)$')),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM w),
s AS (SELECT k.entry_id, k.base, k.k, list_filter(range(1, k.k + 10), lambda i: NOT list_contains(coalesce(g.us, []), i))[k.k] AS slot FROM k LEFT JOIN (SELECT base, list(u) AS us FROM u GROUP BY base) g ON g.base = k.base)
SELECT entry_id, base || CASE WHEN slot > 1 THEN ' (' || CAST(slot AS VARCHAR) || ')' ELSE '' END AS target FROM s""")
def unique_names(t: Inputs) -> DataFrame:
    name = F.concat_ws(" ", "family", "item_type")
    existing = t.v_entries.select(
        F.when(F.col("source") < "src5", name).otherwise(F.concat(name, F.lit(" (3)"))).alias("name")
    ).distinct()
    return rank.unique_names(t.v_entries.select("entry_id", "ord", name.alias("base")), existing).select("entry_id", "target")


LIMIT = 200_000_000
NOW = "TIMESTAMP '1998-08-02 00:00:00'"
MAX_AGE = 1000
EVICT = f"""
f AS (SELECT *, epoch({NOW}) - epoch(mtime) > {MAX_AGE} * 86400 AS old FROM v_cache_files),
r AS (SELECT key, size, sum(size) OVER (ORDER BY mtime DESC, key DESC ROWS UNBOUNDED PRECEDING) AS run FROM f WHERE NOT old),
v AS (SELECT key, size, CASE WHEN run <= {LIMIT} THEN 'kept' ELSE 'over limit' END AS verdict FROM r UNION ALL SELECT key, size, 'too old' FROM f WHERE old)"""


@query("cache_evict", f"WITH {EVICT} SELECT key, size, verdict FROM v")
def cache_evict(t: Inputs) -> DataFrame:
    return rank.cache_eviction(t.v_cache_files, F.expr(NOW), MAX_AGE, LIMIT).select("key", "size", "verdict")


@query("cache_evict_totals", f"""
WITH {EVICT} SELECT count(*) FILTER (verdict <> 'kept') AS removed_files, sum(CASE WHEN verdict <> 'kept' THEN size ELSE 0 END)::BIGINT AS removed_bytes, sum(CASE WHEN verdict = 'kept' THEN size ELSE 0 END)::BIGINT AS remaining_bytes FROM v""")
def cache_evict_totals(t: Inputs) -> DataFrame:
    return rank.eviction_totals(rank.cache_eviction(t.v_cache_files, F.expr(NOW), MAX_AGE, LIMIT))


@query("session_tail", """
SELECT session_id, seq, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM v_messages) s WHERE r <= 3""")
def session_tail(t: Inputs) -> DataFrame:
    return rank.last_messages(t.v_messages, 3).select("session_id", "seq", "role", "content")


@query("sessions_by_update", """
SELECT session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM v_messages GROUP BY session_id ORDER BY 2 DESC, 1""")
def sessions_by_update(t: Inputs) -> DataFrame:
    return t.v_messages.groupBy("session_id").agg(F.max("ts").alias("_ts")).orderBy(F.desc("_ts"), "session_id").select(
        "session_id", F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at")
    )


@query("search_entries", r"""
WITH s AS (SELECT entry_id, title, (contains(lower(title), 'tion')::INT + contains(lower(coalesce(publication_title, '')), 'tion')::INT + contains(coalesce(doi, ''), 'tion')::INT + contains(coalesce(arxiv_id, ''), 'tion')::INT + contains(lower(authors), 'tion')::INT + contains(lower(folder), 'tion')::INT + contains(lower(keywords), 'tion')::INT) AS score FROM v_entries)
SELECT entry_id, title, score FROM s WHERE score > 0""")
def search_entries(t: Inputs) -> DataFrame:
    haystacks = [F.col(c) for c in ("title", "publication_title", "doi", "arxiv_id", "authors", "folder", "keywords")]
    return rank.search(t.v_entries, " Tion", haystacks).select("entry_id", "title", "score")


FIELDS = ("title", "publication_title", "doi", "arxiv_id", "authors", "folder", "keywords")


@query("search_many", rf"""
WITH q AS (SELECT DISTINCT lower(w) AS query FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> ''),
e AS (SELECT entry_id, ord, title, [{', '.join(f"lower(coalesce({f}, ''))" for f in FIELDS)}] AS fields FROM v_entries),
s AS (SELECT query, entry_id, len(list_filter(fields, lambda f: contains(f, query)))::INTEGER AS score, lower(title) AS t, ord FROM q, e)
SELECT query AS query_id, entry_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, t, ord)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 20""")
def search_many(t: Inputs) -> DataFrame:
    """Every word of the benchmark searched for in the library; the 20 best entries of each."""
    words = t.benchmark.select(F.explode(F.split("text", r"\s+")).alias("query")).filter("query <> ''").select(F.lower("query").alias("query")).distinct()
    return search.search_table(t.v_entries, words.withColumn("query_id", F.col("query")), FIELDS)


@query("main_file", r"""
SELECT bundle, rel FROM (SELECT split_part(rel, '/', 1) AS bundle, rel, row_number() OVER (PARTITION BY split_part(rel, '/', 1) ORDER BY size % 10 = 0 DESC, length(rel) - length(replace(rel, '/', '')), size DESC, rel) AS r FROM v_paths) s WHERE r = 1""")
def main_file(t: Inputs) -> DataFrame:
    files = t.v_paths.withColumn("bundle", F.substring_index("rel", "/", 1)).withColumn("has_class", F.col("size") % 10 == 0)
    return rank.main_files(files, "bundle").select("bundle", "rel")


@query("raw_output_pick", r"""
SELECT bundle, rel FROM (SELECT split_part(rel, '/', 1) AS bundle, rel, row_number() OVER (PARTITION BY split_part(rel, '/', 1) ORDER BY size DESC, doc_id DESC, rel) AS r FROM v_paths) s WHERE r = 1""")
def raw_output_pick(t: Inputs) -> DataFrame:
    files = t.v_paths.withColumn("bundle", F.substring_index("rel", "/", 1))
    return rank.largest_latest(files, "bundle", mtime="doc_id").select("bundle", "rel")


@query("precedence_pick", r"""
WITH s AS (SELECT CASE WHEN entry_id % 2 = 0 THEN translate(family, 'abcdefghij', 'ABCDEFGHIJ') ELSE family END AS name, entry_id % 3 AS precedence, entry_id FROM v_entries)
SELECT name, precedence FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY precedence, name) AS r FROM s) q WHERE r = 1""")
def precedence_pick(t: Inputs) -> DataFrame:
    df = t.v_entries.select(
        F.when(F.col("entry_id") % 2 == 0, F.translate("family", "abcdefghij", "ABCDEFGHIJ")).otherwise(F.col("family")).alias("name"),
        (F.col("entry_id") % 3).alias("precedence"),
    )
    return rank.precedence_pick(df, "name", "precedence").select("name", "precedence")


@query("supplement_names", r"""
WITH s AS (SELECT folder, entry_id, row_number() OVER (PARTITION BY folder ORDER BY entry_id) AS n FROM v_entries WHERE role = 'supplement')
SELECT folder, entry_id, CASE WHEN n = 1 THEN 'Supporting Information' ELSE 'Supplement ' || CAST(n AS VARCHAR) END AS supplement_label FROM s""")
def supplement_names(t: Inputs) -> DataFrame:
    rows = t.v_entries.filter("role = 'supplement'").select("folder", "entry_id")
    return rank.supplement_names(rows, "folder", "entry_id")


@query("next_note", r"""
WITH n AS (SELECT DISTINCT folder, 1 + length(title) % 40 AS u FROM v_entries), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY u) AS r FROM n),
g AS (SELECT folder, coalesce(min(CASE WHEN u <> r THEN r END), max(r) + 1) AS number FROM r GROUP BY folder)
SELECT folder, number, 'note' || CASE WHEN number < 10 THEN '0' ELSE '' END || CAST(number AS VARCHAR) || '.md' AS note FROM g""")
def next_note(t: Inputs) -> DataFrame:
    return rank.next_note(t.v_entries.select("folder", (1 + F.length("title") % 40).alias("number")))
