"""Catalog lookups, links and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import catalog
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs
from folioframe.session import cut
from folioframe.sources import files, results
from folioframe.streaming import running

STAMP = "2024-05-01T10:00:00"
SCAN = r"""
i AS (SELECT rel FROM v_paths WHERE lower(rel) LIKE '%.pdf' AND rel LIKE '%.pdf' AND NOT list_has_any(string_split(rel, '/'), ['.library', 'parsed', 'notes', 'translations'])),
sc AS (SELECT i.rel, CASE WHEN m.status = 'organized' THEN 'organized' WHEN m.status IN ('failed', 'missing') THEN 'failed' ELSE 'raw' END AS state FROM i LEFT JOIN v_mappings m ON m.rel = i.rel
UNION ALL SELECT m.rel, 'missing' FROM v_mappings m WHERE m.status = 'organized' AND m.rel NOT IN (SELECT rel FROM v_paths))"""


@query("scan_classify", f"WITH {SCAN} SELECT rel, state FROM sc")
def scan_classify(t: Inputs) -> DataFrame:
    return files.scan_library(t.v_paths, t.v_mappings).select("rel", "state")


@query("list_documents", r"""
SELECT p.rel FROM v_paths p WHERE regexp_matches(p.rel, '(?i)\.(md|tex|png|pdf)$') AND NOT list_contains(string_split(p.rel, '/'), '.library') AND p.rel NOT IN (SELECT rel FROM v_mappings WHERE status = 'supplement')""")
def list_documents(t: Inputs) -> DataFrame:
    outputs = t.v_mappings.filter("status = 'supplement'").select(F.array("rel").alias("outputs"))
    return files.list_documents(t.v_paths, outputs).select("rel")


@query("list_dir", r"""
WITH c AS (SELECT rel, string_split(rel, '/') AS p FROM v_paths WHERE starts_with(rel, 'src1/'))
SELECT DISTINCT p[2] AS name, 'folder' AS kind FROM c WHERE len(p) > 2 AND NOT starts_with(p[2], '.')
UNION ALL SELECT p[2], 'document' FROM c WHERE len(p) = 2 AND NOT starts_with(p[2], '.')""")
def list_dir(t: Inputs) -> DataFrame:
    return files.list_folder(t.v_paths, "src1").select("name", "kind")


@query("list_dir_leaf", r"""
WITH c AS (SELECT rel, string_split(rel, '/') AS p FROM v_paths WHERE starts_with(rel, 'src3/en/'))
SELECT DISTINCT p[3] AS name, 'folder' AS kind FROM c WHERE len(p) > 3 AND NOT starts_with(p[3], '.')
UNION ALL SELECT p[3], 'document' FROM c WHERE len(p) = 3 AND NOT starts_with(p[3], '.') AND regexp_matches(p[3], '(?i)\.(md|tex|png|pdf)$')""")
def list_dir_leaf(t: Inputs) -> DataFrame:
    return files.list_folder(t.v_paths, "src3/en").select("name", "kind")


@query("resolve_paths", r"""
WITH q AS (SELECT rel FROM v_paths UNION SELECT folder || '/main' || CAST(entry_id AS VARCHAR) || '.pdf' FROM v_entries UNION SELECT 'elsewhere/si' || CAST(entry_id AS VARCHAR) || '.pdf' FROM v_entries),
d AS (SELECT rel, entry_id FROM v_mappings WHERE entry_id IS NOT NULL),
k AS (SELECT e.folder || '/' || a.path AS key, e.ord, e.entry_id FROM v_attachments a JOIN v_entries e USING (entry_id) UNION SELECT a.path, e.ord, e.entry_id FROM v_attachments a JOIN v_entries e USING (entry_id)),
o AS (SELECT key, arg_min(entry_id, ord) AS entry_id, min(ord) AS ord FROM k GROUP BY key),
f AS (SELECT rel, arg_min(o.entry_id, o.ord) AS entry_id FROM (SELECT rel, rel AS key FROM q UNION SELECT rel, split_part(rel, '/', -1) FROM q) x JOIN o USING (key) GROUP BY rel)
SELECT q.rel, coalesce(d.entry_id, f.entry_id) AS entry_id, CASE WHEN d.entry_id IS NOT NULL THEN 'mapping' WHEN f.entry_id IS NOT NULL THEN 'attachment' END AS found_by FROM q LEFT JOIN d ON d.rel = q.rel LEFT JOIN f ON f.rel = q.rel""")
def resolve_paths(t: Inputs) -> DataFrame:
    id_text = F.col("entry_id").cast("string")
    wanted = t.v_paths.select("rel").unionByName(
        t.v_entries.select(F.concat("folder", F.lit("/main"), id_text, F.lit(".pdf")).alias("rel"))
    ).unionByName(t.v_entries.select(F.concat(F.lit("elsewhere/si"), id_text, F.lit(".pdf")).alias("rel")))
    return catalog.resolve_paths(wanted, t.v_mappings, t.v_entries, t.v_attachments)


@query("selected_entries", r"""
SELECT DISTINCT e.entry_id, e.title FROM v_mappings m JOIN v_entries e ON e.entry_id = m.entry_id WHERE m.status = 'organized'""")
def selected_entries(t: Inputs) -> DataFrame:
    selection = t.v_mappings.filter("status = 'organized'").select("rel")
    return catalog.selected_entries(selection, t.v_mappings, t.v_entries, t.v_attachments).select("entry_id", "title")


@query("self_heal", r"""
SELECT m.rel, CASE WHEN status IN ('organized', 'supplement') AND p.rel IS NULL THEN 'missing' ELSE status END AS status, CASE WHEN status IN ('organized', 'supplement') AND p.rel IS NULL THEN 'the file was moved or deleted outside the library' END AS message FROM v_mappings m LEFT JOIN v_paths p ON p.rel = m.rel""")
def self_heal(t: Inputs) -> DataFrame:
    return catalog.self_heal(t.v_mappings, t.v_paths).select("rel", "status", "message")


@query("link_supplements", r"""
WITH p AS (SELECT folder, arg_min(entry_id, ord) AS parent_id, arg_min(coalesce(doi, ''), ord) AS pdoi, arg_min(title, ord) AS ptitle FROM v_entries GROUP BY folder),
s AS (SELECT 'sup' || CAST(entry_id AS VARCHAR) AS rel, CASE WHEN year % 9 = 0 THEN 'none' ELSE folder END AS folder, doi, title, CASE WHEN year % 2 = 0 THEN doi END AS parent_doi FROM v_entries)
SELECT s.rel, s.folder, parent_id, coalesce(lower(doi) = lower(nullif(pdoi, '')), false) OR coalesce(lower(trim(title)) = lower(trim(ptitle)), false) AS same_work, coalesce(parent_doi <> nullif(pdoi, ''), false) AS doi_mismatch,
  coalesce(nullif(pdoi, ''), parent_doi) AS relation_target, CASE WHEN doi <> coalesce(nullif(pdoi, ''), parent_doi) THEN doi END AS supplement_doi FROM s LEFT JOIN p ON p.folder = s.folder""")
def link_supplements(t: Inputs) -> DataFrame:
    found = t.v_entries.select(
        F.concat(F.lit("sup"), F.col("entry_id").cast("string")).alias("rel"),
        F.when(F.col("year") % 9 == 0, "none").otherwise(F.col("folder")).alias("folder"), "doi", "title",
        F.when(F.col("year") % 2 == 0, F.col("doi")).alias("parent_doi"),
    )
    return catalog.link_supplements(found, t.v_entries)


PARTS = """x AS (SELECT entry_id, ord, CASE entry_id % 3 WHEN 0 THEN family || ' Studies Part II' WHEN 1 THEN family || ' Studies （上）' ELSE family || ' Studies' END AS title FROM v_entries)"""


@query("group_parts", f"""
WITH {PARTS}, p AS (SELECT entry_id, ord, trim(replace(replace(title, 'Part II', ''), '（上）', '')) AS base, CASE WHEN title LIKE '%Part II' THEN 'II' ELSE '（上）' END AS marker FROM x WHERE title LIKE '%Part II' OR title LIKE '%（上）')
SELECT entry_id, base, marker, CASE marker WHEN 'II' THEN 2 ELSE 1 END AS part_order, row_number() OVER (PARTITION BY base, marker ORDER BY ord) = 1 AS accepted FROM p""")
def group_parts(t: Inputs) -> DataFrame:
    title = F.when(F.col("entry_id") % 3 == 0, F.concat("family", F.lit(" Studies Part II"))).when(
        F.col("entry_id") % 3 == 1, F.concat("family", F.lit(" Studies （上）"))
    ).otherwise(F.concat("family", F.lit(" Studies")))
    return catalog.group_parts(t.v_entries.select("entry_id", "ord", title.alias("title")))


@query("managed_folders", r"""
WITH f AS (SELECT DISTINCT regexp_extract(rel, '^(.*)/[^/]*$', 1) AS folder FROM v_paths) SELECT folder, folder IN (SELECT folder FROM v_entries) AS managed FROM f""")
def managed_folders(t: Inputs) -> DataFrame:
    folders = t.v_paths.select(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return catalog.managed_folders(folders, t.v_entries)


@query("selectable_files", f"""
WITH {SCAN}, a AS (SELECT e.folder || '/doc' || CAST(e.entry_id AS VARCHAR) || '.pdf' AS rel FROM v_entries e)
SELECT rel FROM sc WHERE state IN ('raw', 'organized') UNION SELECT rel FROM a WHERE rel IN (SELECT rel FROM v_paths)""")
def selectable_files(t: Inputs) -> DataFrame:
    attachments = t.v_entries.select("entry_id", F.concat(F.lit("doc"), F.col("entry_id").cast("string"), F.lit(".pdf")).alias("path"))
    return catalog.selectable_files(files.scan_library(t.v_paths, t.v_mappings), t.v_entries, attachments, t.v_paths)


@query("pending_segments", r"""
WITH s AS (SELECT md5(text) AS doc_hash, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS seg_idx FROM documents)
SELECT doc_hash, seg_idx FROM s WHERE doc_hash NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id) OR seg_idx % 2 = 1""")
def pending_segments(t: Inputs) -> DataFrame:
    cut = lambda df: df.select(F.md5("text").alias("doc_hash"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "s")).drop("s")
    done = cut(t.documents.join(t.labels, "doc_id", "left_semi")).filter("seg_idx % 2 = 0")
    return catalog.pending_segments(cut(t.documents), done)


@query("drop_stale", r"""
WITH mv AS (SELECT rel, entry_id, original_name, entry_id % 2 = 0 AS keep FROM v_mappings WHERE status = 'organized')
SELECT rel, status FROM v_mappings m WHERE rel NOT IN (SELECT rel FROM mv) AND (entry_id IS NULL OR entry_id NOT IN (SELECT entry_id FROM mv WHERE NOT keep)) AND NOT (status = 'failed' AND split_part(rel, '/', -1) IN (SELECT original_name FROM mv))""")
def drop_stale(t: Inputs) -> DataFrame:
    moves = t.v_mappings.filter("status = 'organized'").withColumn("keep_entry", F.col("entry_id") % 2 == 0)
    return catalog.drop_stale(t.v_mappings, moves).select("rel", "status")


CHANGES = """ch AS (SELECT entry_id % 700 AS entry_id, entry_id AS version, 'new ' || title AS title FROM v_entries WHERE year >= 2000)"""


@query("upsert_entries", f"""
WITH {CHANGES}, n AS (SELECT entry_id, arg_max(title, version) AS title FROM ch GROUP BY entry_id)
SELECT entry_id, title, NULL AS updated_at FROM v_entries WHERE entry_id NOT IN (SELECT entry_id FROM n) UNION ALL SELECT entry_id, title, '2024-05-01T10:00:00' FROM n""")
def upsert_entries(t: Inputs) -> DataFrame:
    changes = t.v_entries.filter("year >= 2000").select(
        (F.col("entry_id") % 700).alias("entry_id"), F.col("entry_id").alias("version"), F.concat(F.lit("new "), "title").alias("title")
    )
    return catalog.upsert_entries(t.v_entries.select("entry_id", "title"), changes, F.lit(STAMP), "version")


@query("remove_entries", r"""
SELECT rel, status FROM v_mappings WHERE entry_id IS NULL OR entry_id NOT IN (SELECT entry_id FROM v_entries WHERE item_type = 'book')""")
def remove_entries(t: Inputs) -> DataFrame:
    _, mappings = catalog.remove_entries(t.v_entries, t.v_mappings, t.v_entries.filter("item_type = 'book'"))
    return mappings.select("rel", "status")


@query("upsert_mappings", r"""
WITH f AS (SELECT rel FROM v_paths WHERE size % 10 = 0), p AS (SELECT rel FROM v_paths WHERE size % 10 = 1)
SELECT rel, status, folder, NULL AS message FROM v_mappings WHERE rel NOT IN (SELECT rel FROM f UNION SELECT rel FROM p) UNION ALL SELECT rel, 'organized', 'new', NULL FROM p UNION ALL SELECT rel, 'failed', NULL, 'boom' FROM f""")
def upsert_mappings(t: Inputs) -> DataFrame:
    placed = t.v_paths.filter("size % 10 = 1").select(
        "rel", F.lit("organized").alias("status"), F.col("doc_id").alias("entry_id"), F.lit("x").alias("original_name"),
        F.explode(F.array(F.struct(F.lit(1).alias("version"), F.lit("old").alias("folder")), F.struct(F.lit(2).alias("version"), F.lit("new").alias("folder")))).alias("_v"),
    ).select("*", "_v.*").drop("_v")
    failures = t.v_paths.filter("size % 10 = 0").select("rel", F.explode(F.array(F.lit("bang"), F.lit("boom"))).alias("message"))
    recorded = catalog.record_mappings(t.v_mappings, placed, F.lit(STAMP), "version")
    return catalog.mark_failed(recorded, failures, F.lit(STAMP)).select("rel", "status", "folder", "message")


@query("remap_prefix", r"""
SELECT entry_id AS id, 'entry' AS kind, CASE WHEN folder = 'src1' OR starts_with(folder, 'src1/') THEN 'moved/x' || substr(folder, 5) ELSE folder END AS folder, NULL AS rel FROM v_entries
UNION ALL SELECT entry_id, 'mapping', CASE WHEN starts_with(rel, 'src1/') AND (folder = 'src1' OR starts_with(folder, 'src1/')) THEN 'moved/x' || substr(folder, 5) ELSE folder END, CASE WHEN starts_with(rel, 'src1/') THEN 'moved/x' || substr(rel, 5) ELSE rel END FROM v_mappings""")
def remap_prefix(t: Inputs) -> DataFrame:
    entries, mappings = catalog.remap_prefix(t.v_entries, t.v_mappings, "src1/", "/moved/x")
    return entries.select(F.col("entry_id").alias("id"), F.lit("entry").alias("kind"), "folder", F.lit(None).cast("string").alias("rel")).unionByName(
        mappings.select(F.col("entry_id").alias("id"), F.lit("mapping").alias("kind"), "folder", "rel")
    )


@query("remap_many", r"""
WITH r AS (SELECT DISTINCT source AS old, 'archive/' || source AS new FROM documents WHERE length(source) = 4 UNION SELECT DISTINCT source || '/en', 'english' FROM documents WHERE source >= 'src5')
SELECT entry_id, coalesce((SELECT arg_max(r.new || substr(e.folder, length(r.old) + 1), length(r.old)) FROM r WHERE e.folder = r.old OR starts_with(e.folder, r.old || '/')), folder) AS folder FROM v_entries e""")
def remap_many(t: Inputs) -> DataFrame:
    rules = t.documents.filter("length(source) = 4").select(F.col("source").alias("old"), F.concat(F.lit("archive/"), "source").alias("new")).union(
        t.documents.filter("source >= 'src5'").select(F.concat("source", F.lit("/en")), F.lit("english"))
    ).distinct()
    return catalog.remap_many(t.v_entries.select("entry_id", "folder"), "entry_id", "folder", rules)


@query("remove_prefix", r"""
WITH g AS (SELECT entry_id FROM v_entries WHERE folder = 'src2' OR starts_with(folder, 'src2/'))
SELECT 'entry' AS kind, CAST(entry_id AS VARCHAR) AS id FROM v_entries WHERE entry_id NOT IN (SELECT entry_id FROM g)
UNION ALL SELECT 'mapping', rel FROM v_mappings WHERE NOT starts_with(rel, 'src2/') AND (entry_id IS NULL OR entry_id NOT IN (SELECT entry_id FROM g))""")
def remove_prefix(t: Inputs) -> DataFrame:
    entries, mappings = catalog.remove_prefix(t.v_entries, t.v_mappings, "src2/")
    return entries.select(F.lit("entry").alias("kind"), F.col("entry_id").cast("string").alias("id")).unionByName(
        mappings.select(F.lit("mapping").alias("kind"), F.col("rel").alias("id"))
    )


@query("upsert_attachments", r"""
WITH a AS (SELECT * FROM v_attachments WHERE pos = 0), b AS (SELECT * FROM v_attachments WHERE pos = 1)
SELECT coalesce(a.entry_id, b.entry_id) AS entry_id, coalesce(a.path, b.path) AS path, coalesce(a.pos, b.pos) AS pos, coalesce(nullif(b.role, ''), a.role) AS role, coalesce(b.title, a.title) AS title, CASE WHEN b.entry_id % 2 = 0 THEN 'again' ELSE coalesce(b.doi, a.doi) END AS doi,
  CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 2 ELSE 1 END AS n_artifacts, CASE WHEN b.path IS NOT NULL THEN 'new' ELSE 'old' END AS note FROM a FULL JOIN b ON a.entry_id = b.entry_id AND a.path = b.path""")
def upsert_attachments(t: Inputs) -> DataFrame:
    current = t.v_attachments.filter("pos = 0").withColumn("artifacts", F.create_map(F.lit("note"), F.lit("old")))
    incoming = t.v_attachments.filter("pos = 1").withColumn("artifacts", F.create_map(F.lit("note"), F.lit("new")))
    again = incoming.filter("entry_id % 2 = 0").withColumns({"pos": F.lit(2).cast(incoming.schema["pos"].dataType), "role": F.lit(""), "title": F.lit(None).cast("string"), "doi": F.lit("again")})
    incoming = again.unionByName(incoming)  # paths that come in twice
    current = current.withColumn("artifacts", F.map_concat("artifacts", F.create_map(F.lit("parseDir"), F.lit("p"))))
    merged = catalog.upsert_attachments(current, incoming, ["role", "title", "doi"])
    return merged.select(
        "entry_id", "path", "pos", "role", "title", "doi",
        F.when(F.size("artifacts") == 2, F.when(F.col("artifacts")["note"] == "new", 2).otherwise(1)).otherwise(1).alias("n_artifacts"),
        F.col("artifacts")["note"].alias("note"),
    )


@query("delete_effect", r"""
WITH d AS (SELECT 'x/main' || CAST(entry_id AS VARCHAR) || '.pdf' AS rel, entry_id FROM v_entries WHERE year >= 2005),
s AS (SELECT a.entry_id, bool_or(a.role = 'primary') AS primary_gone FROM v_attachments a JOIN d ON d.entry_id = a.entry_id AND split_part(d.rel, '/', -1) = a.path GROUP BY a.entry_id),
l AS (SELECT a.entry_id, count(*) FILTER (a.role = 'supplement' AND a.path NOT LIKE 'main%') AS left_over FROM v_attachments a JOIN d USING (entry_id) GROUP BY a.entry_id)
SELECT l.entry_id, coalesce(s.primary_gone, false) AS primary_gone, l.left_over AS supplements_left, 0::BIGINT AS mappings_dropped, CASE WHEN coalesce(s.primary_gone, false) AND l.left_over = 0 THEN 'removed' ELSE 'kept' END AS outcome FROM l LEFT JOIN s USING (entry_id)""")
def delete_effect(t: Inputs) -> DataFrame:
    deleted = t.v_entries.filter("year >= 2005").select(F.concat(F.lit("x/main"), F.col("entry_id").cast("string"), F.lit(".pdf")).alias("rel"), "entry_id")
    return catalog.delete_effect(deleted, t.v_mappings, t.v_attachments)


@query("upsert_actions", r"""
WITH a AS (SELECT 'f' || CAST(user_id AS VARCHAR) AS rel, event_type AS category, event_id, CASE WHEN value > 5 THEN 'done' ELSE 'error' END AS status FROM events)
SELECT rel, category, arg_max(status, event_id) AS status FROM a GROUP BY ALL""")
def upsert_actions(t: Inputs) -> DataFrame:
    actions = t.events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("rel"), F.col("event_type").alias("category"), "event_id",
        F.when(F.col("value") > 5, "done").otherwise("error").alias("status"),
    )
    old = actions.filter("event_id < 500")
    nothing = t.spark.createDataFrame([], "rel string, category string, status string")
    current = catalog.upsert(nothing, old, ["rel", "category"], "event_id")
    return catalog.upsert(current, actions, ["rel", "category"], "event_id").select("rel", "category", "status")


@query("invalidate_results", r"""
SELECT md5(text) AS doc_hash, count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0) GROUP BY 1""")
def invalidate_results(t: Inputs) -> DataFrame:
    stored = t.documents.select(F.md5("text").alias("doc_hash"), "doc_id")
    bad = t.documents.join(t.labels.filter("quality = 0"), "doc_id", "left_semi").select(F.md5("text").alias("doc_hash"))
    return stored.join(bad, "doc_hash", "left_anti").groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n"))


@query("result_store", r"""
WITH c AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT left(sha256('translate' || chr(0) || CAST(conv_id AS VARCHAR)), 20) AS doc_hash, turn AS seg_idx,
  md5(CASE WHEN conv_id % 6 = 0 AND turn < 2 THEN 'B' || text WHEN conv_id % 3 <> 0 AND turn < 4 THEN text ELSE 'C' || text END) AS result, turn < 4 AND conv_id % 3 <> 0 OR conv_id % 6 = 0 AND turn < 2 AS in_third FROM c""")
def result_store(t: Inputs) -> DataFrame:
    """Results of all turns set, set again, invalidated, replaced, compacted and resumed; `in_third` tells what the third version held."""
    turns = t.conversations.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    turns = cut(turns.select("conv_id", results.doc_hash("translate", F.col("conv_id").cast("string")).alias("doc_hash"), F.col("turn").alias("seg_idx"), F.col("text").alias("result")))
    store = results.ResultStore(t.spark, running.new_folder(t.spark, "results"))
    store.set(turns.filter("seg_idx < 4"))
    if store.set(turns.filter("seg_idx < 4")) is not None:
        raise AssertionError("a repeated run has written")
    store.invalidate(turns.filter("conv_id % 3 = 0"))
    third = store.set(turns.filter("conv_id % 6 = 0 and seg_idx < 2").withColumn("result", F.concat(F.lit("B"), "result")))
    held = cut(store.read(third).select("doc_hash", "seg_idx", F.lit(True).alias("in_third")))
    store.compact()
    store.set(catalog.pending_segments(turns, store.read()).withColumn("result", F.concat(F.lit("C"), "result")))
    now = store.read().join(held, ["doc_hash", "seg_idx"], "left")
    return now.select("doc_hash", "seg_idx", F.md5("result").alias("result"), F.coalesce("in_third", F.lit(False)).alias("in_third"))
