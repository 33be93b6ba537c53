"""Whole jobs: batch identify and archive, rename plan, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import people
from folioframe.operators import catalog, extract, identify, linkage, moves, scale
from folioframe.plans.ratio import key_of, may_match, ratios
from folioframe.plans.registry import STATEMENTS, query
from folioframe.plans.scalars import creators_of
from folioframe.plans.views import Inputs
from folioframe.session import cut
from folioframe.streaming import running


def planted(t: Inputs) -> DataFrame:
    """The waterfall over documents and registries planted for each of its tiers."""
    rows = cut(t.v_planted)
    person = lambda c: F.array(people.parse_name(c))
    year = F.col("y").cast("int").alias("year")
    arxiv = rows.filter("doc_id % 8 = 0").select(F.col("own_arxiv").alias("arxiv_id"), F.concat("lib_title", F.lit(" v2")).alias("title"), person(F.concat("p1", F.lit(" X"))).alias("creators"), year)
    def shelf(label: str, tiers: str, title: Column) -> DataFrame:
        return rows.filter(tiers).select(
            F.when(F.expr("doc_id % 8 < 3"), F.col("own_doi")).alias("doi"), F.col("doc_id").alias("ord"), title.alias("title"), person(F.lit(f"Ann {label}")).alias("creators"), year,
            F.concat(F.lit(f"{label} Letters "), F.when(F.expr("doc_id % 8 < 3"), F.left("h", F.lit(4))).otherwise(F.col("topic"))).alias("publication_title"), F.lit("7").alias("volume"), F.lit("3").alias("issue"), F.lit(label).alias("publisher"))
    by_title = lambda label: F.when(F.expr("doc_id % 8 < 3"), F.concat(F.lit(f"{label} "), "h")).otherwise(F.concat("cn_title", F.lit("续")))
    crossref, openalex = shelf("Crossref", "doc_id % 8 in (1, 4)", by_title("Crossref")), shelf("OpenAlex", "doc_id % 8 in (1, 2, 3)", by_title("OpenAlex"))
    tex = F.concat(F.lit("\\documentclass{article}\n\\title{"), "topic", F.lit("研究}\n\\author{"), "p1", F.lit(" \\and "), "p2", F.lit("}\n\\date{"), "y", F.lit("-05}\n\\begin{document}\n"), "text")
    parsed = rows.filter("doc_id % 16 = 6").select("doc_id", tex.alias("text"))
    return identify.identify(rows.select("doc_id", "filename", "text"), arxiv, crossref, openalex, parsed)


IDENTIFIED = """
ax AS (SELECT own_arxiv AS a, min(lib_title) AS title, min(p1) AS p1, min(y) AS y FROM v_planted WHERE doc_id % 8 = 0 GROUP BY 1),
dois AS (SELECT own_doi AS d, min(h) AS h, min(y) AS y, bool_or(doc_id % 8 = 1) AS cr, bool_or(doc_id % 8 IN (1, 2)) AS oa FROM v_planted WHERE doc_id % 8 IN (1, 2) GROUP BY 1),
cn AS (SELECT cn_title, doc_id % 8 AS k, arg_min(topic, doc_id) AS topic FROM v_planted WHERE doc_id % 8 IN (3, 4) GROUP BY ALL),
m AS (SELECT p.*, doc_id % 8 AS k, CASE WHEN doc_id % 8 = 0 THEN own_arxiv WHEN doc_id % 8 = 1 THEN '9' || substr(own_arxiv, 2) END AS arx, CASE WHEN doc_id % 8 IN (1, 2) THEN own_doi END AS dd FROM v_planted p),
idn AS (SELECT m.doc_id, m.filename, m.text AS whole, m.site, CASE WHEN ax.a IS NOT NULL THEN 'arXiv' WHEN cr THEN 'Crossref' WHEN oa THEN 'OpenAlex' WHEN m.k = 3 THEN 'OpenAlex' WHEN m.k = 4 THEN 'Crossref' WHEN m.k = 5 THEN 'cn-filename' WHEN m.doc_id % 16 = 6 THEN 'local' WHEN m.k = 7 THEN 'local-text' END AS source,
  CASE WHEN ax.a IS NOT NULL THEN ax.title || ' v2' WHEN cr THEN 'Crossref ' || dois.h WHEN oa THEN 'OpenAlex ' || dois.h WHEN m.k IN (3, 4, 5) THEN m.cn_title WHEN m.doc_id % 16 = 6 THEN m.topic || '研究' WHEN m.k = 7 THEN 'A Study of ' || substr(m.h, 1, 6) || ' in ' || m.site END AS title,
  CASE WHEN ax.a IS NOT NULL THEN 'X' WHEN cr THEN 'Crossref' WHEN oa THEN 'OpenAlex' WHEN m.k IN (3, 4, 5) THEN m.p1 WHEN m.doc_id % 16 = 6 THEN m.p1 || '|' || m.p2 WHEN m.k = 7 THEN substr(translate(m.h, '0123456789', 'ghijklmnop'), 1, 6) || '|Stone|' || m.lang END AS families,
  CASE WHEN ax.a IS NOT NULL THEN ax.y WHEN cr OR oa THEN dois.y WHEN m.k IN (3, 4, 5) OR m.doc_id % 16 = 6 THEN m.y END::INTEGER AS year,
  CASE WHEN ax.a IS NOT NULL THEN NULL WHEN cr THEN 'Crossref Letters ' || substr(dois.h, 1, 4) WHEN oa THEN 'OpenAlex Letters ' || substr(dois.h, 1, 4) WHEN m.k = 3 THEN 'OpenAlex Letters ' || cn.topic WHEN m.k = 4 THEN 'Crossref Letters ' || cn.topic END AS venue,
  CASE WHEN m.k IN (3, 4) THEN 'publication_title|volume|issue|publisher' ELSE '' END AS filled, dd AS doi, m.k
  , CASE WHEN arx IS NOT NULL AND ax.a IS NULL THEN 'arXiv-' ELSE '' END AS before, CASE WHEN m.k IN (3, 4) THEN m.cn_title || '续' END AS net_title
  FROM m LEFT JOIN ax ON ax.a = m.arx LEFT JOIN dois ON dois.d = m.dd LEFT JOIN cn ON cn.cn_title = m.cn_title AND cn.k = m.k)"""


# Unlike texts can have one arXiv id: title and year come from one record, as in `merge.one_per_key` the first by its JSON text.
ONE_RECORD = IDENTIFIED.replace(
    "min(lib_title) AS title, min(p1) AS p1, min(y) AS y FROM v_planted WHERE doc_id % 8 = 0",
    "arg_min(lib_title, r) AS title, arg_min(y, r) AS y FROM (SELECT *, CAST(to_json(lib_title || ' v2') AS VARCHAR) || p1 || y AS r FROM v_planted WHERE doc_id % 8 = 0)")


@query("identify_waterfall", f"""
WITH {ONE_RECORD} SELECT doc_id, source, title, families, CASE WHEN k <> 7 THEN year END AS year, CASE WHEN k <> 7 THEN venue END AS venue, filled, doi,
  before || CASE WHEN source IS NULL THEN '' ELSE source || '+' || coalesce(net_title, title) END AS attempts, k = 2 AND doc_id % 3 = 0 AS is_supplement,
  CASE WHEN k = 2 AND doc_id % 3 = 0 THEN 'The parent of ' || site END AS parent_title FROM idn""")
def identify_waterfall(t: Inputs) -> DataFrame:
    """Every document through all tiers: where its record comes from, what it holds and what was tried."""
    tried = F.transform("attempts", lambda a: F.concat(a["source"], F.when(a["ok"], F.concat(F.lit("+"), a["message"])).otherwise("-")))
    other = F.expr("doc_id % 8 <> 7")
    return planted(t).select(
        "doc_id", "source", "title", F.when(F.col("source").isNotNull(), F.array_join(F.transform("creators", lambda p: p["family"]), "|")).alias("families"),
        F.when(other, F.col("year")).alias("year"), F.when(other, F.col("publication_title")).alias("venue"), F.array_join("filled", "|").alias("filled"), "doi",
        F.array_join(tried, "").alias("attempts"), "is_supplement", "parent_title",
    )


NAME = r"trim(regexp_replace(trim(regexp_replace(regexp_replace({0}, '[<>:\"/\\|?*]+', '-', 'g'), '\s+', ' ', 'g'), ' .'), '\s*[-–—]\s*[-–—]+\s*', ' - ', 'g'), ' .')"
W = r"[^\p{L}\p{N}_]"
TEXT_YEAR = rf"""TRY_CAST(coalesce(nullif(regexp_extract(whole, '(?im)^\s*Published\s*:[^\n]*{W[:-1]}\n]((?:19|20)[0-9]{{2}})(?:$|{W})', 1), ''),
  nullif(regexp_extract(whole, '(?i)(?:^|{W})(?:Journal|Nature|Science){W[:-1]}\n](?:[^\n]{{0,98}}?{W[:-1]}\n])?((?:19|20)[0-9]{{2}})(?:$|{W})', 1), ''), nullif(regexp_extract(whole, '(?:^|{W})((?:19|20)[0-9]{{2}})(?:$|{W})', 1), '')) AS INTEGER)"""


@query("batch_identify", f"""
WITH RECURSIVE {IDENTIFIED},
f AS (SELECT doc_id AS entry_id, title, doi, filename, k = 2 AND doc_id % 3 = 0 AS sup, coalesce(split_part(families, '|', 1), '') AS family, {key_of("coalesce(title, '')")} AS key,
  coalesce(CASE WHEN k <> 7 THEN year WHEN {TEXT_YEAR} BETWEEN 1900 AND year(current_date) + 1 THEN {TEXT_YEAR} END::VARCHAR, '') AS y FROM idn),
lib AS (SELECT e.entry_id + 1000000000 AS entry_id, e.ord, e.doi, e.folder, {key_of('e.title')} AS key, coalesce(l.quality = 1, length(e.title) % 2 = 0) AS taken FROM v_entries e LEFT JOIN labels l ON l.doc_id = e.entry_id),
byd AS (SELECT f.entry_id, m[2] AS match_id FROM f JOIN (SELECT doi, min((ord, entry_id)) AS m FROM lib WHERE doi IS NOT NULL GROUP BY doi) USING (doi)),
t AS (SELECT key, min((ord, entry_id)) AS m FROM lib WHERE key <> '' GROUP BY key),
rest AS (SELECT * FROM f WHERE key <> '' AND entry_id NOT IN (SELECT entry_id FROM byd)),
eqt AS (SELECT entry_id, m[2] AS match_id FROM rest JOIN t USING (key)),
op AS (SELECT * FROM rest WHERE entry_id NOT IN (SELECT entry_id FROM eqt)),
{ratios("SELECT op.key AS a, t.key AS b FROM op JOIN t ON " + may_match(0.92, 'op.key', 't.key'))},
fz AS (SELECT op.entry_id, max((ratio, -t.m[1], t.m[2])) AS best FROM op JOIN rt ON rt.a = op.key JOIN t ON t.key = rt.b WHERE ratio >= 0.92 GROUP BY op.entry_id),
dup AS (SELECT * FROM byd UNION ALL SELECT * FROM eqt UNION ALL SELECT entry_id, best[3] FROM fz),
c AS (SELECT f.*, {NAME.format("family || ' - ' || y")} AS name, lib.folder, CASE WHEN coalesce(title, '') = '' THEN 'not identified' WHEN lib.folder IS NOT NULL AND taken AND NOT sup THEN 'the parent already has a primary file' END AS reason
  FROM f LEFT JOIN dup USING (entry_id) LEFT JOIN lib ON lib.entry_id = dup.match_id),
u AS (SELECT entry_id, name || CASE WHEN row_number() OVER (PARTITION BY name ORDER BY entry_id) > 1 THEN ' (' || row_number() OVER (PARTITION BY name ORDER BY entry_id) || ')' ELSE '' END AS fresh FROM c WHERE folder IS NULL AND reason IS NULL),
p AS (SELECT c.*, CASE WHEN reason IS NULL THEN coalesce(folder, fresh) END AS place FROM c LEFT JOIN u USING (entry_id))
SELECT entry_id, filename AS rel, place || '/' || split_part(place, '/', -1) || CASE WHEN sup THEN ' - Supporting Information.pdf' ELSE '.pdf' END AS target, CASE WHEN sup THEN 'supplement' ELSE 'primary' END AS role,
  CASE WHEN reason IS NOT NULL THEN 'failed' WHEN sup THEN 'supplement' ELSE 'organized' END AS status, reason FROM p""")
def batch_identify(t: Inputs) -> DataFrame:
    """Documents to a move plan: all tiers of identification, duplicates in the library by DOI and title, name, place."""
    found = cut(planted(t).join(t.v_planted.select("doc_id", F.col("filename").alias("rel")), "doc_id").withColumn("ord", F.col("doc_id")).withColumnRenamed("doc_id", "entry_id"))
    labels = t.labels.select(F.col("doc_id").alias("entry_id"), (F.col("quality") == 1).alias("good"))
    library = cut(t.v_entries.join(labels, "entry_id", "left").select(
        (F.col("entry_id") + 10**9).alias("entry_id"), "ord", "doi", "title", "folder", F.coalesce("good", F.length("title") % 2 == 0).alias("has_primary")
    ))
    duplicates = linkage.find_duplicates(found.select("entry_id", "ord", "doi", "title"), library)
    names = library.select(F.substring_index("folder", "/", -1).alias("name")).distinct()
    return catalog.archive_plan(found, duplicates, library, names, '{{ authors max="1" name="family" }} - {{ year }}')


@query("archive_plan", r"""
WITH n AS (SELECT entry_id, ord, trim(split_part(split_part(authors, ';', 1), ',', 1)) || ' - ' || year AS x, doi FROM v_entries),
c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(x, '[<>:"/\\|?*]+', '-', 'g'), '\s+', ' ', 'g'), ' .'), '\s*[-–—]\s*[-–—]+\s*', ' - ', 'g'), ' .') AS name FROM n),
m AS (SELECT c.entry_id, l.folder, l.quality = 1 AS taken FROM c LEFT JOIN (SELECT e.doi, arg_min(e.folder, e.entry_id) AS folder, arg_min(lb.quality, e.entry_id) AS quality FROM v_entries e JOIN labels lb ON lb.doc_id = e.entry_id WHERE e.doi IS NOT NULL GROUP BY e.doi) l ON l.doi = c.doi),
k AS (SELECT c.entry_id, c.ord, c.name, m.folder, m.folder IS NOT NULL AND m.taken AND c.entry_id % 5 > 0 AS rejected FROM c JOIN m USING (entry_id)),
u AS (SELECT entry_id, name || CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ord) > 1 THEN ' (' || row_number() OVER (PARTITION BY name ORDER BY ord) || ')' ELSE '' END AS fresh FROM k WHERE folder IS NULL AND NOT rejected),
p AS (SELECT k.*, CASE WHEN NOT rejected THEN coalesce(folder, fresh) END AS place FROM k LEFT JOIN u USING (entry_id))
SELECT entry_id, place || '/' || split_part(place, '/', -1) || CASE WHEN entry_id % 5 = 0 THEN ' - Supporting Information.pdf' ELSE '.pdf' END AS target, CASE WHEN entry_id % 5 = 0 THEN 'supplement' ELSE 'primary' END AS role,
  CASE WHEN rejected THEN 'failed' WHEN entry_id % 5 = 0 THEN 'supplement' ELSE 'organized' END AS status, CASE WHEN rejected THEN 'the parent already has a primary file' END AS reason FROM p""")
def archive_plan(t: Inputs) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("entry_id"), (F.col("quality") == 1).alias("has_primary"))
    library = t.v_entries.join(labels, "entry_id").select((F.col("entry_id") + 10**9).alias("entry_id"), "ord", "doi", "folder", "has_primary")
    first = library.filter("doi is not null").groupBy("doi").agg(F.min("entry_id").alias("match_id"))
    duplicates = t.v_entries.select("entry_id", "doi").join(first, "doi").select("entry_id", "match_id")
    files = creators_of(t.v_entries).withColumn("rel", F.lit("in.pdf")).withColumn("is_supplement", F.col("entry_id") % 5 == 0)
    names = library.select(F.lit("no such name").alias("name")).distinct()
    plan = catalog.archive_plan(files, duplicates, library, names, '{{ authors max="1" name="family" }} - {{ year }}')
    return plan.select("entry_id", "target", "role", "status", "reason")


EFFECTS = f"""pl AS (SELECT *, 'in/doc' || CAST(entry_id AS VARCHAR) || '.pdf' AS rel, 'doc' || CAST(entry_id AS VARCHAR) || '.pdf' AS orig FROM ({STATEMENTS["archive_plan"]}))"""


@query("archive_mappings", f"""
WITH {EFFECTS}, k AS (SELECT rel, status, entry_id, original_name, folder, NULL AS message FROM v_mappings WHERE rel NOT IN (SELECT rel FROM pl WHERE target IS NOT NULL)
  AND coalesce(entry_id NOT IN (SELECT entry_id FROM pl WHERE target IS NOT NULL AND role <> 'supplement'), true) AND NOT (status = 'failed' AND split_part(rel, '/', -1) IN (SELECT orig FROM pl WHERE target IS NOT NULL))),
nw AS (SELECT target AS rel, arg_max(status, entry_id) AS status, max(entry_id) AS entry_id, arg_max(orig, entry_id) AS original_name, arg_max(regexp_extract(target, '^(.*)/[^/]*$', 1), entry_id) AS folder, NULL AS message FROM pl WHERE target IS NOT NULL GROUP BY target)
SELECT * FROM k WHERE rel NOT IN (SELECT rel FROM nw) UNION ALL SELECT * FROM nw UNION ALL SELECT rel, 'failed', NULL, orig, NULL, reason FROM pl WHERE target IS NULL""")
def archive_mappings(t: Inputs) -> DataFrame:
    """The mapping table after the archive plan of all files."""
    plan = archive_plan(t).withColumn("rel", F.concat(F.lit("in/doc"), F.col("entry_id").cast("string"), F.lit(".pdf")))
    after, _ = catalog.archive_effects(plan, t.v_mappings.withColumn("message", F.lit(None).cast("string")))
    return after.select("rel", "status", "entry_id", "original_name", "folder", "message")


@query("archive_bundles", f"""
WITH {EFFECTS} SELECT max(entry_id) AS entry_id, regexp_extract(target, '^(.*)/[^/]*$', 1) || '/citation.bib' AS target FROM pl WHERE target IS NOT NULL GROUP BY regexp_extract(target, '^(.*)/[^/]*$', 1)""")
def archive_bundles(t: Inputs) -> DataFrame:
    """The citation files that the archive plan leaves to write."""
    plan = archive_plan(t).withColumn("rel", F.concat(F.lit("in/doc"), F.col("entry_id").cast("string"), F.lit(".pdf")))
    return catalog.archive_effects(plan, t.v_mappings.withColumn("message", F.lit(None).cast("string")))[1]


RENAMED = STATEMENTS["render_name"].rsplit("SELECT entry_id, CASE WHEN length(x)", 1)


@query("rename_plan", RENAMED[0] + ", nm AS (SELECT entry_id, CASE WHEN length(x)" + RENAMED[1] + r"""),
tg AS (SELECT entry_id, name || CASE WHEN row_number() OVER (PARTITION BY name ORDER BY entry_id) > 1 THEN ' (' || row_number() OVER (PARTITION BY name ORDER BY entry_id) || ')' ELSE '' END AS target FROM nm)
SELECT a.entry_id, a.pos, e.source || '/' || e.lang || '/' || a.path AS src, target || '/' || CASE a.role WHEN 'primary' THEN target || '.pdf' WHEN 'supplement' THEN target || ' - Supporting Information.pdf' ELSE a.path END AS dst
FROM (SELECT entry_id, 0 AS pos, 'main' || CAST(entry_id AS VARCHAR) || '.pdf' AS path, 'primary' AS role, year FROM v_entries UNION ALL SELECT entry_id, 1, CASE WHEN year % 2 = 0 THEN 'si' ELSE 'main' END || CAST(entry_id AS VARCHAR) || '.pdf', CASE WHEN year % 2 = 0 THEN 'supplement' ELSE '' END, year FROM v_entries) a JOIN v_entries e USING (entry_id) JOIN tg USING (entry_id)""")
def rename_plan(t: Inputs) -> DataFrame:
    entries = creators_of(t.v_entries).withColumn("language", F.lit("en"))
    return catalog.rename_plan(entries, t.v_attachments).select("entry_id", "pos", "src", "dst")


@query("move_order", """
WITH n AS (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS n FROM (SELECT DISTINCT rel FROM v_paths)),
b AS (SELECT rel, n // 6 AS b, n % 6 AS k, count(*) OVER (PARTITION BY n // 6) AS size, lead(rel) OVER (PARTITION BY n // 6 ORDER BY n) AS nxt, first_value(rel) OVER (PARTITION BY n // 6 ORDER BY n) AS head, nth_value(rel, 2) OVER (PARTITION BY n // 6 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM n)
SELECT size - 1 - k AS step, rel AS src, coalesce(nxt, rel || '.new') AS dst, 'move' AS kind, NULL::VARCHAR AS reason FROM b WHERE b % 4 = 0
UNION ALL SELECT size - k, rel, coalesce(nxt, head), 'move', NULL FROM b WHERE b % 4 = 1 AND k > 0
UNION ALL SELECT 0, rel, regexp_extract(rel, '^(.*/)[^/]*$', 1) || '.moving-' || md5(rel), 'to temporary', NULL FROM b WHERE b % 4 = 1 AND k = 0 AND size > 1
UNION ALL SELECT size, regexp_extract(rel, '^(.*/)[^/]*$', 1) || '.moving-' || md5(rel), second, 'from temporary', NULL FROM b WHERE b % 4 = 1 AND k = 0 AND size > 1
UNION ALL SELECT 0, rel, rel || '.twin', 'move', NULL FROM b WHERE b % 4 = 2 AND k = 0
UNION ALL SELECT NULL, rel, head || '.twin', 'move', 'another move has the target' FROM b WHERE b % 4 = 2 AND k = 1
UNION ALL SELECT NULL, rel, nxt, 'move', CASE WHEN k = size - 2 THEN 'the target exists' ELSE 'a move behind the target cannot be made' END FROM b WHERE b % 4 = 3 AND nxt IS NOT NULL""")
def move_order(t: Inputs) -> DataFrame:
    """All files of the inventory in groups of six: chains, rings, one target wanted twice, and chains that end at a file that stays."""
    rows = scale.numbered(t.v_paths.select("rel").distinct(), [], "rel", "n").select("rel", F.expr("n - 1").alias("n"))
    group = Window.partitionBy("b").orderBy("n")
    rows = rows.select("rel", "n", F.expr("n div 6").alias("b"), F.expr("n % 6").alias("k")).withColumns({"next": F.lead("rel").over(group), "head": F.first("rel").over(group)})
    dst = F.expr("""CASE b % 4 WHEN 0 THEN coalesce(next, rel || '.new') WHEN 1 THEN coalesce(next, head) WHEN 2 THEN CASE WHEN k < 2 THEN head || '.twin' END ELSE next END""")
    plan = rows.select(F.col("rel").alias("src"), dst.alias("dst")).filter("dst is not null")
    return moves.in_order(plan, t.v_paths)


def _finish(stream) -> None:
    stream.awaitTermination()


@query("stream_usage", "SELECT provider, strftime(ts, '%Y-%m') AS month, sum(chars)::BIGINT AS chars FROM v_usage WHERE chars > 0 GROUP BY ALL")
def stream_usage(t: Inputs) -> DataFrame:
    lines = running.table_stream(t.spark, t.folder, "lineitem", t.lineitem.schema)
    usage = lines.select(
        F.concat(F.lit("p"), (F.col("l_suppkey") % 10).cast("string")).alias("provider"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity").cast("bigint") - 5).alias("chars"),
    )
    out = running.new_folder(t.spark, "usage")
    _finish(running.keep_changes(running.running_usage(usage), out, running.new_folder(t.spark, "usage-state"), available_now=True))
    return running.usage_by_month(t.spark, out)


@query("stream_sessions", """
SELECT conv_id AS session_id, count(*) AS message_count, strftime(make_timestamp((1704067200 + conv_id * 3600 + min(turn) * 60) * 1000000), '%H:%M') AS created_at, strftime(make_timestamp((1704067200 + conv_id * 3600 + max(turn) * 60) * 1000000), '%H:%M') AS updated_at FROM conversations GROUP BY conv_id""")
def stream_sessions(t: Inputs) -> DataFrame:
    rows = running.table_stream(t.spark, t.folder, "conversations", t.conversations.schema)
    messages = rows.select(
        F.col("conv_id").alias("session_id"), F.timestamp_seconds(1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts")
    )
    out = running.new_folder(t.spark, "sessions")
    _finish(running.keep_changes(running.running_sessions(messages), out, running.new_folder(t.spark, "sessions-state"), available_now=True))
    shown = lambda c: F.date_format(c, "HH:mm")
    return running.session_totals(t.spark, out).withColumns({"created_at": shown("created_at"), "updated_at": shown("updated_at")})


INTAKE_TEXT = """'# Report ' || substr(md5(text), 1, 2) || ' of ' || source || chr(10) || 'Ann Stone' || substr(translate(md5(text), '0123456789', 'ghijklmnop'), 1, 1) || ' and Bob Reed' || chr(10) || 'Published: 12 March 2021' || chr(10) || text
  || CASE WHEN length(text) % 5 > 0 THEN chr(10) || 'doi: 10.1234/' || substr(md5(text), 1, 12) ELSE '' END"""


@query("stream_intake", """
WITH d AS (SELECT doc_id, CASE WHEN length(text) % 5 > 0 THEN '10.1234/' || substr(md5(text), 1, 12) END AS doi, 'Report ' || substr(md5(text), 1, 2) || ' of ' || source AS title, 'Stone' || substr(translate(md5(text), '0123456789', 'ghijklmnop'), 1, 1) || ' - 2021' AS name FROM documents),
f AS (SELECT *, CASE WHEN doi IS NOT NULL THEN min(doc_id) OVER (PARTITION BY doi) END AS fd, min(doc_id) OVER (PARTITION BY lower(title)) AS ft FROM d),
s AS (SELECT *, CASE WHEN fd < doc_id THEN 'doi' WHEN ft < doc_id THEN 'title' END AS reason FROM f),
n AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY name, reason IS NULL ORDER BY doc_id) END AS n FROM s),
o AS (SELECT *, name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS own FROM n)
SELECT doc_id AS entry_id, doi, title, CASE WHEN reason IS NULL THEN 'organized' ELSE 'duplicate' END AS status, CASE reason WHEN 'doi' THEN fd WHEN 'title' THEN ft END AS match_id, reason, CASE WHEN reason IS NULL THEN own || '/' || own || '.pdf' END AS target FROM o""")
def stream_intake(t: Inputs) -> DataFrame:
    """Documents as a stream: identified from their whole text, checked for a repeated DOI or title, named and placed."""
    def identified(rows: DataFrame) -> DataFrame:
        guess = extract.text_metadata(rows.select("doc_id", F.expr(INTAKE_TEXT).alias("text")))
        return guess.select(F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("ord"), "doi", "title", "creators", "year")

    arriving = running.table_stream(t.spark, t.folder, "documents", t.documents.schema)
    plan = running.new_folder(t.spark, "plan")
    _finish(running.intake(arriving, identified, plan, running.new_folder(t.spark, "plan-state"), '{{ authors max="1" name="family" }} - {{ year }}', available_now=True))
    return t.spark.read.parquet(plan).select("entry_id", "doi", "title", "status", "match_id", "reason", "target")
