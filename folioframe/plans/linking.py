"""Registry records, merging, duplicates and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import linkage, merge, rank, stats
from folioframe.plans.ratio import key_of, may_match, ratios, squashed_of
from folioframe.plans.registry import STATEMENTS, query
from folioframe.plans.scalars import STOP, creators_of
from folioframe.plans.views import Inputs
from folioframe.sources import records, registries
from folioframe.streaming import running

CLEAN = """jr AS (SELECT *, replace(replace(title, chr(92), ''), chr(34), '') AS jt, replace(replace(family, chr(92), ''), chr(34), '') AS jf, replace(replace(given, chr(92), ''), chr(34), '') AS jg, replace(replace(publication_title, chr(92), ''), chr(34), '') AS jp, replace(replace(publisher, chr(92), ''), chr(34), '') AS jpub FROM v_entries WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY entry_id) = 1)"""


@query("registry_crossref", f"""
WITH {CLEAN} SELECT doi, regexp_replace(trim(jt || '.'), '\\.+$', '') AS title, jf AS family, jg AS given, year, 'en' AS language, nullif(trim(jp), '') AS publication_title, volume, issue, isbn, nullif(trim(jpub), '') AS publisher, 'journalArticle' AS item_type FROM jr""")
def registry_crossref(t: Inputs) -> DataFrame:
    found = registries.crossref_entries(t.v_registry)
    return found.select(
        "doi", "title", F.col("creators")[0]["family"].alias("family"), F.col("creators")[0]["given"].alias("given"), "year",
        "language", "publication_title", "volume", "issue", "isbn", "publisher", "item_type",
    )


@query("registry_openalex", f"""
WITH {CLEAN}, p AS (SELECT *, CASE WHEN year % 4 = 0 THEN NULL ELSE volume END AS fp, CASE WHEN year % 4 = 1 THEN NULL ELSE volume || '9' END AS lp FROM jr)
SELECT doi, regexp_replace(trim(jt || '.'), '\\.+$', '') AS title, year, nullif(trim(jp), '') AS publication_title, volume, issue, CASE WHEN fp IS NOT NULL AND lp IS NOT NULL THEN fp || '-' || lp ELSE fp END AS pages, fp AS page_start, lp AS page_end, 'x' || jg || ' y' || jg || ' ' || jf || ' y' || jg || ' ' || jf AS abstract FROM p""")
def registry_openalex(t: Inputs) -> DataFrame:
    return registries.openalex_entries(t.v_openalex).select(
        "doi", "title", "year", "publication_title", "volume", "issue", "pages", "page_start", "page_end", "abstract"
    )


@query("registry_arxiv", r"""
SELECT entry_id, trim(regexp_replace(regexp_replace(title, '[<>&]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS title, year, arxiv_id, doi, regexp_replace(family, '[<>&,]', '', 'g') AS family FROM v_entries WHERE arxiv_id IS NOT NULL""")
def registry_arxiv(t: Inputs) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, "[<>&]", "")
    xml = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), "arxiv_id", F.lit("v2</id><title>"), plain("title"), F.lit("</title><summary> s\n t </summary><published>"),
        F.col("year").cast("string"), F.lit("-01-02T00:00:00Z</published><author><name>X "), F.regexp_replace("family", "[<>&,]", ""),
        F.lit("</name></author><doi>"), F.coalesce("doi", F.lit("")), F.lit("</doi></entry>"),
    )
    parsed = t.v_entries.filter("arxiv_id is not null").select("entry_id", F.from_xml(xml, registries.ATOM_ENTRY.replace(", `arxiv:doi` STRING", "")).alias("e"))
    feed = parsed.select("entry_id", "e.*").withColumn("arxiv:doi", F.lit(None).cast("string"))
    return registries.arxiv_entries(feed).select("entry_id", "title", "year", "arxiv_id", "doi", F.col("creators")[0]["family"].alias("family"))


@query("cache_status", r"""
WITH c AS (SELECT sha256('https://x/' || CAST(o_orderkey AS VARCHAR)) AS key, o_orderdate AS mtime FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS id, CASE WHEN c.mtime IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '1996-01-01') - epoch(c.mtime) <= 400 * 86400 THEN 'fresh' ELSE 'stale' END AS cache_state FROM orders o LEFT JOIN c ON c.key = sha256('https://x/' || CAST(o.o_orderkey AS VARCHAR))""")
def cache_status(t: Inputs) -> DataFrame:
    url = F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string"))
    cache = t.orders.filter("o_orderstatus = 'F'").select(F.sha2(url, 256).alias("key"), F.col("o_orderdate").alias("mtime"), F.lit("{}").alias("payload"))
    requests = t.orders.select(F.col("o_orderkey").alias("id"), url.alias("url"))
    return registries.cache_status(requests, cache, F.expr("TIMESTAMP '1996-01-01'"), 400).select("id", "cache_state")


BIB = r"""
b AS (SELECT *, lower(coalesce(nullif(regexp_replace(family, '[^A-Za-z0-9]+', '', 'g'), ''), 'anon') || CAST(year AS VARCHAR) || coalesce(list_filter(regexp_extract_all(title, '[A-Za-z0-9]+'), lambda w: length(w) > 2)[1], 'work')) AS base FROM v_entries),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS n FROM b),
p AS (SELECT *, list_transform(list_slice(string_split(authors, ';'), 1, 2), lambda x: CASE WHEN contains(x, ',') THEN trim(trim(split_part(x, ',', 1)) || ', ' || trim(regexp_replace(x, '^[^,]*,', '')), ', ') ELSE trim(regexp_extract(trim(x), '(\S+)$', 1) || ', ' || array_to_string(list_slice(regexp_split_to_array(trim(x), '\s+'), 1, -2), ' '), ', ') END) AS people FROM n)"""


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '{{', chr(92) || '{{'), '}}', chr(92) || '}}')"


@query("export_bibtex", f"""
WITH {BIB} SELECT entry_id, array_to_string(list_filter(['@' || CASE item_type WHEN 'journalArticle' THEN 'article' WHEN 'book' THEN 'book' WHEN 'bookSection' THEN 'incollection' WHEN 'conferencePaper' THEN 'inproceedings' ELSE 'misc' END || '{{' || base || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END || ',',
  '  title = {{' || {escaped('title')} || '}},', '  author = {{' || {escaped("array_to_string(people, ' and ')")} || '}},', '  year = {{' || CAST(year AS VARCHAR) || '}},', '  journal = {{' || {escaped('publication_title')} || '}},', '  publisher = {{' || {escaped('publisher')} || '}},', '  isbn = {{' || isbn || '}},', '  volume = {{' || volume || '}},', '  number = {{' || issue || '}},', '  doi = {{' || doi || '}},', '  file = {{Main article:main' || CAST(entry_id AS VARCHAR) || '.pdf:PDF}},', '}}'], lambda x: x IS NOT NULL), chr(10)) AS bibtex FROM p""")
def export_bibtex(t: Inputs) -> DataFrame:
    entries = creators_of(t.v_entries).withColumn("base", rank.cite_base(F.col("family"), F.col("year"), F.col("title")))
    attachment = F.struct(
        F.concat(F.lit("main"), F.col("entry_id").cast("string"), F.lit(".pdf")).alias("path"), F.lit("primary").alias("role"), F.lit("").alias("title")
    )
    keyed = rank.cite_keys(entries).withColumn("attachments", F.array(attachment, attachment))
    return records.bibtex_record(keyed).select("entry_id", "bibtex")


@query("citation_bundles", STATEMENTS["export_bibtex"].replace("SELECT entry_id, array_to_string", ", bt AS (SELECT entry_id, array_to_string", 1) + """)
SELECT folder || '/citation.bib' AS rel, octet_length(encode(x)) AS size, md5(x) AS content_md5 FROM (SELECT folder, string_agg(bibtex || chr(10), chr(10) ORDER BY split_part(bibtex, chr(10), 1), bibtex) AS x FROM bt JOIN v_entries USING (entry_id) GROUP BY folder)""")
def citation_bundles(t: Inputs) -> DataFrame:
    """The citation file of every folder, written and read back as bytes."""
    keyed = export_bibtex(t).join(t.v_entries.select("entry_id", "folder"), "entry_id").withColumn("cite_key", F.substring_index("bibtex", "\n", 1))
    root = running.new_folder(t.spark, "bundles")
    records.write_citation_bundles(keyed, root)
    back = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bib").load(root)
    return back.select(F.regexp_extract("path", r"/bundles-[0-9a-f]+/(.*)$", 1).alias("rel"), F.col("length").alias("size"), F.md5("content").alias("content_md5"))


@query("registry_by_doi", f"""
WITH {CLEAN} SELECT e.entry_id, CASE WHEN length(e.doi) % 2 = 0 THEN 'crossref' WHEN j.doi IS NOT NULL THEN 'openalex' END AS registry, CASE WHEN j.doi IS NOT NULL THEN regexp_replace(trim(jt || '.'), '\\.+$', '') END AS title FROM v_entries e LEFT JOIN jr j ON j.doi = e.doi""".replace("length(e.doi) % 2 = 0", "j.volume::INT % 2 = 0"))
def registry_by_doi(t: Inputs) -> DataFrame:
    crossref = registries.crossref_entries(t.v_registry).filter(F.col("volume").cast("int") % 2 == 0)
    openalex = registries.openalex_entries(t.v_openalex)
    found = merge.registry_by_doi(t.v_entries.select("entry_id", "doi"), [("crossref", crossref), ("openalex", openalex)])
    return found.select("entry_id", "registry", "record.title")


LOCAL = """lo AS (SELECT entry_id, title, CASE WHEN year % 2 = 0 THEN publication_title END AS publication_title, CASE WHEN year % 3 = 0 THEN volume END AS volume, CASE WHEN year % 5 <> 0 THEN issue END AS issue, CASE WHEN year % 7 > 2 THEN year END AS year, CAST(NULL AS VARCHAR) AS publisher FROM v_entries)"""


def local_entries(t: Inputs) -> DataFrame:
    y = F.col("year")
    return t.v_entries.select(
        "entry_id", "title", F.when(y % 2 == 0, F.col("publication_title")).alias("publication_title"),
        F.when(y % 3 == 0, F.col("volume")).alias("volume"), F.when(y % 5 != 0, F.col("issue")).alias("issue"),
        F.when(y % 7 > 2, y).alias("year"), F.lit(None).cast("string").alias("publisher"),
    )


def network_entries(t: Inputs) -> DataFrame:
    return t.v_entries.filter("doi is not null").select(
        "entry_id", F.lit("net").alias("title"), "publication_title", "volume", "issue", "year", "publisher", F.lit("openalex").alias("source")
    )


MERGED = f"""{LOCAL}, m AS (SELECT l.entry_id, l.title, coalesce(l.publication_title, n.publication_title) AS publication_title, coalesce(l.volume, n.volume) AS volume, coalesce(l.issue, n.issue) AS issue, coalesce(l.year, n.year) AS year, coalesce(l.publisher, n.publisher) AS publisher,
  list_filter([CASE WHEN l.publication_title IS NULL AND n.publication_title IS NOT NULL THEN 'publication_title' END, CASE WHEN l.volume IS NULL AND n.volume IS NOT NULL THEN 'volume' END, CASE WHEN l.issue IS NULL AND n.issue IS NOT NULL THEN 'issue' END, CASE WHEN l.year IS NULL AND n.year IS NOT NULL THEN 'year' END, CASE WHEN l.publisher IS NULL AND n.publisher IS NOT NULL THEN 'publisher' END], lambda x: x IS NOT NULL) AS filled
  FROM lo l LEFT JOIN (SELECT * FROM v_entries WHERE doi IS NOT NULL) n USING (entry_id))"""


@query("merge_fill", f"""
WITH {MERGED} SELECT entry_id, title, publication_title, volume, issue, year, publisher, array_to_string(filled, '|') AS filled, CASE WHEN len(filled) > 0 THEN 'openalex' END AS network_source FROM m""")
def merge_fill(t: Inputs) -> DataFrame:
    merged = merge.merge_fill(local_entries(t), network_entries(t), "entry_id")
    return merged.withColumn("filled", F.array_join("filled", "|"))


@query("enrich_rate", f"""
WITH {MERGED} SELECT '(any)' AS field, count(*) FILTER (len(filled) > 0) AS n FROM m UNION ALL SELECT f, count(*) FROM (SELECT unnest(filled) AS f FROM m) u GROUP BY f""")
def enrich_rate(t: Inputs) -> DataFrame:
    return stats.enrich_rate(merge.merge_fill(local_entries(t), network_entries(t), "entry_id"))


@query("merge_overwrite", f"""
WITH {LOCAL} SELECT e.entry_id, l.title AS title, coalesce(l.publication_title, e.publication_title) AS publication_title, coalesce(l.volume, e.volume) AS volume, coalesce(l.issue, e.issue) AS issue, coalesce(l.year, e.year) AS year, coalesce(l.publisher, e.publisher) AS publisher, e.source || '+' || CAST(e.entry_id AS VARCHAR) AS extra FROM v_entries e JOIN lo l USING (entry_id)""")
def merge_overwrite(t: Inputs) -> DataFrame:
    existing = t.v_entries.select(
        "entry_id", "title", "publication_title", "volume", "issue", "year", "publisher", F.create_map(F.lit("a"), "source", F.lit("b"), F.lit("old")).alias("extra")
    )
    incoming = local_entries(t).withColumn("extra", F.create_map(F.lit("b"), F.col("entry_id").cast("string")))
    merged = merge.merge_overwrite(existing, incoming, "entry_id")
    return merged.withColumn("extra", F.concat(F.col("extra")["a"], F.lit("+"), F.col("extra")["b"]))


@query("merge_identity", """
SELECT entry_id, 'new ' || title AS title, folder, CASE WHEN year % 2 = 0 THEN 'in' ELSE keywords END AS keywords FROM v_entries""")
def merge_identity(t: Inputs) -> DataFrame:
    existing = t.v_entries.select("entry_id", "folder", "title", F.split("keywords", ";").alias("keywords"))
    confirmed = t.v_entries.select(
        "entry_id", F.concat(F.lit("new "), "title").alias("title"), F.lit("?").alias("folder"),
        F.when(F.col("year") % 2 == 0, F.array(F.lit("in"))).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )
    return merge.merge_identity(existing, confirmed, "entry_id").withColumn("keywords", F.array_join("keywords", ";"))


@query("resolve_waterfall", """
WITH t AS (SELECT entry_id AS doc_id, 1 AS tier, 'arXiv' AS source, CASE WHEN year % 2 = 0 THEN title END AS title FROM v_entries WHERE arxiv_id IS NOT NULL
UNION ALL SELECT entry_id, 2, 'Crossref', CASE WHEN year % 3 = 0 THEN title END FROM v_entries WHERE doi IS NOT NULL
UNION ALL SELECT entry_id, 3, 'OpenAlex', CASE WHEN year % 3 = 1 THEN title END FROM v_entries WHERE doi IS NOT NULL
UNION ALL SELECT entry_id, 4, 'local-text', CASE WHEN length(title) > 20 THEN title END FROM v_entries),
w AS (SELECT doc_id, min(CASE WHEN title IS NOT NULL THEN tier END) AS win FROM t GROUP BY doc_id)
SELECT w.doc_id, max(CASE WHEN tier = win THEN source END) AS source, max(CASE WHEN tier = win THEN title END) AS title, string_agg(CASE WHEN win IS NULL OR tier <= win THEN source || ':' || CASE WHEN title IS NOT NULL THEN 'ok' ELSE 'no' END END, '|' ORDER BY tier) AS attempts FROM w JOIN t USING (doc_id) GROUP BY w.doc_id""")
def resolve_waterfall(t: Inputs) -> DataFrame:
    y, title = F.col("year"), F.col("title")

    def tier(df: DataFrame, test) -> DataFrame:
        return df.select(F.col("entry_id").alias("doc_id"), F.when(test, title).alias("title"))

    with_doi = t.v_entries.filter("doi is not null")
    tiers = [
        ("arXiv", tier(t.v_entries.filter("arxiv_id is not null"), y % 2 == 0)), ("Crossref", tier(with_doi, y % 3 == 0)),
        ("OpenAlex", tier(with_doi, y % 3 == 1)), ("local-text", tier(t.v_entries, F.length("title") > 20)),
    ]
    out = merge.resolve_waterfall(t.documents.select("doc_id"), tiers)
    log = F.transform("attempts", lambda a: F.concat(a["source"], F.lit(":"), F.when(a["ok"], "ok").otherwise("no")))
    return out.select("doc_id", "source", "record.title", F.array_join(log, "|").alias("attempts"))


@query("arxiv_waterfall", r"""
WITH d AS (SELECT x.doc_id, CASE WHEN x.doc_id % 7 = 0 THEN '1234.00001' END AS g, CASE WHEN x.doc_id % 5 = 0 THEN 'paper 2101.' || CAST(10000 + x.doc_id % 1000 AS VARCHAR) || 'v1.pdf' ELSE 'paper.pdf' END AS f, nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:arXiv\s*:\s*)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:$|[^\p{L}\p{N}_])', 1), '') AS tx, e.arxiv_id AS m FROM v_text x JOIN v_entries e ON e.entry_id = x.doc_id),
n AS (SELECT doc_id, g, nullif(regexp_extract(f, '(2101\.[0-9]{5})', 1), '') AS f, tx, m FROM d)
SELECT doc_id, coalesce(g, f, tx, m) AS arxiv_id, CASE WHEN g IS NOT NULL THEN 'given' WHEN f IS NOT NULL THEN 'file name' WHEN tx IS NOT NULL THEN 'text' WHEN m IS NOT NULL THEN 'title' END AS found_in FROM n""")
def arxiv_waterfall(t: Inputs) -> DataFrame:
    i = F.col("doc_id")
    docs = t.v_text.select(
        "doc_id", F.when(i % 7 == 0, "1234.00001").alias("arxiv_id"),
        F.when(i % 5 == 0, F.concat(F.lit("paper 2101."), (10000 + i % 1000).cast("string"), F.lit("v1.pdf"))).otherwise("paper.pdf").alias("filename"), "text",
    )
    by_title = t.v_entries.filter("arxiv_id is not null").select(F.col("entry_id").alias("doc_id"), F.concat("arxiv_id", F.lit("v3")).alias("arxiv_id"))
    return merge.arxiv_waterfall(docs, by_title)


@query("text_source", r"""
SELECT d.doc_id, length(CASE WHEN l.doc_id IS NOT NULL THEN 'cached' || text WHEN length(text) % 3 = 0 THEN 'fresh' || text WHEN length(text) % 5 > 0 THEN text ELSE 'stem' END)::INTEGER AS n,
  CASE WHEN l.doc_id IS NOT NULL THEN 'cached preview, pages 1-6' WHEN length(text) % 3 = 0 THEN 'preview, pages 1-6' || CASE WHEN length(text) % 2 = 0 THEN ' with OCR' ELSE '' END WHEN length(text) % 5 > 0 THEN 'text layer, pages 1-6' ELSE 'file name only' END AS text_source,
  CASE WHEN l.doc_id IS NOT NULL OR length(text) % 3 = 0 THEN '' WHEN length(text) % 5 > 0 THEN 'parser failed' ELSE 'parser failed|no usable text on the first pages' END AS warnings FROM documents d LEFT JOIN labels l USING (doc_id)""")
def text_source(t: Inputs) -> DataFrame:
    n = F.length("text")
    docs = t.documents.select(
        "doc_id", F.col("doc_id").cast("string").alias("cache_key"), F.when(n % 5 > 0, F.col("text")).alias("text_layer"),
        F.lit("stem").alias("stem"), (n % 2 == 0).alias("scan_likely"),
    )
    cached = t.documents.join(t.labels, "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("cache_key"), F.concat(F.lit("cached"), "text").alias("text"))
    previews = t.documents.select("doc_id", F.when(n % 3 == 0, F.concat(F.lit("fresh"), "text")).alias("text"), F.when(n % 3 != 0, "parser failed").alias("error"))
    found = merge.text_source(docs, cached, previews)
    return found.select("doc_id", F.length("text").alias("n"), "text_source", F.array_join("warnings", "|").alias("warnings"))


@query("dedupe_doi", """
WITH f AS (SELECT doi, min(ord) AS o FROM v_entries WHERE doi IS NOT NULL GROUP BY doi) SELECT e.entry_id, f.o AS match_id, 'doi' AS reason, 1.0::DOUBLE AS score FROM v_entries e JOIN f ON f.doi = e.doi AND f.o < e.ord""")
def dedupe_doi(t: Inputs) -> DataFrame:
    with_doi = t.v_entries.select("entry_id", "ord", "doi", F.lit("").alias("title"))
    return linkage.find_duplicates(with_doi, with_doi, earlier_only=True)


@query("dedupe_title", f"""
WITH RECURSIVE e AS (SELECT entry_id, ord, doi, {key_of('title')} AS k FROM v_entries),
f AS (SELECT doi, min(ord) AS o FROM e WHERE doi IS NOT NULL GROUP BY doi),
byd AS (SELECT e.entry_id, f.o AS match_id FROM e JOIN f ON f.doi = e.doi AND f.o < e.ord),
rest AS (SELECT * FROM e WHERE k <> '' AND entry_id NOT IN (SELECT entry_id FROM byd)),
t AS (SELECT k, min(ord) AS o FROM e WHERE k <> '' GROUP BY k),
eqt AS (SELECT r.entry_id, t.o AS match_id FROM rest r JOIN t ON t.k = r.k AND t.o < r.ord),
op AS (SELECT * FROM rest WHERE entry_id NOT IN (SELECT entry_id FROM eqt)),
{ratios("SELECT op.k AS a, t.k AS b FROM op JOIN t ON " + may_match(0.92, 'op.k', 't.k'))},
fz AS (SELECT op.entry_id, max((ratio, -t.o)) AS best FROM op JOIN rt ON rt.a = op.k JOIN t ON t.k = rt.b WHERE ratio >= 0.92 AND t.o < op.ord GROUP BY op.entry_id)
SELECT entry_id, match_id, 'doi' AS reason, 1.0::DOUBLE AS score FROM byd UNION ALL SELECT entry_id, match_id, 'title', 1.0 FROM eqt
UNION ALL SELECT entry_id, -best[2], 'title', best[1] FROM fz""")
def dedupe_title(t: Inputs) -> DataFrame:
    """Every entry against all earlier ones, by DOI and by similar title."""
    return linkage.find_duplicates(t.v_entries, t.v_entries, earlier_only=True)


@query("registry_match", f"""
WITH RECURSIVE q AS (SELECT doc_id AS query_id, {squashed_of("topic || '：' || p1")} AS k FROM v_cn),
r AS (SELECT * FROM (SELECT 0 AS tier, doc_id AS ord, {squashed_of("topic || p1 || '的研究'")} AS k FROM v_cn WHERE length(topic || p1 || '的研究') % 2 = 0
  UNION ALL SELECT 1, doc_id, {squashed_of('topic')} FROM v_cn) s WHERE k <> ''),
f AS (SELECT k, min((tier, ord)) AS r FROM r GROUP BY k), qk AS (SELECT DISTINCT k FROM q WHERE k <> ''),
{ratios("SELECT qk.k AS a, f.k AS b FROM qk, f WHERE " + may_match(0.85, 'qk.k', 'f.k') + " OR contains(qk.k, f.k) OR contains(f.k, qk.k)")},
best AS (SELECT a, max((-f.r[1], ratio, -f.r[2])) AS m FROM rt JOIN f ON f.k = rt.b WHERE ratio >= 0.85 OR contains(a, b) OR contains(b, a) GROUP BY a)
SELECT query_id, -m[3] AS record_id, m[2] AS score, CASE m[1] WHEN 0 THEN 'precise' ELSE 'fallback' END AS tier FROM q JOIN best ON best.a = q.k""")
def registry_match(t: Inputs) -> DataFrame:
    """Chinese titles against two registries, the second for what the first leaves open."""
    queries = t.v_cn.select(F.col("doc_id").alias("query_id"), F.concat("topic", F.lit("："), "p1").alias("title"))
    precise = t.v_cn.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("ord"), F.concat("topic", "p1", F.lit("的研究")).alias("title"))
    fallback = t.v_cn.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("ord"), F.col("topic").alias("title"))
    return linkage.tiered_match(queries, [("precise", precise.filter("length(title) % 2 = 0")), ("fallback", fallback)])


@query("jaccard_match", rf"""
WITH s AS (SELECT entry_id, ord, source, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))) AS ws,
  list_distinct(list_filter(list_transform(string_split(authors, ';'), lambda n: lower(regexp_extract(trim(regexp_replace(n, '[^A-Za-z]+', ' ', 'g')), '([A-Za-z]+)$', 1))), lambda n: n <> '')) AS fam, len(list_filter(string_split(authors, ';'), lambda n: trim(n) <> '')) AS given FROM v_entries),
q AS (SELECT DISTINCT array_to_string(ws, ' ') AS k, ws FROM s WHERE len(ws) > 0),
p AS (SELECT a.k AS qk, b.k AS rk, len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) AS score FROM q a JOIN q b ON len(list_intersect(a.ws, b.ws)) > 0),
h AS (SELECT x.entry_id AS query_id, y.entry_id AS record_id, y.ord, p.score FROM p JOIN s x ON array_to_string(x.ws, ' ') = p.qk JOIN s y ON array_to_string(y.ws, ' ') = p.rk WHERE x.source < 'src5' AND y.source >= 'src5' AND CASE WHEN length(x.source) = 4 AND x.given > 0 THEN list_has_any(x.fam, y.fam) AND p.score >= 0.6 ELSE p.score >= 0.9 END)
SELECT query_id, arg_min(record_id, ord) AS record_id, arg_min(score, ord)::DOUBLE AS score FROM h GROUP BY query_id""")
def jaccard_match(t: Inputs) -> DataFrame:
    people = F.split("authors", ";")
    queries = t.v_entries.filter("source < 'src5'").select(
        F.col("entry_id").alias("query_id"), "title", F.when(F.length("source") == 4, people).alias("authors")
    )
    registry = t.v_entries.filter("source >= 'src5'").select(F.col("entry_id").alias("record_id"), "ord", "title", people.alias("authors"))
    return linkage.jaccard_matches(queries, registry)


SCORED = f"""
e AS (SELECT entry_id, ord, doi, arxiv_id, isbn, year, item_type, {key_of('title')} AS k, [lower(family), lower(given)] AS names FROM v_entries),
t AS (SELECT k, min((ord, entry_id)) AS c FROM e WHERE k <> '' GROUP BY k),
same AS (SELECT e.entry_id AS l, c[2] AS c FROM e JOIN (SELECT doi, min((ord, entry_id)) AS c FROM e WHERE doi <> '' GROUP BY doi) USING (doi)
  UNION SELECT e.entry_id, c[2] FROM e JOIN (SELECT arxiv_id, min((ord, entry_id)) AS c FROM e WHERE arxiv_id <> '' GROUP BY arxiv_id) USING (arxiv_id)
  UNION SELECT e.entry_id, c[2] FROM e JOIN (SELECT isbn, min((ord, entry_id)) AS c FROM e WHERE isbn <> '' GROUP BY isbn) USING (isbn)),
{ratios("SELECT x.k AS a, y.k AS b FROM t x JOIN t y ON " + may_match(0.85, 'x.k', 'y.k') + " UNION ALL SELECT x.k, y.k FROM same JOIN e x ON x.entry_id = l JOIN e y ON y.entry_id = c WHERE x.k <> '' AND y.k <> ''")},
w AS (SELECT l, c FROM same UNION SELECT e.entry_id, t.c[2] FROM e JOIN rt ON rt.a = e.k JOIN t ON t.k = rt.b WHERE ratio >= 0.85),
pr AS (SELECT x.entry_id AS l_id, y.entry_id AS c_id, coalesce(ratio, 0) AS ratio, x.doi = y.doi AS sd, lower(x.arxiv_id) = lower(y.arxiv_id) AS sx, x.isbn = y.isbn AS si, x.year = y.year AS sy, x.item_type = 'book' AND y.item_type = 'book' AS st,
  len(list_intersect(list_distinct(x.names), list_distinct(y.names))) AS shared FROM w JOIN e x ON x.entry_id = l JOIN e y ON y.entry_id = c LEFT JOIN rt ON rt.a = x.k AND rt.b = y.k WHERE l <> c),
sc AS (SELECT *, least(1.0, ratio * 0.58 + CASE WHEN sd THEN 0.35 ELSE 0 END + CASE WHEN sx THEN 0.35 ELSE 0 END + CASE WHEN si THEN 0.35 ELSE 0 END + CASE WHEN sy THEN 0.06 ELSE 0 END + least(0.12, 0.05 * shared) + CASE WHEN st THEN 0.05 ELSE 0 END)::DOUBLE AS score FROM pr)"""


def scored_pairs(t: Inputs) -> DataFrame:
    def side(p: str) -> DataFrame:
        return t.v_entries.select(
            F.col("entry_id").alias(f"{p}_id"), F.col("doi").alias(f"{p}_doi"), F.col("arxiv_id").alias(f"{p}_arxiv_id"),
            F.col("isbn").alias(f"{p}_isbn"), F.col("year").alias(f"{p}_year"), F.col("item_type").alias(f"{p}_item_type"),
            F.array(F.lower("family"), F.lower("given")).alias(f"{p}_families"),
        )

    pairs = linkage.candidate_pairs(t.v_entries).join(side("l"), "l_id").join(side("c"), "c_id")
    return linkage.score_candidates(pairs)


@query("score_candidates", f"""
WITH RECURSIVE {SCORED} SELECT l_id, c_id, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN ratio >= 0.82 THEN 'title' END, CASE WHEN sd THEN 'doi' END, CASE WHEN sx THEN 'arxiv' END, CASE WHEN si THEN 'isbn' END, CASE WHEN sy THEN 'year' END, CASE WHEN shared > 0 THEN 'authors' END, CASE WHEN st THEN 'type' END], lambda x: x IS NOT NULL), '|') AS reasons FROM sc""")
def score_candidates(t: Inputs) -> DataFrame:
    """Every entry with the entries it may be the same as, and why."""
    return scored_pairs(t).select("l_id", "c_id", F.round("score", 6).alias("score"), F.array_join("reasons", "|").alias("reasons"))


@query("dedupe_candidates", r"""
WITH c AS (SELECT source AS query_id, entry_id AS seq, 's' || CAST(entry_id % 3 AS VARCHAR) AS src, doi, isbn, title, ((length(title) * 13) % 100) / 100.0 AS score FROM v_entries),
k AS (SELECT *, coalesce('doi:' || doi, 'isbn:' || isbn, 'title:' || regexp_replace(lower(title), '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+', '', 'g')) AS key FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, seq) AS r FROM k),
g AS (SELECT query_id, key, list_sort(list_distinct(list(src))) AS srcs FROM k GROUP BY ALL),
m AS (SELECT b.query_id, b.seq, b.title, b.score, array_to_string(list_concat([b.src], list_filter(g.srcs, lambda s: s <> b.src)), ' + ') AS source FROM b JOIN g USING (query_id, key) WHERE r = 1)
SELECT query_id, seq, source, score::DOUBLE AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), seq) AS rank FROM m) z WHERE rank <= 18""")
def dedupe_candidates(t: Inputs) -> DataFrame:
    candidates = t.v_entries.select(
        F.col("source").alias("query_id"), F.col("entry_id").alias("seq"), F.concat(F.lit("s"), (F.col("entry_id") % 3).cast("string")).alias("source"),
        "doi", "isbn", "title", (((F.length("title") * 13) % 100) / F.lit(100.0)).alias("score"),
    )
    return linkage.dedupe_candidates(candidates).select("query_id", "seq", "source", "score", "rank")


@query("near_part_groups", f"""
WITH RECURSIVE t AS (SELECT {key_of('title')} AS k, min((ord, title)) AS f FROM v_entries GROUP BY 1),
{ratios("SELECT x.k AS a, y.k AS b FROM t x JOIN t y ON " + may_match(0.85, 'x.k', 'y.k') + " WHERE x.k <> '' AND y.k <> ''")},
home AS (SELECT a, min(f) AS f FROM rt JOIN t ON t.k = rt.b WHERE ratio >= 0.85 GROUP BY a)
SELECT title AS base, ord, coalesce(f[2], title) AS group_base FROM v_entries LEFT JOIN home ON home.a = {key_of('title')}""")
def near_part_groups(t: Inputs) -> DataFrame:
    """Base titles that belong to one multi-part work."""
    return linkage.near_part_groups(t.v_entries.select(F.col("title").alias("base"), "ord"))


@query("read_index", "SELECT CAST(entry_id AS VARCHAR) AS id, title, item_type, year, source AS note FROM v_entries")
def read_index(t: Inputs) -> DataFrame:
    """Index objects rebuilt from the entries, read back as rows."""
    raw = F.create_map(
        F.lit("id"), F.col("entry_id").cast("string"), F.lit("title"), "title", F.lit("itemType"), "item_type",
        F.lit("year"), F.concat(F.lit("c. "), F.col("year").cast("string")), F.lit("DOI note"), "source",
    )
    index = t.v_entries.select(F.create_map(F.col("entry_id").cast("string"), F.to_json(raw)).alias("entries"))
    found = records.index_entries(index)
    return found.select("id", "title", "item_type", "year", F.col("extra")["DOI note"].alias("note"))


@query("read_messages", """
SELECT session_id, role, content, 'm' AS mark FROM (SELECT conv_id AS session_id, role, text AS content FROM conversations) s""")
def read_messages(t: Inputs) -> DataFrame:
    good = t.conversations.select(
        F.col("conv_id").alias("session_id"), F.to_json(F.struct(F.lit("t").alias("ts"), "role", F.col("text").alias("content"), F.lit("m").alias("mark"))).alias("value")
    )
    noise = t.conversations.select(F.col("conv_id").alias("session_id"), F.lit('{"role": "user", "cont').alias("value")).unionByName(
        t.conversations.select(F.col("conv_id").alias("session_id"), F.lit("[1, 2]").alias("value"))
    )
    return records.parse_messages(good.unionByName(noise)).select("session_id", "role", "content", F.col("extra")["mark"].alias("mark"))
