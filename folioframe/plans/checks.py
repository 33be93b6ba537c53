"""Classification and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import quality
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs


@query("looks_scanned", r"""
WITH s AS (SELECT doc_id, text AS x FROM documents),
m AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z\x{4e00}-\x{9fff}]{3,}') AS w FROM s)
SELECT doc_id, trim(x) = '' OR length(array_to_string(w, ' ')) < 700 OR 1 - len(regexp_extract_all(x, '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]')) / greatest(length(x), 1) < 0.82
  OR (len(regexp_extract_all(x, '/(?:Type|Length|Filter|Font|XObject)(?:$|[^\p{L}\p{N}_])')) > 25 AND len(w) < 120) AS scanned FROM m""")
def looks_scanned(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", quality.looks_scanned(F.col("text")).alias("scanned"))


@query("pages_scanned", r"""
SELECT conv_id AS doc_id, sum(length(trim(text))) < 80 * count(*) AS scanned FROM conversations GROUP BY conv_id""")
def pages_scanned(t: Inputs) -> DataFrame:
    return quality.pages_look_scanned(t.conversations.withColumnRenamed("conv_id", "doc_id"))


SUPPLEMENT_TEXT = """
CASE doc_id % 6 WHEN 0 THEN 'Supporting Information' || chr(10) || 'A long parent title ' || source || chr(10) || text
  WHEN 1 THEN 'Supplementary Material for: The parent of ' || source || chr(10) || text
  WHEN 2 THEN text || chr(10) || 'Associated content: the Supporting Information is free.'
  WHEN 3 THEN 'Abstract: x' || chr(10) || 'Received: 2020' || chr(10) || 'Supporting Information' || chr(10) || 'University of ' || lang || chr(10) || text
  WHEN 4 THEN 'Published: 2020' || chr(10) || text ELSE text END"""
SUPPLEMENT_NAME = "CASE length(text) % 3 WHEN 0 THEN 'paper_SI.pdf' WHEN 1 THEN 'mmc1.pdf' ELSE 'paper.pdf' END"


@query("detect_supplement", rf"""
WITH d AS (SELECT doc_id, {SUPPLEMENT_TEXT} AS x, {SUPPLEMENT_NAME} AS f, CASE WHEN length(text) % 10 = 0 THEN '10.1000/p' || CAST(doc_id AS VARCHAR) END AS rel FROM documents),
l AS (SELECT *, x AS first, string_split(x, chr(10)) AS ls FROM d),
h AS (SELECT *, regexp_matches(first, '(?im)^\s*(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)(?:\s+(?:for|to)[^\p{{L}}\p{{N}}_]|\s*$)') AS strong,
   trim(regexp_replace(regexp_extract(first, '(?is)(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)\s+(?:for|to)\s*[:\-]?\s*([^\n]{{8,300}})', 1), '\s+', ' ', 'g'), ' :-') AS named FROM l),
a AS (SELECT *, CASE WHEN strong AND length(named) < 8 THEN list_filter(list_transform(ls[1 + (length(regexp_extract(first, '(?s)^(.*?)(?im:^\s*(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)\s*$)', 0)) - length(replace(regexp_extract(first, '(?s)^(.*?)(?im:^\s*(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)\s*$)', 0), chr(10), ''))) + 1:], lambda y: trim(trim(regexp_replace(y, '[\s\p{{Z}}]+', ' ', 'g')), ' :-')),
   lambda y: length(y) BETWEEN 8 AND 300 AND NOT regexp_matches(lower(y), 'doi:|https?://|authors?:|affiliation|abstract|contents') AND NOT regexp_matches(y, '(?i)(^|[^\p{{L}}\p{{N}}_])(university|institute|department|laboratory|college|school)($|[^\p{{L}}\p{{N}}_])') AND NOT (length(y) - length(replace(y, ',', '')) >= 3 AND len(string_split(y, ' ')) < 18))[1] END AS after,
   (SELECT count(*) FROM (SELECT unnest(['abstract:', chr(10) || 'abstract' || chr(10), chr(10) || '■ introduction', chr(10) || 'introduction' || chr(10), 'received:', 'revised:', 'published:', 'article' || chr(10) || 'pubs.', 'journal of ']) AS m) q WHERE contains(lower(h.x), m)) AS markers FROM h),
s AS (SELECT *, greatest(0.0, least(1.0, round(CASE WHEN rel IS NOT NULL THEN 0.9 ELSE 0 END + CASE WHEN regexp_matches(regexp_replace(f, '\.[^.]+$', ''), '(?i)(?:^|[._\-\s])(supp|si|esm|mmc|suppmat)(?:$|[._\-\s0-9])') THEN 0.45 ELSE 0 END + CASE WHEN strong THEN 0.65 ELSE 0 END + CASE WHEN length(named) >= 8 THEN 0.15 ELSE 0 END
   + CASE WHEN after IS NOT NULL THEN 0.10 ELSE 0 END - CASE WHEN markers >= 2 THEN 0.55 WHEN markers = 1 THEN 0.20 ELSE 0 END - CASE WHEN regexp_matches(x, '(?is)associated\s+content.{{0,220}}(?:supporting|supplementary)\s+information') THEN 0.35 ELSE 0 END, 6)))::DOUBLE AS confidence FROM a)
SELECT doc_id, confidence, rel IS NOT NULL OR confidence >= 0.65 AS is_supplement, CASE WHEN NOT (rel IS NOT NULL OR confidence >= 0.65) THEN 'primary' WHEN confidence >= 0.85 THEN 'supplement-high' WHEN confidence >= 0.65 THEN 'supplement-medium' ELSE 'supplement-low' END AS label,
  CASE WHEN length(named) >= 8 THEN named ELSE after END AS parent_title, coalesce(rel, CASE WHEN confidence >= 0.65 THEN '10.1/' || CAST(doc_id AS VARCHAR) END) AS parent_doi FROM s""")
def detect_supplement(t: Inputs) -> DataFrame:
    record = F.concat(F.lit('{"relation":{"is_supplement-to":[{"id-type":"doi","id":"https://doi.org/10.1000/P'), F.col("doc_id").cast("string"), F.lit('"}]}}'))
    df = t.documents.select(
        "doc_id", F.expr(SUPPLEMENT_TEXT).alias("x"), F.expr(SUPPLEMENT_NAME).alias("f"),
        quality.supplement_relation(F.when(F.length("text") % 10 == 0, record)).alias("rel"),
        F.concat(F.lit("doi:10.1/"), F.col("doc_id").cast("string")).alias("own"),
    )
    return quality.detect_supplement(df, "x", "f", "rel", "own").select(
        "doc_id", "confidence", "is_supplement", "label", "parent_title", "parent_doi"
    )


TAGGED = "text || CASE doc_id % 4 WHEN 0 THEN ' Deep Learning model and a robot arm' WHEN 1 THEN ' clinical survey of patients, review' WHEN 2 THEN ' 机器学习 方法' ELSE '' END"
COUNTS = ", ".join(
    "struct_pack(n := " + " + ".join(f"(length(x) - length(replace(x, '{w.lower()}', ''))) // {len(w)}" for w in words) + f", tag := '{tag}')"
    for tag, words in quality.TAG_RULES.items()
)


@query("rule_tags", f"""
WITH d AS (SELECT doc_id, lower({TAGGED}) AS x FROM documents), s AS (SELECT doc_id, unnest([{COUNTS}]) AS s FROM d)
SELECT doc_id, coalesce(string_agg(s.tag, '|' ORDER BY s.n DESC, s.tag) FILTER (s.n > 0), '') AS tags FROM s GROUP BY doc_id""")
def rule_tags(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(quality.rule_tags(F.expr(TAGGED)), "|").alias("tags"))


@query("merge_tags", r"""
WITH l AS (SELECT entry_id, list_filter(list_transform(list_concat(string_split(keywords, ';'), ['#' || upper(source), lang || ' ', 'new']), lambda x: trim(trim(x), '#*- ')), lambda x: x <> '') AS v FROM v_entries)
SELECT entry_id, array_to_string(list_filter(v, lambda y, i: list_position(list_transform(v, lambda z: lower(z)), lower(y)) = i), '|') AS tags FROM l""")
def merge_tags(t: Inputs) -> DataFrame:
    added = F.array(F.concat(F.lit("#"), F.upper("source")), F.concat("lang", F.lit(" ")), F.lit("new"))
    return t.v_entries.select("entry_id", F.array_join(quality.merge_tags(F.split("keywords", ";"), added), "|").alias("tags"))


@query("has_prose", r"""
SELECT doc_id, line_no, regexp_matches(regexp_replace(regexp_replace(text, '\[\[KEEP_[0-9]{6}\]\]', '', 'g'), '[|:#>*_~\-+=`\[\](){}\\/0-9.,;!?%\s]+', '', 'g'), '[A-Za-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}\x{4e00}-\x{9fff}]') AS prose FROM v_lines""")
def has_prose(t: Inputs) -> DataFrame:
    return t.v_lines.select("doc_id", "line_no", quality.has_prose(F.col("text")).alias("prose"))


@query("tokens_intact", r"""
SELECT doc_id, doc_id % 3 <> 1 AS intact FROM documents""")
def tokens_intact(t: Inputs) -> DataFrame:
    before = F.concat(F.lit("[[KEEP_000001]] "), "text", F.lit(" [[KEEP_000002]]"))
    after = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("[[KEEP_000001]]"))).otherwise(
        F.concat(F.lit("[[KEEP_000002]]"), "text", F.lit("[[KEEP_000001]]"))
    )
    return t.documents.select("doc_id", quality.tokens_intact(before, after).alias("intact"))


ACTIONS = """
SELECT rel, CASE WHEN size % 2 = 0 THEN 'translate' ELSE 'parse' END AS category,
  CASE size % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'error' WHEN 2 THEN 'queued' ELSE 'done' END AS status,
  rel AS out1, CASE WHEN size % 3 = 0 THEN rel || '.gone' ELSE rel END AS out2 FROM v_paths"""


def actions_of(t: Inputs) -> DataFrame:
    size = F.col("size")
    return t.v_paths.select(
        "rel", F.when(size % 2 == 0, "translate").otherwise("parse").alias("category"),
        F.when(size % 5 == 0, "running").when(size % 5 == 1, "error").when(size % 5 == 2, "queued").otherwise("done").alias("status"),
        F.array(F.col("rel"), F.when(size % 3 == 0, F.concat("rel", F.lit(".gone"))).otherwise(F.col("rel"))).alias("outputs"),
    )


STATES = f"""a AS ({ACTIONS}), st AS (SELECT rel, category, status, CASE WHEN status = 'done' THEN CASE WHEN ends_with(out2, '.gone') THEN 'stale' ELSE 'complete' END WHEN status IN ('running', 'error') THEN status ELSE 'none' END AS state FROM a)"""


@query("action_status", f"WITH {STATES} SELECT rel, category, state FROM st")
def action_status(t: Inputs) -> DataFrame:
    return quality.action_status(actions_of(t), t.v_paths)
