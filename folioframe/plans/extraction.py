"""Text, file-name and layout jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import people
from folioframe.functions.people import COMMON_COMPOUND_SURNAMES, COMMON_SURNAMES, NOT_A_PERSON, NOT_IN_A_NAME
from folioframe.functions.text import may_have_cjk
from folioframe.operators import cjk, extract, layout
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs
from folioframe.session import cut

SINGLE = ", ".join(f"'{s}'" for s in COMMON_SURNAMES)
COMPOUND = ", ".join(f"'{s}'" for s in COMMON_COMPOUND_SURNAMES)
NOISE = cjk.NOISE
W = r"[^\p{L}\p{N}_]"


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(translate({x}, chr(12288) || chr(160) || chr(8203), '  '), '\s+', ' ', 'g'))"


def person_sql(x: str, v: str = "q") -> str:
    return (
        f"(NOT regexp_matches({x}, '{NOT_A_PERSON}') AND coalesce(list_bool_and(list_transform(list_filter(list_transform("
        f"regexp_split_to_array({x}, '[、，]'), lambda {v}1: trim({v}1)), lambda {v}2: {v}2 <> ''), lambda {v}3: length({v}3) BETWEEN 2 AND 6 "
        f"AND NOT regexp_matches({v}3, '{NOT_IN_A_NAME}') AND (substr({v}3, 1, 2) IN ({COMPOUND}) OR substr({v}3, 1, 1) IN ({SINGLE})))), false))"
    )


def plausible_sql(t: str, n: int) -> str:
    return (
        rf"({t} <> '' AND NOT regexp_matches({t}, '(?i)(^|{W})Vol[.．]?\s*[0-9]+\s*[,，]?\s*(No[.．]?\s*[0-9]+($|{W})|[0-9]{{1,3}}$)|^\s*[0-9]{{4}}\s*Vol') "
        rf"AND NOT regexp_matches({t}, '(19|20)[0-9]{{2}}\s*年\s*第?\s*[0-9]+\s*期') AND NOT regexp_matches({t}, '^[0-9\s.,;:()\-—_~～\[\]]+$') "
        rf"AND len(regexp_extract_all({t}, '[\x{{4e00}}-\x{{9fff}}]')) >= {n} AND NOT regexp_matches({t}, '[。；，、！？：]$') "
        rf"AND NOT regexp_matches({t}, '{NOISE}') AND length({t}) BETWEEN {n} AND 80)"
    )


def split_authors_sql(x: str) -> str:
    people_by = lambda pattern, v: (
        f"list_filter(list_transform(regexp_split_to_array(tk, '{pattern}'), lambda {v}a: trim({v}a)), lambda {v}b: {v}b <> '')"
    )
    sp, an = people_by(r"\s+", "s"), people_by("和", "h")
    ok = lambda lst, v: f"(len({lst}) >= 2 AND list_bool_and(list_transform({lst}, lambda {v}c: {person_sql(v + 'c', v + 'd')})))"
    return (
        f"flatten(list_transform(list_filter(list_transform(regexp_split_to_array({x}, '[、，]'), lambda z1: trim(z1)), lambda z2: z2 <> ''), "
        f"lambda tk: CASE WHEN {ok(sp, 'e')} THEN {sp} WHEN {ok(an, 'g')} THEN {an} ELSE [tk] END))"
    )


@query("text_metadata", rf"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM v_text),
c AS (SELECT doc_id, text, ls, list_transform(ls, lambda x: trim(regexp_replace(x, '^#{{1,6}}\s*', ''))) AS bare FROM l),
t AS (SELECT *, list_position(list_transform(bare, lambda s: length(s) BETWEEN 8 AND 350 AND NOT regexp_matches(s, '(?i)^(doi:|arxiv:|abstract|摘要)') AND NOT regexp_matches(s, '(?i)^[0-9]{{4}}\s*Vol|(^|{W})Vol[.．]?\s*[0-9]+\s*,\s*No[.．]?\s*[0-9]+($|{W})')
   AND NOT regexp_matches(s, '^[0-9]{{1,4}}[\s.,;:]*$') AND NOT (upper(s) = s AND lower(s) <> s AND length(s) >= 8 AND (length(s) - length(replace(s, ' ', ''))) / length(s) > 0.25) AND regexp_matches(s, '\p{{L}}')), true) AS pos FROM c),
n AS (SELECT *, CASE WHEN pos > 0 THEN list_transform(ls[pos + 1:pos + 4], lambda x: trim(regexp_replace(x, '[*†‡§]+', '', 'g'))) END AS nx FROM t),
s AS (SELECT *, list_position(list_transform(nx, lambda x: regexp_matches(x, '(?i)(^|{W})(abstract|department|university|institute|laboratory|center|school|college|address)($|{W})')), true) AS stop FROM n),
a AS (SELECT *, list_filter(list_transform(list_filter(CASE WHEN stop > 0 THEN nx[1:stop - 1] ELSE nx END, lambda x: length(x) <= 600 AND NOT regexp_matches(x, '\p{{Nd}}')), lambda x: CASE WHEN len(list_filter(list_transform(regexp_split_to_array(x, '\s*,\s*|\s+(?:and|&)\s+|\s*;\s*'), lambda y: trim(y, ' ,')), lambda y: y <> '')) = 2 AND NOT contains(list_filter(list_transform(regexp_split_to_array(x, '\s*,\s*|\s+(?:and|&)\s+|\s*;\s*'), lambda y: trim(y, ' ,')), lambda y: y <> '')[1], ' ') AND NOT contains(list_filter(list_transform(regexp_split_to_array(x, '\s*,\s*|\s+(?:and|&)\s+|\s*;\s*'), lambda y: trim(y, ' ,')), lambda y: y <> '')[2], ' ')
   THEN list_filter([x], lambda y: length(y) BETWEEN 2 AND 80) ELSE list_filter(list_transform(regexp_split_to_array(x, '\s*,\s*|\s+(?:and|&)\s+|\s*;\s*'), lambda y: trim(y, ' ,')), lambda y: length(y) BETWEEN 2 AND 80) END), lambda x: len(x) > 0 AND list_bool_and(list_transform(x, lambda y: regexp_matches(y, '[A-Za-z\x{{4e00}}-\x{{9fff}}]'))))[1] AS names,
   array_to_string(ls, chr(10)) AS head FROM s)
SELECT doc_id, title, families, CASE WHEN y BETWEEN 1900 AND year(current_date) + 1 THEN y END AS year FROM (
SELECT doc_id, CASE WHEN pos > 0 THEN bare[pos] ELSE '' END AS title,
  coalesce(array_to_string(list_transform(names, lambda x: CASE WHEN contains(x, ',') THEN trim(split_part(x, ',', 1)) ELSE regexp_extract(x, '(\S+)$', 1) END), '|'), '') AS families,
  TRY_CAST(coalesce(nullif(regexp_extract(head, '(?im)^\s*Published\s*:[^\n]*{W[:-1]}\n]((?:19|20)[0-9]{{2}})(?:$|{W})', 1), ''), nullif(regexp_extract(head, '(?i)(?:^|{W})(?:Journal|Nature|Science){W[:-1]}\n](?:[^\n]{{0,98}}?{W[:-1]}\n])?((?:19|20)[0-9]{{2}})(?:$|{W})', 1), ''), nullif(regexp_extract(head, '(?:^|{W})((?:19|20)[0-9]{{2}})(?:$|{W})', 1), '')) AS INTEGER) AS y FROM a) z""")
def text_metadata(t: Inputs) -> DataFrame:
    found = extract.text_metadata(t.v_text)
    return found.select(
        "doc_id", "title", F.array_join(F.transform("creators", lambda p: p["family"]), "|").alias("families"), "year"
    )


@query("text_metadata_full")
def text_metadata_full(t: Inputs) -> DataFrame:
    """All fields of the free-text guess."""
    return extract.text_metadata(t.v_text).drop("text", "lang", "source")


@query("latex_metadata", r"""
SELECT doc_id, topic || '研究' AS title, p1 || '|' || p2 AS families, CAST(y AS INTEGER) AS year, 'zh' AS language FROM v_cn""")
def latex_metadata(t: Inputs) -> DataFrame:
    tex = F.concat(
        F.lit("% OCR output\n\\documentclass{article}\n\\title{"), "topic", F.lit("\\textbf{}研究}\n\\author{"),
        "p1", F.lit(" \\and "), "p2", F.lit("}\n\\date{"), "y", F.lit("-05}\n\\begin{document}\n"), "text",
    )
    # The macro ends at the first brace pair, so the inner command goes first.
    tex = F.replace(tex, F.lit("\\textbf{}"), F.lit(""))
    out = extract.parsed_metadata(t.v_cn.select("doc_id", tex.alias("text")))
    return out.select(
        "doc_id", "title", F.array_join(F.transform("creators", lambda p: p["family"]), "|").alias("families"), "year", "language"
    )


@query("filename_metadata", rf"""
WITH n AS (SELECT doc_id, {clean_sql('stem')} AS name FROM v_cn),
s AS (SELECT *, list_transform(string_split(name, ' - '), lambda x: trim(x)) AS segs FROM n),
p AS (SELECT *, coalesce(list_position(list_transform(segs, lambda x: regexp_matches(x, '^(19|20)[0-9]{{2}}$')), true), 0) AS yi, coalesce(list_position(list_transform(segs, lambda x: {person_sql('x')}), false), 0) AS np FROM s),
q AS (SELECT *, len(segs) > 1 AS multi, CASE WHEN len(segs) > 1 AND yi > 0 THEN segs[yi] END AS y, CASE WHEN np > 0 THEN np - 1 ELSE len(segs) END AS lead FROM p),
r AS (SELECT *, CASE WHEN y IS NOT NULL THEN segs[1:yi - 1] WHEN multi THEN segs[1:lead] ELSE [] END AS asegs, CASE WHEN y IS NOT NULL THEN segs[yi + 1:] ELSE segs[lead + 1:] END AS rest FROM q),
u AS (SELECT *, CASE WHEN y IS NULL OR coalesce(list_position(list_transform(rest, lambda x: x = y), false), 0) = 0 THEN rest ELSE rest[list_position(list_transform(rest, lambda x: x = y), false):] END AS tail FROM r),
v AS (SELECT *, CASE WHEN multi THEN array_to_string(tail, ' - ') END AS title FROM u)
SELECT doc_id, array_to_string(flatten(list_transform(asegs, lambda sg: {split_authors_sql('sg')})), '|') AS authors, TRY_CAST(y AS INTEGER) AS year,
  CASE WHEN {plausible_sql('title', 2)} THEN title WHEN {plausible_sql('name', 2)} THEN name END AS title,
  regexp_matches(name, '{cjk.BOOK_WORDS}') OR regexp_matches(name, '{cjk.BOOK_ROLES}') AS is_book FROM v""")
def filename_metadata(t: Inputs) -> DataFrame:
    return cjk.filename_metadata(t.v_cn.select("doc_id", "stem")).select(
        "doc_id", F.array_join("fn_authors", "|").alias("authors"), F.col("fn_year").alias("year"),
        F.col("fn_title").alias("title"), F.col("fn_book").alias("is_book"),
    )


@query("person_names", rf"""
SELECT doc_id, {person_sql("p1 || '、' || p2")} AS pair, {person_sql('topic')} AS topic, {person_sql('p2')} AS single FROM v_cn""")
def person_names(t: Inputs) -> DataFrame:
    return t.v_cn.select(
        "doc_id", people.looks_like_person(F.concat("p1", F.lit("、"), "p2")).alias("pair"),
        people.looks_like_person(F.col("topic")).alias("topic"), people.looks_like_person(F.col("p2")).alias("single"),
    )


@query("split_authors", rf"""
WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN p1 || ' ' || p2 WHEN 1 THEN p1 || '和' || p2 || '，' || topic WHEN 2 THEN substr(p1, 1, 1) || ' ' || substr(p1, 2) ELSE p1 || '、' || topic || '和' || p2 END AS seg FROM v_cn)
SELECT doc_id, array_to_string({split_authors_sql('seg')}, '|') AS authors FROM x""")
def split_authors(t: Inputs) -> DataFrame:
    kind = F.col("doc_id") % 4
    seg = (
        F.when(kind == 0, F.concat("p1", F.lit(" "), "p2"))
        .when(kind == 1, F.concat("p1", F.lit("和"), "p2", F.lit("，"), "topic"))
        .when(kind == 2, F.concat(F.substring("p1", 1, 1), F.lit(" "), F.substring("p1", 2, 9)))
        .otherwise(F.concat("p1", F.lit("、"), "topic", F.lit("和"), "p2"))
    )
    return t.v_cn.select("doc_id", F.array_join(people.split_authors(seg), "|").alias("authors"))


@query("plausible_title", rf"""
WITH x AS (SELECT doc_id, line_no, {clean_sql('text')} AS t FROM v_cn_lines) SELECT doc_id, line_no, {plausible_sql('t', 3)} AS plausible FROM x""")
def plausible_title(t: Inputs) -> DataFrame:
    return t.v_cn_lines.select("doc_id", "line_no", cjk.plausible_title(F.col("text"), 3).alias("plausible"))


@query("cn_identifiers", rf"""
SELECT doc_id, nullif(trim(regexp_extract(text, '文章编号[：:]?\s*([0-9A-Za-z][0-9A-Za-z\-–—()（）.]*[0-9])', 1), ' .）).-–—'), '') AS article_no,
  nullif(regexp_extract(text, '(?:中图分类号|CLC|分类号)[：:]\s*([A-Z][A-Z0-9]*(?:\.[0-9]+)?(?:\s*[;；]\s*[A-Z][A-Z0-9]*(?:\.[0-9]+)?)*)', 1), '') AS clc,
  nullif(regexp_extract(text, '收稿日期[：:]?\s*((?:19|20)[0-9]{{2}}[-/年.][0-9]{{1,2}}[-/月.][0-9]{{1,2}}日?)', 1), '') AS received_date,
  nullif(regexp_extract(text, '(?i)(?:^|{W})(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '') AS doi,
  CASE WHEN length(isbn) IN (10, 13) THEN isbn END AS isbn,
  coalesce(nullif(regexp_extract(text, '(?:第)?([0-9]{{1,3}})\s*卷\s*[,，、]?\s*第?\s*([0-9]{{1,3}})\s*期', 1), ''), nullif(regexp_extract(text, '第\s*([0-9]{{1,3}})\s*期\s*[,，、]?\s*(?:第)?([0-9]{{1,3}})\s*卷', 2), '')) AS volume,
  coalesce(nullif(regexp_extract(text, '(?:第)?([0-9]{{1,3}})\s*卷\s*[,，、]?\s*第?\s*([0-9]{{1,3}})\s*期', 2), ''), nullif(regexp_extract(text, '第\s*([0-9]{{1,3}})\s*期\s*[,，、]?\s*(?:第)?([0-9]{{1,3}})\s*卷', 1), '')) AS issue,
  nullif(regexp_extract(text, '页码\s*[:：]?\s*([0-9]{{1,4}})\s*[-–—]\s*([0-9]{{1,4}})', 1), '') AS page_start, nullif(regexp_extract(text, '页码\s*[:：]?\s*([0-9]{{1,4}})\s*[-–—]\s*([0-9]{{1,4}})', 2), '') AS page_end
FROM (SELECT *, upper(regexp_replace(regexp_extract(text, '(?i)(?:^|{W})(?:ISBN(?:-1[03])?\s*[:：]?\s*)?((?:97[89][ -]?)?[0-9][0-9Xx -]{{8,16}}[0-9Xx])(?:$|{W})', 1), '[^0-9Xx]', '', 'g')) AS isbn FROM v_cn) c""")
def cn_identifiers(t: Inputs) -> DataFrame:
    df = t.v_cn.select(
        "doc_id", cjk.front_identifiers(F.col("text")).alias("i"), cjk.volume_issue(F.col("text")).alias("v")
    )
    return df.select("doc_id", "i.*", "v.*")


@query("journal_band", rf"""
WITH a AS (SELECT doc_id, arg_min(y0, line_no) AS anchor_y FROM v_cn_lines WHERE regexp_matches(text, '(?i)第\s*[0-9]{{1,3}}\s*卷|Vol[.．]?\s*[0-9]+|(19|20)[0-9]{{2}}\s*年\s*第?\s*[0-9]+\s*期') GROUP BY doc_id),
s AS (SELECT doc_id, line_no, y0, {clean_sql('text')} AS t FROM v_cn_lines)
SELECT s.doc_id, arg_min(t, line_no) AS journal FROM s JOIN a ON s.doc_id = a.doc_id AND abs(y0 - anchor_y) <= 18
WHERE t <> '' AND NOT regexp_matches(t, '[0-9A-Za-z《》“”、，。；：]') AND len(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]')) >= 2 AND length(t) <= 14 AND t NOT IN ('摘要', '关键词', '引言') AND NOT regexp_matches(t, '{NOISE}') GROUP BY s.doc_id""")
def journal_band(t: Inputs) -> DataFrame:
    return layout.venue_near_volume(t.v_cn_lines)


@query("affiliation", rf"""
WITH s AS (SELECT doc_id, line_no, y0, page_h, 66.0 AS title_y1, {clean_sql('text')} AS t FROM v_cn_lines),
m AS (SELECT *, regexp_extract(t, '^[（(]\s*([^（()）]{{2,70}})\s*[)）]$', 1) AS b FROM s)
SELECT doc_id, arg_min(trim(b), line_no) AS affiliation FROM m WHERE b <> '' AND y0 > title_y1 AND y0 <= title_y1 + page_h * 0.45 AND regexp_matches(b, '省|市|区|县|学院|大学|研究院|研究所|中心|系|院|所|集团|有限公司|[0-9]{{6}}') GROUP BY doc_id""")
def affiliation(t: Inputs) -> DataFrame:
    titles = t.v_cn.select("doc_id", F.lit(66.0).alias("title_y1"))
    return layout.affiliations(t.v_cn_lines, titles)


@query("title_block", "SELECT doc_id, topic AS title, 66.0::DOUBLE AS title_y1, 18.0::DOUBLE AS title_size FROM v_cn")
def title_block(t: Inputs) -> DataFrame:
    return layout.title_blocks(t.v_cn_lines)


@query("author_line", "SELECT doc_id, p1 || '|' || p2 AS authors FROM v_cn")
def author_line(t: Inputs) -> DataFrame:
    lines = cut(t.v_cn_lines.filter(may_have_cjk(F.col("text"), 2)))  # titles and names have Chinese letters
    found = layout.author_lines(lines, layout.title_blocks(lines))
    return found.select("doc_id", F.array_join("authors", "|").alias("authors"))


@query("cn_record", r"""
SELECT c.doc_id, CASE c.doc_id % 7 WHEN 1 THEN topic || '（上）' WHEN 2 THEN '规划' || topic || ' - 梁陈方案新考' WHEN 4 THEN topic || '第三卷' WHEN 5 THEN topic || '全集' WHEN 6 THEN topic || ' Part II' ELSE topic END AS title,
  'cn-filename' AS source, CASE WHEN c.doc_id % 7 = 5 THEN 'book' ELSE 'journalArticle' END AS item_type,
  CASE c.doc_id % 7 WHEN 0 THEN p1 WHEN 3 THEN '欧阳' || substr(p1, 2, 1) ELSE p1 || '|' || p2 END AS authors, CAST(y AS INTEGER) AS year,
  CAST(1 + length(h.text) % 60 AS VARCHAR) AS volume, CAST(1 + length(h.text) % 12 AS VARCHAR) AS issue, '10.' || substr(d, 1, 4) || '/j.issn.' || substr(d, 5, 4) AS doi, topic AS publication_title, NULL::VARCHAR AS isbn,
  CASE WHEN c.doc_id % 3 = 0 THEN '1000-' || substr(d, 1, 4) || '(' || y || ')02-0123-07' END AS article_no, CASE WHEN c.doc_id % 3 = 1 THEN 'TU' || substr(d, 1, 3) || '; TP391' END AS clc,
  CASE WHEN c.doc_id % 3 = 2 THEN y || '-03-1' || substr(d, 1, 1) END AS received_date, CASE WHEN c.doc_id % 2 = 0 THEN CAST(1 + length(h.text) % 300 AS VARCHAR) END AS page_start,
  CASE WHEN c.doc_id % 2 = 0 THEN CAST(1 + length(h.text) % 300 AS VARCHAR) || '9' END AS page_end, topic || '大学规划学院，北京 100045' AS affiliation
FROM v_cn c JOIN v_hashed h ON h.doc_id = c.doc_id""")
def cn_record(t: Inputs) -> DataFrame:
    names = cjk.filename_metadata(t.v_cn.select("doc_id", "stem", "text"))
    record = cjk.chinese_record(names, layout.front_page(t.v_cn_lines))
    return record.withColumn("authors", F.array_join("authors", "|"))


@query("layout_runs", r"""
WITH b AS (SELECT doc_id, min(CASE WHEN regexp_matches(text, '(?i)^abstract\s*(?:[|:—-]|$)') THEN y0 END) AS ay FROM v_lines GROUP BY doc_id),
k AS (SELECT l.doc_id, line_no, trim(text) AS t, size, y0, y1 FROM v_lines l JOIN b USING (doc_id) WHERE length(trim(text)) BETWEEN 8 AND 350 AND len(regexp_split_to_array(trim(text), '\s+')) BETWEEN 1 AND 40 AND (ay IS NULL OR y0 < ay) AND size BETWEEN 12 AND 36
  AND NOT (upper(trim(text)) = trim(text) AND lower(trim(text)) <> trim(text) AND len(regexp_split_to_array(trim(text), '\s+')) <= 4)
  AND NOT (upper(trim(text)) = trim(text) AND lower(trim(text)) <> trim(text) AND (length(trim(text)) - length(replace(trim(text), ' ', ''))) / length(trim(text)) > 0.25) AND NOT regexp_matches(trim(text), '(?i)^(reviews?|articles?|letters?|perspectives?|editorials?|research)$')),
g AS (SELECT *, CASE WHEN lag(size) OVER w = size AND y0 - lag(y1) OVER w < 8 THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g)
SELECT doc_id, min(size) AS size, min(y0) AS y0, max(y1) AS y1, trim(regexp_replace(string_agg(t, ' ' ORDER BY line_no), '[\s\p{Z}]+', ' ', 'g')) AS text, min(line_no)::INTEGER AS line_no FROM r GROUP BY doc_id, run""")
def layout_runs(t: Inputs) -> DataFrame:
    return layout.title_runs(t.v_lines)


@query("front_matter_pick", r"""
WITH x AS (SELECT doc_id, replace(text, 'Published: ', 'March 1999, 3 April ') AS t FROM v_text)
SELECT doc_id, TRY_CAST(coalesce(list_max(regexp_extract_all(t, '(?i)(?:^|[^\p{L}\p{N}_])[0-9]{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+((?:19|20)[0-9]{2})', 1)), list_max(regexp_extract_all(t, '(?i)(?:^|[^\p{L}\p{N}_])(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+((?:19|20)[0-9]{2})', 1))) AS INTEGER) AS year FROM x""")
def front_matter_pick(t: Inputs) -> DataFrame:
    text = F.replace("text", F.lit("Published: "), F.lit("March 1999, 3 April "))
    return t.v_text.select("doc_id", layout.publication_year(text).alias("year"))


@query("rotated_columns", r"""
WITH c AS (SELECT doc_id, round_even(x0 / 2, 0) * 2 AS x, string_agg(text, '' ORDER BY y0) AS text FROM v_rotated WHERE length(text) = 1 GROUP BY ALL) SELECT doc_id, x, text FROM c""")
def rotated_columns(t: Inputs) -> DataFrame:
    return layout.rotated_columns(t.v_rotated)


@query("rotated_record", r"""
SELECT doc_id, topic AS title, p1 AS a1, p2 AS a2 FROM v_cn""")
def rotated_record(t: Inputs) -> DataFrame:
    found = layout.rotated_record(layout.rotated_columns(t.v_rotated))
    by_length = F.array_sort("authors", lambda a, b: F.length(a) - F.length(b))
    return found.select("doc_id", "title", F.get(by_length, F.lit(0)).alias("a1"), F.get(by_length, F.lit(1)).alias("a2"))


@query("note_keywords", r"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## Keywords: ' || lang || ', ' || source || ';' || lang || chr(10) || text ELSE text END AS t FROM v_text),
k AS (SELECT doc_id, CASE WHEN starts_with(t, '## Keywords') THEN regexp_extract(t, '^## Keywords: ([^\n]*)', 1) ELSE regexp_extract(t, '(?i)(?:关键词|keywords)\s*[:：]\s*([^\n]+)', 1) END AS v FROM x),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(v, '[,，;；、|/]+'), lambda y: trim(trim(y), '#*- ')), lambda y: y <> '') AS v FROM k)
SELECT doc_id, array_to_string(list_filter(v, lambda y, i: list_position(list_transform(v, lambda z: lower(z)), lower(y)) = i)[1:8], '|') AS keywords FROM l""")
def note_keywords(t: Inputs) -> DataFrame:
    note = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("## Keywords: "), "lang", F.lit(", "), "source", F.lit(";"), "lang", F.lit("\n"), "text"),
    ).otherwise(F.col("text"))
    return t.v_text.select("doc_id", F.array_join(extract.note_keywords(note), "|").alias("keywords"))


@query("mentions", r"""
SELECT conv_id, turn, 0 AS pos, 'file' AS kind, 'a b/' || role || '.md' AS value FROM conversations
UNION ALL SELECT conv_id, turn, 1 AS pos, 'skill' AS kind, role || CAST(turn AS VARCHAR) AS value FROM conversations""")
def mentions(t: Inputs) -> DataFrame:
    message = F.concat(
        F.lit('Read @File "a b/'), "role", F.lit('.md" and use @skill '), "role", F.col("turn").cast("string"), F.lit("；\n"), "text"
    )
    found = F.posexplode(extract.mentions(message)).alias("pos", "m")
    return t.conversations.select("conv_id", "turn", found).select("conv_id", "turn", "pos", "m.kind", "m.value")


@query("mentions_removed", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(trim('Read and use ' || chr(10) || text), '[ \t]{2,}', ' ', 'g'), ' *\n *', chr(10), 'g') AS clean FROM conversations""")
def mentions_removed(t: Inputs) -> DataFrame:
    message = F.concat(F.lit('Read @file "a b/'), "role", F.lit('.md" and use @skill '), "role", F.lit("\n"), F.trim("text"))
    return t.conversations.select("conv_id", "turn", extract.without_mentions(message).alias("clean"))


@query("part_marker", r"""
WITH x AS (SELECT doc_id, regexp_replace(stem, '^.* - ', '') AS s FROM v_cn),
m AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '（上）$') THEN '（上）' WHEN regexp_matches(s, '第三卷$') THEN '第三卷' WHEN regexp_matches(s, 'Part II$') THEN 'II' END AS marker FROM x)
SELECT doc_id, trim(replace(replace(replace(s, '（上）', ''), '第三卷', ''), 'Part II', '')) AS base, marker, CASE marker WHEN '（上）' THEN 1 WHEN '第三卷' THEN 3 ELSE 2 END AS part_order FROM m WHERE marker IS NOT NULL""")
def part_marker(t: Inputs) -> DataFrame:
    part = extract.part_marker(F.regexp_replace("stem", "^.* - ", ""))
    return t.v_cn.select("doc_id", part.alias("p")).filter("p is not null").select(
        "doc_id", "p.base", "p.marker", F.col("p.order").alias("part_order")
    )


@query("model_json", r"""
SELECT conv_id, turn, CASE WHEN turn BETWEEN 0 AND 2 THEN turn ELSE -1 END AS recommended, least(1.0, turn / 3.0)::DOUBLE AS confidence, role AS reason, 1 AS n_warnings, 'T ' || role AS title, 'answer' AS clean FROM conversations""")
def model_json(t: Inputs) -> DataFrame:
    answer = F.concat(
        F.lit('Sure: {"recommended": '), F.col("turn").cast("string"), F.lit(', "confidence": '),
        (F.col("turn") / 3.0).cast("string"), F.lit(', "reason": " '), "role", F.lit('", "warnings": ["w ", " "]} done'),
    )
    tagged = F.concat(F.lit("answer [TITLE] T\n  "), "role", F.lit(" [/TITLE]"))
    df = t.conversations.select(
        "conv_id", "turn", extract.model_verdict(answer, F.lit(3)).alias("v"), extract.title_tag(tagged).alias("g")
    )
    return df.select(
        "conv_id", "turn", F.col("v.recommended").cast("bigint").alias("recommended"), "v.confidence", "v.reason",
        F.size("v.warnings").alias("n_warnings"), "g.title", "g.clean",
    )


@query("missing_figures", r"""
WITH r AS (SELECT doc_id, 'figs/' || lang || CAST(doc_id AS VARCHAR) AS raw FROM documents UNION ALL SELECT doc_id, 'plot' || CAST(doc_id % 10 AS VARCHAR) || '.png' FROM documents)
SELECT doc_id, raw FROM r WHERE NOT (starts_with(raw, 'figs/') AND doc_id % 3 <> 0) AND NOT (starts_with(raw, 'plot') AND doc_id % 2 = 0)""")
def missing_figures(t: Inputs) -> DataFrame:
    tex = F.concat(
        F.lit("\\includegraphics[width=1cm]{figs\\"), "lang", F.col("doc_id").cast("string"), F.lit("}\n"), "text",
        F.lit("\n\\includegraphics{plot"), (F.col("doc_id") % 10).cast("string"), F.lit(".png}"),
    )
    references = extract.figure_references(t.documents.select("doc_id", tex.alias("text")))
    id_text = F.col("doc_id").cast("string")
    files = F.array_compact(F.array(
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("img/"), "lang", id_text, F.lit(".jpg"))),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("plot"), (F.col("doc_id") % 10).cast("string"), F.lit(".png"))),
    ))
    images = t.documents.select("doc_id", F.explode(files).alias("rel"))
    return extract.missing_figures(references, images)


@query("assemble_deltas", r"""
WITH e AS (SELECT session_id, seq, CASE json_extract_string(event, '$.type') WHEN 'stream_event' THEN json_extract_string(event, '$.event.delta.text') WHEN 'content_block_delta' THEN json_extract_string(event, '$.delta.text') END AS delta, CASE WHEN json_extract_string(event, '$.type') = 'result' THEN json_extract_string(event, '$.result') END AS result FROM v_stream_events)
SELECT session_id, coalesce(nullif(string_agg(delta, '' ORDER BY seq), ''), max(result)) AS text FROM e GROUP BY session_id""")
def assemble_deltas(t: Inputs) -> DataFrame:
    return extract.assemble_deltas(t.v_stream_events)


@query("inverted_abstract", r"""
SELECT doi, 'x' || jg || ' y' || jg || ' ' || jf || ' y' || jg || ' ' || jf AS abstract FROM (SELECT doi, replace(replace(family, chr(92), ''), chr(34), '') AS jf, replace(replace(given, chr(92), ''), chr(34), '') AS jg, row_number() OVER (PARTITION BY doi ORDER BY entry_id) AS rn FROM v_entries WHERE doi IS NOT NULL) s WHERE rn = 1""")
def inverted_abstract(t: Inputs) -> DataFrame:
    index = F.get_json_object("payload", "$.abstract_inverted_index")
    return t.v_openalex.select("doi", extract.inverted_abstract(index).alias("abstract"))
