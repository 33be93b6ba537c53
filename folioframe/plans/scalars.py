"""Column functions over whole tables: identifiers, names, titles, paths, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers, naming, paths, people, text
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("norm_doi", r"""
SELECT entry_id, nullif(lower(regexp_replace(regexp_replace(regexp_replace(trim(raw_doi), '(?i)^https?://(?:dx\.)?doi\.org/', ''), '(?i)^doi\s*:\s*', ''), '[.,;)]+$', '')), '') AS doi FROM v_raw""")
def norm_doi(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", identifiers.normalize_doi(F.col("raw_doi")).alias("doi"))


@query("norm_arxiv", r"""
SELECT entry_id, nullif(regexp_replace(regexp_replace(trim(raw_arxiv), '(?i)^arxiv\s*:\s*', ''), '(?i)v[0-9]+$', ''), '') AS arxiv_id FROM v_raw""")
def norm_arxiv(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", identifiers.normalize_arxiv(F.col("raw_arxiv")).alias("arxiv_id"))


@query("dedupe_list", r"""
WITH s AS (SELECT entry_id, list_filter(list_transform(string_split(raw_list, ';'), lambda x: trim(trim(x), '#*- ')), lambda x: x <> '') AS l FROM v_raw)
SELECT entry_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS tags FROM s""")
def dedupe_list(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", F.array_join(text.dedupe_list(F.split("raw_list", ";"), "#*- "), "|").alias("tags"))


@query("year_extract", r"""
SELECT entry_id, TRY_CAST(nullif(regexp_extract(raw_date, '[0-9]{4}'), '') AS INTEGER) AS leading_year,
  CASE WHEN TRY_CAST(nullif(regexp_extract(raw_date, '(?:19|20)[0-9]{2}'), '') AS INTEGER) <= year(current_date) + 1 THEN TRY_CAST(nullif(regexp_extract(raw_date, '(?:19|20)[0-9]{2}'), '') AS INTEGER) END AS plausible_year,
  nullif(regexp_extract(raw_date, '(?:^|[^\p{L}\p{N}_])([12][0-9]{3})(?:$|[^\p{L}\p{N}_])', 1), '') AS year_of_date,
  list_filter(list_transform(list_filter(regexp_extract_all(title || ' ' || regexp_replace(raw_list || ' ' || raw_date, '(?is)(摘要|关键词|abstract).*$', ''), '[0-9]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]{2}$')), lambda x: CAST(x AS INTEGER)), lambda x: x <= year(current_date) + 1)[1] AS text_year
FROM v_raw""")
def year_extract(t: Inputs) -> DataFrame:
    d = F.col("raw_date")
    return t.v_raw.select(
        "entry_id",
        identifiers.leading_year(d).alias("leading_year"),
        identifiers.plausible_year(d).alias("plausible_year"),
        identifiers.year_of_date(d).alias("year_of_date"),
        identifiers.year_from_text(F.concat_ws(" ", "raw_list", "raw_date"), F.col("title")).alias("text_year"),
    )


NAMES_SQL = r"""
names AS (SELECT entry_id, lang, trim(n) AS n FROM (SELECT entry_id, lang, unnest(string_split(authors, ';')) AS n FROM v_entries) s),
people AS (SELECT entry_id, lang, CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE regexp_extract(n, '(\S+)$', 1) END AS family,
  CASE WHEN contains(n, ',') THEN trim(regexp_replace(n, '^[^,]*,', '')) ELSE array_to_string(list_slice(regexp_split_to_array(n, '\s+'), 1, -2), ' ') END AS given FROM names)"""


@query("parse_names", rf"""WITH {NAMES_SQL}
SELECT entry_id, family, given, CASE WHEN family <> '' AND given <> '' THEN given || ' ' || family ELSE coalesce(nullif(family, ''), given) END AS display,
  CASE WHEN family <> '' AND given <> '' THEN family || ', ' || given ELSE coalesce(nullif(family, ''), given) END AS reversed FROM people""")
def parse_names(t: Inputs) -> DataFrame:
    people_of = t.v_entries.select("entry_id", F.explode(F.split("authors", ";")).alias("n")).select(
        "entry_id", people.parse_name(F.col("n")).alias("p")
    )
    return people_of.select(
        "entry_id", "p.family", "p.given",
        people.display_name(F.col("p")).alias("display"),
        people.display_name(F.col("p"), family_first=True).alias("reversed"),
    )


def creators_of(df: DataFrame) -> DataFrame:
    """Entries with their creator list; the last of three creators is an editor."""
    parsed = F.transform(F.split("authors", ";"), lambda n: people.parse_name(n))
    return df.withColumn(
        "creators",
        F.transform(parsed, lambda p, i: people.creator(p["family"], p["given"], F.when(i == 2, "editor").otherwise("author"))),
    )


@query("first_creator", r"""
WITH n AS (SELECT entry_id, entry_id % 2 = 0 AS zh, list_transform(list_slice(string_split(authors, ';'), 1, 2), lambda x: CASE WHEN contains(x, ',') THEN trim(split_part(x, ',', 1)) ELSE regexp_extract(trim(x), '(\S+)$', 1) END) AS names, len(string_split(authors, ';')) AS total FROM v_entries)
SELECT entry_id, CASE WHEN len(names) = 1 THEN names[1] ELSE names[1] || CASE WHEN zh THEN '和' ELSE ' and ' END || names[2] END AS label FROM n""")
def first_creator(t: Inputs) -> DataFrame:
    language = F.when(F.col("entry_id") % 2 == 0, "zh-CN").otherwise("en")
    return creators_of(t.v_entries).select("entry_id", people.first_creator(F.col("creators"), language).alias("label"))


@query("role_filters", r"""
SELECT entry_id, least(len(string_split(authors, ';')), 2)::INTEGER AS n_authors, greatest(len(string_split(authors, ';')) - 2, 0)::INTEGER AS n_editors,
  a.primary_path, a.n_supplements FROM v_entries e
JOIN (SELECT entry_id, min(CASE WHEN role = 'primary' THEN path END) AS primary_path, count(*) FILTER (role = 'supplement')::INTEGER AS n_supplements FROM v_attachments GROUP BY entry_id) a USING (entry_id)""")
def role_filters(t: Inputs) -> DataFrame:
    files = t.v_attachments.groupBy("entry_id").agg(
        F.min(F.when(F.col("role") == "primary", F.col("path"))).alias("primary_path"),
        F.count_if(F.col("role") == "supplement").cast("int").alias("n_supplements"),
    )
    return creators_of(t.v_entries).select(
        "entry_id",
        F.size(people.authors(F.col("creators"))).alias("n_authors"),
        F.size(people.editors(F.col("creators"))).alias("n_editors"),
    ).join(files, "entry_id")


@query("title_keys", rf"""
SELECT entry_id, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS folded, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS squashed,
  trim(regexp_replace(lower(title), '[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) AS word_folded,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))), ' ') AS words
FROM v_entries""")
def title_keys(t: Inputs) -> DataFrame:
    c = F.col("title")
    return t.v_entries.select(
        "entry_id", text.title_key(c).alias("folded"), text.squashed_title(c).alias("squashed"),
        text.word_folded_title(c).alias("word_folded"),
        F.array_join(F.sort_array(text.content_words(c)), " ").alias("words"),
    )


@query("clean_text", r"""
SELECT doc_id, trim(regexp_replace(translate(x, chr(12288) || chr(160) || chr(8203), '  '), '\s+', ' ', 'g')) AS cleaned,
  replace(replace(replace(x, 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬂ', 'fl') AS unfolded,
  regexp_replace(replace(x, chr(8203), ''), '(?i)(10\.[0-9]{4,9}/)\s+([A-Z0-9])', '\1\2', 'g') AS healed
FROM (SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), ', ', chr(12288) || chr(160)) || chr(8203) AS x FROM v_text) s""")
def clean_text(t: Inputs) -> DataFrame:
    x = F.concat(
        F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit(", "), F.lit("\u3000\u00a0")), F.lit("\u200b")
    )
    return t.v_text.select("doc_id", x.alias("x")).select(
        "doc_id", text.clean_text(F.col("x")).alias("cleaned"),
        text.unfold_ligatures(F.col("x")).alias("unfolded"),
        text.heal_identifiers(F.col("x")).alias("healed"),
    )


@query("safe_name", r"""
WITH a AS (SELECT entry_id, CASE WHEN entry_id % 50 = 0 THEN 'CON' ELSE family || ' <' || folder || '>: ' || title || ' -- ' || given || ' .' END AS x FROM v_entries),
b AS (SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[\x00-\x1f]', ' ', 'g'), '[<>:"/\\|?*]+', '-', 'g'), '\s+', ' ', 'g'), ' .') AS x FROM a),
c AS (SELECT entry_id, trim(regexp_replace(regexp_replace(x, '\s*[-–—]\s*[-–—]+\s*', ' - ', 'g'), '\s{2,}', ' ', 'g'), ' .') AS x FROM b)
SELECT entry_id, CASE WHEN lower(x) = 'con' THEN x || '_' ELSE x END AS name FROM c""")
def safe_name(t: Inputs) -> DataFrame:
    raw = F.when(F.col("entry_id") % 50 == 0, "CON").otherwise(
        F.concat("family", F.lit(" <"), "folder", F.lit(">: "), "title", F.lit(" -- "), "given", F.lit(" ."))
    )
    return t.v_entries.select("entry_id", naming.safe_file_name(raw).alias("name"))


@query("artifact_paths", r"""
WITH p AS (SELECT doc_id, rel, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS parent, split_part(rel, '/', -1) AS name FROM v_paths),
q AS (SELECT *, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix, regexp_replace(name, '(.)\.[^.]+$', '\1') AS stem FROM p)
SELECT doc_id, parent || '/parsed/' || stem AS parse_dir, parent || '/notes/' || stem || '.summary.md' AS note,
  parent || '/translations/' || stem || '.zh-Hans-x' || CASE WHEN suffix = '' THEN '.' ELSE suffix END AS translation FROM q""")
def artifact_paths(t: Inputs) -> DataFrame:
    rel = F.col("rel")
    return t.v_paths.select(
        "doc_id", paths.parse_dir(rel).alias("parse_dir"), paths.note_path(rel, F.lit("summary")).alias("note"),
        paths.translation_path(rel, F.lit(" zh-Hans  x"), paths.suffix(rel)).alias("translation"),
    )


@query("render_name", r"""
WITH n AS (SELECT entry_id, title, year, list_transform(list_slice(string_split(authors, ';'), 1, 2), lambda x: CASE WHEN contains(x, ',') THEN trim(split_part(x, ',', 1)) ELSE regexp_extract(trim(x), '(\S+)$', 1) END) AS names FROM v_entries),
r AS (SELECT entry_id, trim(CASE WHEN len(names) = 1 THEN names[1] ELSE names[1] || ' and ' || names[2] END) || ' - ' || year || ' - ' || trim(left(title, 100)) AS x FROM n),
b AS (SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[\x00-\x1f]', ' ', 'g'), '[<>:"/\\|?*]+', '-', 'g'), '\s+', ' ', 'g'), ' .') AS x FROM r),
c AS (SELECT entry_id, trim(regexp_replace(regexp_replace(x, '\s*[-–—]\s*[-–—]+\s*', ' - ', 'g'), '\s{2,}', ' ', 'g'), ' .') AS x FROM b)
SELECT entry_id, CASE WHEN length(x) > 180 THEN rtrim(left(x, 180), ' .-_') ELSE x END AS name FROM c""")
def render_name(t: Inputs) -> DataFrame:
    named = naming.with_name(creators_of(t.v_entries).withColumn("language", F.lit("en")))
    return named.select("entry_id", "name")


@query("render_name_template", r"""
SELECT entry_id, CASE WHEN year >= 2000 THEN trim(lower(regexp_replace(trim(title), '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+', '_', 'g')), '_') ELSE 'old ' || upper(item_type) END AS raw FROM v_entries""")
def render_name_template(t: Inputs) -> DataFrame:
    template = '{{ if year >= 2000 }}{{ title case="snake" }}{{ else }}{{ "old " }}{{ itemType case="upper" }}{{ endif }}'
    return t.v_entries.select("entry_id", naming.NameTemplate(template).column(t.v_entries.columns).alias("raw"))


@query("change_case", r"""
SELECT entry_id, replace(upper(title), 'ẞ', 'SS') AS upper_case, lower(title) AS lower_case, replace(upper(left(title, 1)), 'ẞ', 'SS') || substr(title, 2) AS sentence_case,
  trim(lower(regexp_replace(title, '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+', '-', 'g')), '-') AS hyphen_case,
  trim(lower(regexp_replace(title, '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+', '_', 'g')), '_') AS snake_case,
  array_to_string(list_transform(list_filter(regexp_split_to_array(title, '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+'), lambda w: w <> ''), lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE replace(upper(left(w, 1)), 'ẞ', 'SS') || substr(w, 2) END), '') AS camel_case,
  array_to_string(list_transform(list_filter(regexp_split_to_array(title, '[^A-Za-z0-9_\x{80}-\x{10FFFF}]+'), lambda w: w <> ''), lambda w: replace(upper(left(w, 1)), 'ẞ', 'SS') || substr(w, 2)), '') AS pascal_case,
  array_to_string(list_transform(regexp_extract_all(title, '\p{L}+|[^\p{L}]+'), lambda w: replace(upper(left(w, 1)), 'ẞ', 'SS') || lower(substr(w, 2))), '') AS title_case
FROM v_entries""")
def change_case(t: Inputs) -> DataFrame:
    styles = ("upper", "lower", "sentence", "hyphen", "snake", "camel", "pascal", "title")
    return t.v_entries.select("entry_id", *[naming.change_case(F.col("title"), s).alias(f"{s}_case") for s in styles])


@query("access_date", r"""
WITH u AS (SELECT entry_id, raw_access, CASE WHEN ends_with(raw_access, 'Z') THEN CAST(replace(raw_access, 'Z', '') AS TIMESTAMP) WHEN ends_with(raw_access, '+02:00') THEN CAST(replace(raw_access, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR ELSE CAST(raw_access || ':00' AS TIMESTAMP) END AS utc FROM v_raw)
SELECT entry_id, CASE WHEN ends_with(raw_access, 'Z') OR ends_with(raw_access, '+02:00') THEN strftime(utc + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(utc + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END || '+08:00' AS accessed FROM u""")
def access_date(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", naming.access_date(F.col("raw_access"), "Asia/Shanghai").alias("accessed"))


# Numbers that follow each other share the blank or sign between them. The first rule marks their ends beforehand, the last one runs twice.
@query("clean_authors", r"""
WITH l AS (SELECT entry_id, replace(replace(replace(replace(replace(replace(raw_authors, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(173), '') AS x FROM v_raw),
a AS (SELECT entry_id, regexp_replace(regexp_replace(x, '[✉†‡§*]+', ' ', 'g'), '([0-9])(\s|$)', '\1' || chr(57344) || '\2', 'g') AS x FROM l),
b AS (SELECT entry_id, replace(regexp_replace(x, '([^0-9\x{E000}])\s+[0-9]+\x{E000}', '\1 ', 'g'), chr(57344), '') AS x FROM a),
c AS (SELECT entry_id, regexp_replace(regexp_replace(x, '([A-Za-z])[0-9]+', '\1', 'g'), ',\s*[0-9]+', ' ', 'g') AS x FROM b),
d AS (SELECT entry_id, regexp_replace(regexp_replace(x, '(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])', '\1 \2', 'g'), '(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])', '\1 \2', 'g') AS x FROM c)
SELECT entry_id, trim(regexp_replace(x, '\s+', ' ', 'g'), ' ,;') AS authors FROM d""")
def clean_authors(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", people.clean_author_line(F.col("raw_authors")).alias("authors"))


@query("strip_latex", r"""
WITH a AS (SELECT doc_id, '\documentclass[10pt]{article}% c' || chr(10) || '\title{T ' || source || '}' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '\begin{document}' ELSE '' END || chr(10) || '\section*[s]{One} ' || text AS x FROM documents),
b AS (SELECT doc_id, x, CASE WHEN strpos(x, '\begin{document}') > 0 THEN substr(x, strpos(x, '\begin{document}')) ELSE x END AS y FROM a)
SELECT doc_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(x, '(?m)%.*$', '', 'g'), '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?', ' ', 'g'), '{}\', '   '), '[\s\p{Z}]+', ' ', 'g')) AS plain,
  trim(regexp_replace(translate(regexp_replace(regexp_replace(y, '(?m)%.*$', '', 'g'), '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?', ' ', 'g'), '{}\', '   '), '[\s\p{Z}]+', ' ', 'g')) AS body FROM b""")
def strip_latex(t: Inputs) -> DataFrame:
    x = F.concat(
        F.lit("\\documentclass[10pt]{article}% c\n\\title{T "), "source", F.lit("}"),
        F.when(F.col("doc_id") % 2 == 0, "\n\\begin{document}").otherwise(""), F.lit("\n\\section*[s]{One} "), "text",
    )
    return t.documents.select("doc_id", x.alias("x")).select(
        "doc_id", text.strip_latex(F.col("x")).alias("plain"), text.latex_body(F.col("x")).alias("body")
    )


@query("lang_tag", r"""
SELECT doc_id, CASE WHEN regexp_matches(stem, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS stem_lang, CASE WHEN regexp_matches(source, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS source_lang FROM v_cn""")
def lang_tag(t: Inputs) -> DataFrame:
    return t.v_cn.select(
        "doc_id", text.language_tag(F.col("stem")).alias("stem_lang"), text.language_tag(F.col("source")).alias("source_lang")
    )


# The JVM writes an upper-case ß as SS.
@query("spaced_header", r"""
WITH h AS (SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN upper(replace(family, 'ß', 'ss')) || ' A B C D E' WHEN 1 THEN upper(replace(title, 'ß', 'ss')) ELSE title END AS raw_header FROM v_entries)
SELECT entry_id, upper(raw_header) = raw_header AND lower(raw_header) <> raw_header AND length(raw_header) >= 8 AND (length(raw_header) - length(replace(raw_header, ' ', ''))) / length(raw_header) > 0.25 AS spaced FROM h""")
def spaced_header(t: Inputs) -> DataFrame:
    return t.v_raw.select("entry_id", text.is_letter_spaced_header(F.col("raw_header")).alias("spaced"))


@query("content_key", r"""
SELECT doc_id, left(sha256('translation:md:p:' || lang || ':zh' || chr(0) || text), 20) AS doc_hash FROM documents""")
def content_key(t: Inputs) -> DataFrame:
    namespace = F.concat(F.lit("translation:md:p:"), "lang", F.lit(":zh"))
    return t.documents.select("doc_id", text.content_key(F.col("text"), namespace).alias("doc_hash"))


@query("summary_line", r"""
SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(ltrim(trim(x), '#>'))), lambda x: length(x) > 20)[1], 240) AS summary,
  coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[#>*\-\s]+', ''))), lambda x: length(x) BETWEEN 4 AND 60)[1], nullif(left(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), 60), ''), 'Untitled') AS label
FROM v_text""")
def summary_line(t: Inputs) -> DataFrame:
    c = F.col("text")
    return t.v_text.select("doc_id", text.summary_line(c).alias("summary"), text.fallback_title(c, c).alias("label"))


@query("front_matter", r"""
SELECT doc_id, source AS name, lang || ': x' AS description, trim(array_to_string(list_filter(list_transform(string_split(list_filter(regexp_split_to_array(trim(text, chr(10) || ' '), '\n\s*\n'), lambda p: trim(p) <> '')[1], chr(10)), lambda x: trim(trim(trim(x), '# '))), lambda x: x <> ''), ' '))[1:300] AS paragraph
FROM documents""")
def front_matter(t: Inputs) -> DataFrame:
    raw = F.concat(F.lit("---\nname: "), "source", F.lit("\nnonsense\ndescription: '"), "lang", F.lit(": x'\n---\n"), "text")
    parsed = t.documents.select("doc_id", raw.alias("raw")).select(
        "doc_id", text.front_matter(F.col("raw")).alias("m"), text.front_matter_body(F.col("raw")).alias("body")
    )
    return parsed.select(
        "doc_id", F.try_element_at("m", F.lit("name")).alias("name"),
        F.try_element_at("m", F.lit("description")).alias("description"),
        text.first_paragraph(F.col("body")).alias("paragraph"),
    )


@query("sensitive_paths", r"""
WITH p AS (SELECT doc_id, rel, lower(rel) AS l, lower(regexp_replace(split_part(rel, '/', -1), '(.)\.[^.]+$', '\1')) AS stem FROM v_paths),
w AS (SELECT *, regexp_extract_all(stem, '[a-z0-9]+') AS words FROM p)
SELECT doc_id, rel, list_has_any(string_split(l, '/'), ['.git', '.library', '.ssh', 'node_modules']) OR list_has_any(words, ['cookie', 'secret', 'token', 'password']) OR (list_contains(words, 'private') AND list_contains(words, 'key')) AS private FROM w""")
def sensitive_paths(t: Inputs) -> DataFrame:
    return t.v_paths.select("doc_id", "rel", paths.is_private(F.col("rel")).alias("private"))


@query("text_files", r"""
SELECT doc_id, rel FROM v_paths WHERE lower(regexp_extract(split_part(rel, '/', -1), '^.+(\.[^.]+)$', 1)) IN ('.md', '.tex', '.txt') AND size <= 8388608 AND NOT list_contains(string_split(rel, '/'), '.library')""")
def text_files(t: Inputs) -> DataFrame:
    return t.v_paths.filter(paths.is_text_file(F.col("rel"), F.col("size"))).select("doc_id", "rel")


@query("sniff_files", r"""
WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN '\documentclass{article}' || chr(10) || text WHEN 2 THEN text || chr(0) ELSE text END AS x FROM documents),
b AS (SELECT doc_id, encode(x) AS raw FROM c), h AS (SELECT doc_id, hex(raw) AS hx, octet_length(raw) AS n FROM b)
SELECT doc_id, n = 0 OR starts_with(hx, '25504446') OR regexp_matches(left(hx, 8192), '^(?:[0-9A-F]{2})*?00') AS is_binary,
  n > 0 AND NOT starts_with(hx, '25504446') AND NOT regexp_matches(left(hx, 4096), '^(?:[0-9A-F]{2})*?00') AS is_latex,
  regexp_matches(left(hx, 8192), '^(?:[0-9A-F]{2})*?5C646F63756D656E74636C617373') AS has_class FROM h""")
def sniff_files(t: Inputs) -> DataFrame:
    kind = F.col("doc_id") % 4
    x = (
        F.when(kind == 0, F.concat(F.lit("%PDF-1.7 "), "text"))
        .when(kind == 1, F.concat(F.lit("\\documentclass{article}\n"), "text"))
        .when(kind == 2, F.concat("text", F.lit("\0")))
        .otherwise(F.col("text"))
    )
    c = F.col("content")
    return t.documents.select("doc_id", x.cast("binary").alias("content")).select(
        "doc_id", paths.is_binary(c).alias("is_binary"), paths.is_latex_source(c).alias("is_latex"),
        paths.has_documentclass(c).alias("has_class"),
    )


@query("extract_doi", r"""
SELECT doc_id, nullif(lower(regexp_replace(regexp_extract(regexp_replace(text, '(?i)(10\.[0-9]{4,9}/)\s+([A-Z0-9])', '\1\2', 'g'), '(?i)(?:^|[^\p{L}\p{N}_])(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)', 1), '[.,;)]+$', '')), '') AS doi FROM v_text""")
def extract_doi(t: Inputs) -> DataFrame:
    return t.v_text.select("doc_id", identifiers.first_doi(F.col("text")).alias("doi"))


@query("doi_mentions", r"""
SELECT doc_id, lower(regexp_replace(m, '[.,;)]+$', '')) AS doi FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?i)(10\.[0-9]{4,9}/)\s+([A-Z0-9])', '\1\2', 'g'), '(?i)(?:^|[^\p{L}\p{N}_])(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)', 1)) AS m FROM v_text) s""")
def doi_mentions(t: Inputs) -> DataFrame:
    return t.v_text.select("doc_id", F.explode(identifiers.all_dois(F.col("text"))).alias("doi"))


@query("extract_arxiv", r"""
SELECT doc_id, nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:arXiv\s*:\s*)?([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:$|[^\p{L}\p{N}_])', 1), '') AS arxiv_id FROM v_text""")
def extract_arxiv(t: Inputs) -> DataFrame:
    return t.v_text.select("doc_id", identifiers.first_arxiv_id(F.col("text")).alias("arxiv_id"))


# Letters and digits beyond ASCII become Z first, as \b knows ASCII words only.
@query("extract_isbn", r"""
WITH w AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]', 'Z', 'g') AS text FROM v_text)
SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?i)\b(?:ISBN(?:-1[03])?\s*[:：]?\s*)?((?:97[89][ -]?)?[0-9][0-9Xx -]{8,16}[0-9Xx])\b', 1), lambda m: upper(regexp_replace(m, '[^0-9Xx]', '', 'g'))), lambda m: length(m) IN (10, 13))[1] AS isbn FROM w""")
def extract_isbn(t: Inputs) -> DataFrame:
    return t.v_text.select("doc_id", identifiers.first_isbn(F.col("text")).alias("isbn"))
