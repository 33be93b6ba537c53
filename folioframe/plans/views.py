"""Adapter views: library-shaped inputs derived from the given tables.

The given tables hold prose without identifiers, so the views append DOI,
arXiv, ISBN and year lines made from each row's own hash. Every view keeps all
rows of its base table. The text is plain SQL that Spark and DuckDB both read;
where the dialects differ a view has two texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from folioframe.session import checkpoint_dir

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

STORED_VIEWS = ("documents", "v_entries", "v_text", "v_cn", "v_md", "v_paths")
# Rows in a file of a stored view: readers get many files, as a real library has, whatever row groups the given file has.
FILE_ROWS = 1000
_STORED: dict[tuple[str, str, str], str] = {}


@dataclass(frozen=True)
class View:
    spark: str
    duck: str = ""

    @property
    def oracle(self) -> str:
        return self.duck or self.spark


def _lines(base: str, columns: str, text: str) -> View:
    """One row per line of a text column, numbered from 0."""
    return View(
        spark=f"SELECT {columns}, line_no, line AS text FROM {{{base}}} LATERAL VIEW posexplode(split({text}, '\\n')) AS line_no, line",
        duck=f"SELECT {columns}, unnest(range(len(string_split({text}, chr(10)))))::INTEGER AS line_no, unnest(string_split({text}, chr(10))) AS text FROM {{{base}}}",
    )


# Documents planted for every tier: by doc_id modulo 8 an arXiv id, an arXiv id that no registry has and a DOI, a DOI that OpenAlex alone has,
# three Chinese file names (found in OpenAlex, in Crossref, nowhere), parser output or nothing at all, and a text with a title block.
CN_TITLE = "topic || CASE doc_id % 8 WHEN 3 THEN '导论甲甲甲甲' WHEN 4 THEN '图说乙乙乙乙' ELSE '札记丙丙丙丙' END"
PLANTED = f"""SELECT c.doc_id, e.title AS lib_title, c.p1, c.p2, c.y, c.source AS site, h.h, h.lang, '10.' || CAST(1000 + length(h.text) % 7 AS STRING) || '/' || substr(h.h, 1, 10) AS own_doi, substr(h.d, 1, 4) || '.' || substr(h.d, 5, 5) AS own_arxiv, {CN_TITLE.replace('topic', 'c.topic').replace('doc_id', 'c.doc_id')} AS cn_title, c.topic,
  CASE WHEN c.doc_id % 8 IN (3, 4, 5) THEN c.p1 || ' - ' || c.y || ' - ' || {CN_TITLE.replace('topic', 'c.topic').replace('doc_id', 'c.doc_id')} ELSE 'doc' || CAST(c.doc_id AS STRING) END || '.pdf' AS filename,
  CASE c.doc_id % 8 WHEN 0 THEN h.text || chr(10) || 'arXiv:' || substr(h.d, 1, 4) || '.' || substr(h.d, 5, 5) || 'v2'
    WHEN 1 THEN h.text || chr(10) || 'arXiv:9' || substr(h.d, 2, 3) || '.' || substr(h.d, 5, 5) || chr(10) || 'https://doi.org/10.' || CAST(1000 + length(h.text) % 7 AS STRING) || '/' || substr(h.h, 1, 10)
    WHEN 2 THEN CASE WHEN c.doc_id % 3 = 0 THEN 'Supplementary Material for: The parent of ' || c.source || chr(10) ELSE '' END || h.text || chr(10) || 'doi: 10.' || CAST(1000 + length(h.text) % 7 AS STRING) || '/' || substr(h.h, 1, 10)
    WHEN 6 THEN '12 34'
    WHEN 7 THEN '# A Study of ' || substr(h.h, 1, 6) || ' in ' || c.source || chr(10) || 'Ann ' || substr(translate(h.h, '0123456789', 'ghijklmnop'), 1, 6) || ', Bob Stone and Carl ' || h.lang || chr(10) || h.text
    ELSE h.text END AS text
FROM {{v_cn}} c JOIN {{v_hashed}} h ON h.doc_id = c.doc_id JOIN {{v_entries}} e ON e.entry_id = c.doc_id"""

_HASHED = "SELECT *, md5(text) AS h, translate(md5(text), 'abcdef', '012345') AS d FROM {documents}"

VIEWS: dict[str, View] = {
    "v_hashed": View(_HASHED),
    # Entries: the first sentence is the title, words of it the creators.
    "v_entries": View("""
SELECT doc_id AS entry_id, doc_id AS ord, source, lang, title,
  f AS family, g AS given,
  CASE length(text) % 3 WHEN 0 THEN f || ', ' || g
       WHEN 1 THEN f || ', ' || g || ';' || g || ' ' || f2
       ELSE f || ', ' || g || ';' || f2 || ';' || g || ' ' || f END AS authors,
  CAST(1990 + length(text) % 35 AS INT) AS year,
  CASE WHEN length(text) % 5 = 0 THEN CAST(NULL AS STRING)
       ELSE '10.' || CAST(1000 + length(text) % 7 AS STRING) || '/' || substr(h, 1, 10) END AS doi,
  CASE WHEN length(text) % 11 = 0 THEN substr(d, 1, 4) || '.' || substr(d, 5, 5) END AS arxiv_id,
  CASE WHEN length(text) % 13 = 0 THEN '978' || substr(d, 3, 10) END AS isbn,
  source || '/' || lang AS folder,
  CASE length(text) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'supplement' WHEN 2 THEN 'part' ELSE 'other' END AS role,
  CASE length(text) % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'bookSection' WHEN 2 THEN 'conferencePaper'
       WHEN 3 THEN 'preprint' ELSE 'journalArticle' END AS item_type,
  CASE WHEN length(text) % 2 = 0 THEN 'Journal of ' || f ELSE CAST(NULL AS STRING) END AS publication_title,
  CAST(1 + length(text) % 60 AS STRING) AS volume,
  CASE WHEN length(text) % 3 = 0 THEN CAST(NULL AS STRING) ELSE CAST(1 + length(text) % 12 AS STRING) END AS issue,
  CASE WHEN length(text) % 4 = 1 THEN f || ' Press' END AS publisher,
  lang || ';' || source || ';' || upper(lang) || ';' || f AS keywords, n_chars
FROM (SELECT *, coalesce(nullif(split_part(title, ' ', 2), ''), 'Anon') AS f,
        coalesce(nullif(split_part(title, ' ', 1), ''), 'A') AS g,
        coalesce(nullif(split_part(title, ' ', 3), ''), 'Noname') AS f2
      FROM (SELECT *, CASE WHEN length(sentence) BETWEEN 3 AND 350 THEN sentence
                      ELSE 'Untitled ' || substr(h, 1, 12) END AS title
            FROM (SELECT *, trim(split_part(split_part(text, chr(10), 1), '.', 1)) AS sentence FROM {v_hashed}) s) t) u"""),
    # Identifiers and dates as people write them.
    "v_raw": View("""
SELECT entry_id, title, lang,
  CASE entry_id % 4 WHEN 0 THEN ' https://doi.org/' || upper(doi) || '.' WHEN 1 THEN 'DOI : ' || doi || ';)' WHEN 2 THEN 'http://dx.doi.org/' || doi ELSE coalesce(doi, ' ') END AS raw_doi,
  CASE entry_id % 3 WHEN 0 THEN 'arXiv: ' || arxiv_id || 'v3' WHEN 1 THEN arxiv_id || 'V12' ELSE ' ' || arxiv_id END AS raw_arxiv,
  lang || ', ' || source AS raw_year, CAST(year AS STRING) || CASE entry_id % 3 WHEN 0 THEN '-03-01' WHEN 1 THEN ' (rev. 1)' ELSE '' END AS raw_date,
  '  ' || upper(lang) || '; ' || source || ' ;' || lang || ';#' || source || '- ;;' || family AS raw_list,
  '2024-0' || CAST(1 + entry_id % 9 AS STRING) || '-1' || CAST(entry_id % 10 AS STRING) || 'T' || CASE entry_id % 3 WHEN 0 THEN '23:15:00Z' WHEN 1 THEN '08:30:45+02:00' ELSE '11:05' END AS raw_access,
  family || CAST(entry_id % 10 AS STRING) || ',' || CAST(entry_id % 7 AS STRING) || ', ' || given || '† and ' || CAST(entry_id AS STRING) || ' ,;' AS raw_authors,
  CASE entry_id % 4 WHEN 0 THEN upper(family) || ' A B C D E' WHEN 1 THEN upper(title) ELSE title END AS raw_header
FROM {v_entries}"""),
    # Whole texts with identifier lines put in.
    "v_text": View("""
SELECT doc_id, lang, source, CASE doc_id % 6
  WHEN 0 THEN text || chr(10) || 'Available at https://doi.org/10.' || substr(d, 1, 4) || '/' || upper(substr(h, 1, 8)) || '.' || substr(h, 9, 4) || ').'
  WHEN 1 THEN text || chr(10) || 'doi: 10.' || substr(d, 1, 5) || '/  ' || substr(h, 1, 10)
  WHEN 2 THEN 'arXiv:' || substr(d, 1, 4) || '.' || substr(d, 5, 5) || 'v2' || chr(10) || text
  WHEN 3 THEN text || chr(10) || 'ISBN 978-' || substr(d, 1, 1) || '-' || substr(d, 2, 3) || '-' || substr(d, 5, 5) || '-' || substr(d, 10, 1)
  WHEN 4 THEN text || chr(10) || 'Published: 12 March ' || CAST(1950 + length(text) % 70 AS STRING) || chr(10) || 'hep-th/' || substr(d, 1, 7)
  ELSE '# A Study of ' || substr(h, 1, 6) || ' in ' || source || chr(10) || 'Ann ' || substr(translate(h, '0123456789', 'ghijklmnop'), 1, 6) || ', Bob Stone and Carl ' || lang || chr(10) || 'Journal of ' || source || chr(10) || text || chr(10) || 'Keywords: alpha, ' || substr(h, 1, 5) || '; Alpha| beta'
  END AS text FROM {v_hashed}"""),
    # Chinese file stems and front-matter text.
    "v_cn": View("""
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN p1 || ' - ' || y || ' - ' || topic
  WHEN 1 THEN p1 || '、' || p2 || ' - ' || y || ' - ' || topic || '（上）'
  WHEN 2 THEN '规划' || topic || ' - 梁陈方案新考'
  WHEN 3 THEN '欧阳' || substr(p1, 2, 1) || ' - ' || y || ' - ' || y || ' - ' || topic
  WHEN 4 THEN p1 || '和' || p2 || ' - ' || topic || '第三卷'
  WHEN 5 THEN p1 || ' ' || p2 || ' - ' || y || ' - ' || topic || '全集'
  ELSE topic || ' Part II' END AS stem,
  y || ' Vol. ' || vol || ', No. ' || iss || chr(10) || topic || chr(10) || p1 || ' ' || p2 || 'XU Hao' || chr(10)
  || '（' || topic || '大学规划学院，北京 100045）' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '第' || vol || '卷 第' || iss || '期 页码 ' || pg || '-' || pg || '9'
          ELSE y || '年 第' || iss || '期 第' || vol || '卷' END || chr(10) || '城市学刊' || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN '文章编号：1000-' || substr(d, 1, 4) || '(' || y || ')02-0123-07 '
          WHEN 1 THEN '中图分类号：TU' || substr(d, 1, 3) || '; TP391 ' ELSE '收稿日期：' || y || '-03-1' || substr(d, 1, 1) || ' ' END
  || 'DOI:10.' || substr(d, 1, 4) || '/j.issn.' || substr(d, 5, 4) || chr(10) || '摘要：' || topic || '，' || text AS text,
  y, p1, p2, topic, source
FROM (SELECT *, CAST(1990 + length(text) % 35 AS STRING) AS y, CAST(1 + length(text) % 60 AS STRING) AS vol,
        CAST(1 + length(text) % 12 AS STRING) AS iss, CAST(1 + length(text) % 300 AS STRING) AS pg,
        substr('张李王刘陈杨黄吴周徐', CAST(1 + length(text) % 10 AS INT), 1) || substr('伟芳娜敏静丽强磊军洋', CAST(1 + doc_id % 10 AS INT), 1) AS p1,
        substr('孙马朱胡郭何林高罗郑', CAST(1 + length(text) % 10 AS INT), 1) || substr('杰娟艳勇', CAST(1 + doc_id % 4 AS INT), 1) || substr('平刚桂', CAST(1 + doc_id % 3 AS INT), 1) AS p2,
        split_part('城市空间;乡村治理;古代礼制;园林艺术;水利工程;交通网络;住房保障;文化遗产', ';', CAST(1 + length(text) % 8 AS INT)) || split_part('演变;考述;概论;述要;比较', ';', CAST(1 + doc_id % 5 AS INT)) AS topic
      FROM {v_hashed}) s"""),
    "v_planted": View(PLANTED),
    # Layout lines of a first page: size and position from the line number and length.
    "v_cn_lines": View(
        spark="""SELECT doc_id, line_no, text, CASE line_no WHEN 1 THEN 18.0D ELSE 9.0D + length(text) % 3 END AS size,
  10.0D * (line_no % 3) AS x0, 40.0D + 14.0D * line_no AS y0, 52.0D + 14.0D * line_no AS y1, 800.0D AS page_h
FROM (SELECT doc_id, line_no, line AS text FROM {v_cn} LATERAL VIEW posexplode(split(text, '\\n')) AS line_no, line) s""",
        duck="""SELECT doc_id, line_no, text, CASE line_no WHEN 1 THEN 18.0 ELSE 9.0 + length(text) % 3 END::DOUBLE AS size,
  (10.0 * (line_no % 3))::DOUBLE AS x0, (40.0 + 14.0 * line_no)::DOUBLE AS y0, (52.0 + 14.0 * line_no)::DOUBLE AS y1, 800.0::DOUBLE AS page_h
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS text FROM {v_cn}) s""",
    ),
    # Single-character blocks of a scan that was read sideways.
    "v_rotated": View(
        spark="""SELECT doc_id, line_no, ch AS text, CASE WHEN line_no < length(topic) THEN 101.0D WHEN line_no < length(topic) + length(p1) THEN 61.3D ELSE 41.0D END AS x0, 12.0D * line_no AS y0
FROM {v_cn} LATERAL VIEW posexplode(split(topic || p1 || p2, '(?!^)(?!$)')) AS line_no, ch""",
        duck="""SELECT doc_id, line_no, text, CASE WHEN line_no < length(topic) THEN 101.0 WHEN line_no < length(topic) + length(p1) THEN 61.3 ELSE 41.0 END::DOUBLE AS x0, (12.0 * line_no)::DOUBLE AS y0
FROM (SELECT doc_id, topic, p1, p2, unnest(range(length(topic || p1 || p2)))::INTEGER AS line_no, unnest(regexp_extract_all(topic || p1 || p2, '.')) AS text FROM {v_cn}) s""",
    ),
    # Streamed answer events of a conversation, with a closing result event each.
    "v_stream_events": View("""
SELECT conv_id AS session_id, turn * 2 AS seq, CASE WHEN role = 'user' THEN '{"type":"stream_event","event":{"delta":{"text":"' || j || '"}}}'
  WHEN turn % 4 = 1 THEN '{"type":"content_block_delta","delta":{"text":"' || j || '"}}' ELSE '{"type":"ping"}' END AS event
FROM (SELECT *, replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' ') AS j FROM {conversations}) s WHERE conv_id % 3 > 0 OR role <> 'user' AND turn % 4 <> 1
UNION ALL SELECT conv_id AS session_id, 2 * max(turn) + 1 AS seq, '{"type":"result","result":"done ' || CAST(conv_id AS STRING) || '"}' AS event FROM {conversations} GROUP BY conv_id"""),
    "v_lines": View(
        spark="""SELECT doc_id, line_no, text, 9.0D + length(text) % 9 AS size, 10.0D * (line_no % 3) AS x0,
  14.0D * line_no AS y0, 14.0D * line_no + 12 AS y1
FROM (SELECT doc_id, line_no, line AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) AS line_no, line) s""",
        duck="""SELECT doc_id, line_no, text, (9.0 + length(text) % 9)::DOUBLE AS size, (10.0 * (line_no % 3))::DOUBLE AS x0,
  (14.0 * line_no)::DOUBLE AS y0, (14.0 * line_no + 12)::DOUBLE AS y1
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS text FROM {documents}) s""",
    ),
    # File inventory; extensions, folders and names vary with the text.
    "v_paths": View("""
SELECT doc_id, rel, n_chars AS size, h AS content_hash FROM (
SELECT *, source || '/' || lang || '/' || CASE length(text) % 9 WHEN 0 THEN 'notes/' WHEN 1 THEN 'parsed/' WHEN 2 THEN '.library/' ELSE '' END
  || CASE length(text) % 7 WHEN 0 THEN 'my-token-' WHEN 1 THEN 'Paper ' WHEN 2 THEN 'private key ' ELSE 'doc' END || CAST(doc_id AS STRING)
  || CASE length(text) % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.TeX' WHEN 2 THEN '.png' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.pdf' END AS rel
FROM {v_hashed}) s"""),
    # Mappings exist for the labelled documents; some point at files that are gone.
    "v_mappings": View("""
SELECT CASE WHEN p.size % 5 = 0 THEN p.rel || '.moved' ELSE p.rel END AS rel,
  CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'organized' WHEN p.size % 2 = 0 THEN 'supplement' ELSE 'missing' END AS status,
  CASE WHEN l.toxic = 1 THEN CAST(NULL AS BIGINT) ELSE p.doc_id END AS entry_id,
  'orig' || CAST(p.doc_id % 50 AS STRING) || '.pdf' AS original_name,
  substr(p.rel, 1, length(p.rel) - length(split_part(p.rel, '/', -1)) - 1) AS folder
FROM {v_paths} p JOIN {labels} l ON p.doc_id = l.doc_id"""),
    # Attachments: two per entry.
    "v_attachments": View("""
SELECT entry_id, 0 AS pos, 'main' || CAST(entry_id AS STRING) || '.pdf' AS path, 'primary' AS role, 'Main article' AS title, doi FROM {v_entries}
UNION ALL
SELECT entry_id, 1 AS pos, CASE WHEN year % 2 = 0 THEN 'si' || CAST(entry_id AS STRING) || '.pdf' ELSE 'main' || CAST(entry_id AS STRING) || '.pdf' END AS path,
  CASE WHEN year % 2 = 0 THEN 'supplement' ELSE '' END AS role, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS doi FROM {v_entries}"""),
    # Registry dump: one Crossref-like JSON record per DOI.
    "v_registry": View("""
SELECT doi, '{"DOI":"' || upper(doi) || '","title":["","' || jt || '."],"container-title":["' || coalesce(jp, '') || '"],"author":[{"family":"' || jf || '","given":"' || jg || '"},{"family":"","given":""}],'
  || CASE WHEN year % 3 = 0 THEN '"published-print":{"date-parts":[[' || CAST(year AS STRING) || ',3]]}' WHEN year % 3 = 1 THEN '"issued":{"date-parts":[[' || CAST(year AS STRING) || ']]}' ELSE '"created":{"date-parts":[[' || CAST(year AS STRING) || ',1,2]]}' END
  || ',"volume":"' || volume || '","issue":"' || coalesce(issue, '') || '","publisher":"' || coalesce(jpub, '') || '","ISBN":["' || coalesce(isbn, '') || '"]}' AS payload
FROM (SELECT *, replace(replace(title, chr(92), ''), chr(34), '') AS jt, replace(replace(family, chr(92), ''), chr(34), '') AS jf, replace(replace(given, chr(92), ''), chr(34), '') AS jg,
        replace(replace(publication_title, chr(92), ''), chr(34), '') AS jp, replace(replace(publisher, chr(92), ''), chr(34), '') AS jpub,
        row_number() OVER (PARTITION BY doi ORDER BY entry_id) AS rn FROM {v_entries} WHERE doi IS NOT NULL) s WHERE rn = 1"""),
    # OpenAlex-like dump with an inverted abstract.
    "v_openalex": View("""
SELECT doi, '{"title":"' || jt || '.","publication_year":' || CAST(year AS STRING) || ',"authorships":[{"author":{"display_name":"' || jg || ' ' || jf || '"}}],"primary_location":{"source":{"display_name":"' || coalesce(jp, '') || '"}},"biblio":{"volume":"' || volume || '","issue":"' || coalesce(issue, '') || '","first_page":"' || CASE WHEN year % 4 = 0 THEN '' ELSE volume END || '","last_page":"' || CASE WHEN year % 4 = 1 THEN '' ELSE volume || '9' END || '"},"doi":"https://doi.org/' || doi || '","abstract_inverted_index":{"' || jf || '":[2,4],"x' || jg || '":[0],"y' || jg || '":[1,3]}}' AS payload
FROM (SELECT *, replace(replace(title, chr(92), ''), chr(34), '') AS jt, replace(replace(family, chr(92), ''), chr(34), '') AS jf, replace(replace(given, chr(92), ''), chr(34), '') AS jg,
        replace(replace(publication_title, chr(92), ''), chr(34), '') AS jp,
        row_number() OVER (PARTITION BY doi ORDER BY entry_id) AS rn FROM {v_entries} WHERE doi IS NOT NULL) s WHERE rn = 1"""),
    "v_messages": View(
        spark="SELECT conv_id AS session_id, turn AS seq, timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60) AS ts, role, text AS content FROM {conversations}",
        duck="SELECT conv_id AS session_id, turn AS seq, make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS ts, role, text AS content FROM {conversations}",
    ),
    "v_usage": View("SELECT 'p' || CAST(l_suppkey % 10 AS STRING) AS provider, l_shipdate AS ts, CAST(l_quantity AS BIGINT) - 5 AS chars FROM {lineitem}"),
    "v_cache_files": View("SELECT o_orderkey AS key, o_orderdate AS mtime, CAST(round(o_totalprice) AS BIGINT) AS size FROM {orders}"),
    # History: runs of events by one user form a group.
    "v_history": View("""
SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN CAST(NULL AS STRING) ELSE 'g' || CAST(user_id % 3 AS STRING) END AS group_id, ts,
  'src' || CAST(user_id % 20 AS STRING) || '/' || event_type || '/f' || CAST(event_id % 97 AS STRING) || '.pdf' AS rel, event_type, value FROM {events}"""),
    # Markdown with things to protect put around the text.
    "v_md": View("""
SELECT doc_id, '# ' || source || chr(10) || chr(10) || 'Let $x_{' || lang || '}^2$ and [the site](https://example.org/' || substr(h, 1, 6) || ') hold, see 10.' || substr(d, 1, 4) || '/' || substr(h, 1, 6) || '.' || chr(10) || chr(10)
  || text || chr(10) || chr(10) || '$$' || chr(10) || 'E = mc^2' || chr(10) || '$$' || chr(10) || chr(10) || '```' || chr(10) || 'code ' || h || chr(10) || '```' || chr(10) || chr(10)
  || '| a | b |' || chr(10) || '| ' || substr(h, 1, 4) || ' | `q` |' || chr(10) AS text FROM {v_hashed}"""),
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def oracle(sql: str) -> str:
    """The statement with the views it names put in front as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name].oracle)
                order.append(name)

    visit(sql)
    ctes = [f"{n} AS ({_REFERENCE.sub(lambda m: m.group(1), _duck_types(VIEWS[n].oracle))})" for n in order]
    sql = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(head):
            return head + ", ".join([*ctes, sql[len(head) :]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql


def _duck_types(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)")


class Inputs:
    """The given tables and the adapter views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tag = f"{zlib.crc32(folder.encode()):08x}"

    def table(self, name: str) -> DataFrame:
        """A given table; splits are Spark's, by `spark.sql.files.maxPartitionBytes`."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A view (or the documents) written once per application: its columns are data then, as in a real library."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            rows = self.table(name) if name in TABLES else self.spark.sql(self._resolve(VIEWS[name].spark))
            rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED_VIEWS:
            return self.stored(name)
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(self._resolve(VIEWS[name].spark))

    def _resolve(self, sql: str) -> str:
        def registered(match: re.Match[str]) -> str:
            name = match.group(1)
            if name not in TABLES and name not in VIEWS:
                return match.group(0)
            view = f"{name}_{self._tag}"
            getattr(self, name).createOrReplaceTempView(view)
            return view

        return _REFERENCE.sub(registered, sql)
