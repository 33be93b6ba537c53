"""Row types of the library tables."""

from __future__ import annotations

CREATOR = "STRUCT<family: STRING, given: STRING, creator_type: STRING>"
ATTACHMENT = (
    "STRUCT<path: STRING, role: STRING, title: STRING, content_type: STRING, doi: STRING, relation: STRING, "
    "relation_target: STRING, artifacts: MAP<STRING, STRING>>"
)
ENTRY = f"""
entry_id STRING, ord BIGINT, item_type STRING, title STRING, creators ARRAY<{CREATOR}>, year INT, date STRING,
publication_title STRING, publisher STRING, place STRING, edition STRING, isbn STRING, volume STRING, issue STRING,
pages STRING, doi STRING, arxiv_id STRING, abstract STRING, language STRING, keywords ARRAY<STRING>, tags ARRAY<STRING>,
reading_status STRING, url STRING, folder STRING, files MAP<STRING, STRING>, attachments ARRAY<{ATTACHMENT}>,
ai_note MAP<STRING, STRING>, extra MAP<STRING, STRING>, created_at STRING, updated_at STRING"""
MAPPING = "rel STRING, status STRING, entry_id STRING, original_name STRING, folder STRING, moved_at STRING, message STRING"
ACTION = "rel STRING, category STRING, status STRING, outputs ARRAY<STRING>, message STRING, updated_at STRING"
MESSAGE = "ts STRING, role STRING, content STRING, _bad STRING"
USAGE = "provider STRING, ts TIMESTAMP, chars BIGINT"
SEGMENT_RESULT = "doc_hash STRING, seg_idx INT, result STRING"
HISTORY = "seq BIGINT, group_id STRING, baseline BOOLEAN, ts TIMESTAMP"
SNAPSHOT = "seq BIGINT, rel STRING, existed BOOLEAN, is_dir BOOLEAN, content_hash STRING"
LISTING = "seq BIGINT, rel STRING"
LAYOUT_LINE = "doc_id BIGINT, line_no INT, text STRING, size DOUBLE, x0 DOUBLE, y0 DOUBLE, y1 DOUBLE, page_h DOUBLE"
INDEX_FILE = "version INT, renameTemplate STRING, mappings MAP<STRING, STRING>, entries MAP<STRING, STRING>, updatedAt STRING"
