"""Segmentation and translation-job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import catalog, segment, stats
from folioframe.plans.registry import query
from folioframe.plans.views import Inputs
from folioframe.session import cut


@query("chunk_text")
def chunk_text(t: Inputs) -> DataFrame:
    return segment.chunk_text(t.documents.select("doc_id", "text"))


@query("chunk_cover", r"""
SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS squeezed, true AS within FROM documents WHERE trim(text, chr(10) || chr(9) || ' ') <> ''""")
def chunk_cover(t: Inputs) -> DataFrame:
    """Chunks cover the whole text and respect the limit."""
    from folioframe.operators.extract import ordered_concat

    chunks = segment.chunk_text(t.documents.select("doc_id", "text"))
    joined = ordered_concat(chunks, ["doc_id"], "idx", "chunk", "joined")
    within = chunks.groupBy("doc_id").agg((F.max(F.length("chunk")) <= segment.MAX_CHARS).alias("within"))
    return joined.join(within, "doc_id").select("doc_id", F.regexp_replace("joined", r"\s+", "").alias("squeezed"), "within")


@query("protect_spans")
def protect_spans(t: Inputs) -> DataFrame:
    return segment.span_table(segment.protect(t.v_md))


@query("span_census", r"""
SELECT 'code-fence' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'inline-code', count(*) FROM documents UNION ALL SELECT 'url', count(*) FROM documents UNION ALL SELECT 'doi', count(*) FROM documents""")
def span_census(t: Inputs) -> DataFrame:
    """Spans by kind, for the kinds that only the view puts in."""
    spans = segment.span_table(segment.protect(t.v_md))
    kinds = ("code-fence", "inline-code", "url", "doi")
    return spans.filter(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("segments")
def segments(t: Inputs) -> DataFrame:
    return segment.segments(segment.protect(t.v_md))


@query("paragraphs", r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\n[ \t]*\n+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS l FROM v_md)
SELECT doc_id, i::INTEGER AS idx, piece FROM (SELECT doc_id, unnest(range(len(f))) AS i, unnest(f) AS piece FROM (SELECT doc_id, list_filter(l, lambda x: x <> '') AS f FROM p) a) b""")
def paragraphs(t: Inputs) -> DataFrame:
    return t.v_md.select("doc_id", F.posexplode(segment.paragraphs(F.col("text"))).alias("idx", "piece"))


@query("render_docs", "SELECT doc_id, text FROM v_md")
def render_docs(t: Inputs) -> DataFrame:
    """Protect, cut, put together again: the source comes back unchanged."""
    protected = cut(segment.protect(t.v_md))
    return segment.render(segment.segments(protected), protected)


@query("apply_segments")
def apply_segments(t: Inputs) -> DataFrame:
    """All segments through a function that loses tokens, so that the fallback works too."""
    work = segment.segments(segment.protect(t.v_md)).withColumnRenamed("doc_id", "doc_hash")
    return segment.apply_segments(work, lambda s: s.upper().replace("[[KEEP", "[[kept"))


@query("glossary", r"""
SELECT doc_id, replace(replace(replace(replace(x, '库伦', '库仑'), '洛仑兹', '洛伦兹'), '勒让德尔', '勒让德'), '贝赛尔', '贝塞尔') AS text FROM (SELECT doc_id, topic || '库伦' || stem || '洛仑兹贝赛尔' || text AS x FROM v_cn) s""")
def glossary(t: Inputs) -> DataFrame:
    x = F.concat("topic", F.lit("库伦"), "stem", F.lit("洛仑兹贝赛尔"), "text")
    return t.v_cn.select("doc_id", segment.glossary(x).alias("text"))


@query("estimate_job")
def estimate_job(t: Inputs) -> DataFrame:
    return stats.estimate_job(segment.segments(segment.protect(t.v_md)))


@query("estimate_plain", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, count(*) AS segments, sum(length(regexp_replace(text, '\[\[KEEP_[0-9]{6}\]\]', '', 'g')))::BIGINT AS chars, (count(*) / 2.0)::DOUBLE AS seconds FROM l WHERE text <> '' GROUP BY doc_id""")
def estimate_plain(t: Inputs) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    return stats.estimate_job(rows.withColumn("translatable", F.lit(True)), per_second=2.0)


@query("pack_requests")
def pack_requests(t: Inputs) -> DataFrame:
    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda p: segment.split_long_pieces(p, 400)))
    packed = t.documents.select("doc_id", pieces.alias("p")).select("doc_id", F.posexplode(segment.pack_requests(F.col("p"), 400)).alias("chunk", "r"))
    return packed.select("doc_id", "chunk", "r.start", "r.end", F.size("r.pieces").alias("n"))


@query("assemble", r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS piece_idx, CASE WHEN doc_id % 3 = 0 THEN ps[i] WHEN doc_id % 3 = 1 THEN 'T' || ps[i] WHEN i = 1 THEN 'one' || chr(10) || array_to_string(ps, chr(10)) ELSE '' END AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p) q""")
def assemble(t: Inputs) -> DataFrame:
    whole = t.documents.select("doc_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.split("text", "\n").alias("pieces"))
    matched = F.array_join(F.transform("pieces", lambda p: F.concat(F.lit("T"), p)), "\n")
    odd = F.concat(F.lit("one\n"), F.array_join("pieces", "\n"))
    answers = whole.filter("doc_id % 3 > 0").select("doc_id", "chunk", F.when(F.col("doc_id") % 3 == 1, matched).otherwise(odd).alias("text"))
    return segment.assemble(whole, answers)


@query("translation_job", r"""
SELECT doc_id, text FROM v_md""")
def translation_job(t: Inputs) -> DataFrame:
    """The whole job over all documents: protect, cut, skip stored results, work, store, render.

    The work function changes nothing, so every document must come back as it was.
    """
    protected = cut(segment.protect(t.v_md))
    pieces = cut(segment.segments(protected).withColumnRenamed("doc_id", "doc_hash"))
    stored = pieces.join(t.labels.select(F.col("doc_id").alias("doc_hash")), "doc_hash", "left_semi").select("doc_hash", "seg_idx", F.col("text").alias("result"))
    fresh = segment.apply_segments(catalog.pending_segments(pieces, stored), lambda s: s)
    results = stored.unionByName(fresh).withColumnRenamed("doc_hash", "doc_id")
    return segment.render(results, protected, value="result")
