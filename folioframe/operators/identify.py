"""Identification of documents by the whole waterfall of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers, paths
from folioframe.functions.people import DEFAULT_SURNAMES, Surnames, parse_name
from folioframe.functions.text import has_cjk, null_if_blank, text_or_empty
from folioframe.operators import cjk, extract, layout, linkage, merge, quality
from folioframe.session import cut

# Fields that every tier can give, and names of sources.
FIELDS = ("title", "creators", "year", "publication_title", "volume", "issue", "publisher", "doi", "arxiv_id", "isbn")
ARXIV, CROSSREF, OPENALEX, LOCAL, TEXT = "arXiv", "Crossref", "OpenAlex", "local", "local-text"
ATTEMPT = "struct<source:string,ok:boolean,message:string>"


def _tried(source: Column | str, ok: bool, message: Column | str) -> Column:
    name = F.lit(source) if isinstance(source, str) else source
    return F.struct(name.alias("source"), F.lit(ok).alias("ok"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _given(df: DataFrame, record: str = "") -> list[Column]:
    """The fields that a table (or one of its structs) has."""
    names = [f.name for f in df.schema[record].dataType.fields] if record else df.columns
    return [F.col(f"{record}.{f}" if record else f).alias(f) for f in FIELDS if f in names]


def identify(
    documents: DataFrame, arxiv: DataFrame, crossref: DataFrame, openalex: DataFrame, parsed: DataFrame | None = None,
    lines: DataFrame | None = None, key: str = "doc_id", surnames: Surnames = DEFAULT_SURNAMES,
) -> DataFrame:
    """The best record of every document, its source, and what was tried before.

    `documents` has the key, filename and text; a missing text is empty. The
    registries are entry tables: `arxiv` by arxiv_id, the others by doi, with ord and the fields
    that each has. `parsed` (key, text) is parser output, `lines` the layout of first
    pages. Tiers, each for the documents that are still open:

    1. arXiv by the id in text or file name;
    2. Crossref, then OpenAlex, by the DOI in text or file name;
    3. with Chinese text or file name: the Chinese record; a similar title in
       OpenAlex, else in Crossref, fills its empty fields and names the source;
    4. parser output with a title;
    5. the free-text guess, if its title is not just the file name.

    Adds source (null if nothing was found), the fields, filled (by tier 3),
    attempts (source, ok, message) in order, is_supplement, confidence,
    parent_doi, parent_title and role. Between tiers only keys, identifiers and
    records move; texts are read by the tiers that need them, for open documents.
    """
    stem = paths.stem(F.col("filename"))
    first = lambda of: F.coalesce(of(F.col("text")), of(F.col("filename")))
    found = documents.select(
        key, stem.alias("_stem"), first(identifiers.first_doi).alias("_own"), first(identifiers.first_arxiv_id).alias("_arxiv"),
        (has_cjk(text_or_empty(F.col("text"))) | has_cjk(text_or_empty(stem))).alias("_cjk"),
    )

    def titled(registry: DataFrame) -> DataFrame:
        return registry.filter(null_if_blank(F.col("title")).isNotNull())

    # Tier 1: rows without an id stay out of the join.
    known = merge.one_per_key(titled(arxiv).filter("arxiv_id is not null"), "arxiv_id")
    record = F.struct(*[c for c in known.columns if c != "arxiv_id"]).alias("_record")
    asked = cut(found)
    by_id = cut(asked.filter("_arxiv is not null").join(known.select(F.col("arxiv_id").alias("_arxiv"), record), "_arxiv", "left"))
    hit = by_id.filter("_record is not null")
    done = [hit.select(key, F.lit(ARXIV).alias("source"), F.col("_arxiv").alias("arxiv_id"), F.col("_own").alias("_own_doi"), *[c for c in _given(hit, "_record")], F.array(_tried(ARXIV, True, F.col("_record.title"))).alias("attempts"))]
    missed = F.array(_tried(ARXIV, False, "not found"))
    rest = by_id.filter("_record is null").drop("_record").withColumn("_tried", missed).unionByName(
        asked.filter("_arxiv is null").withColumn("_tried", F.array().cast(f"array<{ATTEMPT}>")))

    # Tier 2.
    registries = [(CROSSREF, titled(crossref)), (OPENALEX, titled(openalex))]
    by_doi = cut(merge.registry_by_doi(rest, registries, "_own"))
    hit = by_doi.filter("registry is not null")
    log = F.concat("_tried", F.array(_tried(F.col("registry"), True, F.col("record.title"))))
    done.append(hit.select(key, F.col("registry").alias("source"), F.col("_own").alias("doi"), *[c for c in _given(hit, "record")], log.alias("attempts")))
    rest = by_doi.filter("registry is null").drop("registry", "record")

    # Tier 3.
    texts = documents.select(key, F.col("text").alias("_text"))
    chinese = rest.filter("_cjk").join(texts, key)
    front = layout.front_page(lines, key, surnames) if lines is not None else _no_front(documents, key)
    # Written, as without a layout the filter on titles would otherwise take the file names apart once more for each use of a part.
    names = cut(cjk.filename_metadata(chinese.select(key, F.col("_stem").alias("stem"), F.col("_text").alias("text")), surnames=surnames))
    own = cut(cjk.chinese_record(names, front, key))
    own = own.withColumn("creators", F.transform("authors", lambda a: parse_name(a))).drop("authors")
    shelves = [(name, table.select(F.struct(F.lit(name).alias("shelf"), F.col("ord")).alias("record_id"), "ord", "title")) for name, table in reversed(registries)]
    matches = linkage.tiered_match(own.select(F.col(key).alias("query_id"), "title"), shelves).select(F.col("query_id").alias(key), "record_id")
    fields = [f for f in merge.FILL_FIELDS + merge.FILL_EXTRA if all(f in t.columns for _, t in registries)]
    stock = registries[0][1].select(F.struct(F.lit(CROSSREF).alias("shelf"), F.col("ord")).alias("record_id"), F.col("title").alias("net_title"), *fields).unionByName(
        registries[1][1].select(F.struct(F.lit(OPENALEX).alias("shelf"), F.col("ord")).alias("record_id"), F.col("title").alias("net_title"), *fields))
    network = cut(matches.join(stock, "record_id").select(key, F.col("record_id.shelf").alias("_shelf"), "net_title", *fields))
    filled = merge.merge_fill(own, network.drop("_shelf", "net_title"), key).join(network.select(key, "_shelf", "net_title"), key, "left")
    step = F.when(F.col("_shelf").isNotNull(), _tried(F.col("_shelf"), True, F.col("net_title"))).otherwise(_tried(F.col("source"), True, F.col("title")))
    filled = cut(filled.join(rest.select(key, "_tried", F.col("_own").alias("_own_doi")), key).withColumn("attempts", F.concat("_tried", F.array(step))))
    done.append(filled.select(key, F.coalesce("_shelf", "source").alias("source"), *_given(filled), "filled", "attempts", "_own_doi"))
    rest = rest.join(filled.select(key), key, "left_anti")

    # Tier 4.
    if parsed is not None:
        guess = extract.parsed_metadata(rest.join(parsed.select(key, F.col("text").alias("_parsed")), key), "_parsed")
        guess = cut(guess.filter(null_if_blank(F.col("title")).isNotNull()))
        done.append(guess.select(key, F.lit(LOCAL).alias("source"), *_given(guess), F.concat("_tried", F.array(_tried(LOCAL, True, F.col("title")))).alias("attempts"), F.col("_own").alias("_own_doi")))
        rest = rest.join(guess.select(key), key, "left_anti")

    # Tier 5.
    guess = extract.text_metadata(rest.join(texts, key), "_text", "_stem")
    told = (null_if_blank(F.col("title")).isNotNull()) & (F.lower("title") != F.lower("_stem"))
    guess = guess.withColumn("_told", F.coalesce(told, F.lit(False)))
    kept = [F.when(F.col("_told"), c).alias(f) for f, c in ((f, F.col(f)) for f in FIELDS if f in guess.columns)]
    log = F.when(F.col("_told"), F.concat("_tried", F.array(_tried(TEXT, True, F.col("title"))))).otherwise(F.col("_tried"))
    done.append(guess.select(key, F.when(F.col("_told"), TEXT).alias("source"), *kept, log.alias("attempts"), F.col("_own").alias("_own_doi")))

    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more, allowMissingColumns=True)
    result = result.withColumn("doi", F.coalesce("doi", "_own_doi")).withColumn("filled", F.coalesce("filled", F.array().cast("array<string>")))
    for f in FIELDS:
        if f not in result.columns:
            result = result.withColumn(f, F.lit(None).cast("string"))
    judged = quality.detect_supplement(documents.select(key, "text", "filename").join(asked.select(key, "_own"), key), "text", "filename", None, "_own")
    judged = judged.select(key, "is_supplement", "confidence", "parent_doi", "parent_title")
    role = F.when(F.col("is_supplement"), "parent-of-supplement").otherwise("primary")
    return result.select(key, "source", *FIELDS, "filled", "attempts").join(judged, key).withColumn("role", role)


def _no_front(documents: DataFrame, key: str) -> DataFrame:
    """The columns of a page layout, without rows."""
    kinds = {"fm_year": "int", "fm_book": "boolean", "fm_authors": "array<string>"}
    names = ("fm_title", "fm_authors", "fm_year", "fm_book", "fm_volume", "fm_issue", "fm_page_start", "fm_page_end", "fm_doi", "fm_isbn", "fm_article_no", "fm_clc", "fm_received_date", "fm_journal", "fm_affiliation")
    return documents.filter("false").select(key, *[F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])
