"""Readers and writers for the index file, session logs, BibTeX and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import identifiers, paths
from folioframe.functions.people import authors, bibtex_name, parse_name
from folioframe.functions.text import dedupe_list, let, null_if_blank, text_or_empty
from folioframe.operators.scale import numbered
from folioframe.schemas import INDEX_FILE, MESSAGE
from folioframe.sources.textfiles import write_files

INDEX_VERSION = 3
CITATION_FILE = "citation.bib"
# BibTeX types and field order.
BIB_TYPES = {
    "journalArticle": "article", "book": "book", "bookSection": "incollection", "conferencePaper": "inproceedings", "preprint": "misc",
}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files as rows with maps of raw entry and mapping objects; other versions give no rows."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema(INDEX_FILE).json(path).filter(
        F.col("version") == INDEX_VERSION
    )


def index_entries(index: DataFrame) -> DataFrame:
    """Entry rows of an index: camel-case aliases folded, unknown fields swept into `extra`.

    Rows that are not objects are dropped; blank strings become NULL.
    """
    rows = index.select(F.explode("entries").alias("_key", "_json")).withColumn(
        "_m", F.from_json("_json", "map<string,string>")
    ).filter("_m is not null")
    known = {
        "id": ("id",), "item_type": ("item_type", "itemType"), "title": ("title",), "year": ("year",), "date": ("date",),
        "publication_title": ("publication_title", "publicationTitle"), "publisher": ("publisher",), "place": ("place",),
        "edition": ("edition",), "isbn": ("isbn",), "volume": ("volume",), "issue": ("issue",), "pages": ("pages",),
        "doi": ("doi",), "arxiv_id": ("arxiv_id", "arxivId"), "abstract": ("abstract",), "language": ("language",),
        "reading_status": ("reading_status", "readingStatus"), "url": ("url",), "folder": ("folder",),
        "created_at": ("created_at", "createdAt"), "updated_at": ("updated_at", "updatedAt"),
    }
    nested = ("creators", "authors", "editors", "keywords", "tags", "files", "attachments", "ai_note", "aiNote", "extra")
    taken = [name for names in known.values() for name in names] + list(nested)

    def field(*names: str) -> Column:
        return F.coalesce(*[null_if_blank(F.try_element_at("_m", F.lit(n))) for n in names])

    def strings(name: str) -> Column:
        return dedupe_list(F.coalesce(F.from_json(field(name), "array<string>"), F.array().cast("array<string>")))

    def people(name: str, kind: str) -> Column:
        raw = F.coalesce(F.from_json(field(name), "array<string>"), F.array().cast("array<string>"))

        def one(p: Column) -> Column:
            part = lambda *keys: F.trim(F.coalesce(*[null_if_blank(F.get_json_object(p, f"$.{k}")) for k in keys], F.lit("")))
            named = parse_name(p, kind)
            listed = p.startswith("{")
            role = F.coalesce(F.get_json_object(p, "$.creator_type"), F.get_json_object(p, "$.creatorType"), F.lit(kind))
            return F.struct(
                F.when(listed, part("family", "lastName", "name")).otherwise(named["family"]).alias("family"),
                F.when(listed, part("given", "firstName")).otherwise(named["given"]).alias("given"),
                F.when(listed, role).otherwise(F.lit(kind)).alias("creator_type"),
            )

        return F.transform(raw, one)

    first = F.when(F.size(people("creators", "author")) > 0, people("creators", "author")).otherwise(people("authors", "author"))
    swept = F.map_filter("_m", lambda k, v: ~k.isin(*taken))
    extra = F.coalesce(F.from_json(field("extra"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    plain = {name: field(*names) for name, names in known.items()}
    plain["id"] = F.coalesce(plain["id"], F.col("_key"))
    plain["doi"] = identifiers.normalize_doi(plain["doi"])
    plain["arxiv_id"] = identifiers.normalize_arxiv(plain["arxiv_id"])
    return rows.select(
        *[c.alias(n) for n, c in plain.items() if n != "year"],
        F.coalesce(identifiers.leading_year(plain["year"]), F.lit(None).cast("int")).alias("year"),
        F.concat(first, people("editors", "editor")).alias("creators"),
        strings("keywords").alias("keywords"), strings("tags").alias("tags"),
        F.from_json(field("files"), "map<string,string>").alias("files"),
        F.from_json(field("attachments"), "array<map<string,string>>").alias("attachments"),
        F.map_concat(extra, swept).alias("extra"),
    )


def index_mappings(index: DataFrame) -> DataFrame:
    """Mapping rows of an index."""
    schema = "status string, entryId string, originalName string, folder string, movedAt string, message string"
    rows = index.select(F.explode("mappings").alias("rel", "_json")).withColumn("_m", F.from_json("_json", schema))
    return rows.filter("_m is not null").select(
        "rel", "_m.status", null_if_blank(F.col("_m.entryId")).alias("entry_id"),
        null_if_blank(F.col("_m.originalName")).alias("original_name"), null_if_blank(F.col("_m.folder")).alias("folder"),
        F.col("_m.movedAt").alias("moved_at"), null_if_blank(F.col("_m.message")).alias("message"),
    )


def parse_messages(raw: DataFrame, line: str = "value") -> DataFrame:
    """Session log lines to messages; malformed lines and non-objects are skipped."""
    is_object = F.col(line).rlike(r"^\s*\{")
    parsed = raw.filter(is_object).withColumn("_m", F.from_json(line, MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    swept = F.map_filter(F.from_json(line, "map<string,string>"), lambda k, v: ~k.isin("ts", "role", "content"))
    kept = [c for c in raw.columns if c != line]
    return parsed.filter("_m is not null and _m._bad is null").select(
        *kept, "_m.ts", "_m.role", "_m.content", swept.alias("extra")
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSONL session logs; the session id is the file name."""
    raw = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1).alias("session_id"))
    return parse_messages(raw)


def _escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def file_field(attachments: Column) -> Column:
    """`label:path:TYPE` items of the attachments, repeated paths once."""

    def once(items: Column) -> Column:
        return let(F.transform(items, lambda a: a["path"]), lambda seen: F.filter(
            items, lambda a, i: (text_or_empty(a["path"]) != "") & (F.array_position(seen, a["path"]) == i + 1)
        ))

    def item(a: Column) -> Column:
        label = F.when(a["role"] == "supplement", "Supplement").when(a["role"] == "primary", "Main article").otherwise(text_or_empty(a["title"]))
        kind = F.upper(F.regexp_replace(paths.suffix(a["path"]), r"^\.", ""))
        return F.concat(
            F.translate(label, ":;", "-,"), F.lit(":"), F.replace(a["path"], F.lit(";"), F.lit("%3B")), F.lit(":"), kind
        )

    return F.array_join(F.transform(once(attachments), item), ";")


def bibtex_record(df: DataFrame, cite_key: str = "cite_key") -> DataFrame:
    """Add `bibtex`: one record per entry with its filled fields in order.

    Uses the entry columns that exist, `creators` for authors and `attachments`
    for the file field.
    """
    columns = {"year": "year", "title": "title", "journal": "publication_title", "publisher": "publisher", "address": "place",
               "edition": "edition", "isbn": "isbn", "volume": "volume", "number": "issue", "pages": "pages", "doi": "doi", "url": "url"}
    order = ("title", "author", "year", "journal", "publisher", "address", "edition", "isbn", "volume", "number", "pages", "doi", "url", "file")
    fields = []
    for name in order:
        if name == "author" and "creators" in df.columns:
            value = F.array_join(F.transform(authors(F.col("creators")), bibtex_name), " and ")
        elif name == "file" and "attachments" in df.columns:
            value = file_field(F.col("attachments"))
        elif columns.get(name) in df.columns:
            value = F.col(columns[name]).cast("string")
        else:
            continue
        shown = value if name == "file" else _escaped(value)
        fields.append(F.when(text_or_empty(value) != "", F.concat(F.lit(f"  {name} = {{"), shown, F.lit("},"))))
    kinds = F.create_map(*[F.lit(v) for pair in BIB_TYPES.items() for v in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("item_type")), F.lit("misc"))
    head = F.concat(F.lit("@"), kind, F.lit("{"), F.col(cite_key), F.lit(","))
    return df.withColumn("bibtex", F.concat_ws("\n", head, *fields, F.lit("}")))


def write_bibtex(records: DataFrame, path: str) -> None:
    """One text file set with a blank line between records."""
    records.select(F.concat("bibtex", F.lit("\n"))).write.mode("overwrite").text(path)


def write_citation_bundles(records: DataFrame, path: str) -> None:
    """Each folder's records in its `citation.bib`, by cite key, a blank line between them."""
    numbered_ = numbered(records.select(F.concat("folder", F.lit(f"/{CITATION_FILE}")).alias("target"), "cite_key", "bibtex"), ["target"], "cite_key", "n", ["bibtex"])
    part = F.concat(F.when(F.col("n") > 1, "\n").otherwise(""), "bibtex", F.lit("\n"))
    write_files(numbered_.select("target", "n", part.alias("part")), path, "n")


def write_rendered(documents: DataFrame, path: str) -> None:
    """Rendered documents, each (target, text) in a file of its own."""
    write_files(documents.select("target", F.col("text").alias("part")), path)


def write_report(rows: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines; the total is their count."""
    rows.write.mode("overwrite").json(path)
