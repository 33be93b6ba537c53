"""Bibliographic registry dumps: JSON and Atom records to entry rows, and the response cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.people import creator, parse_name
from folioframe.functions.text import fold_spaces, language_tag, null_if_blank
from folioframe.operators.extract import inverted_abstract

# Record layouts of the public registries.
_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>>"
CROSSREF_RECORD = f"""
DOI STRING, title ARRAY<STRING>, `container-title` ARRAY<STRING>, author ARRAY<STRUCT<family: STRING, given: STRING>>,
`published-print` {_DATE}, `published-online` {_DATE}, published {_DATE}, issued {_DATE}, created {_DATE},
volume STRING, issue STRING, publisher STRING, ISBN ARRAY<STRING>"""
DATE_ORDER = ("published-print", "published-online", "published", "issued", "created")
OPENALEX_RECORD = """
title STRING, publication_year INT, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>,
primary_location STRUCT<source: STRUCT<display_name: STRING>>,
biblio STRUCT<volume: STRING, issue: STRING, first_page: STRING, last_page: STRING>, doi STRING, abstract_inverted_index STRING"""
CACHE_DAYS = 14


def _first_filled(values: Column) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))


def _bare_title(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def crossref_entries(dump: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries from Crossref work records; records without a title are dropped."""
    r = dump.withColumn("_r", F.from_json(payload, CROSSREF_RECORD))

    def year_of(kind: str) -> Column:
        first = F.get(F.get(F.col(f"_r.`{kind}`.`date-parts`"), F.lit(0)), F.lit(0))
        return F.when(first.rlike(r"^\d+$"), first.try_cast("int"))

    people = F.filter(
        F.transform("_r.author", lambda a: creator(F.trim(F.coalesce(a["family"], F.lit(""))), F.trim(F.coalesce(a["given"], F.lit(""))))),
        lambda p: (p["family"] != "") | (p["given"] != ""),
    )
    title = _first_filled(F.col("_r.title"))
    return r.withColumn("_title", title).filter("_title is not null").select(
        *[c for c in dump.columns if c not in (payload, "doi")],
        F.lit("journalArticle").alias("item_type"), _bare_title(F.col("_title")).alias("title"),
        F.coalesce(people, F.array().cast("array<struct<family:string,given:string,creator_type:string>>")).alias("creators"),
        F.coalesce(*[year_of(k) for k in DATE_ORDER]).alias("year"),
        language_tag(F.col("_title")).alias("language"),
        _first_filled(F.col("_r.`container-title`")).alias("publication_title"),
        identifiers.normalize_doi(F.col("_r.DOI")).alias("doi"),
        null_if_blank(F.trim("_r.volume")).alias("volume"), null_if_blank(F.trim("_r.issue")).alias("issue"),
        identifiers.normalize_isbn(F.get("_r.ISBN", F.lit(0))).alias("isbn"),
        null_if_blank(F.trim("_r.publisher")).alias("publisher"), F.lit("crossref").alias("source"),
    )


def openalex_entries(dump: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries from OpenAlex work records, with pages and the rebuilt abstract."""
    r = dump.withColumn("_r", F.from_json(payload, OPENALEX_RECORD)).withColumn("_title", null_if_blank(F.trim("_r.title")))
    names = F.filter(F.transform("_r.authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: n != "")
    first, last = null_if_blank(F.trim("_r.biblio.first_page")), null_if_blank(F.trim("_r.biblio.last_page"))
    return r.filter("_title is not null").select(
        *[c for c in dump.columns if c not in (payload, "doi")],
        F.lit("journalArticle").alias("item_type"), _bare_title(F.col("_title")).alias("title"),
        F.coalesce(F.transform(names, lambda n: parse_name(n)), F.array().cast("array<struct<family:string,given:string,creator_type:string>>")).alias("creators"),
        F.col("_r.publication_year").alias("year"), language_tag(F.col("_title")).alias("language"),
        null_if_blank(F.trim("_r.primary_location.source.display_name")).alias("publication_title"),
        identifiers.normalize_doi(F.col("_r.doi")).alias("doi"),
        null_if_blank(F.trim("_r.biblio.volume")).alias("volume"), null_if_blank(F.trim("_r.biblio.issue")).alias("issue"),
        F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit("-"), last)).otherwise(first).alias("pages"),
        first.alias("page_start"), last.alias("page_end"),
        null_if_blank(inverted_abstract(F.col("_r.abstract_inverted_index"))).alias("abstract"), F.lit("openalex").alias("source"),
    )


ATOM_ENTRY = """
id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name: STRING>>, doi STRING, `arxiv:doi` STRING"""
ATOM_COLUMNS = ("id", "title", "summary", "published", "author", "doi", "arxiv:doi")


def arxiv_entries(feed: DataFrame) -> DataFrame:
    """Entries from parsed Atom records (`read_arxiv`, or `from_xml` with ATOM_ENTRY); columns beside the record stay."""
    names = F.transform("author", lambda a: parse_name(F.coalesce(a["name"], F.lit(""))))
    year = F.left("published", F.lit(4))
    return feed.select(
        *[c for c in feed.columns if c not in ATOM_COLUMNS],
        F.lit("preprint").alias("item_type"), null_if_blank(fold_spaces(F.col("title"))).alias("title"), names.alias("creators"),
        F.when(year.rlike(r"^\d{4}$"), year.try_cast("int")).alias("year"), F.col("published").alias("date"),
        identifiers.normalize_doi(F.coalesce("arxiv:doi", "doi")).alias("doi"),
        identifiers.normalize_arxiv(F.substring_index("id", "/", -1)).alias("arxiv_id"),
        null_if_blank(fold_spaces(F.col("summary"))).alias("abstract"), F.lit("en").alias("language"), F.col("id").alias("url"),
    )


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Atom files split at their entry elements."""
    return arxiv_entries(spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path))


def cache_status(requests: DataFrame, cache: DataFrame, now: Column, max_age_days: int = CACHE_DAYS) -> DataFrame:
    """fresh / stale / miss for each request url; cached responses come along.

    `cache` has key (sha256 of the url), mtime and payload.
    """
    keyed = requests.withColumn("key", F.sha2("url", 256)).join(cache, "key", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("mtime")
    status = F.when(F.col("mtime").isNull(), "miss").when(age <= max(1, max_age_days) * 86400, "fresh").otherwise("stale")
    return keyed.withColumn("cache_state", status)


def fetch_missing(requests: DataFrame, lookup: Callable[[str], str | None]) -> DataFrame:
    """Call `lookup(url)` for stale and missing rows only; a failure serves the stale payload.

    `requests` is the output of `cache_status`. Each distinct url is looked up once.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for url in batch["url"]:
                try:
                    answers.append(lookup(url))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"url": batch["url"], "answer": answers})

    open_urls = requests.filter("cache_state <> 'fresh'").select("url").distinct()
    answered = open_urls.mapInPandas(call, "url string, answer string")
    return requests.join(answered, "url", "left").withColumn("payload", F.coalesce("answer", "payload")).withColumn(
        "served", F.when(F.col("answer").isNotNull(), "lookup").when(F.col("payload").isNotNull(), F.col("cache_state")).otherwise("failed")
    ).drop("answer")
