"""Merging records: fill, overwrite, identity, and the source waterfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.text import null_if_blank

# Merged fields.
FILL_FIELDS = ("publication_title", "volume", "issue", "pages", "abstract", "year", "doi", "publisher")
FILL_EXTRA = ("page_start", "page_end", "journal", "affiliation")
OVERWRITE_FIELDS = (
    "item_type", "title", "year", "date", "publication_title", "publisher", "place", "edition", "isbn", "volume", "issue",
    "pages", "doi", "arxiv_id", "abstract", "language", "url",
)
IDENTITY_FIELDS = ("entry_id", "folder", "files", "attachments", "ai_note")


def _filled(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind == "string":
        return null_if_blank(c)
    return F.when(F.size(c) > 0, c) if kind.startswith(("array", "map")) else c


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """One row per key; of rows that repeat a key the first by their JSON text."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns if c != key])
    return table.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select(key, "_row.*")


def _paired(local: DataFrame, other: DataFrame, key: str) -> DataFrame:
    other = one_per_key(other, key)
    renamed = other.select(F.col(key), *[F.col(c).alias(f"_net_{c}") for c in other.columns if c != key])
    return local.join(renamed, key, "left")


def merge_fill(
    local: DataFrame, network: DataFrame, key: str, fields: Sequence[str] = FILL_FIELDS + FILL_EXTRA, source: str = "source"
) -> DataFrame:
    """Fill empty local fields from the network record; say which, and from where.

    Title and creators are never touched. Adds `filled` and `network_source`.
    """
    df = _paired(local, network, key)
    ours = [f for f in fields if f in network.columns]
    for f in ours:
        if f not in local.columns:
            df = df.withColumn(f, F.lit(None).cast(dict(network.dtypes)[f]))
    news = {f: _filled(df, f).isNull() & _filled(df, f"_net_{f}").isNotNull() for f in ours}
    df = df.withColumn("filled", F.array_compact(F.array(*[F.when(test, F.lit(f)) for f, test in news.items()])))
    origin = F.coalesce(F.col(f"_net_{source}"), F.lit("network")) if source in network.columns else F.lit("network")
    df = df.withColumn("network_source", F.when(F.size("filled") > 0, origin))
    df = df.withColumns({f: F.coalesce(_filled(df, f), _filled(df, f"_net_{f}")) for f in ours})
    return df.select(*[c for c in df.columns if not c.startswith("_net_")])


def merge_overwrite(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Filled incoming fields win; creators and keywords are replaced whole; extra maps are united."""
    df = _paired(existing, incoming, key)
    merged = {
        f: F.coalesce(_filled(df, f"_net_{f}"), F.col(f))
        for f in (*OVERWRITE_FIELDS, "creators", "keywords") if f in existing.columns and f in incoming.columns
    }
    if "extra" in existing.columns and "extra" in incoming.columns:
        empty = F.create_map().cast("map<string,string>")
        merged["extra"] = F.map_concat(F.coalesce("extra", empty), F.coalesce("_net_extra", empty))
    return df.withColumns(merged).select(*existing.columns)


def merge_identity(existing: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Confirmed metadata under the existing identity; tags and keywords stay when none came in."""
    df = _paired(confirmed, existing, key)
    kept = {f: F.col(f"_net_{f}") for f in IDENTITY_FIELDS if f in existing.columns and f != key}
    for f in ("tags", "keywords", "reading_status"):
        if f in existing.columns and f in confirmed.columns:
            kept[f] = F.coalesce(_filled(df, f), F.col(f"_net_{f}"))
    out = list(dict.fromkeys([*confirmed.columns, *kept]))
    return df.withColumns(kept).select(*out)


def registry_by_doi(requests: DataFrame, registries: Sequence[tuple[str, DataFrame]], doi: str = "doi") -> DataFrame:
    """Exact DOI lookup; the first registry that has the DOI answers.

    Registries are entry tables with a normalised `doi`; a DOI that one repeats
    counts once. Rows without a DOI stay out of the joins. Adds `registry` and a
    struct `record` of the shared columns.
    """
    shared = [c for c in registries[0][1].columns if all(c in r.columns for _, r in registries) and c != "doi"]
    asked = requests.withColumn("_doi", identifiers.normalize_doi(F.col(doi)))
    df, unasked = asked.filter("_doi is not null"), asked.filter("_doi is null")
    hits = []
    for name, registry in registries:
        answer = one_per_key(registry.filter("doi is not null"), "doi").select(F.col("doi").alias("_doi"), F.struct(*shared).alias(f"_hit_{name}"))
        df = df.join(answer, "_doi", "left")
        hits.append((name, F.col(f"_hit_{name}")))
    source = F.coalesce(*[F.when(h.isNotNull(), F.lit(n)) for n, h in hits])
    found = df.withColumn("registry", source).withColumn("record", F.coalesce(*[h for _, h in hits])).drop(
        "_doi", *[f"_hit_{n}" for n, _ in hits]
    )
    return found.unionByName(unasked.drop("_doi"), allowMissingColumns=True)


def resolve_waterfall(documents: DataFrame, tiers: Sequence[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """First tier with a titled record per document, with the log of attempts.

    `tiers` are (name, table) in order; a table has the key, `title` and any other
    columns all tiers share, one row per document it was tried for: a NULL title
    is a failed attempt, an absent row means not tried. Tables of later tiers may
    hold documents settled earlier; they are ignored and not logged.
    """
    shared = [c for c in tiers[0][1].columns if all(c in t.columns for _, t in tiers) and c != key]
    stacked: DataFrame | None = None
    for rank, (name, table) in enumerate(tiers):
        rows = table.select(key, F.lit(rank).alias("_tier"), F.lit(name).alias("source"), F.struct(*shared).alias("_record"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    title = null_if_blank(F.col("_record.title"))
    attempt = F.struct(
        F.col("_tier").alias("tier"), F.col("source"), title.isNotNull().alias("ok"), F.coalesce(title, F.lit("not found")).alias("message")
    )
    per_document = stacked.groupBy(key).agg(
        F.min_by(F.struct("_tier", "source", "_record"), F.when(title.isNotNull(), F.col("_tier"))).alias("_win"),
        F.sort_array(F.collect_list(attempt)).alias("_attempts"),
    )
    tried = F.filter("_attempts", lambda a: F.col("_win").isNull() | (a["tier"] <= F.col("_win._tier")))
    return documents.join(per_document, key, "left").select(
        *documents.columns, F.col("_win.source").alias("source"), F.col("_win._record").alias("record"),
        F.transform(tried, lambda a: F.struct(a["source"].alias("source"), a["ok"].alias("ok"), a["message"].alias("message"))).alias("attempts"),
    )


def final_verdict(initial: Column, detected: Column) -> Column:
    """The first supplement verdict when positive and more confident, else the later one."""
    return F.when(initial["is_supplement"] & (initial["confidence"] > detected["confidence"]), initial).otherwise(detected)


def arxiv_waterfall(documents: DataFrame, by_title: DataFrame, key: str = "doc_id") -> DataFrame:
    """arXiv id: given, else in the file name, else in the text, else by title match.

    `documents`: key, arxiv_id, filename, text. `by_title`: key and arxiv_id of
    the title matches, wanted only for documents without another id.
    """
    given = null_if_blank(F.trim("arxiv_id"))
    in_name, in_text = identifiers.first_arxiv_id(F.col("filename")), identifiers.first_arxiv_id(F.col("text"))
    matched = by_title.select(key, identifiers.normalize_arxiv(F.col("arxiv_id")).alias("_matched"))
    df = documents.select(key, given.alias("_given"), in_name.alias("_name"), in_text.alias("_text")).join(matched, key, "left")
    steps = (("given", "_given"), ("file name", "_name"), ("text", "_text"), ("title", "_matched"))
    return df.select(
        key, F.coalesce(*[c for _, c in steps]).alias("arxiv_id"),
        F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in steps]).alias("found_in"),
    )


def text_source(documents: DataFrame, cached: DataFrame, previews: DataFrame | None, key: str = "doc_id", pages: int = 6) -> DataFrame:
    """Text to identify a document by: cached preview, fresh preview, text layer, file stem.

    `documents`: key, cache_key, text_layer, stem, scan_likely. `cached`: cache_key,
    text. `previews`: key, text, error; None when no parser is available.
    """
    df = documents.join(cached.select("cache_key", null_if_blank(F.col("text")).alias("_cached")), "cache_key", "left")
    if previews is None:
        df = df.withColumn("_fresh", F.lit(None).cast("string")).withColumn("_error", F.lit("no parser available, text layer used"))
    else:
        df = df.join(previews.select(key, null_if_blank(F.col("text")).alias("_fresh"), F.col("error").alias("_error")), key, "left")
    layer = null_if_blank(F.col("text_layer"))
    ocr = F.when(F.col("scan_likely"), " with OCR").otherwise("")
    unread = F.col("_cached").isNull() & F.col("_fresh").isNull()
    label = (
        F.when(F.col("_cached").isNotNull(), f"cached preview, pages 1-{pages}")
        .when(F.col("_fresh").isNotNull(), F.concat(F.lit(f"preview, pages 1-{pages}"), ocr))
        .when(layer.isNotNull(), f"text layer, pages 1-{pages}").otherwise("file name only")
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("_cached").isNull(), F.col("_error")),
        F.when(unread & layer.isNull(), "no usable text on the first pages"),
    ))
    return df.select(key, F.coalesce("_cached", "_fresh", layer, "stem").alias("text"), label.alias("text_source"), warnings.alias("warnings"))
