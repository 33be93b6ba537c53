"""The library tables: path lookup, healing, links, upserts and plans.

Every function maps DataFrames to a new DataFrame; the caller writes it.
Tables: entries(entry_id, ord, folder, ...), attachments(entry_id, pos, path, role, ...),
mappings(rel, status, entry_id, original_name, folder, ...), inventory(rel, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers, naming, paths
from folioframe.functions.text import null_if_blank, text_or_empty
from folioframe.operators.extract import part_marker
from folioframe.operators.rank import supplement_names, unique_names
from folioframe.operators.scale import first_per_key
from folioframe.session import cut

# Mapping states.
ORGANIZED, SUPPLEMENT, FAILED, MISSING = "organized", "supplement", "failed", "missing"
ABSENT_MESSAGE = "the file was moved or deleted outside the library"


def under(path: Column, prefix: str | Column) -> Column:
    """The path is the folder itself or lies below it."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def moved(path: Column, old: str | Column, new: str | Column) -> Column:
    """The path with its leading folder `old` replaced by `new`."""
    old = F.lit(old) if isinstance(old, str) else old
    new = F.lit(new) if isinstance(new, str) else new
    return F.when(under(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.lit(2**30)))).otherwise(path)


# ---- lookup -------------------------------------------------------------


def resolve_paths(queries: DataFrame, mappings: DataFrame, entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """Entry of each path: by mapping, else the first entry with that file path or base name.

    Attachment keys are reduced to their first entry before the join, so a base
    name shared by many entries meets a query once.
    """
    direct = mappings.filter("entry_id is not null").select("rel", F.col("entry_id").alias("_mapped"))
    files = attachments.join(entries.select("entry_id", "ord", "folder"), "entry_id").select(
        "entry_id", "ord",
        F.explode(F.array_distinct(F.array(paths.join(F.col("folder"), F.col("path")), paths.name(F.col("path"))))).alias("_key"),
    )
    owners = files.groupBy("_key").agg(F.min(F.struct("ord", "entry_id")).alias("_owner"))
    open_paths = queries.select("rel").distinct().join(direct, "rel", "left")
    keyed = open_paths.filter("_mapped is null").select(
        "rel", F.explode(F.array_distinct(F.array(F.col("rel"), paths.name(F.col("rel"))))).alias("_key")
    )
    found = keyed.join(owners, "_key").groupBy("rel").agg(F.min("_owner").alias("_best"))
    return open_paths.join(found, "rel", "left").select(
        "rel", F.coalesce("_mapped", "_best.entry_id").alias("entry_id"),
        F.when(F.col("_mapped").isNotNull(), "mapping").when(F.col("_best").isNotNull(), "attachment").alias("found_by"),
    )


def selected_entries(selection: DataFrame, mappings: DataFrame, entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """The entries of the selected files, once each."""
    found = resolve_paths(selection, mappings, entries, attachments).filter("entry_id is not null")
    return entries.join(found.select("entry_id").distinct(), "entry_id", "left_semi")


def self_heal(mappings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Organized and supplement mappings whose file is gone become missing."""
    there = inventory.select("rel").distinct().withColumn("_there", F.lit(True))
    lost = F.col("status").isin(ORGANIZED, SUPPLEMENT) & F.col("_there").isNull()
    return mappings.join(there, "rel", "left").withColumn(
        "message", F.when(lost, ABSENT_MESSAGE)
    ).withColumn("status", F.when(lost, MISSING).otherwise(F.col("status"))).drop("_there")


def link_supplements(supplements: DataFrame, entries: DataFrame) -> DataFrame:
    """Parent entry of each supplement by folder, with same-work and mismatch flags.

    `supplements` has rel, folder, doi, title and parent_doi (the detected one).
    """
    parents = first_per_key(entries.filter("folder is not null"), ["folder"], F.col("ord")).select(
        "folder", F.col("entry_id").alias("parent_id"), F.col("doi").alias("_doi"), F.col("title").alias("_title")
    )
    same_doi = F.lower(F.trim("doi")) == F.lower(F.trim("_doi"))
    same_title = F.lower(F.trim("title")) == F.lower(F.trim("_title"))
    detected, known = identifiers.normalize_doi(F.col("parent_doi")), identifiers.normalize_doi(F.col("_doi"))
    target = F.coalesce(known, detected)
    own = identifiers.normalize_doi(F.col("doi"))
    return supplements.join(parents, "folder", "left").select(
        "rel", "folder", "parent_id",
        (F.coalesce(same_doi, F.lit(False)) | F.coalesce(same_title, F.lit(False))).alias("same_work"),
        F.coalesce(detected != known, F.lit(False)).alias("doi_mismatch"),
        target.alias("relation_target"),
        F.when(own != target, own).alias("supplement_doi"),
    )


def group_parts(entries: DataFrame, title: str = "title") -> DataFrame:
    """Entries with a part marker grouped by base title; a repeated marker is rejected."""
    parts = entries.withColumn("_p", part_marker(F.col(title))).filter("_p is not null").select(
        "entry_id", "ord", F.col("_p.base").alias("base"), F.col("_p.marker").alias("marker"),
        F.col("_p.order").alias("part_order"),
    )
    winners = parts.groupBy("base", "marker").agg(F.min(F.struct("ord", "entry_id")).alias("_first"))
    return parts.join(winners, ["base", "marker"]).select(
        "entry_id", "base", "marker", "part_order", (F.col("entry_id") == F.col("_first.entry_id")).alias("accepted")
    )


def managed_folders(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """Flag the folders that hold an entry."""
    owned = entries.select("folder").distinct().withColumn("_owned", F.lit(True))
    return folders.join(owned, "folder", "left").select("folder", F.col("_owned").isNotNull().alias("managed"))


def selectable_files(
    scan: DataFrame, entries: DataFrame, attachments: DataFrame, inventory: DataFrame
) -> DataFrame:
    """Raw and organized files plus attachments on disk, outside generated folders."""
    attached = attachments.join(entries.select("entry_id", "folder"), "entry_id").select(
        paths.join(F.col("folder"), F.col("path")).alias("rel")
    ).join(inventory.select("rel").distinct(), "rel", "left_semi")
    listed = scan.filter(F.col("state").isin("raw", "organized")).select("rel")
    return listed.unionByName(attached).filter(~paths.has_part(F.col("rel"), paths.GENERATED_DIRS)).distinct()


def pending_segments(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments that still need work."""
    return segments.join(results, ["doc_hash", "seg_idx"], "left_anti")


def drop_stale(mappings: DataFrame, moves: DataFrame) -> DataFrame:
    """Mappings left after files moved.

    `moves` has rel (old path), entry_id, original_name and keep_entry. Dropped
    are the old path, other mappings of the entry (unless kept) and failed rows
    with the same base name.
    """
    kept = mappings.join(moves.select("rel"), "rel", "left_anti")
    kept = kept.join(moves.filter(~F.col("keep_entry")).select("entry_id"), "entry_id", "left_anti")
    names = moves.select(F.col("original_name").alias("_name")).distinct()
    failed = kept.filter(F.col("status") == FAILED).withColumn("_name", paths.name(F.col("rel")))
    return kept.filter(F.coalesce(F.col("status") != FAILED, F.lit(True))).unionByName(
        failed.join(names, "_name", "left_anti").drop("_name")
    )


# ---- table maintenance ---------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last-wins upsert: of several changes of a key the one with the highest `order` counts, and is the only row of that key."""
    newest = first_per_key(changes, keys, F.desc(order)).drop(order)
    return current.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest, allowMissingColumns=True)


def upsert_entries(entries: DataFrame, changes: DataFrame, now: Column, order: str) -> DataFrame:
    return upsert(entries, changes.withColumn("updated_at", now), ["entry_id"], order)


def remove_entries(entries: DataFrame, mappings: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries without the removed ids, and mappings without theirs."""
    ids = removed.select("entry_id").distinct()
    return entries.join(ids, "entry_id", "left_anti"), mappings.join(ids, "entry_id", "left_anti")


def record_mappings(mappings: DataFrame, placed: DataFrame, now: Column, order: str) -> DataFrame:
    return upsert(mappings, placed.withColumn("moved_at", now), ["rel"], order)


def mark_failed(mappings: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """`failures` has rel and message; the mapping loses its entry."""
    rows = failures.select(
        "rel", F.lit(FAILED).alias("status"), F.lit(None).cast(mappings.schema["entry_id"].dataType).alias("entry_id"),
        paths.name(F.col("rel")).alias("original_name"), F.lit(None).cast("string").alias("folder"),
        now.alias("moved_at"), "message",
    )
    return upsert(mappings, rows.withColumn("_latest", F.col("message")), ["rel"], "_latest")


def remap_prefix(entries: DataFrame, mappings: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Move a folder: entry folders, mapping paths and mapping folders below it follow."""
    old, new = old.strip("/"), new.strip("/")
    if not old or not new:
        return entries, mappings
    # A mapping's folder follows only together with its path.
    moved_maps = mappings.withColumn(
        "folder", F.when(under(F.col("rel"), old), moved(F.col("folder"), old, new)).otherwise(F.col("folder"))
    ).withColumn("rel", moved(F.col("rel"), old, new))
    return entries.withColumn("folder", moved(F.col("folder"), old, new)), moved_maps


def remap_many(df: DataFrame, key: str, column: str, rules: DataFrame) -> DataFrame:
    """Apply many (old, new) folder moves at once; the longest matching folder wins.

    Each path is exploded to its ancestor folders and joined on equality, so no
    prefix comparison of all pairs takes place.
    """
    ladder = df.select(key, F.explode(paths.self_and_ancestors(F.col(column))).alias("old"))
    hits = ladder.join(rules, "old").groupBy(key).agg(F.max(F.struct(F.length("old").alias("n"), "old", "new")).alias("_r"))
    return df.join(hits, key, "left").withColumn(
        column, F.when(F.col("_r").isNotNull(), moved(F.col(column), F.col("_r.old"), F.col("_r.new"))).otherwise(F.col(column))
    ).drop("_r")


def remove_prefix(entries: DataFrame, mappings: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Drop a folder: its entries, the mappings below it and those of the dropped entries."""
    gone = F.coalesce(under(F.col("folder"), prefix.strip("/")), F.lit(False))
    removed = entries.filter(gone).select("entry_id")
    kept = mappings.filter(~under(F.col("rel"), prefix.strip("/"))).join(removed, "entry_id", "left_anti")
    return entries.filter(~gone), kept


def upsert_attachments(current: DataFrame, incoming: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Merge on (entry_id, path): filled incoming fields win, artifact maps are united.

    A path that comes in more than once is reduced first: per field the last
    filled value in order of `pos`, of the maps the last value of each name.
    """
    last = [F.max_by(null_if_blank(F.col(c)), F.when(null_if_blank(F.col(c)).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in fields]
    empty = F.create_map().cast("map<string,string>")
    maps = F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.coalesce("artifacts", empty)).alias("json"))))
    united = F.aggregate(maps, empty, lambda acc, m: F.map_concat(acc, F.from_json(m["json"], "map<string,string>")))
    fresh = incoming.groupBy("entry_id", "path").agg(*last, united.alias("_artifacts"), F.min("pos").alias("_pos"))
    return current.join(fresh, ["entry_id", "path"], "full_outer").select(
        "entry_id", "path", F.coalesce("pos", "_pos").alias("pos"),
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in fields],
        F.map_concat(F.coalesce("artifacts", empty), F.coalesce("_artifacts", empty)).alias("artifacts"),
    )


def delete_effect(deleted: DataFrame, mappings: DataFrame, attachments: DataFrame) -> DataFrame:
    """What becomes of entries when files are deleted.

    `deleted` has rel and entry_id. Per entry: primary_gone, supplements left and
    the outcome `removed` (primary gone, no supplement left) or `kept`.
    """
    names = deleted.select("entry_id", paths.name(F.col("rel")).alias("_name")).distinct().withColumn("_gone", F.lit(True))
    touched = attachments.withColumn("_name", paths.name(F.col("path"))).join(
        deleted.select("entry_id").distinct(), "entry_id", "left_semi"
    )
    state = touched.join(names, ["entry_id", "_name"], "left").groupBy("entry_id").agg(
        F.coalesce(F.bool_or(F.col("_gone") & (F.col("role") == "primary")), F.lit(False)).alias("primary_gone"),
        F.count_if((F.col("role") == "supplement") & F.col("_gone").isNull()).alias("supplements_left"),
    )
    dropped = mappings.join(deleted.select("rel").distinct(), "rel", "left_semi").groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("mappings_dropped")
    )
    removed = F.col("primary_gone") & (F.col("supplements_left") == 0)
    return state.join(dropped, "entry_id", "left").select(
        "entry_id", "primary_gone", "supplements_left", F.coalesce("mappings_dropped", F.lit(0)).alias("mappings_dropped"),
        F.when(removed, "removed").otherwise("kept").alias("outcome"),
    )


# ---- plans ----------------------------------------------------------------


def archive_plan(
    files: DataFrame, duplicates: DataFrame, entries: DataFrame, existing_names: DataFrame, template: str | None = None
) -> DataFrame:
    """Where each identified file goes, or why it stays.

    `files`: rel, entry_id, ord, is_supplement and the entry fields of the naming
    template. `duplicates`: entry_id, match_id (from `linkage`). `entries`: the
    library with entry_id, folder and has_primary. `existing_names`: name.
    """
    matched = duplicates.select("entry_id", F.col("match_id").alias("_match"))
    known = entries.select(F.col("entry_id").alias("_match"), F.col("folder").alias("_folder"), F.col("has_primary").alias("_taken"))
    named = naming.with_name(files, template).join(matched, "entry_id", "left").join(known, "_match", "left")
    reject = F.col("_folder").isNotNull() & F.coalesce(F.col("_taken"), F.lit(False)) & ~F.col("is_supplement")
    reason = F.when(text_or_empty(F.col("title")) == "", "not identified").when(reject, "the parent already has a primary file")
    named = cut(named.select(
        "entry_id", "ord", "rel", "name", "is_supplement", "_folder", reason.alias("reason")
    ))
    fresh = unique_names(
        named.filter("reason is null and _folder is null").select("entry_id", "ord", F.col("name").alias("base")), existing_names
    ).select("entry_id", F.col("target").alias("_new"))
    placed = named.join(fresh, "entry_id", "left").withColumn("folder", F.when(F.col("reason").isNull(), F.coalesce("_folder", "_new")))
    last = paths.name(F.col("folder"))
    target = F.when(F.col("is_supplement"), F.concat(last, F.lit(" - Supporting Information.pdf"))).otherwise(F.concat(last, F.lit(".pdf")))
    status = F.when(F.col("reason").isNotNull(), FAILED).when(F.col("is_supplement"), SUPPLEMENT).otherwise(ORGANIZED)
    return placed.select(
        "entry_id", "rel", F.when(F.col("folder").isNotNull(), paths.join(F.col("folder"), target)).alias("target"),
        F.when(F.col("is_supplement"), "supplement").otherwise("primary").alias("role"), status.alias("status"), "reason",
    )


def archive_effects(plan: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, bundles) after an archive plan has been carried out.

    `plan` is a result of `archive_plan`, `mappings` has rel, status, entry_id,
    original_name and folder. A placed file's mapping replaces what `drop_stale`
    says; of several files with one target the highest entry_id counts. A file that
    stays gets a failed mapping with its reason. Bundles are the citation files to
    write: entry_id and target of every folder that has received a file.
    """
    original = paths.name(F.col("rel"))
    placed = cut(plan.filter("target is not null").select("entry_id", "rel", "target", "role", "status", original.alias("original_name"), paths.parent(F.col("target")).alias("folder")))
    left = drop_stale(mappings, placed.select("rel", "entry_id", "original_name", (F.col("role") == SUPPLEMENT).alias("keep_entry")))
    new = placed.select(F.col("target").alias("rel"), "status", "entry_id", "original_name", "folder", F.col("entry_id").alias("_latest"))
    failures = plan.filter("target is null").select(
        "rel", F.lit(FAILED).alias("status"), F.lit(None).cast(plan.schema["entry_id"].dataType).alias("entry_id"), original.alias("original_name"), F.lit(None).cast("string").alias("folder"),
        F.col("reason").alias("message"), F.col("entry_id").alias("_latest"),
    )
    after = upsert(upsert(left, new, ["rel"], "_latest"), failures, ["rel"], "_latest")
    bundles = placed.groupBy("folder").agg(F.max("entry_id").alias("entry_id")).select("entry_id", paths.join(F.col("folder"), F.lit("citation.bib")).alias("target"))
    return after, bundles


def rename_plan(entries: DataFrame, attachments: DataFrame, template: str | None = None) -> DataFrame:
    """Moves that follow a metadata change: folder, primary, parts and supplements.

    Entries whose folder already has the canonical name keep it; the others take
    the next free name.
    """
    named = cut(naming.with_name(entries, template).select("entry_id", "ord", "folder", "name"))
    current = paths.name(F.col("folder"))
    staying = named.filter(current == F.col("name")).select("entry_id", F.col("name").alias("target"))
    leaving = named.filter(F.coalesce(current != F.col("name"), F.lit(True)))
    moving = unique_names(leaving.select("entry_id", "ord", F.col("name").alias("base")),
                          named.select(current.alias("name")).distinct()).select("entry_id", "target")
    folders = named.select("entry_id", "folder").join(staying.unionByName(moving), "entry_id")
    numbered = supplement_names(attachments.filter("role = 'supplement'")).select("entry_id", "pos", "supplement_label")
    ext = F.coalesce(null_if_blank(paths.suffix(F.col("path"))), F.lit(".pdf"))
    marker = F.coalesce(part_marker(paths.stem(F.col("path")))["marker"], F.lit(""))
    new_name = (
        F.when(F.col("role") == "supplement", F.concat("target", F.lit(" - "), "supplement_label", ext))
        .when(F.col("role") == "part", F.concat("target", marker, ext))
        .when(F.col("role") == "primary", F.concat("target", marker, F.lit(".pdf")))
        .otherwise(F.col("path"))
    )
    moves = attachments.join(folders, "entry_id").join(numbered, ["entry_id", "pos"], "left")
    return moves.select(
        "entry_id", "pos", "role", paths.join(F.col("folder"), F.col("path")).alias("src"),
        paths.join(F.col("target"), new_name).alias("dst"),
    )
