"""Citation keys, unique names, eviction, search and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import paths
from folioframe.functions.text import null_if_blank, text_or_empty
from folioframe.operators.scale import first_per_key, numbered, running_total, top_per_key, within_limit
from folioframe.session import cut


def cite_base(family: Column, year: Column, title: Column) -> Column:
    """Family, year (or `nd`) and the first title word of three letters or more, lower case."""
    word = F.get(F.filter(F.regexp_extract_all(title, F.lit("([A-Za-z0-9]+)"), 1), lambda w: F.length(w) > 2), F.lit(0))
    name = null_if_blank(F.regexp_replace(text_or_empty(family), "[^A-Za-z0-9]+", ""))
    return F.lower(F.concat(
        F.coalesce(name, F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(word, F.lit("work"))
    ))


def cite_keys(df: DataFrame, base: str = "base", order: str = "ord") -> DataFrame:
    """Add `cite_key`: the base, then base2, base3 … in order; taken numbers are skipped.

    A base that is itself another base plus a number (`smith2020a2`) keeps the
    right of the natural key, as its owner came with it.
    """
    df = cut(df)
    ranked = numbered(df, [base], order, "_n")
    naturals = df.select(F.col(base).alias("_key")).distinct()
    # Natural keys that read as a base plus a number, at every split: x12 = x1 + 2 = x + 12.
    splits = naturals.filter(F.col("_key").rlike("[0-9]$")).select(
        "_key", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_key") - 1, F.lit(1)))).alias("_i")
    ).select(F.substring("_key", F.lit(1), F.length("_key") - F.col("_i")).alias(base), F.right("_key", F.col("_i")).alias("_d"))
    taken = splits.filter(F.col("_d").rlike(r"^[1-9]\d{0,9}$") & (F.col(base) != "")).select(
        base, F.col("_d").try_cast("bigint").alias("_u")
    ).filter("_u >= 2").join(naturals.select(F.col("_key").alias(base)), base, "left_semi")
    counted = _kth_free(ranked, taken, base)
    return counted.withColumn(
        "cite_key", F.when(F.col("_slot") == 1, F.col(base)).otherwise(F.concat(base, F.col("_slot").cast("string")))
    ).drop("_slot", "_n")


def _kth_free(ranked: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """The `_n`-th number per key that is not in `taken` (key, _u), as `_slot`.

    With the taken numbers in order u1 < u2 < …, the k-th free one is k plus the
    count of those with u_j - j < k: one running count over both kinds of rows.
    """
    used = numbered(taken.distinct(), [key], "_u", "_j").select(
        key, (F.col("_u") - F.col("_j")).alias("_t"), F.lit(1).alias("_used")
    )
    marks = used.select(key, (F.col("_t") * 2 + 1).alias("_at"), "_used", F.lit(None).cast("bigint").alias("_row"))
    # Only keys with taken numbers take part; everywhere else the slot is the row number.
    clashing = ranked.join(taken.select(key).distinct(), key, "left_semi")
    wanted = clashing.select(key, (F.col("_n") * 2).alias("_at"), F.lit(0).alias("_used"), F.col("_n").alias("_row"))
    merged = running_total(marks.unionByName(wanted), [key], "_at", F.col("_used").cast("bigint"), "_skip").filter("_row is not null")
    slots = merged.select(key, F.col("_row").alias("_n"), (F.col("_row") + F.col("_skip")).alias("_moved"))
    return ranked.join(slots, [key, "_n"], "left").withColumn("_slot", F.coalesce("_moved", "_n")).drop("_moved")


def unique_names(wanted: DataFrame, existing: DataFrame, base: str = "base", order: str = "ord", name: str = "name") -> DataFrame:
    """Add `target`: `name`, `name (2)`, … skipping names that exist."""
    wanted = cut(wanted)
    numbered_name = r"^(.*) \((\d{1,9})\)$"
    taken = existing.select(F.col(name).alias(base), F.lit(1).cast("bigint").alias("_u")).unionByName(
        existing.filter(F.col(name).rlike(numbered_name)).select(
            F.regexp_extract(name, numbered_name, 1).alias(base), F.regexp_extract(name, numbered_name, 2).try_cast("bigint").alias("_u")
        ).filter("_u >= 2")
    ).join(wanted.select(base).distinct(), base, "left_semi")
    slots = _kth_free(numbered(wanted, [base], order, "_n"), taken, base)
    return slots.withColumn(
        "target", F.when(F.col("_slot") == 1, F.col(base)).otherwise(F.concat(base, F.lit(" ("), F.col("_slot").cast("string"), F.lit(")")))
    ).drop("_n", "_slot")


def cache_eviction(
    files: DataFrame, now: Column, max_age_days: int = 30, max_bytes: int = 512 * 1024 * 1024,
    key: str = "key", mtime: str = "mtime", size: str = "size",
) -> DataFrame:
    """Flag cache files: too old, then the oldest beyond the byte limit, else kept.

    Of equal times the smaller key goes first. `key` is an integer.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(mtime)
    old = age > max(1, max_age_days) * 86400
    fresh = files.filter(~old).withColumns({
        "_hour": F.date_trunc("hour", mtime), "_newer": -F.col(key), "_range": F.floor(F.col(key) / 65536),
    })
    flagged = within_limit(fresh, size, ["_hour", mtime, "_range"], max_bytes, "_newer").drop("_hour", "_newer", "_range")
    return flagged.select(*files.columns, F.when(F.col("kept"), "kept").otherwise("over limit").alias("verdict")).unionByName(
        files.filter(old).withColumn("verdict", F.lit("too old"))
    )


def eviction_totals(flagged: DataFrame, size: str = "size") -> DataFrame:
    gone = F.col("verdict") != "kept"
    return flagged.agg(
        F.count_if(gone).alias("removed_files"),
        F.coalesce(F.sum(F.when(gone, F.col(size))), F.lit(0)).alias("removed_bytes"),
        F.coalesce(F.sum(F.when(~gone, F.col(size))), F.lit(0)).alias("remaining_bytes"),
    )


def last_messages(messages: DataFrame, n: int, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The last `n` messages of every session."""
    return top_per_key(messages, [session], n, F.desc(order), rank="_r").drop("_r")


def search_score(haystacks: Sequence[Column], query: Column) -> Column:
    """In how many fields the query occurs, ignoring case."""
    return sum((F.when(F.lower(text_or_empty(h)).contains(query), 1).otherwise(0) for h in haystacks), F.lit(0))


def search(df: DataFrame, query: str, haystacks: Sequence[Column], title: str = "title", order: str = "ord") -> DataFrame:
    """Entries that contain the query, best score first, then by title; a blank query keeps all."""
    q = query.strip().lower()
    if not q:
        return df.withColumn("score", F.lit(0))
    return df.withColumn("score", search_score(haystacks, F.lit(q))).filter("score > 0").orderBy(
        F.desc("score"), F.lower(title), order
    )


def main_files(files: DataFrame, bundle: str, rel: str = "rel", size: str = "size", has_class: str = "has_class") -> DataFrame:
    """Main document of each bundle: with a document class if any has one, then shallowest, then largest."""
    return first_per_key(
        files, [bundle], F.desc(has_class), paths.depth(F.col(rel)).asc(), F.desc(size), F.asc(rel)
    )


def largest_latest(files: DataFrame, bundle: str, size: str = "size", mtime: str = "mtime", rel: str = "rel") -> DataFrame:
    """Raw parser output to use: the largest, the latest of equals."""
    return first_per_key(files, [bundle], F.desc(size), F.desc(mtime), F.asc(rel))


def precedence_pick(df: DataFrame, name: str, precedence: str) -> DataFrame:
    """One row per lower-cased name: the lowest precedence number wins."""
    keyed = df.withColumn("_name", F.lower(name))
    return first_per_key(keyed, ["_name"], F.asc(precedence), F.asc(name)).drop("_name")


def supplement_names(supplements: DataFrame, entry: str = "entry_id", order: str = "pos") -> DataFrame:
    """First "Supporting Information", then "Supplement n"."""
    ranked = numbered(supplements, [entry], order, "_n")
    label = F.when(F.col("_n") == 1, "Supporting Information").otherwise(F.concat(F.lit("Supplement "), F.col("_n").cast("string")))
    return ranked.withColumn("supplement_label", label).drop("_n")


def next_note(notes: DataFrame, folder: str = "folder", number: str = "number") -> DataFrame:
    """Smallest free note number per folder; numbers are de-duplicated before they are ranked."""
    used = notes.filter(F.col(number) >= 1).select(folder, F.col(number).cast("bigint").alias("_u")).distinct()
    ranked = numbered(used, [folder], "_u", "_r")
    gap = F.min(F.when(F.col("_u") != F.col("_r"), F.col("_r")))
    return ranked.groupBy(folder).agg(F.coalesce(gap, F.max("_r") + 1).alias("number")).withColumn(
        "note", F.concat(F.lit("note"), F.when(F.col("number") < 10, F.lit("0")).otherwise(""), F.col("number").cast("string"), F.lit(".md"))
    )
