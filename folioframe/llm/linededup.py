"""Removal of lines that many sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import cut, free_name

# Registers of the sketches as a power of two, and how far from the threshold (in parts of it) an estimate is not trusted.
LOG_REGISTERS = 12
DOUBT = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first) of the lines on at least `min_sites` sites; `lines` has line (a hash), site and place (a struct).

    Sketches of the sites are merged by the aggregation, part by part before the
    shuffle, so a line with a third of all rows arrives as one sketch a task.
    Only lines whose estimate is near the threshold are counted exactly.
    """
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"), F.min("place").alias("first"),
    )
    wide = cut(spread.where(F.col("sites") >= min_sites * (1 - DOUBT)))
    near = wide.where(F.col("sites") < min_sites * (1 + DOUBT)).select("line")
    counted = lines.select("line", "site").join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("site").alias("exact"))
    return wide.join(counted, "line", "left").where(F.coalesce("exact", "sites") >= min_sites).select("line", "first")


def drop_shared_lines(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """`docs` with the text cleaned, plus lines_in and lines_out (long).

    Lines are split at line feeds and compared whole. A line that stands on at
    least `min_sites` different sites is boilerplate: it stays where it stands
    first (smallest key, then place) and goes everywhere else. Blank lines are
    never boilerplate. A null text stays null with no lines; an empty one has one
    blank line. Rows with a null site are cleaned but add no site. Rows that
    repeat key and text are cleaned alike. A null key comes before all others.
    All columns of `docs` stay; columns named lines_in or lines_out are replaced.

    One pass cuts the texts into line hashes, a table of a tenth of their size;
    places to drop come from it and meet the texts in one join on the row.
    """
    row = [F.col(key).alias("id"), F.xxhash64(text).alias("body")]
    exploded = docs.where(F.col(text).isNotNull()).select(*row, F.col(site).cast("string").alias("site"), F.posexplode(_lines(F.col(text))).alias("at", "string"))
    lines = cut(exploded.where(F.trim("string") != "").select("id", "body", "site", "at", F.xxhash64("string").alias("line")))
    shared = cut(shared_lines(lines.select("line", "site", F.struct("id", "body", "at").alias("place")), min_sites))
    hits = lines.join(shared, "line").where(~F.struct("id", "body", "at").eqNullSafe(F.col("first")))
    its_id, its_body, gone = (free_name(n, docs.columns) for n in ("drop id", "drop body", "drop at"))
    drops = hits.groupBy(F.col("id").alias(its_id), F.col("body").alias(its_body)).agg(F.collect_set("at").alias(gone))
    joined = docs.join(drops, F.col(key).eqNullSafe(F.col(its_id)) & (F.xxhash64(text) == F.col(its_body)), "left")
    parts = _lines(F.col(text))
    total = F.when(F.col(text).isNotNull(), F.size(parts)).otherwise(0)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    clean = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "lines_in", "lines_out")]
    return joined.select(
        *others, clean.alias(text), total.cast("long").alias("lines_in"), (total - F.coalesce(F.size(gone), F.lit(0))).cast("long").alias("lines_out"),
    )
