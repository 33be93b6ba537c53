"""Moves that depend on each other: companions, order, swaps, and what is in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import paths
from folioframe.operators.scale import first_per_key
from folioframe.session import cut

# Folders and endings of what belongs to a document.
PARSED, NOTES, TRANSLATIONS, SUMMARY = "parsed", "notes", "translations", ".summary.md"
MOVE, AWAY, BACK = "move", "to temporary", "from temporary"
TAKEN, TWICE, BEHIND = "the target exists", "another move has the target", "a move behind the target cannot be made"


def with_sidecars(moves: DataFrame, inventory: DataFrame) -> DataFrame:
    """`moves` (src, dst) and those of what belongs to each document: parser output, summary note, translations.

    `inventory` has rel of all files. Every file names the documents it may belong to by
    folder and stem, so the join is on equality; of several the longest stem
    counts. Files that have a move of their own keep it.
    """
    files = inventory.select("rel").distinct().join(moves.select(F.col("src").alias("rel")), "rel", "left_anti")
    parts = files.withColumn("_p", paths.parts(F.col("rel"))).withColumn("_n", F.size("_p"))
    folder = lambda n: F.array_join(F.slice("_p", F.lit(1), n), "/")
    named = parts.filter("_n >= 2").withColumn("_file", F.element_at("_p", -1)).withColumn("_kind", F.element_at("_p", -2))
    notes = named.filter((F.col("_kind") == NOTES) & F.col("_file").endswith(SUMMARY)).select(
        "rel", folder(F.col("_n") - 2).alias("_home"), F.expr(f"left(_file, length(_file) - {len(SUMMARY)})").alias("_stem"), F.lit(NOTES).alias("_kind"), F.lit(SUMMARY).alias("_tail"))
    pieces = F.split("_file", r"\.")
    upto = F.explode(F.sequence(F.lit(1), F.size(pieces) - 1))
    translated = named.filter((F.col("_kind") == TRANSLATIONS) & F.col("_file").contains(".")).withColumn("_i", upto).select(
        "rel", folder(F.col("_n") - 2).alias("_home"), F.array_join(F.slice(pieces, F.lit(1), F.col("_i")), ".").alias("_stem"), F.lit(TRANSLATIONS).alias("_kind"), "_file"
    ).withColumn("_tail", F.expr("substring(_file, length(_stem) + 1)")).drop("_file")
    at = F.array_position("_p", PARSED).cast("int")
    parsed = parts.withColumn("_i", at).filter("_i > 0 and _i < _n - 1").select(
        "rel", folder(F.col("_i") - 1).alias("_home"), F.element_at("_p", F.col("_i") + 1).alias("_stem"), F.lit(PARSED).alias("_kind"),
        F.concat(F.lit("/"), F.array_join(F.slice("_p", F.col("_i") + 2, F.col("_n")), "/")).alias("_tail"))
    documents = moves.select(paths.parent(F.col("src")).alias("_home"), paths.stem(F.col("src")).alias("_stem"), paths.parent(F.col("dst")).alias("_to"), paths.stem(F.col("dst")).alias("_as"))
    owned = notes.unionByName(translated).unionByName(parsed).join(documents, ["_home", "_stem"])
    own = first_per_key(owned, ["rel"], F.desc(F.length("_stem")), F.asc("_to"), F.asc("_as"))
    beside = own.select(F.col("rel").alias("src"), paths.join(F.col("_to"), F.col("_kind"), F.concat("_as", "_tail")).alias("dst")).filter("src <> dst")
    return moves.select("src", "dst").unionByName(beside)


def in_order(moves: DataFrame, inventory: DataFrame) -> DataFrame:
    """Steps that never overwrite a file: step, src, dst, kind, reason.

    Moves of one step do not touch each other. A move waits for the one that
    takes its target away, so chains run from their end; in a ring the smallest
    source steps aside under a temporary name first and comes back last. A move
    whose target exists and stays, is wanted twice (the smallest source has
    it), or waits for such a move gets a reason and no step. Moves onto themselves are left out.

    Each target is the source of at most one move, so the moves form chains and
    rings; ranks come from pointer doubling: as many joins as the logarithm of
    the longest chain, over the moves that wait for others only.
    """
    wanted = moves.select("src", "dst").filter("src <> dst").distinct()
    one = first_per_key(wanted, ["src"], F.asc("dst"))
    winner = one.groupBy("dst").agg(F.min("src").alias("_winner"))
    sources = one.select(F.col("src").alias("dst"), F.col("src").alias("next"))
    stays = inventory.select(F.col("rel").alias("dst")).distinct().join(sources.select("dst"), "dst", "left_anti").withColumn("_stays", F.lit(True))
    marked = one.join(winner, "dst").join(sources, "dst", "left").join(stays, "dst", "left")
    reason = F.when(F.col("_stays"), TAKEN).when(F.col("src") != F.col("_winner"), TWICE)
    graph = cut(marked.select("src", "dst", "next", reason.alias("reason")))
    # Who waits for nobody is settled; a move with a reason of its own waits for nobody either.
    chain = cut(graph.withColumn("ptr", F.when(F.col("reason").isNull(), F.col("next"))).select("src", "dst", "ptr", "reason", F.col("reason").isNotNull().alias("stuck"), F.col("src").alias("least")))
    left = chain.filter("ptr is not null").count()
    while left:
        chain = _doubled(chain)
        before, left = left, chain.filter("ptr is not null").count()
        if left == before:  # only rings are left
            break
    rings = chain.filter("ptr is not null")
    heads = None
    if left:
        rings, changed = cut(rings), 1
        while changed:
            after = _doubled(rings.withColumn("was", F.col("least")))
            changed = after.filter("least <> was").count()
            rings = after.drop("was")
        heads = cut(rings.filter("src = least").select("src"))
    stuck = chain.filter("stuck").select("src", F.coalesce("reason", F.lit(BEHIND)).alias("_why"))
    free = graph.drop("reason").join(stuck, "src", "left_anti").select("src", "dst", "next", F.lit(MOVE).alias("kind"), F.col("src").alias("id"))
    if heads is not None:
        aside = paths.join(paths.parent(F.col("src")), F.concat(F.lit(".moving-"), F.md5("src")))
        ring = free.join(heads, "src", "left_semi")
        away = ring.select("src", aside.alias("dst"), F.lit(None).cast("string").alias("next"), F.lit(AWAY).alias("kind"), "id")
        back = ring.select(aside.alias("src"), "dst", "next", F.lit(BACK).alias("kind"), F.concat(F.lit("\u0001"), "id").alias("id"))
        free = free.join(heads, "src", "left_anti").unionByName(away).unionByName(back)
    ranked = cut(free.select(F.col("id").alias("src"), F.col("src").alias("from"), "dst", "kind", F.col("next").alias("ptr"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("stuck"), F.col("id").alias("least"),
                             F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    while ranked.filter("ptr is not null").count():
        ranked = _doubled(ranked)
    held = graph.select("src", "dst").join(stuck, "src").select(F.lit(None).cast("long").alias("step"), "src", "dst", F.lit(MOVE).alias("kind"), F.col("_why").alias("reason"))
    return ranked.select(F.col("dist").alias("step"), F.col("from").alias("src"), "dst", "kind", "reason").unionByName(held)


def _doubled(chain: DataFrame) -> DataFrame:
    """One round of pointer doubling over src, ptr, stuck, least (and dist): rows that still point take over what they point at."""
    target = chain.select(F.col("src").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("stuck").alias("_stuck"), F.col("least").alias("_least"), *([F.col("dist").alias("_dist")] if "dist" in chain.columns else []))
    waiting = chain.filter("ptr is not null").join(target, "ptr")
    taken = {"ptr": F.col("_ptr"), "stuck": F.col("stuck") | F.col("_stuck"), "least": F.least("least", "_least")}
    if "dist" in chain.columns:
        taken["dist"] = F.col("dist") + F.col("_dist")
    return cut(waiting.withColumns(taken).select(*chain.columns).unionByName(chain.filter("ptr is null")))
