"""Record linkage: duplicates, registry matches, candidate scoring.

The title join is exact: it finds every pair whose sequence-matcher ratio
reaches the threshold, without comparing all pairs. See `similar_titles`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.people import family_of
from folioframe.functions.similarity import TitleBlock, matching_pairs, sequence_ratio
from folioframe.functions.text import content_words, has_cjk, null_if_blank, squashed_title, title_key
from folioframe.operators.scale import first_per_key, in_ranges, top_per_key
from folioframe.session import cut

# Thresholds and weights.
DUPLICATE_RATIO, MATCH_RATIO = 0.92, 0.85
JACCARD_FLOOR, JACCARD_WITH_AUTHORS, JACCARD_ALONE = 0.5, 0.6, 0.9
FREQUENCY_SLOTS = 1 << 16
TOP_CANDIDATES = 18


# Titles in a block of the similarity join: at most, at least, and so many blocks otherwise.
LARGEST_BLOCK, SMALLEST_BLOCK, BLOCKS = 1 << 14, 1 << 10, 64
# Tasks of the similarity join.
MOST_TASKS = 4096


def _block_pairs(titles: DataFrame, threshold: float) -> DataFrame:
    """Titles once more for each pair of blocks that they are compared in: job, own block (0 or 1), and the titles' columns.

    Blocks are ranges of lengths. Only their numbers and bounds go through the driver, a few hundred at most for
    each million titles.
    """
    spark, count = titles.sparkSession, titles.count()
    size = min(LARGEST_BLOCK, max(SMALLEST_BLOCK, count // BLOCKS))
    placed = in_ranges(titles, [], ["len", "key"], max(1, math.ceil(count / size)))
    bounds = sorted(tuple(r) for r in placed.groupBy("_range").agg(F.min("len"), F.max("len")).collect())
    pairs = [(p, q) for k, (p, _, longest) in enumerate(bounds) for q, shortest, _ in bounds[k:] if shortest * threshold <= longest * (2 - threshold) + 1e-6]
    jobs = [(job, own, block) for job, pair in enumerate(pairs) for own, block in enumerate(pair) if not (own and pair[0] == pair[1])]
    if not jobs:
        return placed.select(F.lit(0).alias("job"), F.lit(0).alias("own"), *titles.columns)
    plan = spark.createDataFrame(jobs, "job int, own int, _range long")
    return placed.join(F.broadcast(plan), "_range").select("job", "own", *titles.columns).repartition(min(len(pairs), MOST_TASKS), "job")


def _compared(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Two blocks (or one with itself) to pairs of a left and a right title; titles of one side only meet those of the other."""
    def sides(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = (TitleBlock(part["key"][part[side]].tolist()) for part, side in ((one, "is_left"), (other, "is_right")))
        found = [(a.titles[i], b.titles[j]) for i, j in matching_pairs(a, b, threshold)]
        return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["left_key", "right_key"], dtype=object)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [part for _, part in rows.groupby("own")]
        if not (rows["is_left"] & rows["is_right"]).all():
            return pd.concat([sides(parts[0], parts[-1]), *([sides(parts[1], parts[0])] if len(parts) > 1 else [])])
        blocks = [TitleBlock(part["key"].tolist()) for part in parts]
        a, b = blocks[0], blocks[-1]
        found = matching_pairs(a, b, threshold)
        x, y = (np.array(block.titles, dtype=object)[np.array([p[side] for p in found], dtype=np.int64)] for side, block in enumerate((a, b)))
        return pd.DataFrame({"left_key": np.concatenate([x, y]), "right_key": np.concatenate([y, x])})

    return compare


def title_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (left_key, right_key) that may reach the threshold; no match is missed.

    `left` and `right` have one column `key` of normalised titles, each value
    once. A ratio of t leaves at most (1 - t) of both titles' characters
    unmatched. Titles are cut into blocks by length, and each pair of blocks whose
    lengths allow a match is compared in one task: lengths, then counted characters,
    then the longest common subsequence, all on arrays. Only pairs that pass
    leave the task, so what is written grows with titles and blocks and not with pairs.
    """
    if not 2 / 3 < threshold < 1:
        raise ValueError("the threshold must lie between two thirds and one")
    flags = [F.lit(x).alias(f"is_{side}") for x, side in ((True, "left"), (left is right, "right"))]
    titles = left.select("key", *flags)
    if left is not right:
        titles = titles.unionByName(right.select("key", F.lit(False).alias("is_left"), F.lit(True).alias("is_right")))
        titles = titles.groupBy("key").agg(F.bool_or("is_left").alias("is_left"), F.bool_or("is_right").alias("is_right"))
    titles = cut(titles.withColumn("len", F.length("key")).filter("len > 0"))
    near = _block_pairs(titles, threshold).groupBy("job").applyInPandas(_compared(threshold), "left_key string, right_key string")
    same = titles.filter("is_left and is_right").select(F.col("key").alias("left_key"), F.col("key").alias("right_key"))
    return cut(near).union(same)


def similar_titles(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All (left_key, right_key, ratio) with ratio >= threshold: candidates, then the sequence matcher."""
    pairs = title_candidates(left, right, threshold)
    return pairs.withColumn("ratio", sequence_ratio("left_key", "right_key")).filter(F.col("ratio") >= threshold)


def find_duplicates(
    candidates: DataFrame, existing: DataFrame, threshold: float = DUPLICATE_RATIO, earlier_only: bool = False
) -> DataFrame:
    """Best existing entry per candidate: same DOI first, else the most similar title.

    Both sides have entry_id, ord, doi, title. With `earlier_only` a candidate
    matches only entries of a lower ord (a batch against itself). Adds match_id,
    reason (`doi` / `title`) and score; rows without a match are left out.

    Copies cost nothing: per DOI and per title key only the first entry takes
    part, so a group of any size is joined as one row, never pair by pair.
    """
    known = cut(existing.select(
        F.col("entry_id").alias("match_id"), F.col("ord").alias("_mord"),
        identifiers.normalize_doi(F.col("doi")).alias("_mdoi"), title_key(F.col("title")).alias("_mkey"),
    ))
    new = cut(candidates.select(
        "entry_id", F.col("ord").alias("_ord"), identifiers.normalize_doi(F.col("doi")).alias("_doi"),
        title_key(F.col("title")).alias("_key"),
    ))

    def allowed(df: DataFrame) -> DataFrame:
        return df.filter(F.col("_mord") < F.col("_ord")) if earlier_only else df

    first = F.min(F.struct("_mord", "match_id"))
    by_doi = known.filter("_mdoi is not null").groupBy("_mdoi").agg(first.alias("_m")).select(
        "_mdoi", "_m._mord", "_m.match_id"
    )
    doi_hits = allowed(new.join(by_doi, F.col("_doi") == F.col("_mdoi"))).select(
        "entry_id", "match_id", F.lit("doi").alias("reason"), F.lit(1.0).alias("score")
    )
    rest = new.join(doi_hits, "entry_id", "left_anti").filter("_key <> ''")
    titles = known.filter("_mkey <> ''").groupBy("_mkey").agg(first.alias("_m")).select("_mkey", "_m._mord", "_m.match_id")
    # Equal titles have the best possible ratio: settled without the similarity join.
    equal = allowed(rest.join(titles, F.col("_key") == F.col("_mkey"))).select(
        "entry_id", "match_id", F.lit("title").alias("reason"), F.lit(1.0).alias("score")
    )
    open_rows = cut(rest.join(equal, "entry_id", "left_anti"))
    keys = open_rows.select(F.col("_key").alias("key")).distinct()
    near = similar_titles(keys, titles.select(F.col("_mkey").alias("key")), threshold)
    scored = near.join(titles, F.col("right_key") == F.col("_mkey")).select("left_key", "ratio", "_mord", "match_id")
    if earlier_only:
        # Per title key the rows ask for "earlier than me"; the join stays on the key.
        hits = allowed(open_rows.join(scored, F.col("_key") == F.col("left_key")))
    else:
        best = scored.groupBy("left_key").agg(F.max(F.struct(F.col("ratio"), (-F.col("_mord")).alias("o"), F.col("match_id"))).alias("_b"))
        hits = open_rows.join(best, F.col("_key") == F.col("left_key")).select(
            "entry_id", F.col("_b.ratio").alias("ratio"), (-F.col("_b.o")).alias("_mord"), F.col("_b.match_id").alias("match_id")
        )
    fuzzy = hits.groupBy("entry_id").agg(
        F.max(F.struct(F.col("ratio"), (-F.col("_mord")).alias("o"), F.col("match_id"))).alias("_b")
    ).select("entry_id", F.col("_b.match_id").alias("match_id"), F.lit("title").alias("reason"), F.col("_b.ratio").alias("score"))
    return doi_hits.unionByName(equal).unionByName(fuzzy)


def contained_titles(left: DataFrame, right: DataFrame, q: int = 4) -> DataFrame:
    """(left_key, right_key) where one squashed title contains the other.

    The shorter title's rarest q-gram must occur in the longer one: each title
    is posted once under that gram and the other side brings all its grams.
    Titles shorter than q are posted whole under their length.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.select("key").withColumn("_len", F.length("key"))

    def pieces(c: Column, n: Column) -> Column:
        at = F.greatest(F.length(c) - n + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), at), lambda i: F.substring(c, i, n)))

    a, b = side(left), side(right)
    slot = F.pmod(F.xxhash64("_g"), F.lit(FREQUENCY_SLOTS)).cast("int")
    every = F.explode(pieces(F.col("key"), F.lit(q))).alias("_g")
    frequency = a.unionByName(b).select(every).groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_freq"))

    def rarest(df: DataFrame) -> DataFrame:
        long = df.filter(F.col("_len") >= q).select("key", "_len", every).withColumn("_slot", slot)
        long = long.join(F.broadcast(frequency), "_slot").groupBy("key", "_len").agg(F.min(F.struct("_freq", "_g")).alias("_r"))
        return long.select("key", "_len", F.col("_r._g").alias("_g")).unionByName(
            df.filter(F.col("_len") < q).withColumn("_g", F.col("key"))
        )

    def all_grams(df: DataFrame) -> DataFrame:
        sizes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(q)), lambda n: pieces(F.col("key"), n)))
        return df.select("key", "_len", F.explode(F.array_distinct(sizes)).alias("_g"))

    def within(shorter: DataFrame, longer: DataFrame) -> DataFrame:
        s = rarest(shorter).select(F.col("key").alias("_s"), F.col("_len").alias("_ls"), "_g")
        g = all_grams(longer).select(F.col("key").alias("_l"), F.col("_len").alias("_ll"), "_g")
        return s.join(g, "_g").filter((F.col("_ls") <= F.col("_ll")) & F.col("_l").contains(F.col("_s")))

    forward = within(a, b).select(F.col("_s").alias("left_key"), F.col("_l").alias("right_key"))
    backward = within(b, a).select(F.col("_l").alias("left_key"), F.col("_s").alias("right_key"))
    return forward.unionByName(backward).distinct()


def registry_match(queries: DataFrame, registry: DataFrame, threshold: float = MATCH_RATIO) -> DataFrame:
    """Best registry title per query: ratio of 0.85 or one title inside the other; Chinese titles only.

    `queries` has query_id and title, `registry` record_id, ord, title and, for
    several search tiers, an integer `tier`: a lower tier wins whatever the ratio,
    then the highest ratio, then the first record.
    """
    if "tier" not in registry.columns:
        registry = registry.withColumn("tier", F.lit(0))
    q = cut(queries.select("query_id", squashed_title(F.col("title")).alias("_k")).filter("_k <> ''"))
    r = registry.filter(has_cjk(F.col("title"))).select("tier", "record_id", "ord", squashed_title(F.col("title")).alias("_k")).filter("_k <> ''")
    firsts = cut(r.groupBy("_k").agg(F.min(F.struct("tier", "ord", "record_id")).alias("_r")))
    left, right = q.select(F.col("_k").alias("key")).distinct(), firsts.select(F.col("_k").alias("key"))
    pairs = title_candidates(left, right, threshold).withColumn("_inside", F.lit(False)).unionByName(
        contained_titles(left, right).withColumn("_inside", F.lit(True))
    ).groupBy("left_key", "right_key").agg(F.bool_or("_inside").alias("_inside"))
    scored = pairs.withColumn("ratio", sequence_ratio("left_key", "right_key")).filter((F.col("ratio") >= threshold) | F.col("_inside"))
    order = F.struct((-F.col("_r.tier")).alias("t"), F.col("ratio"), (-F.col("_r.ord")).alias("o"), F.col("_r.record_id").alias("record_id"))
    best = scored.join(firsts, F.col("right_key") == F.col("_k")).groupBy("left_key").agg(F.max(order).alias("_b"))
    return q.join(best, F.col("_k") == F.col("left_key")).select(
        "query_id", "_b.record_id", F.col("_b.ratio").alias("score"), (-F.col("_b.t")).alias("tier")
    )


def tiered_match(queries: DataFrame, tiers: list[tuple[str, DataFrame]], threshold: float = MATCH_RATIO) -> DataFrame:
    """Search several registries in order of preference with one similarity join."""
    stacked = [t.select("record_id", "ord", "title").withColumn("tier", F.lit(i)) for i, (_, t) in enumerate(tiers)]
    registry = stacked[0]
    for more in stacked[1:]:
        registry = registry.unionByName(more)
    names = F.array(*[F.lit(n) for n, _ in tiers])
    return registry_match(queries, registry, threshold).withColumn("tier", F.get(names, F.col("tier")))


def _word_prefix(df: DataFrame, key: str, frequency: DataFrame, floor: float) -> DataFrame:
    """The rarest words of a title that a Jaccard match of `floor` must share one of."""
    slot = F.pmod(F.xxhash64("_w"), F.lit(FREQUENCY_SLOTS)).cast("int")
    words = df.select(key, F.size("_words").alias("_n"), F.explode("_words").alias("_w")).withColumn("_slot", slot)
    listed = words.join(F.broadcast(frequency), "_slot").groupBy(key, "_n").agg(
        F.sort_array(F.collect_list(F.struct("_freq", "_w"))).alias("_t")
    )
    keep = F.col("_n") - F.ceil(F.col("_n") * floor - 1e-9) + 1
    return listed.select(key, F.explode(F.slice(F.col("_t"), F.lit(1), keep.cast("int"))).alias("_p")).select(
        key, F.col("_p._w").alias("_w")
    )


def jaccard_matches(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Token-set title matches that count as the same work.

    `queries`: query_id, title, authors (array). `registry`: record_id, ord, title,
    authors. Shared content words over all: at least 0.6 with a shared family name
    when the query gives authors (none of whom may have a Latin name: then nothing
    matches), else at least 0.9. The first accepted record wins.
    Distinct word sets are joined once; prefix words keep common words out of the join.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_words", F.sort_array(content_words(F.col("title")))).filter(F.size("_words") > 0).withColumn(
            "_set", F.array_join("_words", " ")
        )

    q, r = keyed(queries), keyed(registry)
    q_sets, r_sets = q.select("_set", "_words").distinct(), r.select("_set", "_words").distinct()
    slot = F.pmod(F.xxhash64("_w"), F.lit(FREQUENCY_SLOTS)).cast("int")
    frequency = q_sets.unionByName(r_sets).select(F.explode("_words").alias("_w")).groupBy(slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("_freq")
    )
    floor = JACCARD_WITH_AUTHORS
    pairs = _word_prefix(q_sets, "_set", frequency, floor).withColumnRenamed("_set", "_q").join(
        _word_prefix(r_sets, "_set", frequency, floor).withColumnRenamed("_set", "_r"), "_w"
    ).select("_q", "_r").distinct()
    a, b = F.split("_q", " "), F.split("_r", " ")
    shared = F.size(F.array_intersect(a, b))
    scored = pairs.withColumn("score", shared / (F.size(a) + F.size(b) - shared)).filter(F.col("score") >= floor)

    def families(c: str) -> Column:
        return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), family_of), lambda f: f != ""))

    # Records of one word set (and family name) beyond the first can never win: they are reduced before the join.
    record = F.struct("ord", "record_id")
    first = r.groupBy(F.col("_set").alias("_r")).agg(F.min(record).alias("_first"))
    named = r.withColumn("_family", F.explode(families("authors"))).groupBy(F.col("_set").alias("_r"), "_family").agg(F.min(record).alias("_first"))
    given = F.size(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a) != "")) > 0
    asked = q.select("query_id", F.col("_set").alias("_q"), given.alias("_given"), families("authors").alias("_fq"))
    by_name = asked.filter("_given").withColumn("_family", F.explode("_fq")).join(scored, "_q").join(named, ["_r", "_family"])
    by_title = asked.filter("not _given").join(scored.filter(F.col("score") >= JACCARD_ALONE), "_q").join(first, "_r")
    hits = by_name.select("query_id", "_first", "score").union(by_title.select("query_id", "_first", "score"))
    best = hits.groupBy("query_id").agg(F.min(F.struct("_first.ord", "_first.record_id", "score")).alias("_b"))
    return best.select("query_id", "_b.record_id", "_b.score")


def search_terms(title: Column, n: int = 4) -> Column:
    """The longest content words of a title, for a keyword query."""
    by_length = F.sort_array(F.transform(content_words(title), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(by_length, lambda x: x["w"]), 1, n)


def score_candidates(pairs: DataFrame, ratio: str = "ratio", bonus: str | None = None) -> DataFrame:
    """Score a (local, candidate) pair table; adds `score` and `reasons`.

    Columns l_* and c_* hold doi, arxiv_id, isbn, year, item_type and families
    (array of folded names); `ratio` is the title similarity.
    """
    def same(name: str, fold) -> Column:
        left, right = fold(F.col(f"l_{name}")), fold(F.col(f"c_{name}"))
        return F.coalesce(left == right, F.lit(False))

    title = F.coalesce(F.col(ratio), F.lit(0.0))
    overlap = F.size(F.array_intersect(F.array_distinct("l_families"), F.array_distinct("c_families")))
    evidence = [
        ("doi", same("doi", identifiers.normalize_doi), F.lit(0.35)),
        ("arxiv", same("arxiv_id", lambda c: F.lower(null_if_blank(c))), F.lit(0.35)),
        ("isbn", same("isbn", identifiers.normalize_isbn), F.lit(0.35)),
        ("year", same("year", lambda c: F.left(c.cast("string"), F.lit(4))), F.lit(0.06)),
        ("authors", overlap > 0, F.least(F.lit(0.12), overlap * 0.05)),
        ("type", F.coalesce((F.col("l_item_type") == "book") & (F.col("c_item_type") == "book"), F.lit(False)), F.lit(0.05)),
    ]
    total = sum((F.when(test, weight).otherwise(0.0) for _, test, weight in evidence), title * 0.58)
    score = F.least(F.lit(1.0), total)
    if bonus:
        score = F.least(F.lit(1.0), score + F.col(bonus))
    reasons = F.array_compact(F.array(
        F.when(title >= 0.82, F.lit("title")), *[F.when(test, F.lit(name)) for name, test, _ in evidence]
    ))
    return pairs.withColumn("score", score).withColumn("reasons", reasons)


def candidate_pairs(entries: DataFrame, threshold: float = MATCH_RATIO) -> DataFrame:
    """(l_id, c_id, ratio) of entries worth scoring against each other.

    `entries` has entry_id, ord, title, doi, arxiv_id and isbn. A candidate is the
    first entry (by ord) of a title that is similar to the entry's, or the first
    with its DOI, arXiv id or ISBN. Copies never meet pair by pair. `ratio` is that
    of the title keys, 0 where one is empty.
    """
    known = cut(entries.select(
        "entry_id", "ord", title_key(F.col("title")).alias("_key"), identifiers.normalize_doi(F.col("doi")).alias("_doi"),
        F.lower(null_if_blank(F.col("arxiv_id"))).alias("_arxiv"), identifiers.normalize_isbn(F.col("isbn")).alias("_isbn"),
    ))

    def first(key: str) -> DataFrame:
        return known.filter(F.col(key) != "").groupBy(key).agg(F.min(F.struct("ord", "entry_id", "_key")).alias("_c"))

    keys = known.filter("_key <> ''").select(F.col("_key").alias("key")).distinct()
    near = title_candidates(keys, keys, threshold)
    by_title = near.join(first("_key").select(F.col("_key").alias("right_key"), "_c"), "right_key")
    by_title = known.join(by_title, F.col("_key") == F.col("left_key")).select("entry_id", "_key", "_c", F.lit(True).alias("_by_title"))
    found = by_title
    for name in ("_doi", "_arxiv", "_isbn"):
        found = found.union(known.join(first(name), name).select("entry_id", known["_key"], "_c", F.lit(False)))
    pairs = found.filter(F.col("entry_id") != F.col("_c.entry_id")).groupBy(
        F.col("entry_id").alias("l_id"), F.col("_c.entry_id").alias("c_id"), F.col("_key").alias("_lk"), F.col("_c._key").alias("_ck")
    ).agg(F.bool_and("_by_title").alias("_by_title"))
    # Each pair of title keys is compared once, however many entries share them.
    ratios = pairs.select("_lk", "_ck").distinct().filter("_lk <> '' and _ck <> ''").withColumn("ratio", sequence_ratio("_lk", "_ck"))
    scored = pairs.join(ratios, ["_lk", "_ck"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return scored.filter((F.col("ratio") >= threshold) | ~F.col("_by_title")).select("l_id", "c_id", "ratio")


def candidate_key(doi: Column, isbn: Column, title: Column) -> Column:
    """Identity of a candidate: DOI, else ISBN, else the folded title."""
    return F.coalesce(
        F.concat(F.lit("doi:"), identifiers.normalize_doi(doi)),
        F.concat(F.lit("isbn:"), identifiers.normalize_isbn(isbn)),
        F.concat(F.lit("title:"), F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\x{80}-\x{10FFFF}]+", "")),
    )


def dedupe_candidates(candidates: DataFrame, top: int = TOP_CANDIDATES) -> DataFrame:
    """Per query and identity the best score; sources joined; the best `top` of each query.

    `candidates`: query_id, seq, source, doi, isbn, title, score. Sources are few
    by nature; they are gathered as a set, so repeats do not grow the group.
    """
    keyed = candidates.withColumn("_key", candidate_key(F.col("doi"), F.col("isbn"), F.col("title")))
    best = first_per_key(keyed, ["query_id", "_key"], F.desc("score"), F.asc("seq"))
    sources = keyed.groupBy("query_id", "_key").agg(F.sort_array(F.collect_set("source")).alias("_sources"))
    joined = best.join(sources, ["query_id", "_key"]).withColumn("source", F.array_join(
        F.concat(F.array("source"), F.filter("_sources", lambda s: s != F.col("source"))), " + "
    ))
    return top_per_key(joined, ["query_id"], top, F.desc("score"), F.lower("title"), F.asc("seq")).drop("_key", "_sources")


def near_part_groups(bases: DataFrame, threshold: float = MATCH_RATIO) -> DataFrame:
    """Base titles of multi-part works that belong together: equal or 0.85 similar.

    `bases` has base and ord; every base gets the earliest base it matches.
    """
    keyed = cut(bases.groupBy(title_key(F.col("base")).alias("key")).agg(F.min(F.struct("ord", "base")).alias("_f")))
    keys = keyed.select("key")
    near = similar_titles(keys, keys, threshold)
    home = near.join(keyed.select(F.col("key").alias("right_key"), "_f"), "right_key").groupBy("left_key").agg(F.min("_f").alias("_home"))
    return bases.withColumn("left_key", title_key(F.col("base"))).join(home, "left_key", "left").select(
        "base", "ord", F.coalesce("_home.base", "base").alias("group_base")
    )

