"""Search with a table of queries over gram posting lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import let, text_or_empty
from folioframe.operators.scale import top_per_key
from folioframe.session import cut

GRAM = 3


def grams(c: Column, size: int) -> Column:
    """The distinct substrings of one size."""
    last = F.length(c) - size + 1
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(size))))


def postings(entries: DataFrame, fields: Sequence[str], key: str = "entry_id", sizes: Sequence[int] = (1, 2, GRAM)) -> DataFrame:
    """(gram, key) of every gram in any of the fields, each once; ignores case. Write it to keep it as an index."""
    folded = [F.lower(text_or_empty(F.col(f))) for f in fields]
    found = let(F.array(*folded), lambda texts: F.array_distinct(F.flatten(F.array(*[F.flatten(F.transform(texts, lambda t: grams(t, n))) for n in sizes]))))  # noqa: B023
    return entries.select(F.explode(found).alias("gram"), key)


def search_table(entries: DataFrame, queries: DataFrame, fields: Sequence[str], top: int = 20, key: str = "entry_id", title: str = "title",
                 order: str = "ord", index: DataFrame | None = None) -> DataFrame:
    """The `top` best entries of every query: query_id, key, score, rank.

    `queries` has query_id and query. The score counts the fields that contain
    the query, ignoring case and outer blanks; ties go by title, then `order`, then key. A
    query without a hit gives no row, a null or blank one the first entries with
    score 0.

    Each distinct query takes the rarest of its grams (three characters, or all
    of a shorter query) and visits that posting list only; the fields of the
    entries there decide. `index` is a stored result of `postings` over the same
    fields. Ranks are limited in each task ahead of the shuffle.
    """
    asked = cut(queries.select("query_id", F.lower(F.trim(text_or_empty(F.col("query")))).alias("_q")))
    texts = asked.filter("_q <> ''").select("_q").distinct()
    size = F.least(F.lit(GRAM), F.length("_q"))
    by_size = F.when(size == 1, grams(F.col("_q"), 1)).when(size == 2, grams(F.col("_q"), 2)).otherwise(grams(F.col("_q"), GRAM))
    parts = texts.select("_q", F.explode(by_size).alias("gram"))
    if index is None:
        index = postings(entries, fields, key)
    lists = cut(index.join(parts.select("gram").distinct(), "gram", "left_semi"))
    lengths = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram without a list rules the query out; no list is as short as that.
    rarest = parts.join(lengths, "gram", "left").groupBy("_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g")).filter("_g.n > 0")
    places = rarest.select("_q", F.col("_g.gram").alias("gram")).join(lists, "gram").select("_q", key)
    held = entries.select(F.col(key), F.lower(title).alias("_title"), F.col(order).alias("_ord"), F.array(*[F.lower(text_or_empty(F.col(f))) for f in fields]).alias("_fields"))
    score = F.size(F.filter("_fields", lambda f: f.contains(F.col("_q"))))
    hits = places.join(held, key).withColumn("score", score).filter("score > 0")
    best = top_per_key(hits, ["_q"], top, F.desc("score"), F.asc("_title"), F.asc("_ord"), F.asc(key)).select("_q", key, "score", "rank")
    first = entries.orderBy(order, key).limit(top).select(key, order)
    blank = top_per_key(first.withColumn("_q", F.lit("")), ["_q"], top, F.asc(order), F.asc(key)).select("_q", key, F.lit(0).alias("score"), "rank")
    return asked.join(best.union(blank), "_q").select("query_id", key, "score", "rank")
