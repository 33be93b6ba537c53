"""Joins, ordered work, segmentation and undo against brute force or by hand."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folioframe.operators import linkage, rank, scale, segment
from folioframe.sources import registries


def test_similar_titles_misses_no_match(spark):
    rng = random.Random(7)
    words = ["spectral", "methods", "for", "quantum", "ion", "traps", "a", "of", "night", "city", "史", "研究"]
    titles = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(60)}
    for t in list(titles):
        edited = list(t)
        edited[rng.randrange(len(edited))] = rng.choice("abcxyz")
        titles.add("".join(edited).strip())
    titles = sorted(t for t in titles if t)
    df = spark.createDataFrame([(t,) for t in titles], "key string")
    for threshold in (0.92, 0.85):
        want = {(a, b) for a in titles for b in titles if SequenceMatcher(None, a, b).ratio() >= threshold}
        got = {(r.left_key, r.right_key) for r in linkage.similar_titles(df, df, threshold).collect()}
        assert got == want


def test_contained_titles(spark):
    titles = ["城市", "城市空间演变", "空间演变研究", "空间", "演变的城市空间", "abc", "zabcz"]
    df = spark.createDataFrame([(t,) for t in titles], "key string")
    got = {(r.left_key, r.right_key) for r in linkage.contained_titles(df, df).collect()}
    assert got == {(a, b) for a in titles for b in titles if a in b or b in a}


def test_duplicates_prefer_doi_then_best_then_earliest(spark):
    old = spark.createDataFrame([(1, 1, "10.1/a", "Alpha methods in optics"), (2, 2, None, "Beta fields of view"), (3, 3, None, "Beta fields of view!")],
                                "entry_id long, ord long, doi string, title string")
    new = spark.createDataFrame([(10, 10, "doi:10.1/A", "Beta fields of view"), (11, 11, None, "beta field of view"), (12, 12, None, "Unrelated")],
                                "entry_id long, ord long, doi string, title string")
    got = {r.entry_id: (r.match_id, r.reason) for r in linkage.find_duplicates(new, old).collect()}
    assert got == {10: (1, "doi"), 11: (2, "title")}


def test_running_total_over_ranges(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") > 9, F.xxhash64("id")).alias("o"), "id", (F.col("id") % 7).alias("v"))
    order = lambda r: (r.o is not None, r.o or 0, r.id)
    rows, want = df.collect(), {}
    for key in (None, 1, 2):
        total = 0
        for r in sorted((r for r in rows if r.k == key), key=order):
            want[r.id] = total = total + r.v
    assert {r.id: r.s for r in scale.running_total(df, ["k"], "o", F.col("v"), "s", ["id"], ranges=16).collect()} == want
    assert scale.running_total(df.limit(0), ["k"], "o", F.col("v"), "s").count() == 0


def test_one_key_with_sparse_orders_is_spread(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), F.xxhash64("id").alias("o"))
    sizes = [r["count"] for r in scale.in_ranges(df, ["k"], ["o"], 32).groupBy("_range").count().collect()]
    assert len(sizes) > 24 and max(sizes) < 2 * 1_000_000 / 32
    top = scale.numbered(df, ["k"], "o", "n", ranges=32).agg(F.min("n"), F.max("n"), F.sum("n"), F.max(F.struct("o", "n"))["n"]).first()
    assert tuple(top) == (1, 1_000_000, 1_000_000 * 1_000_001 // 2, 1_000_000)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(11)
    keys = [None, "a", "a", "a", "a", "b"]
    log = [(rng.choice(keys), rng.randrange(300), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    asked = [(i, rng.choice([*keys, "c"]), rng.randrange(300)) for i in range(400)]
    left = spark.createDataFrame(asked, "i long, k string, at long")
    right = spark.createDataFrame(log, "k string, at long, v long")
    for inclusive in (False, True):
        want = {}
        for i, k, at in asked:
            earlier = [(a, v is not None, v or 0, v) for key, a, v in log if key == k and (a < at or inclusive and a == at)]
            want[i] = max(earlier, key=lambda x: x[:3])[3] if earlier else None
        found = scale.as_of(left, right, ["k"], "at", "v", "last", inclusive, ranges=9)
        assert {r.i: r.last for r in found.collect()} == want and found.columns == ["i", "k", "at", "last"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert scale.as_of(left, right.limit(0), ["k"], "at", "v", "last").filter("last is null").count() == 400


def test_eviction_with_equal_times(spark):
    rows = [(i, f"2024-01-0{1 + i // 40} 00:00:00", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, mtime string, size long").withColumn("mtime", F.to_timestamp("mtime"))
    got = {r.key: r.verdict for r in rank.cache_eviction(df, F.to_timestamp(F.lit("2024-01-05 00:00:00")), 2, 300).collect()}
    fresh = [r for r in rows if r[1] >= "2024-01-03"]
    total, want = 0, {r[0]: "too old" for r in rows if r not in fresh}
    for key, _, size in sorted(fresh, key=lambda r: (r[1], r[0]), reverse=True):
        total += size
        want[key] = "kept" if total <= 300 else "over limit"
    assert got == want


def test_unique_names_and_cite_keys(spark):
    wanted = spark.createDataFrame([(i, "A" if i < 5 else "B") for i in range(7)], "ord long, base string")
    existing = spark.createDataFrame([("A",), ("A (3)",), ("A (4)",), ("C",)], "name string")
    got = [r.target for r in rank.unique_names(wanted, existing).orderBy("ord").collect()]
    assert got == ["A (2)", "A (5)", "A (6)", "A (7)", "A (8)", "B", "B (2)"]
    bases = spark.createDataFrame([(0, "x1"), (1, "x12"), (2, "x1"), (3, "x1")], "ord long, base string")
    assert [r.cite_key for r in rank.cite_keys(bases).orderBy("ord").collect()] == ["x1", "x12", "x13", "x14"]


MARKDOWN = """# Title

Let $a_1$ and \\$5 with `code` and ![i](p.png), see [@doe] and \\cite{x}.

$$
E = mc^2
$$

- item at [site](https://e.org/x) 10.1234/abc
| a | b |
```py
x = $y$
```

## References
[1] Some reference $z$
"""


def test_protection_round_trip_and_kinds(spark):
    df = segment.protect(spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")).cache()
    kinds = [r.kind for r in segment.span_table(df).orderBy("token").collect()]
    assert kinds == ["code-fence", "bibliography", "display-math", "inline-math", "inline-code", "image", "citation", "citation", "doi",
                     "equation-gap", "equation-gap", "url", "table-pipe", "table-pipe", "table-pipe", "markdown-prefix", "markdown-prefix"]
    assert segment.render(segment.segments(df), df).first().text == MARKDOWN
    assert "$" not in df.first().protected.replace("\\$5", "")


def test_segments_respect_the_limit_and_sentences(spark):
    sentence = "Dr. Roe et al. measured 3.5 units in Fig. 2 of the set. "
    df = spark.createDataFrame([(1, sentence * 20)], "doc_id long, text string")
    rows = segment.segments(segment.protect(df), max_chars=200).orderBy("seg_idx").collect()
    assert "".join(r.text for r in rows) == sentence * 20
    assert all(len(r.text) <= 200 and r.text.rstrip().endswith("set.") for r in rows)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "One. Two three. " * 30), (2, "x" * 500), (3, "  "), (4, "short")], "doc_id long, text string")
    rows = segment.chunk_text(df, max_chars=100).collect()
    assert max(len(r.chunk) for r in rows) <= 100 and {r.doc_id for r in rows} == {1, 2, 4}
    assert "".join(r.chunk for r in sorted(rows, key=lambda r: r.idx) if r.doc_id == 2) == "x" * 500


def test_lost_tokens_fall_back_to_pieces(spark):
    df = spark.createDataFrame([("h", 0, "[[KEEP_000000]]alpha [[KEEP_000001]] beta", True)], "doc_hash string, seg_idx int, text string, translatable boolean")
    out = segment.apply_segments(df, lambda s: s.upper().replace("[[KEEP_000001]]", "")).first().result
    assert out == "[[KEEP_000000]]ALPHA [[KEEP_000001]] BETA"


def test_lookup_failure_serves_stale(spark):
    requests = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    cache = spark.createDataFrame([("u1", "2024-01-01", "old1"), ("u2", "2023-01-01", "old2")], "url string, mtime string, payload string").select(
        F.sha2("url", 256).alias("key"), F.to_timestamp("mtime").alias("mtime"), "payload")
    status = registries.cache_status(requests, cache, F.to_timestamp(F.lit("2024-01-05")))

    def lookup(url):
        raise OSError(url)

    got = {r.url: (r.payload, r.served) for r in registries.fetch_missing(status, lookup).collect()}
    assert got == {"u1": ("old1", "fresh"), "u2": ("old2", "stale"), "u3": (None, "failed")}


def test_openalex_abstract_and_crossref_year(spark):
    item = '{"title":"T.","abstract_inverted_index":{"hello":[0,2],"world":[1]},"biblio":{"first_page":"5"}}'
    row = registries.openalex_entries(spark.createDataFrame([(item,)], "payload string")).first()
    assert (row.title, row.abstract, row.pages) == ("T", "hello world hello", "5")
    msg = '{"title":["X"],"issued":{"date-parts":[[2019]]},"published-print":{"date-parts":[[2020,1]]},"DOI":"10.1/X"}'
    row = registries.crossref_entries(spark.createDataFrame([(msg,)], "payload string")).first()
    assert (row.year, row.doi) == (2020, "10.1/x")
