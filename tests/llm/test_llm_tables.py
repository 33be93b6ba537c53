"""Operators on vectors, urls and links, the registered queries and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from folioframe.llm import hosts, langid, topk, vectors
from folioframe.llm.components import connected_components, merged_components
from test_llm_text import brute_groups


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 3)
    turn = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(turn.normal(size=(600, 4)), 1))]  # many ties
    rows += [(700, None), (750, [1.0, None, 0.0, 0.0]), (800, [float("nan")] * 4), (850, [float("inf")] * 4), (900, []), (950, [0.0] * 4), (1000, [1e30] * 4), (1050, [1.0, 2.0]), (None, [1.0] * 4), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as length")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q, v in whole.items():
        if q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole.items() if i != q and len(w) == len(v))
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in topk.top_products(table).collect()} == expected
    assert topk.top_products(table.limit(0)).count() == 0


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 60)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    turn = np.random.default_rng(4)
    points = [*turn.normal(size=(200, 5)), *(turn.normal(size=5) + 0.15 * turn.normal(size=(250, 5)))]
    points += [points[7]] * 20 + [3 * points[9]]
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    odd = [(1000, None), (1001, [0.0] * 5), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 5), (1004, []), (1005, [1.0, 0.0]), (1006, [2.0, 0.0]), (None, points[7].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as cell")
    unit = np.array(points) / np.linalg.norm(points, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(points))
    while True:
        new = np.minimum(label, np.where(hit, label, len(points)).min(1))
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    assert [found[i].n_links for i in range(len(points))] == hit.sum(1).tolist()
    assert [found[i].component_id for i in range(len(points))] == label.tolist()
    assert all(found[i].kept == (label[i] == i) for i in range(len(points)))
    assert [(found[i].n_links, found[i].component_id, found[i].kept) for i in range(1000, 1005)] == [(0, i, True) for i in range(1000, 1005)]
    assert found[1006].component_id == 1005 and found[None].kept and found[None].n_links == 0
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_of_scaled_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    turn = np.random.default_rng(6)
    one = turn.normal(size=5)
    points = [*turn.normal(size=(120, 5)), *(one * 2.0**k for k in range(-40, 40))]
    unit = np.array(points) / np.linalg.norm(points, axis=1)[:, None]
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()}
    assert [found[i] for i in range(len(points))] == hit.sum(1).tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (300, 150), (1, 2), (2, 1), (1, 2)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in [*range(100, 161), 7, *range(200, 400)]} == {7}
    assert found[1] == found[2] == 1 and 5 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_with_links(spark):
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = connected_components(table([(1, 2), (3, 4), (5, 6)]))
    found = {r.node: r.component for r in merged_components(known, table([(6, 4), (9, 8), (2, 1), (10, 9)])).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 8: 8, 9: 8, 10: 8}
    assert {r.node: r.component for r in merged_components(known, table([])).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_url_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/12#t", "https://example.org/en/2", "http://org", "http://x.com/fr/", "http://xcom/fr/", "http://x.com/de/1", "http://a.net/://b", "x\n://h\ny/p\nq?z", "http://a.co.uk/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, good int")
    rows = {r.page_id: r for r in hosts.judge_urls(pages, none).collect()}
    assert [(rows[i].host, rows[i].path) for i in (0, 1, 2, 3, 6, 10, 11)] == [("", ""), ("", ""), ("", ""), ("a.example.org", "/es/x"), ("org", ""), ("a.net", "/://b"), ("h\ny", "/p\nq")]
    assert [rows[i].rule for i in range(len(urls))] == [None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "com/fr/", None, "com/de/", None, None, None]
    assert [rows[i].verdict for i in (3, 4, 5, 7, 9)] == ["block", "block", "allow", "allow", "block"]
    good = spark.createDataFrame([(urls[10], 1)] * 40 + [(urls[12], 0)] * 40 + [(urls[6], None), (None, None)], "url string, good int")
    rows = {r.page_id: r.verdict for r in hosts.judge_urls(pages, good).collect()}
    assert rows[10] == "allow" and rows[12] == "block"
    assert hosts.judge_urls(pages.limit(0), good).count() == 0
    names = ["a.b.co.uk", "x@y.b.org:80", "10.0.0.1:8080", "[::1]:80", "localhost", "", "a.github.io", "co.uk", "deep.a.blog.example.ne.jp"]
    table = spark.createDataFrame([(n,) for n in names], "host string").select(hosts.name_of(F.col("host")).alias("name"))
    table = table.withColumn("suffix", hosts.suffix_of(F.col("name"), ["github.io", "blog.example.ne.jp"])).withColumn("domain", hosts.domain_of(F.col("name"), F.col("suffix")))
    assert [tuple(r) for r in table.collect()] == [
        ("a.b.co.uk", "co.uk", "b.co.uk"), ("y.b.org", "org", "b.org"), ("10.0.0.1",) * 3, ("[::1]",) * 3, ("localhost",) * 3, ("",) * 3,
        ("a.github.io", "github.io", "a.github.io"), ("co.uk",) * 3, ("deep.a.blog.example.ne.jp", "blog.example.ne.jp", "a.blog.example.ne.jp"),
    ]
    plan = hosts.judge_urls(pages, good)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_labels_belong_to_the_pages_of_their_documents(spark, tmp_path):
    """The html holds the text of the document that the url numbers, so that document's label is the page's outcome."""
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    numbered = [(p, int(p.url.split("?")[0].rsplit("/", 1)[1])) for p in pages if p.url and p.url.split("?")[0].rsplit("/", 1)[1].isdigit()]
    # Forty letters of the text in a row, as markup and entities may break longer ones.
    runs = [(p, n) for p, n in numbered if n in texts and len(texts[n]) > 200]
    held = [any(texts[n][at : at + 40] in p.html for at in range(0, 160, 10)) for p, n in runs]
    assert sum(held) > 0.9 * len(held) > 0


@pytest.mark.parametrize("key", ["op1_topk", "op4_linededup", "op8_hosts"])
def test_query_equals_its_sql(spark, key):
    folder = "/root/testdata/sf0.001"
    difference, _ = oracle.compare(spark, oracle.connect(folder), key, folder)
    assert not difference or difference.startswith(" ")


def test_held_out_languages_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = oracle.app.queries()["op3_langid"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 0


def test_pipeline_equals_brute_force(spark):
    turn = random.Random(8)
    given = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    note = "this very line stands on every site"
    for i, row in enumerate(given):
        row["source"] = f"site{i % 12}"
        row["text"] = f"{row['text']}\n{note}"
    for text in (given[3]["text"], given[4]["text"] + " one", None, "", "123", note):
        given.append({**given[0], "doc_id": 500 + len(given), "text": text, "source": "site1"})
    turn.shuffle(given)
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    stages = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(stage(spark, stages[-1], "unused"))
        if len(stages) < 5:
            assert stages[-1].columns == docs.columns
    model = langid.learn(docs)
    with_letters = {d["doc_id"]: d for d in given if d["text"] and any(c.isalpha() for c in d["text"])}
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in langid.identify(docs, model).where("lang_pred <> 'und'").collect()} <= set(with_letters)
    lines: dict[str, set] = {}
    first: dict[str, tuple] = {}
    for d in sorted((d for d in given if d["doc_id"] in kept), key=lambda d: d["doc_id"]):
        for n, line in enumerate(d["text"].split("\n")):
            lines.setdefault(line, set()).add(d["source"])
            first.setdefault(line, (d["doc_id"], n))
    clean = {}
    for i in sorted(kept):
        d = with_letters[i]
        parts = [x for n, x in enumerate(d["text"].split("\n")) if not x.strip() or len(lines[x]) < 10 or first[x] == (i, n)]
        if "\n".join(parts).strip():
            clean[i] = "\n".join(parts)
    assert {r.doc_id: r.text for r in stages[2].collect()} == clean
    _, label = brute_groups([*clean.values()])
    alone = {i for n, i in enumerate(clean) if label[n] == n}
    assert {r.doc_id for r in stages[3].collect()} == alone
    assert {r.doc_id for r in stages[4].collect()} == alone


def test_pipeline_stages_with_clashing_columns_and_repeated_keys(spark):
    names = ["drop id", "drop body", "drop at", "body to read", "language found", "its score", "set hash", "its id", "its hash", "number", "Node", "line"]
    texts = ["the words of one document go on and on in a row for quite a while", "other words that have nothing to do with what the first one says at all", "12 34"]
    rows = [(3, texts[0]), (7, texts[0]), (7, texts[1]), (7, None), (8, texts[2]), (None, texts[0]), (9, texts[1]), (9, texts[1] + " x"), (3, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"1 as `{n}`" for n in names])
    kept = corpus_pipeline.near_dedup(spark, docs, "unused")
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, texts[0]), (3, texts[0]), (7, texts[1]), (7, None), (8, texts[2]), (None, texts[0])]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert set(names) <= set(docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() == docs.count()
