"""The identification waterfall and the search table."""

import random

from pyspark.sql import functions as F

from folioframe.functions.people import parse_name
from folioframe.operators import identify, search

RECORD = "doi string, ord long, title string, year int, publication_title string, volume string, issue string, publisher string"


def registries(spark, crossref=(), openalex=()):
    people = F.array(parse_name(F.lit("Ann Net")))
    return [spark.createDataFrame(list(rows), RECORD).withColumn("creators", people) for rows in (crossref, openalex)]


def test_each_tier_settles_its_documents(spark):
    documents = spark.createDataFrame([
        (1, "a.pdf", "see arXiv:2101.00001v2 and doi 10.1000/both"), (2, "b.pdf", "arXiv:2101.99999 then https://doi.org/10.1000/both"), (3, "10.1000_x.pdf", "doi:10.1000/open"),
        (4, "李浩 - 2024 - 某标题的研究.pdf", "some body text"), (5, "李浩 - 2024 - 另外一个题目.pdf", None), (6, "f.pdf", "nothing"), (7, "g.pdf", "A Study of Everything\nAnn Stone and Bob Reed"),
        (8, "h.pdf", None), (9, "i.pdf", ""), (10, "j.pdf", "doi:10.1000/unknown"),
    ], "doc_id long, filename string, text string")
    arxiv = spark.createDataFrame([("2101.00001", "From arXiv", 2021), ("2101.00001", "From arXiv", 2021), (None, "no id", 1), ("2101.99999", " ", 1)], "arxiv_id string, title string, year int").withColumn("creators", F.array(parse_name(F.lit("Ann Net"))))
    crossref, openalex = registries(
        spark,
        [("10.1000/both", 1, "From Crossref", 2001, "J", "1", "2", "P"), (None, 2, "某标题的研究", 1900, "城市规划", "9", "9", "P")],
        [("10.1000/both", 1, "Not asked", 2002, "J", "1", "2", "P"), ("10.1000/open", 2, "From OpenAlex", 2003, None, None, None, None), (None, 3, "某标题的研究", None, "城市发展研究", "25", "5", None)],
    )
    parsed = spark.createDataFrame([(6, "\\documentclass{article}\n\\title{城市规划的历史研究}\n\\author{Ann Stone}\n\\date{2020-05}\n\\begin{document}\nx"), (7, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in identify.identify(documents, arxiv, crossref, openalex, parsed).collect()}
    assert {i: (r.source, r.title) for i, r in found.items()} == {
        1: ("arXiv", "From arXiv"), 2: ("Crossref", "From Crossref"), 3: ("OpenAlex", "From OpenAlex"), 4: ("OpenAlex", "某标题的研究"), 5: ("cn-filename", "另外一个题目"),
        6: ("local", "城市规划的历史研究"), 7: ("local-text", "A Study of Everything"), 8: (None, None), 9: (None, None), 10: ("local-text", "doi:10.1000/unknown") if found[10].source else (None, None),
    }
    # The network fills what is empty; title, authors and year of the file name stay.
    four = found[4]
    assert (four.publication_title, four.volume, four.issue, four.year, four.filled) == ("城市发展研究", "25", "5", 2024, ["publication_title", "volume", "issue"])
    assert [p.family for p in four.creators] == ["李浩"]
    assert [(a.source, a.ok) for a in found[2].attempts] == [("arXiv", False), ("Crossref", True)] and found[1].doi == "10.1000/both" and found[1].arxiv_id == "2101.00001"
    assert found[8].attempts == [] and found[10].doi == "10.1000/unknown" and found[4].role == "primary"


def test_waterfall_without_registries_and_documents(spark):
    documents = spark.createDataFrame([(1, "a.pdf", "A Study of Everything\nAnn Stone and Bob Reed")], "doc_id long, filename string, text string")
    arxiv = spark.createDataFrame([], "arxiv_id string, title string, year int").withColumn("creators", F.array(parse_name(F.lit(""))))
    crossref, openalex = registries(spark)
    assert identify.identify(documents, arxiv, crossref, openalex).first().source == "local-text"
    assert identify.identify(documents.limit(0), arxiv, crossref, openalex).count() == 0


def test_search_table_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcäß 京") for _ in range(rng.randint(0, 9)))
    entries = [(i, i * 31 % 97, rng.choice([None, word()]), word(), word().upper()) for i in range(97)]
    queries = [(i, rng.choice([None, "", "  ", "a", "AB", "bca", word(), f" {word()} "])) for i in range(150)]
    table = spark.createDataFrame(entries, "entry_id long, ord long, title string, doi string, tags string")
    asked = spark.createDataFrame(queries, "query_id long, query string")
    want = set()
    for i, query in queries:
        q = (query or "").strip(" ").lower()
        scored = [(-sum(q in (f or "").lower() for f in e[2:]), (e[2] is not None, (e[2] or "").lower()), e[1], e[0]) for e in entries] if q else [(0, e[1], e[0]) for e in entries]
        hits = sorted(s for s in scored if s[0] or not q)[:5]
        want |= {(i, h[-1], -h[0], n) for n, h in enumerate(hits, 1)}
    fields = ("title", "doi", "tags")
    assert {tuple(r) for r in search.search_table(table, asked, fields, top=5).collect()} == want
    index = search.postings(table, fields)
    assert {tuple(r) for r in search.search_table(table, asked, fields, top=5, index=index).collect()} == want
    assert search.search_table(table.limit(0), asked, fields).count() == 0 == search.search_table(table, asked.limit(0), fields).count()
