"""Searches in whole texts: what a text cannot hold is not looked for, and results stay the same."""

from __future__ import annotations

import time
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, clean_text, cjk_count, lines
from folioframe.operators import cjk, extract, layout
from folioframe.plans import extraction
from folioframe.plans.registry import STATEMENTS

DOI = rf"(?i){NOT_WORD_BEFORE}(10\.\d{{4,9}}/[-._;()/:A-Z0-9]+)"
PROSE = "les échanges publiés à l'époque ont été très intéressants pour la société et ses membres "


def seconds(df, *columns):
    """The best of three runs over the same rows."""
    taken = []
    for _ in range(3):
        start = time.perf_counter()
        df.select(*columns).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return min(taken)


@pytest.fixture(scope="module")
def prose(spark):
    """Texts of 300 lines without any sign that the searches look for."""
    text = F.concat(F.repeat(F.concat(F.lit(PROSE), F.lit("\n")), 300), F.col("id").cast("string"))
    return spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text")).localCheckpoint()


def test_identifiers_of_texts_without_marks(prose):
    former = [F.regexp_extract(F.translate("text", "​﻿", ""), DOI, 1), F.regexp_extract("text", cjk.CLASS_NO, 1)]
    former += [F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)) for p in (cjk.VOLUME_ISSUE, cjk.ISSUE_VOLUME)]
    former += [F.regexp_extract("text", cjk.PAGE_RANGE.replace("(?=[页p])", ""), n) for n in (1, 2)]
    found = cjk.front_identifiers(F.col("text"))
    now = [found.getField("doi"), found.getField("clc"), cjk.volume_issue(F.col("text"))]
    assert seconds(prose, *now) < 0.75 * seconds(prose, *former)


def test_free_text_guess_without_marks(prose):
    """The patterns for press and edition alone took longer than the whole guess does now."""
    guess = extract.text_metadata(prose).select("title", "year", "isbn", "edition", "publisher", "publication_title")
    former = [F.col("text").rlike(extract.PUBLISHER), F.col("text").rlike(extract.BOOK_SIGNS), F.col("text").rlike(extract.EDITION)]
    assert seconds(guess, "*") < 1.5 * seconds(prose, *former)


def test_plausible_titles_of_long_lines(prose):
    long = F.repeat("text", 1)
    assert seconds(prose, cjk.plausible_title(long)) < 0.5 * seconds(prose, cjk_count(clean_text(long)))


def test_signs_that_only_unfolded_texts_hold(spark):
    rows = spark.createDataFrame([
        (1, "A title of some length\nISBN 0306406152\nWorld Scientiﬁc"), (2, "A title of some length\nISBN 0306406152\nSprin­ger, 2nd edition 2004"),
        (3, "A title of some length\rNature Reviews | Phys"), (4, "one two"), (5, None), (6, "broken 1​0.1234/\n  aB. and 10.5555/x"),
    ], "doc_id long, text string")
    got = {r["doc_id"]: r for r in extract.text_metadata(rows).collect()}
    assert [got[n]["publisher"] for n in (1, 2)] == ["World Scientific", "Springer"]
    assert (got[2]["edition"], got[2]["year"], got[3]["publication_title"]) == ("2nd edition", 2004, "Nature Reviews Physics")
    assert [r[0] for r in rows.orderBy("doc_id").select(lines(F.col("text"))).collect()][3:5] == [["one", "two"], None]
    assert (got[6]["doi"], got[5]["doi"], got[5]["title"]) == ("10.1234/ab", None, "")
    assert rows.filter("doc_id = 6").select(identifiers.all_dois(F.col("text"))).first()[0] == ["10.1234/ab", "10.5555/x"]


def test_pairs_of_volume_and_issue(spark):
    texts = ["第4期，第3卷", "3卷 4期 第9期 第8卷", "x 2015 Vol. 3, No. 4 pp. 3–9", "卷 期 2015 Vol.7", "7 期 卷 8", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(cjk.volume_issue(F.col("text")).alias("v")).select("v.*")
    assert [tuple(r) for r in rows.collect()] == [
        ("3", "4", None, None), ("3", "4", None, None), ("3", "4", "3", "9"), ("7", None, None, None), (None,) * 4, (None,) * 4,
    ]


def test_lines_of_a_page_are_cleaned_once(spark):
    """Title, names, venue and affiliation come from the lines with Chinese letters; one long line without them is not searched."""
    text = "2015 Vol. 3, No. 4\n城市空间演变\n张伟 孙杰平XU Hao\n（城市大学规划学院，北京 100045）\n第3卷 第4期\n城市学刊\n摘要：城市" + "，" + PROSE
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    page = rows.select("*", F.expr("case line_no when 1 then 18D else 9D end size"), F.expr("40D + 14 * line_no y0"), F.expr("52D + 14 * line_no y1"), F.lit(800.0).alias("page_h"))
    front = layout.front_page(page)
    got = front.first()
    assert (got["fm_title"], got["fm_authors"], got["fm_journal"], got["fm_affiliation"]) == ("城市空间演变", ["张伟", "孙杰平"], "城市空间演变", "城市大学规划学院，北京 100045")
    # The whole page is read for its joined text only.
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(front).count("Generate ") == 1
    # Once to choose the lines, once for what is kept of them.
    assert plan(layout.author_lines(page, layout.title_blocks(page))).count("■●◆") == 2


def test_front_identifiers_are_given_whole(spark):
    """The ISBN too, as in the SQL: that of the first place that looks like one, if it has 10 or 13 digits."""
    texts = [
        (1, "第3卷 第4期\nISBN 978-7-112-01234-5 文章编号：1000-1234(2019)02-0123-07"), (2, "书号isbn-10: 7-112-0123-x"), (3, "ISBN：7112012345。"),
        (4, "收稿日期：2019-03-15 ISBN 7-112-01234-5"), (5, "中图分类号：TU984"), (6, "A7112012345 97871120123451"), (7, ""),
    ]
    page = SimpleNamespace(v_cn=spark.createDataFrame(texts, "doc_id long, text string"))
    found = extraction.cn_identifiers(page)
    got = {r.doc_id: r for r in found.collect()}
    assert [got[n].isbn for n in range(1, 8)] == ["9787112012345", None, "7112012345", None, None, None, None]
    con = duckdb.connect()
    con.execute("CREATE TABLE v_cn (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO v_cn VALUES (?, ?)", texts)
    cursor = con.execute(STATEMENTS["cn_identifiers"])
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    assert found.columns == names and sorted(rows) == sorted(tuple(r) for r in got.values())


def test_full_guess_gives_the_people(spark):
    texts = [(1, "en", "s", "A title of some length\nAnn Lee Roe, Bob Stone\nx"), (2, "en", "s", "A title of some length\nRoe, Ann"), (3, "en", "s", "A title of some length\n12")]
    page = SimpleNamespace(v_text=spark.createDataFrame(texts, "doc_id long, lang string, source string, text string"))
    got = {r.doc_id: [(p.family, p.given) for p in r.creators] for r in extraction.text_metadata_full(page).collect()}
    assert got == {1: [("Roe", "Ann Lee"), ("Stone", "Bob")], 2: [("Roe", "Ann")], 3: []}
