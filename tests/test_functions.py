"""Column functions on small cases."""

from pyspark.sql import functions as F

from folioframe.functions import identifiers, naming, people, text
from folioframe.operators import cjk, extract, quality


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_years_next_to_chinese_and_inside_longer_numbers(spark):
    year = lambda s: F.regexp_extract(F.lit(s), identifiers.YEAR, 1)
    assert one(spark, year("于2005年5月1日起施行"), year("2025 Vol.40, No.5"), year("12005年")) == ("2005", "2025", "")


def test_identifiers(spark):
    got = one(
        spark, identifiers.normalize_doi(F.lit(" HTTPS://doi.org/10.1/AbC.) ")), identifiers.normalize_arxiv(F.lit("arXiv: 2101.00001v2")),
        identifiers.first_isbn(F.lit("ISBN 978-7-114-12345-6")), identifiers.first_doi(F.lit("x 10.3969/  j.issn.1000-1891.2019.02.007")),
    )
    assert got == ("10.1/abc", "2101.00001", "9787114123456", "10.3969/j.issn.1000-1891.2019.02.007")


def test_author_splitting(spark):
    split = lambda s: people.split_authors(F.lit(s))
    assert one(spark, split("许皓 王百浩"), split("许皓和王百浩"), split("王 扬")) == (["许皓", "王百浩"], ["许皓", "王百浩"], ["王 扬"])


def test_file_name_records(spark):
    rows = spark.createDataFrame([
        (1, "张三、李四 - 2020 - 北京城市研究"), (2, "欧阳娜娜 - 2020 - 城市设计"), (3, "规划北京 - 梁陈方案新考"), (4, "张三 - 2003 - 2003 - 城记新编"),
    ], "doc_id int, stem string")
    got = {r.doc_id: r for r in cjk.filename_metadata(rows).collect()}
    assert got[1].fn_authors == ["张三", "李四"] and got[1].fn_title == "北京城市研究" and got[1].fn_year == 2020
    assert got[2].fn_authors == ["欧阳娜娜"]
    assert got[3].fn_authors == [] and "规划北京" in got[3].fn_title
    assert got[4].fn_title == "城记新编"


def test_front_page_identifiers(spark):
    line = F.lit("文章编号：1000-1891(2019)02-0123-07  中图分类号：TP391  收稿日期：2019-03-15  DOI:10.3969/j.issn.1000-1891.2019.02.007")
    ids, pair = one(spark, cjk.front_identifiers(line), cjk.volume_issue(F.lit("城市规划 2025年第5期 第49卷 页码 123-128")))
    assert (ids.article_no, ids.clc, ids.received_date, ids.isbn) == ("1000-1891(2019)02-0123-07", "TP391", "2019-03-15", None)
    assert tuple(pair) == ("49", "5", "123", "128")


def test_headers_and_author_lines(spark):
    header = lambda s: text.is_letter_spaced_header(F.lit(s))
    assert one(spark, header("P LAN ETARY SCI EN C E"), header("PLANETARY SCIENCE"), header("abc")) == (True, False, False)
    cleaned = one(spark, people.clean_author_line(F.lit("Qin1,3, Wu1, Liu1,2")))[0]
    assert "1" not in cleaned and all(n in cleaned for n in ("Qin", "Wu", "Liu"))


def test_latex_macros_win(spark):
    tex = "% x\n\\documentclass{article}\n\\title{北京——都市计划的无比杰作}\n\\author{梁思成}\n\\date{2020}\n\\begin{document}\ntext\n\\end{document}"
    row = extract.parsed_metadata(spark.createDataFrame([(tex,)], "text string")).first()
    assert row.title == "北京——都市计划的无比杰作" and row.creators[0].family == "梁思成" and row.year == 2020


def test_parts_and_supplements(spark):
    part = lambda s: extract.part_marker(F.lit(s))
    a, b, c, d = one(spark, part("北京研究（续二）"), part("史记 第三卷"), part("Optics Part IV"), part("Plain"))
    assert (a.base, a.order, b.order, c.marker, c.order, d) == ("北京研究", 100, 3, "IV", 4, None)
    df = spark.createDataFrame([("Supplementary Material for: The parent paper title\nx", "a_SI.pdf")], "text string, f string")
    row = quality.detect_supplement(df, "text", "f").first()
    assert row.is_supplement and row.confidence == 1.0 and row.parent_title == "The parent paper title"


def test_name_templates(spark):
    df = spark.createDataFrame([("A: Title", 1999, "Roe, Ann;Doe, Bob")], "title string, year int, names string")
    df = df.withColumn("creators", F.transform(F.split("names", ";"), lambda n: people.parse_name(n))).withColumn("language", F.lit("en"))
    render = lambda t: naming.with_name(df, t).first().name
    assert render(None) == "Roe and Doe - 1999 - A- Title"
    assert render('{{ if year >= 2000 }}new{{ elseif {{ title }} == "a: title" }}{{ authors max="-1" initialize="given" name="full" }}{{ endif }}') == "B. Doe"
    assert render('{{ title replaceFrom="t" replaceTo="T$0" regexOpts="g" suffix=" -" }} - {{ year }}') == "A- TiTtle - 1999"
    assert render("{{ if year }}unbalanced") == "Roe and Doe - 1999 - A- Title"
    assert one(spark, naming.safe_file_name(F.lit("CON")), naming.safe_file_name(F.lit('a<b>:"c"\t-- d .'))) == ("CON_", "a-b-c - d")
