"""First-page layout lines to title, authors, venue and affiliation.

Lines are rows (doc_id, line_no, text, size, x0, y0, y1, page_h). Picks are
`min_by`/`max_by` aggregates, which combine before the shuffle; lists are
collected only from lines that already passed the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.people import DEFAULT_SURNAMES, Surnames, clean_author_line, looks_like_person, split_authors
from folioframe.functions.text import (
    cjk_count, clean_text, fold_spaces, is_letter_spaced_header, let, may_have_cjk, null_if_blank, unfold_ligatures,
)
from folioframe.operators.cjk import NOISE, front_identifiers, plausible_title, volume_issue
from folioframe.session import cut

# Layout patterns and bands.
VOLUME_MARK = r"(?=[第Vv12])(?i)(?:第\s*\d{1,3}\s*卷|Vol[.．]?\s*\d+|(?:19|20)\d{2}\s*年\s*第?\s*\d+\s*期)"
SECTION_LABELS = ("摘要", "关键词", "引言", "参考文献", "作者简介", "规划研究", "本刊专稿")
BRACKETED = r"^[（(]\s*([^（()）]{2,70})\s*[)）]$"
ORGANISATION = (
    r"省|市|自治区|特别行政区|区|县|学院|大学|研究院|研究所|研究中心|研究部|中心|系|院|所|集团|有限公司|邮编|邮政编码|[0-9]{6}"
)
BIO_LINE = r"^作者(简介)?\s*[:：]"
BIO_ORGANISATION = (
    "(?<!作者)([一-鿿A-Za-z（）()]{4,40}(?:大学|学院|研究院|研究所|系|中心)[一-鿿A-Za-z（）()]{0,20})"
)
VENUE_BAND, TITLE_AREA, AUTHOR_BAND, AFFILIATION_BAND = 18.0, 0.55, 0.24, 0.45
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH_YEAR = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:([0-9]{{1,2}})\s+)?(?:{MONTHS})\s+((?:19|20)\d{{2}})(?![\p{{L}}\p{{N}}_])"
ABSTRACT_LINE = r"(?i)^abstract\s*(?:[|:—-]|$)"
SECTION_WORD = r"(?i)^(reviews?|articles?|letters?|perspectives?|editorials?|research)$"


def venue_near_volume(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """First short pure-Chinese line within 18 points of the first volume or issue line.

    A band join on equal documents: one anchor row per document, so the lines
    are never paired with each other.
    """
    anchors = lines.filter(F.col("text").rlike(VOLUME_MARK)).groupBy(doc).agg(F.min_by("y0", "line_no").alias("anchor_y"))
    short = lines.filter(may_have_cjk(F.col("text"), 2) & ~F.col("text").rlike(NOISE) & let(clean_text(F.col("text")), lambda t: (
        (F.length(t) <= 14) & (t != "") & ~t.rlike("[0-9A-Za-z《》“”、，。；：]") & (cjk_count(t) >= 2)
        & ~t.isin(*SECTION_LABELS) & ~t.rlike(NOISE)
    ))).select(doc, "line_no", "y0", clean_text(F.col("text")).alias("t"))
    near = short.join(anchors, doc).filter(F.abs(F.col("y0") - F.col("anchor_y")) <= VENUE_BAND)
    return near.groupBy(doc).agg(F.min_by("t", "line_no").alias("journal"))


def _bracket_or_note(c: Column) -> Column:
    """Lines that `affiliations` can use: they begin with a bracket or with the author's sign."""
    return c.rlike("\\A[\\s\u3000\u00a0\u200b]*[（(作]")


def affiliations(lines: DataFrame, titles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Bracketed organisation below the title, else the organisation in an author note.

    `titles` has one `title_y1` per document.
    """
    lines = lines.filter(_bracket_or_note(F.col("text")))
    t = clean_text(F.col("text"))
    bracketed = F.regexp_extract(t, BRACKETED, 1)
    in_band = (F.col("y0") > F.col("title_y1")) & (F.col("y0") <= F.col("title_y1") + F.col("page_h") * AFFILIATION_BAND)
    top = F.when(in_band & bracketed.rlike(ORGANISATION), F.trim(bracketed))
    note = F.when(t.rlike(BIO_LINE), null_if_blank(F.regexp_extract(t, BIO_ORGANISATION, 1)))
    found = lines.join(titles.select(doc, "title_y1"), doc).select(doc, "line_no", top.alias("top"), note.alias("note"))
    return found.filter("top is not null or note is not null").groupBy(doc).agg(
        F.coalesce(
            F.min_by("top", F.when(F.col("top").isNotNull(), F.col("line_no"))),
            F.min_by("note", F.when(F.col("note").isNotNull(), F.col("line_no"))),
        ).alias("affiliation")
    )


def title_blocks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Title by layout: the largest plausible line of the upper page with its continuation lines.

    Gives title, title_y1 and title_size per document.
    """
    plausible = lines.filter(
        (F.col("y0") < F.col("page_h") * TITLE_AREA) & plausible_title(F.col("text"), 3)
    )
    best = F.max_by(
        F.struct("line_no", clean_text(F.col("text")).alias("t"), "size", "y1"),
        F.struct(F.col("size"), -F.col("y0"), -F.col("line_no")),
    )
    anchors = plausible.groupBy(doc).agg(best.alias("a"))
    follow = lines.join(anchors, doc).filter(
        (F.col("line_no") != F.col("a.line_no"))
        & (F.abs(F.col("size") - F.col("a.size")) <= 1.5)
        & (F.col("y0") > F.col("a.y1") - 1.0)
        & plausible_title(F.col("text"), 2)
    )
    ordered = follow.groupBy(doc).agg(F.sort_array(F.collect_list(
        F.struct(F.col("line_no"), F.col("y0"), F.col("y1"), clean_text(F.col("text")).alias("t"))
    )).alias("_follow"))
    gap = F.greatest(F.lit(6.0), F.col("a.size") * 1.6)

    def extend(acc: Column, line: Column) -> Column:
        joins = (line["y0"] > acc["y1"] - 1.0) & (line["y0"] <= acc["y1"] + gap)
        return F.when(joins, F.struct(
            F.concat(acc["t"], F.lit(" "), line["t"]).alias("t"), line["y1"].alias("y1")
        )).otherwise(acc)

    merged = F.aggregate(
        F.coalesce("_follow", F.slice("_follow", 1, 0)), F.struct(F.col("a.t").alias("t"), F.col("a.y1").alias("y1")), extend
    )
    out = anchors.join(ordered, doc, "left").withColumn(
        "_m", F.when(F.col("_follow").isNull(), F.struct(F.col("a.t").alias("t"), F.col("a.y1").alias("y1"))).otherwise(merged)
    )
    half = (F.length("_m.t") / 2).cast("int")
    doubled = (half >= 4) & (F.left("_m.t", half) == F.substring(F.col("_m.t"), half + 1, half))
    return out.select(
        doc, F.when(doubled, F.left("_m.t", half)).otherwise(F.col("_m.t")).alias("title"),
        F.col("_m.y1").alias("title_y1"), F.col("a.size").alias("title_size"),
    )


def _names_in(c: Column, surnames: Surnames) -> Column:
    """The names of an author line, NULL for other lines. Each step is computed once and only for lines that passed the one before."""
    footnote = r"[（(]?[\d,，、\s\-]+[)）]?$"

    def run_of(t: Column) -> Column:
        bare = F.trim(F.regexp_replace(t, "^[■●◆▣□○·★☆※]+", ""))
        return F.when(
            ~t.startswith("——") & (cjk_count(t) >= 2) & ~t.rlike(NOISE) & ~t.rlike("[。；！？《》“”]"),
            F.trim(F.regexp_extract(bare, "^([一-鿿、，和\\s]+)", 1)),
        )

    def names_of(run: Column) -> Column:
        names = F.transform(
            split_authors(run, surnames), lambda n: F.trim(F.regexp_replace(n, footnote, ""), F.lit(" ,，、"))
        )
        return F.when((F.length(run) <= 26) & (cjk_count(run) >= 2), F.filter(names, lambda n: cjk_count(n) >= 2))

    def accepted(names: Column) -> Column:
        single = F.get(names, F.lit(0))
        return F.when((F.size(names) > 0) & (F.forall(names, lambda n: looks_like_person(n, surnames)) | (
            (F.size(names) == 1) & F.length(single).between(2, 6)
            & (F.substring(single, 1, 2).isin(*surnames.compound) | F.substring(single, 1, 1).isin(*surnames.single))
        )), names)

    return let(let(let(clean_text(c), run_of), names_of), accepted)


def author_lines(
    lines: DataFrame, titles: DataFrame, doc: str = "doc_id", surnames: Surnames = DEFAULT_SURNAMES
) -> DataFrame:
    """First line below the title whose leading Chinese run is names only."""
    named = lines.filter(may_have_cjk(F.col("text"), 2) & ~F.col("text").rlike(NOISE)).select(
        doc, "line_no", "y0", "page_h", _names_in(F.col("text"), surnames).alias("authors")
    ).filter("authors is not null")
    below = named.join(titles.select(doc, "title_y1"), doc).filter(
        (F.col("y0") > F.col("title_y1")) & (F.col("y0") <= F.col("title_y1") + F.col("page_h") * AUTHOR_BAND)
    )
    return below.groupBy(doc).agg(F.min_by("authors", F.struct("y0", "line_no")).alias("authors"))


def front_page(lines: DataFrame, doc: str = "doc_id", surnames: Surnames = DEFAULT_SURNAMES, head_lines: int | None = None) -> DataFrame:
    """All layout fields of a Chinese first page, one row per document (`fm_*` columns); year and book signs from the first `head_lines` lines, or all.

    The fields of the whole page search its joined lines; all others use lines with
    Chinese letters or a volume mark only, which are written once.
    """
    page = lines.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_l")).select(
        doc, F.array_join("_l.text", " ").alias("_wide"), *([] if head_lines is None else [F.array_join(F.slice("_l.text", 1, head_lines), " ").alias("_head")]),
    )
    head = F.col("_wide" if head_lines is None else "_head")
    years = F.transform(F.regexp_extract_all(head, F.lit(identifiers.YEAR), 1), lambda y: y.cast("int"))
    ids, pair = front_identifiers(F.col("_wide")), volume_issue(F.col("_wide"))
    fields = page.select(
        doc,
        F.get(F.filter(years, lambda y: (y >= 1900) & (y <= F.year(F.current_date()) + 1)), F.lit(0)).alias("fm_year"),
        (head.contains("图书在版编目") | head.contains("CIP") | head.contains("ISBN")).alias("_book"), ids.alias("_ids"), pair.alias("_pair"),
    ).select(
        doc, "fm_year", "_book",
        *[F.col(f"_ids.{c}").alias(f"fm_{c}") for c in ("article_no", "clc", "received_date", "doi", "isbn")],
        *[F.col(f"_pair.{c}").alias(f"fm_{c}") for c in ("volume", "issue", "page_start", "page_end")],
    )
    text = F.col("text")
    lines = cut(lines.filter(may_have_cjk(text, 2) | text.rlike(VOLUME_MARK) | _bracket_or_note(text)))
    titles = cut(title_blocks(lines, doc))
    out = fields.join(titles, doc, "left")
    out = out.join(venue_near_volume(lines, doc), doc, "left")
    out = out.join(author_lines(lines, titles, doc, surnames), doc, "left")
    out = out.join(affiliations(lines, titles, doc), doc, "left")
    return out.withColumn("fm_book", F.col("_book") & F.col("title").isNotNull()).drop("_book", "title_size").withColumnsRenamed({
        "title": "fm_title", "title_y1": "fm_title_y1", "journal": "fm_journal", "authors": "fm_authors",
        "affiliation": "fm_affiliation",
    })


def title_runs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Consecutive lines of one size before the abstract, joined into runs (gaps and islands)."""
    abstracts = lines.groupBy(doc).agg(F.min(F.when(F.col("text").rlike(ABSTRACT_LINE), F.col("y0"))).alias("abstract_y"))
    t = F.col("t")
    words = F.size(F.split(t, r"\s+"))
    kept = lines.withColumn("t", F.trim("text")).join(abstracts, doc).filter(
        F.length(t).between(8, 350) & words.between(1, 40)
        & (F.col("abstract_y").isNull() | (F.col("y0") < F.col("abstract_y")))
        & F.col("size").between(12, 36)
        & ~((F.upper(t) == t) & (F.lower(t) != t) & (words <= 4))
        & ~is_letter_spaced_header(t) & ~t.rlike(SECTION_WORD)
    )
    by_doc = Window.partitionBy(doc).orderBy("line_no")
    kept = kept.withColumn("_sized", F.coalesce((F.lag("size").over(by_doc) != F.col("size")).cast("int"), F.lit(1)))
    kept = kept.withColumn("_size_run", F.sum("_sized").over(by_doc))
    before = Window.partitionBy(doc, "_size_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("y0") - F.max("y1").over(before)
    kept = kept.withColumn("_break", F.when(gap < 8, 0).otherwise(1)).withColumn("_run", F.sum("_break").over(by_doc))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ")
    return kept.groupBy(doc, "_run").agg(
        F.first("size").alias("size"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), fold_spaces(text).alias("text"),
        F.min("line_no").alias("line_no"),
    ).drop("_run")


def best_title_run(runs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Largest run, the top-most of equals."""
    top = F.max_by(F.struct("text", "y1"), F.struct(F.col("size"), -F.col("y0"), -F.col("line_no")))
    return runs.groupBy(doc).agg(top.alias("_top")).select(doc, F.col("_top.text").alias("title"), F.col("_top.y1").alias("title_y1"))


def author_block(blocks: DataFrame, titles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Top-most block between title and abstract that is not an affiliation, cleaned."""
    unfit = r"(?i)^abstract(?![\p{L}\p{N}_])|department|university|institute|laboratory|doi\.org|(?<![\p{L}\p{N}_])et\s+al(?![\p{L}\p{N}_])|Sci\.?\s+Adv"
    abstracts = blocks.groupBy(doc).agg(F.min(F.when(F.col("text").rlike(ABSTRACT_LINE), F.col("y0"))).alias("abstract_y"))
    below = blocks.join(titles, doc).join(abstracts, doc).filter(
        (F.col("y0") >= F.col("title_y1")) & (F.col("abstract_y").isNull() | (F.col("y0") < F.col("abstract_y")))
        & F.length("text").between(4, 600) & ~F.col("text").rlike(unfit)
    )
    return below.groupBy(doc).agg(F.min_by(clean_author_line(F.col("text")), F.struct("y0", "line_no")).alias("author_text"))


def publication_year(c: Column) -> Column:
    """Latest year of a dated month, else the latest month-year."""
    text = unfold_ligatures(c)
    days = F.regexp_extract_all(text, F.lit(MONTH_YEAR), 1)
    years = F.regexp_extract_all(text, F.lit(MONTH_YEAR), 2)
    dated = F.filter(F.zip_with(days, years, lambda d, y: F.when(d != "", y)), lambda y: y.isNotNull())
    return F.coalesce(F.array_max(dated), F.array_max(years)).try_cast("int")


def rotated_columns(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Single-character blocks of rotated scans read column by column."""
    single = lines.filter((F.length("text") == 1))
    column = F.rint(F.col("x0") / 2) * 2
    ordered = F.sort_array(F.collect_list(F.struct("y0", "line_no", "text")))
    return single.groupBy(doc, column.alias("x")).agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), "").alias("text")
    )


def rotated_record(columns: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Longest plausible column is the title; the other short Chinese ones are authors."""
    t = F.col("text")
    rank = F.struct(F.length(t), -F.col("x"))
    titles = columns.groupBy(doc).agg(F.max_by(F.struct("x", "text"), F.when(plausible_title(t, 4), rank)).alias("_t"))
    short = columns.filter(F.length(t).between(2, 12) & (cjk_count(t) >= 2))
    authors = short.join(titles, doc).filter(F.col("_t").isNull() | (F.col("x") != F.col("_t.x"))).groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct((-F.length(t)).alias("n"), "x", "text"))).alias("_a")
    )
    return titles.join(authors, doc, "left").select(
        doc, clean_text(F.col("_t.text")).alias("title"),
        F.coalesce(F.transform("_a", lambda a: a["text"]), F.array().cast("array<string>")).alias("authors"),
    )
