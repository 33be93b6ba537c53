"""Bibliographic fields out of text, LaTeX, notes, messages and model output."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions import identifiers
from folioframe.functions.people import parse_name
from folioframe.functions.text import (
    NOT_WORD_AFTER, NOT_WORD_BEFORE, clean_text, dedupe_list, filled_lines, first_group, fold_spaces, has_cjk,
    is_letter_spaced_header, language_tag, latex_body, let, lines, null_if_blank, strip_latex, text_or_empty,
    unfold_ligatures,
)

# Patterns of the front-page heuristics.
VOLUME_HEADER = rf"(?i)^\d{{4}}\s*Vol|{NOT_WORD_BEFORE}Vol[.．]?\s*\d+\s*,\s*No[.．]?\s*\d+{NOT_WORD_AFTER}"
AFFILIATION = (
    rf"(?i){NOT_WORD_BEFORE}(abstract|department|university|institute|laboratory|center|school|college|address){NOT_WORD_AFTER}"
)
JOURNAL_LINE = (
    r"(?i)^((?:The\s+)?Journal of .{3,80}|Physical Review [A-Z](?: .*)?"
    r"|Nature(?: Physics| Photonics| Chemistry| Materials| Communications)?"
    r"|Science(?: Advances| Translational Medicine| Robotics)?)$"
)
REVIEW_HEADER = rf"(?=[Nn])(?i)(?:{NOT_WORD_BEFORE}natrevphys{NOT_WORD_AFTER}|Nature\s+Rev\w*\s*\|?\s*Phys\w*)"
BAR_JOURNAL = r"\|\s*([A-Z][A-Za-z. ]{3,60})\s+(?:19|20)\d{2}\s*,"
PUBLISHED_YEAR = rf"(?im)^\s*Published\s*:[^\n]*({NOT_WORD_BEFORE}(?:19|20)\d{{2}}{NOT_WORD_AFTER})"
JOURNAL_YEAR = (
    rf"(?=[JPCNSjpcns])(?i){NOT_WORD_BEFORE}(?:J\.|Journal|Phys\.|Chem\.|Nature|Science)(?<=[.A-Za-z])(?:(?<=\.)(?=[\p{{L}}\p{{N}}_])|(?<=[A-Za-z]){NOT_WORD_AFTER})"
    rf"[^\n]{{0,100}}?({NOT_WORD_BEFORE}(?:19|20)\d{{2}}{NOT_WORD_AFTER})"
)
FREE_YEAR = rf"(?=[12]){NOT_WORD_BEFORE}((?:19|20)\d{{2}}){NOT_WORD_AFTER}"
BOOK_SIGNS = (
    rf"(?i){NOT_WORD_BEFORE}(?:\d+(?:st|nd|rd|th)\s+edition|revised\s+edition|publisher|published\s+by|isbn"
    rf"|library\s+of\s+congress|university\s+press|[\p{{L}}\p{{N}}_]+\s+press){NOT_WORD_AFTER}"
)
EDITION = (
    rf"(?i){NOT_WORD_BEFORE}((?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+(?:st|nd|rd|th))"
    rf"\s+(?:revised\s+)?edition){NOT_WORD_AFTER}"
)
PUBLISHER = (
    rf"(?i){NOT_WORD_BEFORE}(Cambridge University Press|Oxford University Press|Princeton University Press|MIT Press"
    rf"|Springer(?:-Verlag)?|Elsevier|Wiley(?:-VCH)?|CRC Press|Taylor\s*&\s*Francis|McGraw[- ]Hill|World Scientific"
    rf"|(?:[A-Z][A-Za-z&. -]{{2,50}}\s+Press)){NOT_WORD_AFTER}"
)
# Words without which the patterns above cannot match, in lower case; the patterns themselves try every word of a text.
BOOK_WORDS = ("edition", "publish", "isbn", "congress", "press")
PUBLISHER_WORDS = ("press", "springer", "elsevier", "wiley", "taylor", "mcgraw", "world scientific")
REVIEW_WORDS = ("natrevphys", "nature")
# Lines from the top that are tried for a title before all are.
FIRST_LINES = 8
KEYWORD_HEADING = rf"(?i)^#{{1,6}}\s*(关键词|keywords){NOT_WORD_AFTER}"
KEYWORD_INLINE = r"(?i)(?:关键词|keywords)\s*[:：]\s*([^\n]+)"
KEYWORD_GAP = r"[,，;；、|/]+"


def first_match(items: Column, test) -> Column:
    """First element that passes, NULL when none does."""
    return F.get(F.filter(items, test), F.lit(0))


def _author_names(line: Column) -> Column:
    raw = F.split(line, r"\s*,\s*|\s+(?:and|&)\s+|\s*;\s*")
    names = F.filter(F.transform(raw, lambda n: F.trim(n, F.lit(" ,"))), lambda n: n != "")
    # "Family, Given" is one person, not two.
    names = F.when((F.size(names) == 2) & ~F.exists(names, lambda n: n.contains(" ")), F.array(line)).otherwise(names)
    return F.filter(names, lambda n: F.length(n).between(2, 80))


def _has_any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [low.contains(w) for w in words])


def _upto(items: Column | str, limit: int | None) -> Column:
    return F.col(items) if limit is None and isinstance(items, str) else items if limit is None else F.slice(items, 1, limit)


def text_metadata(
    df: DataFrame, text: str = "text", filename: str | None = None, title_lines: int | None = None, head_lines: int | None = None,
    bar_lines: int | None = None, publisher_lines: int | None = None, author_window: int = 4,
) -> DataFrame:
    """Guess title, creators, year, venue, book fields and identifiers from free text.

    Adds title, creators, year, doi, arxiv_id, isbn, publication_title, publisher,
    edition, language and item_type. Each step is a projection; nothing shuffles.
    Title, year and venue, running bars and publisher are looked for in whole texts, or
    in as many lines from the top as the limits say. Authors stand in the
    `author_window` lines below the title, by the rule of such pages.
    """
    stem = F.col(filename) if filename else F.lit("")
    df = df.withColumn("_lines", filled_lines(F.col(text)))

    def title_in(items: Column) -> Column:
        bare = F.transform(items, lambda x, i: F.struct(F.trim(F.regexp_replace(x, r"^#{1,6}\s*", "")).alias("s"), i.alias("i")))
        return first_match(bare, lambda c: (
            F.length(c["s"]).between(8, 350)
            & ~c["s"].rlike(r"(?i)^(doi:|arxiv:|abstract|摘要)")
            & ~c["s"].rlike(VOLUME_HEADER)
            & ~c["s"].rlike(r"^\d{1,4}[\s.,;:]*$")
            & ~is_letter_spaced_header(c["s"])
            & c["s"].rlike(r"\p{L}")
        ))

    tried = _upto("_lines", title_lines)
    df = df.withColumn("_title", F.coalesce(title_in(F.slice(tried, 1, FIRST_LINES)), title_in(tried)))
    marks_gone = F.transform(
        F.when(F.col("_title").isNotNull(), F.slice(F.col("_lines"), F.col("_title.i") + 2, F.lit(author_window))),
        lambda x: F.trim(F.regexp_replace(unfold_ligatures(x), r"[*†‡§]+", "")),
    )
    df = df.withColumn("_next", marks_gone)
    stop = F.array_position(F.transform("_next", lambda x: x.rlike(AFFILIATION)), True)
    candidates = F.when(stop > 0, F.slice(F.col("_next"), F.lit(1), stop.cast("int") - 1)).otherwise(F.col("_next"))
    names = F.transform(
        F.filter(candidates, lambda x: (F.length(x) <= 600) & ~x.rlike(r"\p{Nd}")), _author_names
    )
    df = df.withColumn("_names", first_match(
        names, lambda n: (F.size(n) > 0) & F.forall(n, lambda x: x.rlike("[A-Za-z\u4e00-\u9fff]"))
    ))
    df = df.withColumn("_head", F.array_join(_upto("_lines", head_lines), "\n"))
    # The last pattern finds any year: without it the others have nothing to find.
    year = F.when(F.col("_head").rlike(FREE_YEAR), F.coalesce(*[first_group(F.col("_head"), p) for p in (PUBLISHED_YEAR, JOURNAL_YEAR, FREE_YEAR)]))
    body = F.col(text)
    df = df.withColumns({"_unfolded": unfold_ligatures(F.col("_head")), "_bound": unfold_ligatures(body) != body})
    df = df.withColumn("_low", F.lower("_unfolded"))
    # Lines are trimmed already; they change only where the text has ligatures.
    clean = F.when(F.col("_bound"), F.transform("_lines", lambda x: F.trim(unfold_ligatures(x)))).otherwise(F.col("_lines"))
    bar = first_match(_upto(clean, bar_lines), lambda x: x.rlike(BAR_JOURNAL))
    venue = F.coalesce(
        first_match(_upto(clean, head_lines), lambda x: x.rlike(JOURNAL_LINE)),
        F.when(_has_any(F.col("_low"), REVIEW_WORDS) & F.col("_unfolded").rlike(REVIEW_HEADER), "Nature Reviews Physics"),
        F.when(body.contains("|"), fold_spaces(F.regexp_extract(bar, BAR_JOURNAL, 1))),
    )
    df = df.withColumns({
        "title": F.coalesce(unfold_ligatures(F.col("_title.s")), F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))),
        "creators": F.transform(F.coalesce("_names", F.array().cast("array<string>")), lambda n: parse_name(n)),
        "year": identifiers.plausible_year(year),
        "doi": identifiers.first_doi(body),
        "arxiv_id": identifiers.first_arxiv_id(body),
        "isbn": identifiers.first_isbn(body),
        "publication_title": venue,
    })
    df = df.withColumn("_book", F.col("isbn").isNotNull() | (_has_any(F.col("_low"), BOOK_WORDS) & F.col("_head").rlike(BOOK_SIGNS)))
    press = first_match(_upto(clean, publisher_lines), lambda x: x.rlike(PUBLISHER))
    return df.withColumns({
        "language": language_tag(F.col("title")),
        "edition": F.when(F.col("_book") & F.col("_low").contains("edition"), let(fold_spaces(F.regexp_extract("_head", EDITION, 1)), null_if_blank)),
        "publisher": F.when(F.col("_book") & _has_any(F.lower(unfold_ligatures(body)), PUBLISHER_WORDS), let(fold_spaces(F.regexp_extract(press, PUBLISHER, 1)), null_if_blank)),
        "item_type": F.when(F.col("_book") & F.col("doi").isNull() & F.col("arxiv_id").isNull(), "book")
        .otherwise("journalArticle"),
    }).drop("_lines", "_title", "_next", "_names", "_head", "_unfolded", "_bound", "_low", "_book")


def is_latex(c: Column) -> Column:
    head = F.ltrim(c)
    return (
        head.startswith("%") | head.startswith("\\")
        | c.contains("\\documentclass") | c.contains("\\begin{document}")
    )


def latex_macros(c: Column) -> Column:
    """Title (Chinese only), author list and year from the title macros."""
    title = F.trim(strip_latex(F.regexp_extract(c, r"\\title\s*\{([^{}]*)\}", 1)))
    raw = strip_latex(F.replace(F.regexp_extract(c, r"\\author\s*\{([^{}]*)\}", 1), F.lit("\\and"), F.lit(";")))
    names = F.filter(
        F.transform(F.split(raw, rf"{NOT_WORD_BEFORE}and{NOT_WORD_AFTER}|[;；]"), lambda n: F.trim(n, F.lit(" ,，、\n"))),
        lambda n: n != "",
    )
    return F.struct(
        F.when(has_cjk(title) & F.length(title).between(2, 200), title).alias("title"),
        F.when(F.size(names) > 0, F.transform(names, lambda n: parse_name(n))).alias("creators"),
        identifiers.plausible_year(strip_latex(F.regexp_extract(c, r"\\date\s*\{([^{}]*)\}", 1))).alias("year"),
    )


def parsed_metadata(df: DataFrame, text: str = "text", filename: str | None = None) -> DataFrame:
    """`text_metadata` for parser output: LaTeX is recognised by content and its macros win."""
    source = F.col(text)
    df = df.withColumn("_tex", is_latex(source))
    df = df.withColumn("_macros", F.when(F.col("_tex"), latex_macros(source)))
    df = df.withColumn("_plain", F.when(F.col("_tex"), latex_body(source)).otherwise(source))
    out = text_metadata(df, "_plain", filename)
    return out.withColumns({
        "title": F.coalesce("_macros.title", "title"),
        "language": F.when(F.col("_macros.title").isNotNull(), "zh").otherwise(F.col("language")),
        "creators": F.coalesce("_macros.creators", "creators"),
        "year": F.coalesce("_macros.year", "year"),
    }).drop("_tex", "_macros", "_plain")


def note_keywords(c: Column, limit: int = 8) -> Column:
    """Keywords under a heading (same line or the next), else after an inline label."""
    all_lines = F.transform(lines(c), lambda x: F.trim(x))
    at = F.array_position(F.transform(all_lines, lambda x: x.rlike(KEYWORD_HEADING)), True).cast("int")
    heading = F.get(all_lines, at - 1)
    tail = F.regexp_replace(heading, r"(?i)^#{1,6}\s*(关键词|keywords)\s*[:：-]?\s*", "")
    under = F.coalesce(null_if_blank(tail), F.get(all_lines, at), F.lit(""))
    chosen = F.when(at > 0, under).otherwise(F.regexp_extract(c, KEYWORD_INLINE, 1))
    return F.slice(dedupe_list(F.split(chosen, KEYWORD_GAP), "#*- "), 1, limit)


MENTION = rf"(?i)@(file|skill){NOT_WORD_AFTER}"
MENTION_VALUE = r"""(?is)\A@(file|skill)\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|["'].*|[^\s"']\S*)"""


def mentions(c: Column) -> Column:
    """`@file` and `@skill` mentions in order, with quoted or bare value."""
    pieces = F.filter(F.split(c, rf"(?={MENTION})"), lambda p: p.rlike(r"\A(?:" + MENTION + ")"))

    def one(piece: Column) -> Column:
        raw = F.regexp_extract(piece, MENTION_VALUE, 2)
        bare = F.when(
            raw.rlike(r"""\A("(?s:.*)"|'(?s:.*)')\z""") & (F.length(raw) > 1),
            F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1"),
        ).when(raw.rlike(r"""\A["']"""), F.substring(raw, 2, 2**30)).otherwise(raw)
        return F.struct(
            F.lower(F.regexp_extract(piece, MENTION_VALUE, 1)).alias("kind"),
            F.rtrim(bare, F.lit("，,;；")).alias("value"),
        )

    return F.filter(F.transform(pieces, one), lambda m: m["value"] != "")


def without_mentions(c: Column) -> Column:
    """The text with its mentions cut out and the gaps folded."""
    inner = MENTION_VALUE.replace(r"\A@", "@").replace("(file|skill)", rf"(file|skill){NOT_WORD_AFTER}")
    inner = inner.replace("""["'].*""", """["'](?:(?!@(?:file|skill)).)*""")
    cut = F.regexp_replace(c, inner, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[ \t]{2,}", " "), r" *\n *", "\n"))


# Volume and part markers with their order.
PART_NUMERALS = "一二三四五六七八九十"
_QUOTE_END = "[》」』]*"
PART_PATTERNS = (
    rf"^(.+?)\s*([（(](?:上|中|下|续|续一|续二|续三|[{PART_NUMERALS}])[)）]){_QUOTE_END}$",
    rf"^(.+?)\s*(上册|中册|下册|上篇|中篇|下篇){_QUOTE_END}$",
    rf"^(.+?)\s*(之[{PART_NUMERALS}]){_QUOTE_END}$",
    rf"^(.+?)\s*(第[{PART_NUMERALS}百]+[卷辑]){_QUOTE_END}$",
    r"(?i)^(.+?)\s*Part\s*(I{1,3}|IV|V|[1-9])\s*$",
    r"^(.+?)\s*([（(](?:[1-9]|I{1,3}|IV|V)[)）])\s*$",
)
PART_ORDER = {
    **{n: i for i, n in enumerate(PART_NUMERALS, 1)},
    "上": 1, "中": 2, "下": 3, "续": 98, "续一": 99, "续二": 100, "续三": 101,
}
ROMAN_ORDER = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def part_marker(c: Column) -> Column:
    """Struct of base title, marker and numeric order; NULL when there is no marker."""

    def split(s: Column) -> Column:
        return F.coalesce(*[
            F.when(s.rlike(p) & (F.length(F.regexp_extract(s, p, 1)) >= 2), F.struct(
                F.trim(F.regexp_extract(s, p, 1)).alias("base"), F.trim(F.regexp_extract(s, p, 2)).alias("marker")
            )) for p in PART_PATTERNS
        ])

    def order(bare: Column) -> Column:
        volume, numbered, halves = bare.rlike("^第.+[卷辑]$"), bare.rlike("^之."), bare.rlike("^[上中下].")
        key = (
            F.when(volume, F.regexp_replace(bare, "^第|[卷辑]$", ""))
            .when(numbered, F.substring(bare, 2, 9)).when(halves, F.left(bare, F.lit(1))).otherwise(bare)
        )
        return F.coalesce(
            F.try_element_at(_lookup(PART_ORDER), key),
            F.when(~(volume | numbered | halves), F.coalesce(
                bare.try_cast("int"), F.try_element_at(_lookup(ROMAN_ORDER), F.upper(bare))
            )),
        )

    folded = F.trim(F.regexp_replace(F.translate(c, "\u3000", " "), r"\s+", " "))
    return let(let(folded, split), lambda f: F.when(f.isNotNull(), F.struct(
        f["base"].alias("base"), f["marker"].alias("marker"),
        let(F.regexp_replace(f["marker"], "[（()）]", ""), order).alias("order"),
    )))


def part_base(c: Column) -> Column:
    """Title without its part marker."""
    return F.coalesce(part_marker(c)["base"], F.trim(F.regexp_replace(F.translate(c, "\u3000", " "), r"\s+", " ")))


def title_tag(c: Column, tag: str = "TITLE", max_chars: int = 80) -> Column:
    """Struct of the `[TAG]..[/TAG]` title in an answer and the answer without it."""
    pattern = rf"(?is)\[{tag}\](.*?)\[/{tag}\]"
    return F.struct(
        F.substring(fold_spaces(F.regexp_extract(c, pattern, 1)), 1, max_chars).alias("title"),
        F.regexp_replace(F.regexp_replace(c, pattern, ""), r"^\s+|\s+$", "").alias("clean"),
    )


VERDICT = T.StructType([
    T.StructField("recommended", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())),
])


def model_verdict(output: Column, n_candidates: Column) -> Column:
    """The outermost JSON object of an answer, index checked and confidence clamped to 0..1."""
    body = F.regexp_extract(output, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, VERDICT)
    index = F.coalesce(parsed["recommended"].try_cast("int"), F.lit(-1))
    confidence = F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.0))
    return F.struct(
        F.when((index >= 0) & (index < n_candidates), index).otherwise(-1).alias("recommended"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.trim(text_or_empty(parsed["reason"])).alias("reason"),
        F.filter(F.transform(F.coalesce(parsed["warnings"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda w: w != "")
        .alias("warnings"),
    )


IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".pdf", ".eps", ".svg", ".webp", ".gif", ".bmp", ".tif", ".tiff")


def figure_references(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct `\\includegraphics` target of a document."""
    pattern = r"\\includegraphics(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}"
    targets = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.replace(F.trim(x), F.lit("\\"), F.lit("/"))
    )
    return df.select(doc, F.explode(F.array_distinct(targets)).alias("raw"))


def missing_figures(references: DataFrame, images: DataFrame, doc: str = "doc_id", rel: str = "rel") -> DataFrame:
    """References that no image of the same document satisfies.

    A reference matches by path or base name, and without an extension also with
    each image extension: all candidate keys go through one equi join.
    """
    base = F.substring_index("raw", "/", -1)
    exact = F.array(F.col("raw"), base)
    guessed = F.array(*[F.concat(key, F.lit(e)) for key in (F.col("raw"), base) for e in IMAGE_EXTENSIONS])
    keyed = references.withColumn(
        "key", F.explode(F.array_distinct(F.when(base.rlike(r".\.[^.]+$"), exact).otherwise(F.concat(exact, guessed))))
    )
    names = images.select(doc, F.explode(F.array(F.col(rel), F.substring_index(rel, "/", -1))).alias("key")).distinct()
    found = keyed.join(names, [doc, "key"], "left_semi").select(doc, "raw").distinct()
    return references.join(found, [doc, "raw"], "left_anti")


def text_delta(event: Column) -> Column:
    """Text carried by one streamed event, NULL for other events."""
    kind = F.get_json_object(event, "$.type")
    return F.coalesce(
        F.when(kind == "stream_event", F.get_json_object(event, "$.event.delta.text")),
        F.when(kind == "content_block_delta", F.get_json_object(event, "$.delta.text")),
        F.when(kind.isin("assistant_delta", "text"), F.get_json_object(event, "$.text")),
    )


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: str, output: str, span: int = 4096) -> DataFrame:
    """Concatenate `value` by `order` within each key.

    Two steps, so that one very long key is first joined in `span`-sized runs
    on many tasks and only the runs meet in the end.
    """
    def joined(name: str, by: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(by).alias("o"), F.col(name).alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p["v"]), "")

    runs = df.groupBy(*keys, F.floor(F.col(order) / span).alias("_run")).agg(joined(value, order).alias("_part"))
    return runs.groupBy(*keys).agg(joined("_part", "_run").alias(output))


def assemble_deltas(events: DataFrame, session: str = "session_id", order: str = "seq", event: str = "event") -> DataFrame:
    """Streamed text per session in order; the final result event when no text was streamed."""
    typed = events.select(
        session, order, text_delta(F.col(event)).alias("_delta"),
        F.when(F.get_json_object(event, "$.type") == "result", F.get_json_object(event, "$.result")).alias("_result"),
    )
    streamed = ordered_concat(typed.filter("_delta is not null"), [session], order, "_delta", "_text")
    final = typed.groupBy(session).agg(F.max_by("_result", F.when(F.col("_result").isNotNull(), F.col(order))).alias("_last"))
    return final.join(streamed, session, "left").select(
        session, F.coalesce(null_if_blank(F.col("_text")), F.col("_last"), F.lit("")).alias("text")
    )


def inverted_abstract(index_json: Column) -> Column:
    """Abstract text from a word → positions object."""
    entries = F.map_entries(F.from_json(index_json, T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))))
    placed = F.flatten(F.transform(
        entries, lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))
    ))
    return F.trim(F.array_join(F.transform(F.sort_array(placed), lambda p: p["w"]), " "))
