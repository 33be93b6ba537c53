"""Text clean-up, title keys and small text predicates as Columns.

Character classes are spelled out (`[\\p{L}\\p{N}_]`) because the JVM's `\\w`
and `\\b` are ASCII-only and would treat accented or CJK letters as gaps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line boundaries, letters and stop words.
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
RARE_BREAKS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"  # all but the line feed
BLANKS = " \t\n\u000b\u000c\r"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("\u00ad", ""))
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with",
    "by", "at", "from", "as", "is", "are", "via", "into", "using", "between",
    "its", "their", "his", "her", "this", "that", "these", "those", "we",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_blank(c: Column) -> Column:
    """Empty and blank strings count as missing everywhere in this package."""
    return F.when(F.trim(c) != "", c)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL if it is blank; the text is searched once."""
    return let(F.regexp_extract(c, pattern, group), null_if_blank)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of `chars` from both ends."""
    return F.trim(c, F.lit(chars))


def lines(c: Column) -> Column:
    rare = reduce(or_, [c.contains(s) for s in RARE_BREAKS])
    return F.when(rare, F.split(c, LINE_BREAK)).otherwise(F.split(c, "\n"))


def filled_lines(c: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(lines(c), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


def fold_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def clean_text(c: Column) -> Column:
    """Ideographic and no-break spaces become spaces, zero-width ones vanish, runs fold."""
    return F.trim(F.regexp_replace(F.translate(c, "\u3000\u00a0\u200b", "  "), r"\s+", " "))


def unfold_ligatures(c: Column) -> Column:
    for glyph, plain in LIGATURES:
        c = F.replace(c, F.lit(glyph), F.lit(plain))
    return c


def visible(c: Column, signs: str = "\u200b\ufeff\u00ad") -> Column:
    """The text without invisible characters; one that has none is not translated."""
    there = reduce(or_, [c.contains(s) for s in signs])
    return F.when(there, F.translate(c, signs, "")).otherwise(c)


def heal_identifiers(c: Column) -> Column:
    """Drop invisible characters and rejoin a DOI that was broken after its prefix."""
    return F.regexp_replace(visible(c), r"(?i)(10\.\d{4,9}/)\s+(?=[A-Z0-9])", "$1")


def title_key(c: Column) -> Column:
    """Letters and digits in lower case, everything else folded to one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def squashed_title(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def word_folded_title(c: Column) -> Column:
    """Folds ASCII punctuation only; every character from U+0080 up is kept."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\x{80}-\x{10FFFF}]+", " "))


def content_words(c: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more, without stop words."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9]+)"), 1), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def has_cjk(c: Column) -> Column:
    return c.rlike("[\u4e00-\u9fff]")


def may_have_cjk(c: Column, n: int = 1) -> Column:
    """False only if there are fewer than n (one or more) Chinese characters: each takes three bytes, so most texts are settled by their sizes."""
    return (F.octet_length(c) >= F.length(c) + 2 * n) & has_cjk(c)


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[\u4e00-\u9fff]"))


def language_tag(c: Column) -> Column:
    return F.when(has_cjk(c), F.lit("zh")).otherwise(F.lit("en"))


def is_letter_spaced_header(c: Column) -> Column:
    """All capitals, eight characters or more, over a quarter of them spaces."""
    all_upper = (F.upper(c) == c) & (F.lower(c) != c)
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return all_upper & (F.length(c) >= 8) & (spaces / F.length(c) > 0.25)


def dedupe_list(arr: Column, strip: str = " ") -> Column:
    """Strip, drop blanks and repeats (case-insensitive); the first spelling stays."""
    stripped = F.filter(F.transform(arr, lambda x: strip_chars(F.trim(x), strip)), lambda x: x != "")

    def firsts(items: Column) -> Column:
        return let(F.transform(items, F.lower), lambda keys: F.filter(
            items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1
        ))

    return let(stripped, firsts)


def summary_line(c: Column, min_chars: int = 20, max_chars: int = 240) -> Column:
    """First line longer than `min_chars` after its heading marks, cut to `max_chars`."""
    bare = F.transform(lines(c), lambda x: F.trim(F.ltrim(F.trim(x), F.lit("#>"))))
    return F.substring(F.get(F.filter(bare, lambda x: F.length(x) > min_chars), F.lit(0)), 1, max_chars)


def fallback_title(output: Column, hint: Column, default: str = "Untitled") -> Column:
    """First line of 4 to 60 characters, else the folded hint, else a default."""
    bare = F.transform(lines(output), lambda x: F.trim(F.regexp_replace(x, r"^[#>*\-\s]+", "")))
    first = F.get(F.filter(bare, lambda x: F.length(x).between(4, 60)), F.lit(0))
    return F.coalesce(first, null_if_blank(F.substring(fold_spaces(hint), 1, 60)), F.lit(default))


def safe_title(c: Column, max_chars: int = 80, default: str = "Untitled") -> Column:
    return F.coalesce(null_if_blank(F.substring(fold_spaces(c), 1, max_chars)), F.lit(default))


def strip_latex(c: Column) -> Column:
    """LaTeX comments, commands and braces removed, blanks folded."""
    c = F.regexp_replace(c, r"(?m)%.*$", "")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ")
    return fold_spaces(F.translate(c, "{}\\", "   "))


def latex_body(c: Column) -> Column:
    """Plain text from `\\begin{document}` on (from the start when there is none)."""
    at = F.locate(r"\begin{document}", c)
    return strip_latex(F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c))


def content_key(content: Column, namespace: Column) -> Column:
    """20 hex digits over namespace, a NUL and the content."""
    return F.left(F.sha2(F.concat(namespace, F.lit("\0"), content), 256), F.lit(20))


def front_matter(c: Column) -> Column:
    """`key: value` lines between the opening and closing `---` fences, as a map."""
    block = F.regexp_extract(c, r"\A---[^\n]*\n((?s:.*?)\n?)^---$".replace("^---$", r"(?m:^---$)"), 1)
    pairs = F.filter(F.split(block, r"\n"), lambda x: x.contains(":"))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            strip_chars(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "\"'").alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def front_matter_body(c: Column) -> Column:
    """What follows the closing fence; the whole text when there is no header."""
    return F.regexp_replace(c, r"\A---[^\n]*\n(?s:.*?)(?m:^---$)\n?", "")


def first_paragraph(c: Column, max_chars: int = 300) -> Column:
    chunks = F.split(c, r"\n\s*\n")
    folded = F.transform(
        chunks,
        lambda p: F.array_join(
            F.transform(filled_lines(p), lambda x: F.trim(strip_chars(x, "# "))), " "
        ),
    )
    return F.substring(F.get(F.filter(folded, lambda x: x != ""), F.lit(0)), 1, max_chars)
