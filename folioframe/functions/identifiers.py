"""DOI, arXiv, ISBN and year columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, heal_identifiers, let, null_if_blank, visible

# Identifier patterns. Each first asks for a sign that it must begin with, as looking behind every letter is dear.
DOI = r"(?=10\.)(?i)" + NOT_WORD_BEFORE + r"(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ARXIV = (
    r"(?i)" + NOT_WORD_BEFORE + r"(?:arXiv\s*:\s*)?"
    r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?" + NOT_WORD_AFTER
)
ISBN = (
    r"(?=[0123456789Ii])(?i)" + NOT_WORD_BEFORE + r"(?:ISBN(?:-1[03])?\s*[:：]?\s*)?"
    r"((?:97[89][ -]?)?[0-9][0-9Xx -]{8,16}[0-9Xx])" + NOT_WORD_AFTER
)
YEAR = r"(?=[12])(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
ARXIV_NUMBER = r"[./][0123456789]{4}"  # a part of every arXiv id
TEXT_CUT = r"(?i)摘要|关键词|abstract"


def normalize_doi(c: Column) -> Column:
    c = F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    c = F.regexp_replace(c, r"(?i)^doi\s*:\s*", "")
    return null_if_blank(F.lower(F.regexp_replace(c, r"[.,;)]+$", "")))


def normalize_arxiv(c: Column) -> Column:
    c = F.regexp_replace(F.trim(c), r"(?i)^arxiv\s*:\s*", "")
    return null_if_blank(F.regexp_replace(c, r"(?i)v\d+$", ""))


def normalize_isbn(c: Column) -> Column:
    return null_if_blank(F.upper(F.regexp_replace(c, "[^0-9Xx]", "")))


def first_doi(c: Column) -> Column:
    # Broken or not, a DOI has its prefix: other texts are not healed.
    doi = lambda v: let(F.regexp_extract(heal_identifiers(v), DOI, 1), normalize_doi)
    return let(visible(c), lambda v: F.when(v.contains("10."), doi(v)))


def all_dois(c: Column) -> Column:
    """Every DOI mention, in order; explode for one row per mention."""
    return F.transform(F.regexp_extract_all(heal_identifiers(c), F.lit(DOI), 1), normalize_doi)


def first_arxiv_id(c: Column) -> Column:
    return F.when(c.rlike(ARXIV_NUMBER), let(F.regexp_extract(c, ARXIV, 1), normalize_arxiv))


def first_isbn(c: Column) -> Column:
    """First candidate with 10 or 13 digits; the check digit is not verified."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(ISBN), 1), normalize_isbn)
    return F.get(F.filter(digits, lambda d: F.length(d).isin(10, 13)), F.lit(0))


def leading_year(c: Column) -> Column:
    """First four digits found, as an integer."""
    return F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")


def _in_range(year: Column, last: Column | None) -> Column:
    last = last if last is not None else F.year(F.current_date()) + 1
    return F.when((year >= 1900) & (year <= last), year)


def plausible_year(c: Column, last: Column | None = None) -> Column:
    """First 19xx/20xx in the value, when not later than next year."""
    return _in_range(F.regexp_extract(c.cast("string"), r"((?:19|20)\d{2})", 1).try_cast("int"), last)


def year_of_date(c: Column) -> Column:
    """A free-standing 1xxx or 2xxx in a date string."""
    return null_if_blank(F.regexp_extract(c, NOT_WORD_BEFORE + r"([12]\d{3})" + NOT_WORD_AFTER, 1))


def year_from_text(text: Column, title: Column, probe_chars: int | None = None, last: Column | None = None) -> Column:
    """First plausible year in the title or the text (at most `probe_chars` of it) that precedes the abstract."""
    body = F.get(F.split(text, TEXT_CUT, 2), F.lit(0))
    probe = F.concat(title, F.lit(" "), body if probe_chars is None else F.substring(body, 1, probe_chars))
    years = F.transform(F.regexp_extract_all(probe, F.lit(YEAR), 1), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: _in_range(y, last).isNotNull()), F.lit(0))
