"""Scan detection, supplement detection, rule tags and small checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import identifiers
from folioframe.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, RARE_BREAKS, dedupe_list, fold_spaces, let, lines, null_if_blank, text_or_empty

# Thresholds, patterns and tag rules.
PDF_OBJECT = rf"/(?:Type|Length|Filter|Font|XObject){NOT_WORD_AFTER}"
SUPPLEMENT_NAME = (
    r"(?i)(?:^|[._\-\s])(supp(?:lement(?:ary)?)?|supporting[._\-\s]*info(?:rmation)?|si|esm|mmc|suppmat)(?:$|[._\-\s\d])"
)
SUPPLEMENT_HEADER = (
    rf"(?im)^\s*(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)(?:\s+(?:for|to){NOT_WORD_AFTER}|\s*$)"
)
SUPPLEMENT_FOR = (
    r"(?is)(?:supporting|supplementary|supplemental)\s+(?:information|material(?:s)?)\s+(?:for|to)\s*[:\-]?\s*([^\n]{8,300})"
)
MAIN_MARKERS = (
    "abstract:", "\nabstract\n", "\n■ introduction", "\nintroduction\n",
    "received:", "revised:", "published:", "article\npubs.", "journal of ",
)
ASSOCIATED = r"(?is)associated\s+content.{0,220}(?:supporting|supplementary)\s+information"
S_HEADING = r"(?im)^\s*\*?s\s+supporting\s+information\s*$"
NOT_A_TITLE = ("doi:", "http://", "https://", "authors:", "author:", "affiliation", "abstract", "contents")
INSTITUTION = rf"(?i){NOT_WORD_BEFORE}(university|institute|department|laboratory|college|school){NOT_WORD_AFTER}"
TAG_RULES: dict[str, tuple[str, ...]] = {
    "AI": ("artificial intelligence", "machine learning", "deep learning", "neural network", "transformer", "llm",
           "large language model", "人工智能", "机器学习", "深度学习"),
    "NLP": ("natural language processing", "language model", "nlp", "自然语言处理"),
    "CV": ("computer vision", "image recognition", "vision transformer", "计算机视觉", "图像识别"),
    "Robotics": ("robot", "robotics", "机器人"),
    "Biology": ("biology", "protein", "genome", "cell", "生物", "蛋白", "基因"),
    "Medicine": ("clinical", "patient", "medical", "disease", "医学", "临床", "疾病"),
    "Methods": ("method", "methodology", "algorithm", "framework", "方法", "算法", "框架"),
    "Review": ("review", "survey", "meta-analysis", "综述", "元分析"),
}


def looks_scanned(c: Column, sample_chars: int | None = None) -> Column:
    """Text too poor to use: the file needs OCR. Judged on the whole text, or on its first `sample_chars` characters."""
    sample = text_or_empty(c) if sample_chars is None else F.substring(text_or_empty(c), 1, sample_chars)
    words = F.regexp_extract_all(sample, F.lit("([A-Za-z一-鿿]{3,})"), 1)
    n_words = F.size(words)
    joined = F.length(F.array_join(words, " "))
    unprintable = F.regexp_count(sample, F.lit(r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}"))
    ratio = 1 - unprintable / F.greatest(F.length(sample), F.lit(1))
    noise = F.regexp_count(sample, F.lit(PDF_OBJECT))
    return (F.trim(sample) == "") | (joined < 700) | (ratio < 0.82) | ((noise > 25) & (n_words < 120))


def pages_look_scanned(pages: DataFrame, doc: str = "doc_id", text: str = "text", per_page: int = 80) -> DataFrame:
    """Page variant: fewer than 80 characters per page on average."""
    return pages.groupBy(doc).agg(
        (F.sum(F.length(F.trim(text))) < per_page * F.count(F.lit(1))).alias("scanned")
    )


def supplement_relation(metadata_json: Column) -> Column:
    """DOI of an is-supplement-to relation in a registry record."""
    relation = F.coalesce(F.get_json_object(metadata_json, "$.relation"), F.get_json_object(metadata_json, "$.relations"))
    entries = F.map_entries(F.from_json(relation, "map<string,string>"))
    ours = F.filter(entries, lambda e: F.lower(F.replace(e["key"], F.lit("_"), F.lit("-"))).isin("is-supplement-to", "issupplementto"))
    keyed = r'"(?:id|identifier|DOI|doi)"\s*:\s*"([^"]*)"'

    def dois(e: Column) -> Column:
        v = e["value"]
        return F.when(v.rlike(keyed), F.regexp_extract_all(v, F.lit(keyed), 1)).otherwise(
            F.split(F.regexp_replace(v, r'[\[\]"]', ""), r"\s*,\s*")
        )

    normal = F.transform(F.flatten(F.transform(ours, dois)), identifiers.normalize_doi)
    return F.get(F.filter(normal, lambda d: d.startswith("10.")), F.lit(0))


def detect_supplement(
    df: DataFrame, text: str = "text", filename: str | None = None, relation: str | None = None,
    extracted_doi: str | None = None, header_lines: int | None = None, title_lines: int | None = None,
) -> DataFrame:
    """Additive evidence that a document is supplementary material.

    Adds is_supplement, confidence, label, parent_doi, parent_title and reasons.
    The header is looked for in the first `header_lines` lines and the parent's
    title in `title_lines` lines after it; without these limits in all lines.
    """
    source = text_or_empty(F.col(text))
    name = F.coalesce(F.col(filename), F.lit("")) if filename else F.lit("")
    link = null_if_blank(F.col(relation)) if relation else F.lit(None).cast("string")
    own_doi = identifiers.normalize_doi(F.col(extracted_doi)) if extracted_doi else F.lit(None).cast("string")
    if header_lines is None:
        first = F.when(reduce(or_, [source.contains(s) for s in RARE_BREAKS]), F.array_join(lines(source), "\n")).otherwise(source)
    else:
        first = F.array_join(F.slice(lines(source), 1, header_lines), "\n")
    # The patterns are tried only where their words occur.
    df = df.withColumns({"_first": first, "_low": F.lower(source)})
    lower = F.col("_low")
    titled = lower.contains("supporting") | lower.contains("supplement")
    df = df.withColumn("_strong", titled & F.col("_first").rlike(SUPPLEMENT_HEADER))
    named = F.trim(fold_spaces(F.when(titled, F.regexp_extract("_first", SUPPLEMENT_FOR, 1)).otherwise("")), F.lit(" :-"))
    named = F.trim(F.get(F.split(named, rf"(?i){NOT_WORD_BEFORE}Authors?\s*:", 2), F.lit(0)))
    df = df.withColumn("_named", F.when(F.length(named) >= 8, F.left(named, F.lit(300))))
    # Without "for <title>" the first fitting line after the header is the parent's title.
    header = F.regexp_extract("_first", r"(?s)\A.*?" + SUPPLEMENT_HEADER, 0)
    at = F.length(header) - F.length(F.replace(header, F.lit("\n"), F.lit("")))
    following = F.transform(F.slice(lines(F.col("_first")), at + 2, F.size(lines(F.col("_first"))) if title_lines is None else F.lit(title_lines)), lambda x: F.trim(fold_spaces(x), F.lit(" :-")))

    def fits(x: Column) -> Column:
        low = F.lower(x)
        commas = F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
        labelled = low.contains(NOT_A_TITLE[0])
        for token in NOT_A_TITLE[1:]:
            labelled = labelled | low.contains(token)
        return F.length(x).between(8, 300) & ~labelled & ~x.rlike(INSTITUTION) & ~((commas >= 3) & (F.size(F.split(x, " ")) < 18))

    df = df.withColumn("_after", F.when(
        F.col("_strong") & F.col("_named").isNull(), F.get(F.filter(following, fits), F.lit(0))
    ))
    df = df.withColumn("_markers", sum((F.when(lower.contains(m), 1).otherwise(0) for m in MAIN_MARKERS), F.lit(0)))
    evidence = {
        "metadata relation": (link.isNotNull(), 0.9),
        "file name": (F.regexp_replace(name, r"(?<=.)\.[^.]+$", "").rlike(SUPPLEMENT_NAME), 0.45),
        "header": (F.col("_strong"), 0.65),
        "header names the parent": (F.col("_named").isNotNull(), 0.15),
        "line after the header": (F.col("_after").isNotNull(), 0.10),
        "main article structure": (F.col("_markers") >= 2, -0.55),
        "one main article marker": (F.col("_markers") == 1, -0.20),
        "associated content": (lower.contains("associated") & source.rlike(ASSOCIATED), -0.35),
        "heading beside an abstract": (
            lower.contains("supporting") & F.col("_first").rlike(S_HEADING) & F.lower("_first").contains("abstract:") & ~F.col("_strong"), -0.25
        ),
    }
    df = df.withColumn("_hits", F.array(*[F.when(test, F.lit(why)) for why, (test, _) in evidence.items()]))
    weights = list(w for _, w in evidence.values())
    score = sum((F.when(F.get("_hits", F.lit(i)).isNotNull(), w).otherwise(0.0) for i, w in enumerate(weights)), F.lit(0.0))
    df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))))
    df = df.withColumn("is_supplement", link.isNotNull() | (F.col("confidence") >= 0.65))
    return df.withColumns({
        "label": F.when(~F.col("is_supplement"), "primary").when(F.col("confidence") >= 0.85, "supplement-high")
        .when(F.col("confidence") >= 0.65, "supplement-medium").otherwise("supplement-low"),
        "parent_title": F.coalesce("_named", "_after"),
        "parent_doi": F.coalesce(link, F.when(F.col("is_supplement"), own_doi)),
        "reasons": F.array_compact("_hits"),
    }).drop("_first", "_low", "_strong", "_named", "_after", "_markers", "_hits")


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def rule_tags(c: Column, rules: dict[str, tuple[str, ...]] | None = None, limit: int = 8) -> Column:
    """Tags by how often their words occur, most frequent first."""

    def ranked(low: Column) -> Column:
        scored = F.array(*[
            F.struct((-sum((occurrences(low, w.lower()) for w in words), F.lit(0))).alias("n"), F.lit(tag).alias("tag"))
            for tag, words in (rules or TAG_RULES).items()
        ])
        hits = F.filter(F.sort_array(scored), lambda s: s["n"] < 0)
        return F.slice(F.transform(hits, lambda s: s["tag"]), 1, limit)

    return let(F.lower(c), ranked)


def merge_tags(existing: Column, added: Column) -> Column:
    return dedupe_list(F.concat(existing, added), "#*- ")


# Protection tokens, markup and letters.
TOKEN = r"\[\[KEEP_\d{6}\]\]"
MARKUP = r"[|:#>*_~\-+=`\[\](){}\\/\d.,;!?%\s]+"
PROSE_LETTER = "[A-Za-zÀ-ɏͰ-ϿЀ-ӿ一-鿿]"


def has_prose(c: Column) -> Column:
    """Letters are left once tokens and markup are gone."""
    return F.regexp_replace(F.regexp_replace(c, TOKEN, ""), MARKUP, "").rlike(PROSE_LETTER)


def tokens_intact(before: Column, after: Column) -> Column:
    """Both texts hold the same tokens, however ordered."""
    def bag(c: Column) -> Column:
        return F.sort_array(F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN), 0))

    return bag(before) == bag(after)


def action_status(actions: DataFrame, inventory: DataFrame, rel: str = "rel") -> DataFrame:
    """complete / stale / running / error / none per (file, category).

    `actions` has rel, category, status and outputs; an action is complete when
    it is done and all its outputs are in the inventory.
    """
    outputs = actions.filter("status = 'done'").select(rel, "category", F.explode("outputs").alias("_out"))
    present = inventory.select(F.col(rel).alias("_out")).distinct().withColumn("_there", F.lit(True))
    complete = outputs.join(present, "_out", "left").groupBy(rel, "category").agg(
        F.bool_and(F.coalesce("_there", F.lit(False))).alias("_complete")
    )
    status = (
        F.when(F.col("_complete"), "complete").when(F.col("status") == "done", "stale")
        .when(F.col("status").isin("running", "error"), F.col("status")).otherwise("none")
    )
    return actions.join(complete, [rel, "category"], "left").select(rel, "category", status.alias("state"))


__all__ = [
    "action_status", "detect_supplement", "has_prose", "looks_scanned", "merge_tags", "pages_look_scanned",
    "rule_tags", "supplement_relation", "tokens_intact",
]
