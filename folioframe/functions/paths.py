"""Relative POSIX paths as Columns: parts, file classes, artifact locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, extensions and names with a meaning.
INTERNAL_DIR = ".library"
GENERATED_DIRS = ("parsed", "notes", "translations")
DOCUMENT_EXTENSIONS = (
    ".md", ".txt", ".tex", ".srt", ".vtt", ".pdf", ".doc", ".docx",
    ".ppt", ".pptx", ".xls", ".xlsx", ".csv", ".json", ".png", ".jpg",
    ".jpeg", ".webp", ".mp3", ".wav", ".m4a", ".mp4", ".mkv", ".mov",
)
TEXT_EXTENSIONS = (
    ".md", ".markdown", ".txt", ".tex", ".csv", ".json", ".yaml", ".yml",
    ".toml", ".ini", ".cfg", ".py", ".js", ".ts", ".tsx", ".jsx", ".html",
    ".css", ".xml", ".rst", ".srt", ".vtt", ".bib", ".sql", ".sh",
    ".ps1", ".bat", ".cmd", ".java", ".c", ".h", ".cpp", ".hpp", ".go", ".rs",
)
TEXT_NAMES = ("README", "LICENSE", "Makefile")
PRIVATE_PARTS = (
    ".git", INTERNAL_DIR, ".claude", ".ssh", ".aws", "__pycache__", ".pytest_cache", "node_modules",
)
PRIVATE_STEMS = (
    "cookie", "cookies", "credential", "credentials", "secret", "secrets", "token", "tokens",
    "password", "passwd", "apikey", "api_key", "private_key", "records_list",
)
PRIVATE_WORDS = (
    "cookie", "cookies", "credential", "credentials", "secret", "secrets", "token", "tokens",
    "password", "passwd", "apikey",
)
MAX_TEXT_BYTES = 8 * 1024 * 1024


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def parent(rel: Column) -> Column:
    """Folder part, empty at the root."""
    return F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)


def suffix(rel: Column) -> Column:
    """Extension with its dot; none for dot files."""
    return F.regexp_extract(name(rel), r"^.+(\.[^.]+)$", 1)


def stem(rel: Column) -> Column:
    return F.regexp_replace(name(rel), r"(?<=.)\.[^.]+$", "")


def depth(rel: Column) -> Column:
    return F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit("")))


def join(folder: Column, *rest: Column) -> Column:
    return F.concat_ws("/", F.when(folder != "", folder), *rest)


def ancestors(rel: Column) -> Column:
    """Every proper ancestor folder of a path, shallowest first."""
    p = parts(rel)
    return F.transform(
        F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"),
    )


def self_and_ancestors(rel: Column) -> Column:
    p = parts(rel)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))


def has_part(rel: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts(rel), F.array(*[F.lit(n) for n in names]))


def is_document(rel: Column) -> Column:
    return F.lower(suffix(rel)).isin(*DOCUMENT_EXTENSIONS)


def is_private(rel: Column) -> Column:
    """Paths that must not be read or written: secrets, key files, internal folders."""
    lowered = F.lower(rel)
    base, bare = name(lowered), stem(lowered)
    words = F.regexp_extract_all(bare, F.lit("([a-z0-9]+)"), 1)
    return (
        has_part(lowered, PRIVATE_PARTS)
        | base.startswith(".env")
        | base.isin("id_rsa", "id_ed25519")
        | bare.isin(*PRIVATE_STEMS)
        | F.arrays_overlap(words, F.array(*[F.lit(w) for w in PRIVATE_WORDS]))
        | (F.array_contains(words, "private") & F.array_contains(words, "key"))
    )


def is_text_file(rel: Column, size: Column, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    """Editable text of bounded size outside internal folders."""
    known = F.lower(suffix(rel)).isin(*TEXT_EXTENSIONS) | name(rel).isin(*TEXT_NAMES)
    return known & (size <= max_bytes) & ~has_part(rel, PRIVATE_PARTS)


def is_binary(content: Column) -> Column:
    """PDF, PNG or zip signature, or a NUL byte in the first 4096 bytes; empty counts as binary."""
    head = F.hex(F.substring(content, 1, 4096))
    return (
        (F.length(content) == 0)
        | head.rlike("^(25504446|89504E47|504B0304)")
        | head.rlike("^(?:[0-9A-F]{2})*?00")
    )


def is_latex_source(content: Column) -> Column:
    """Text that may be LaTeX: not empty, no PDF signature and no NUL in the first 2048 bytes."""
    head = F.hex(F.substring(content, 1, 2048))
    return (F.length(content) > 0) & ~head.rlike("^25504446") & ~head.rlike("^(?:[0-9A-F]{2})*?00")


def has_documentclass(content: Column) -> Column:
    """`\\documentclass` within the first 4096 bytes."""
    marker = "".join(f"{ord(ch):02X}" for ch in r"\documentclass")
    return F.hex(F.substring(content, 1, 4096)).rlike("^(?:[0-9A-F]{2})*?" + marker)


def safe_language(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(t != "", t).otherwise("translated")


def parse_dir(rel: Column) -> Column:
    return join(parent(rel), F.lit("parsed"), stem(rel))


def translation_path(rel: Column, language: Column, extension: Column) -> Column:
    dotted = F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension))
    return join(parent(rel), F.lit("translations"), F.concat(stem(rel), F.lit("."), safe_language(language), dotted))


def note_path(rel: Column, kind: Column) -> Column:
    safe = F.trim(F.regexp_replace(kind, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    safe = F.when(safe != "", safe).otherwise("summary")
    return join(parent(rel), F.lit("notes"), F.concat(stem(rel), F.lit("."), safe, F.lit(".md")))
