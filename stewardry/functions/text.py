"""File-name and text expressions. All of them are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# White space and word classes, spelled out because `\s` and `\w` differ between
# regex engines.
SPACE = r"[\s\x1c-\x1f]"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"

# Suffixes that mark a copy or a version of the same file.
COPY_PAREN = r"\s*\(\d+\)\s*$"
COPY_EN = r"\s*-\s*copy\s*$"
COPY_KO = r"\s*-\s*복사본\s*$"
TRAILING_VERSION = r"[_\s.-]+(?:v|ver|version|r)[.\s_-]?\d+\s*$"
TRAILING_LABEL = (
    r"[_\s.-]+(?:final|draft|complete|done|edit|"
    r"최종|최종본|수정|수정본|완료|임시|제안|본안|확정|편집)\d*\s*$"
)
TRAILING_NUMBER = r"[_\s.-]+\d{1,4}\s*$"
STEM_ROUNDS = 6


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` names it. A plain expression
    would be computed once for each mention, which multiplies from step to step of a long text."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def one_line(c: ColumnOrName) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), rf"(?U){SPACE}+", " "))


def has_text(c: ColumnOrName) -> Column:
    return F.coalesce(col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def clip(c: ColumnOrName, size: int) -> Column:
    """At most ``size`` characters, the last three of a longer text being dots."""
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 3), F.lit("..."))).otherwise(c)


def basename(path: ColumnOrName) -> Column:
    return F.regexp_extract(col(path), r"[^/\\]*$", 0)


def dirname(path: ColumnOrName) -> Column:
    path = col(path)
    parent = F.regexp_replace(path, r"[/\\][^/\\]*$", "")
    return (
        F.when(~path.rlike(r"[/\\]"), F.lit(""))
        .when(parent == "", F.substring(path, 1, 1))
        .otherwise(parent)
    )


def extension(name: ColumnOrName) -> Column:
    """With its dot; leading dots do not start an extension."""
    return F.regexp_extract(col(name), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def suffix(path: ColumnOrName) -> Column:
    """Lower-cased extension used by the file filters (a trailing dot is none)."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]+)$", 1))


def _drop_extension(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def _strip_patterns(c: Column, *patterns: str) -> Column:
    for pattern in patterns:
        c = F.regexp_replace(c, f"(?iU){pattern}", "")
    return c


def lineage_group_key(name: ColumnOrName) -> Column:
    """Key shared by `report.txt`, `report (1).txt` and `report - copy.txt`."""
    name = strip(name)
    base = _strip_patterns(_drop_extension(name), COPY_PAREN, COPY_EN, COPY_KO)
    return F.lower(F.concat(base, extension(name)))


def normalize_stem(name: ColumnOrName) -> Column:
    """Stem of a file name without copy, version, label and short numeric tails."""
    stem = strip(_drop_extension(col(name)))
    stem = _strip_patterns(stem, COPY_PAREN, COPY_EN, COPY_KO)
    for _ in range(STEM_ROUNDS):
        stem = _strip_patterns(stem, TRAILING_VERSION, TRAILING_LABEL, TRAILING_NUMBER)
    stem = F.regexp_replace(stem, r"^[ _.\-]+|[ _.\-]+$", "")
    return F.lower(F.regexp_replace(stem, r"(?U)[_\s.\-]+", "_"))


def summary_tokens(summary: ColumnOrName) -> Column:
    """Distinct lower-cased words of two characters or more, in sorted order."""
    lowered = F.lower(F.coalesce(col(summary), F.lit("")))
    return F.sort_array(F.array_distinct(F.regexp_extract_all(lowered, F.lit(WORD_TOKEN), F.lit(0))))


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Overlap of two arrays of distinct items; 0 where either is empty."""
    a, b = col(a), col(b)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / union.cast("double")
    )


def sanitize_cell(c: ColumnOrName) -> Column:
    return one_line(F.replace(col(c), F.lit("|"), F.lit("\\|")))


def label_safe(c: ColumnOrName, size: int = 80) -> Column:
    return clip(F.translate(col(c), '"\n[]', "' ()"), size)


def tags_cell(tags: ColumnOrName, count: int = 8) -> Column:
    return F.array_join(F.slice(F.coalesce(col(tags), F.array()), 1, count), ", ")


def tag_set(tags: ColumnOrName) -> Column:
    trimmed = F.transform(F.coalesce(col(tags), F.array()), lambda t: F.lower(strip(t)))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def sha256_hex(c: ColumnOrName) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def sha_prefix(sha: ColumnOrName, size: int = 12) -> Column:
    return F.substring(F.trim(col(sha)), 1, size)


def numbered_grams(c: ColumnOrName, size: int) -> Column:
    """Every substring of ``size`` characters with its occurrence number, so that the
    intersection of two such arrays is the intersection of the multisets."""
    c = col(c)
    count = F.length(c) - (size - 1)
    grams = F.when(
        count >= 1,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(
        grams,
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")
        ),
    )


def distinct_grams(c: ColumnOrName, size: int) -> Column:
    """The distinct substrings of ``size`` characters, in one pass: ``substring`` would walk the text up to
    each of them. No text has none."""
    every = F.regexp_extract_all(col(c), F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))
