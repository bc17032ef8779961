"""Path normalisation and path predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ColumnOrName, basename, col, strip, suffix

# File-name words that mark personal or contractual papers, first match wins.
SENSITIVE_NAME_KEYWORDS = (
    "주민등록",
    "졸업증명",
    "계약서",
    "이력서",
    "여권",
    "통장",
    "급여",
    "연봉",
    "신분증",
    "가족관계",
    "개인정보",
    "사업자등록",
    "인감",
    "계좌",
)


def is_unc(path: ColumnOrName) -> Column:
    p = F.translate(F.coalesce(col(path), F.lit("")), "/", "\\")
    return p.startswith("\\\\") & ~p.startswith("\\\\?\\")


def normalize_path(path: ColumnOrName) -> Column:
    """Fold ``.``, ``..`` and repeated separators; network roots keep their two backslashes."""
    raw = strip(path)
    unc = is_unc(raw)
    backslashed = unc | raw.contains("\\")
    rooted = raw.rlike(r"^[/\\]")
    parts = F.filter(F.split(raw, r"[/\\]"), lambda x: (x != "") & (x != "."))

    def fold(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when((part == "..") & can_pop, popped)
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), fold)
    joined = F.when(backslashed, F.array_join(kept, "\\")).otherwise(F.array_join(kept, "/"))
    root = (
        F.when(unc, F.lit("\\\\"))
        .when(rooted & backslashed, F.lit("\\"))
        .when(rooted, F.lit("/"))
        .otherwise(F.lit(""))
    )
    return F.when(raw == "", raw).when((root == "") & (joined == ""), F.lit(".")).otherwise(F.concat(root, joined))


def fold_path(path: ColumnOrName) -> Column:
    """Key for case-insensitive path comparison."""
    return F.lower(F.translate(col(path), "\\", "/"))


def passes_file_filters(
    path: ColumnOrName,
    length: ColumnOrName,
    extensions: Sequence[str],
    min_bytes: int = 0,
    max_bytes: int = 2**62,
) -> Column:
    allowed = suffix(path).isin(*[e.lower() for e in extensions]) if extensions else F.lit(False)
    return F.coalesce(allowed & col(length).between(min_bytes, max_bytes), F.lit(False))


def in_excluded_dir(path: ColumnOrName, names: Sequence[str]) -> Column:
    """True if any path component, the file name included, is an excluded name."""
    if not names:
        return F.lit(False)
    parts = F.split(F.lower(col(path)), r"[/\\]")
    return F.arrays_overlap(parts, F.array(*[F.lit(n.lower()) for n in names]))


def under_root(path: ColumnOrName, root: str) -> Column:
    path = col(path)
    root = root.rstrip("/") or "/"
    return (path == root) | path.startswith(root if root == "/" else root + "/")


def path_allowed(path: ColumnOrName, roots: Sequence[str], enforce: bool = True) -> Column:
    """No roots, or the check switched off, allows every path."""
    if not enforce or not roots:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [under_root(path, r) for r in roots])


def allowlist_roots(*sources: DataFrame) -> DataFrame:
    """Union of ``(root, ord)`` tables, first spelling kept where roots differ only in case."""
    tagged = [s.select("root", F.lit(i).alias("source"), "ord") for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, tagged)
    return (
        merged.groupBy(fold_path("root").alias("folded"))
        .agg(
            F.min_by("root", F.struct("source", "ord")).alias("root"),
            F.min(F.struct("source", "ord")).alias("position"),
        )
        .select("root", "position.source", "position.ord")
    )


def parent_depth(path: ColumnOrName, roots: Sequence[str]) -> Column:
    """Directories between the nearest root above the file and the file; null outside all roots."""
    from .text import dirname

    parent = dirname(path)

    def below(root: str) -> Column:
        base = root.rstrip("/")
        rest = F.substring(parent, F.lit(len(base) + 1), F.length(parent))
        depth = F.size(F.filter(F.split(rest, "/"), lambda x: x != ""))
        return F.when(under_root(parent, root), depth)

    depths = [below(r) for r in roots]
    if not depths:
        return F.lit(None).cast("int")
    return depths[0] if len(depths) == 1 else F.least(*depths)


def sensitive_keyword(path: ColumnOrName, keywords: Sequence[str] = SENSITIVE_NAME_KEYWORDS) -> Column:
    """First keyword of the list found in the file name, or null."""
    name = F.lower(basename(path))
    return F.coalesce(*[F.when(name.contains(k.lower()), F.lit(k)) for k in keywords])
