"""Security levels P1 (most sensitive) to P4 and their display labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col, strip

LEVELS = ("P1", "P2", "P3", "P4")
# The more sensitive, the higher.
RANK = {level: rank for rank, level in enumerate(reversed(LEVELS))}
LEVEL_PATTERN = r"^P[1-4]\z"

# Default labels.
DEFAULT_LABELS = {"P1": "매우 민감", "P2": "민감", "P3": "내부", "P4": "일반"}


def clean_level(level: ColumnOrName) -> Column:
    return F.upper(strip(F.coalesce(col(level), F.lit(""))))


def level_rank(level: ColumnOrName) -> Column:
    """3 for P1 down to 0 for P4; -1 for anything else."""
    return F.coalesce(F.try_element_at(_literal_map(RANK, "int"), clean_level(level)), F.lit(-1))


def _literal_map(values: Mapping, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def level_of(rank: ColumnOrName) -> Column:
    levels = _literal_map({rank: level for level, rank in RANK.items()}, "string")
    return F.coalesce(F.try_element_at(levels, col(rank)), F.lit(""))


def higher(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The more sensitive of two levels; an unknown code gives way to a known one."""
    known = level_of(F.greatest(level_rank(a), level_rank(b)))
    return F.when(known == "", clean_level(b)).otherwise(known)


def format_level(level: ColumnOrName, labels: Mapping[str, str] | None = None) -> Column:
    """``label (P1)``; an unknown code as it is, an empty one as an empty text."""
    own = {k.strip().upper(): v.strip() for k, v in (labels or {}).items()}
    shown = {**DEFAULT_LABELS, **{k: v for k, v in own.items() if k and v}}
    code = clean_level(level)
    label = F.try_element_at(_literal_map(shown, "string"), code)
    return F.coalesce(F.concat(label, F.lit(" ("), code, F.lit(")")), code)


def is_sensitive(level: ColumnOrName) -> Column:
    return F.coalesce(col(level).isin("P1", "P2"), F.lit(False))
