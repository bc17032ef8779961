"""Periodic documents: which of them are missing in the current period."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PatternError, compiled_pattern
from ..functions.text import ColumnOrName, basename, col
from ..functions.times import as_timestamp, in_period


@dataclass(frozen=True)
class CadenceRule:
    id: str
    pattern: str
    label: str = ""
    cadence: str = "weekly"
    watch_subdir: str = ""

    @property
    def title(self) -> str:
        return self.label.strip() or self.id.strip()


def _glob_to_regex(pattern: str) -> str:
    """Whole-name match of a glob, in Java syntax."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2 + pattern.startswith("!", i + 1)) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            chars = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{chars}]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def name_matches(pattern: str, name: ColumnOrName) -> Column:
    """A pattern with ``*``, ``?``, ``[`` or ``]`` is a glob for the whole name; any other is a
    regular expression found anywhere, or plain text where it is not a valid one."""
    stated, name = (pattern or "").strip(), col(name)
    if set(stated) & set("*?[]"):
        return F.lower(name).rlike(_glob_to_regex(stated.lower()))
    try:
        return name.rlike(compiled_pattern(stated, "iUd")) if stated else F.lit(False)
    except PatternError:
        return F.lower(name).contains(stated.lower())


def evaluate_cadence(files: DataFrame, rules: Sequence[CadenceRule], as_of: datetime | str) -> DataFrame:
    """``ord, id, label, status, latest_path, message`` of every rule.

    The rules become conditional aggregates of one pass over the files; nothing is joined.
    """
    if not rules:
        raise ValueError("no cadence rules")
    seen = F.coalesce("last_analyzed_utc", "last_checked_utc")
    found = []
    for i, rule in enumerate(rules):
        hit = name_matches(rule.pattern, basename("path")) & in_period(seen, as_of, rule.cadence)
        if rule.watch_subdir.strip():
            hit = hit & F.translate("path", "\\", "/").contains(rule.watch_subdir.strip().replace("\\", "/"))
        newest = F.struct(seen.alias("t"), (-F.col("ord")).alias("o"), F.col("path").alias("path"))
        found.append(F.max(F.when(hit, newest)).alias(f"r{i}"))
    row = files.agg(*found)

    def result(i: int, rule: CadenceRule) -> Column:
        path = F.col(f"r{i}.path")
        return F.struct(
            F.lit(i).alias("ord"),
            F.lit(rule.id.strip()).alias("id"),
            F.lit(rule.title).alias("label"),
            F.when(path.isNotNull(), "ok").otherwise("miss").alias("status"),
            F.coalesce(path, F.lit("")).alias("latest_path"),
            F.when(path.isNotNull(), F.concat(F.lit(f"{rule.title}: found "), basename(path)))
            .otherwise(F.lit(f"{rule.title}: not found (pattern={rule.pattern.strip()})"))
            .alias("message"),
        )

    return row.select(F.explode(F.array(*[result(i, r) for i, r in enumerate(rules)])).alias("r")).select("r.*")


def cadence_log(results: DataFrame, logged: DataFrame, as_of: datetime | str) -> DataFrame:
    """Miss rows of the day that ``logged(rule_id, day)`` does not hold yet."""
    day = F.to_date(as_timestamp(as_of))
    misses = results.filter(F.col("status") == "miss").select(F.col("id").alias("rule_id"), day.alias("day"), "message")
    return misses.join(logged.select("rule_id", "day"), ["rule_id", "day"], "left_anti")
