"""Quality rules of documents and of the hosts they come from.

Each document is measured and held against rules: the base rule (too few words, or too many that
repeat), many symbols, many repeated lines, words that are too short or too long. Failures of each
rule are added up by host (the ``source`` of a document), and the failure rate of a host is shrunk
towards that of all hosts with a beta prior. The prior is fitted to how much the hosts differ
beyond what chance makes of their numbers of documents, so hosts of a few documents say little.
A host whose shrunk rate of some rule is above the limit is rejected with all its documents.

Odd input. Null text has no words and fails the base rule. A null source is a host of its own.
Repeated rows count each. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, store
from .words import SPACED, find_words, in_pieces, mix, per_text, prefix_sums, span_hashes, windows

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURE_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in MEASURES) + ">"


@dataclass(frozen=True)
class HostRules:
    """Limits of documents, and ``host_limit``, the shrunk failure rate above which a host is rejected."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_lines_percent: int = 5
    mean_word_chars: tuple[int, int] = (3, 10)
    host_limit: float = 0.7


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, bounds[1:]]))
    counts = 1 + np.diff(np.searchsorted(breaks, bounds))
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), counts)


def _measure(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    n = len(bounds) - 1
    starts, ends, first = find_words(data, bounds, SPACED)
    sums = prefix_sums(data)
    n_words = np.diff(first)
    inside = SPACED[data]
    word_chars = per_text(inside & ((data & 0xC0) != 0x80), bounds)

    line_starts, line_ends, line_text = _lines(data, bounds)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    full = before[line_ends] > before[line_starts]
    line_starts, line_ends, line_text = line_starts[full], line_ends[full], line_text[full]
    own = mix(span_hashes(sums, line_starts, line_ends) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(own, return_index=True)
    n_dup = np.bincount(line_text, minlength=n) - np.bincount(line_text[kept], minlength=n)

    at, text, joint = windows(span_hashes(sums, starts, ends), first, 3)
    joint = mix(joint + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(joint)
    same = joint[order][1:] == joint[order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        covered[at[again] + k] = True
    values = (n_words, word_chars, per_text(SYMBOLS[data], bounds), n_dup, per_text(covered, first))
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=list(MEASURES))


def measures(text: Column) -> Column:
    """Struct of the measures of a text; a null text has no words."""

    @F.arrow_udf(MEASURE_TYPE)
    def measured(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, _measure)

    return measured(text)


def base_failed(n_words: Column, n_repeat_words: Column, rules: HostRules) -> Column:
    return (n_words < rules.min_words) | (n_repeat_words * 100 > n_words * rules.max_repeat_percent)


RULES = ("base", "symbols", "dup_lines", "word_length")


def failures(measured: Callable[[str], Column], rules: HostRules) -> dict[str, Column]:
    """Which rules a document fails; ``measured`` gives a measure by name. Percentages are of its words."""
    n = measured("n_words")
    low, high = rules.mean_word_chars
    return {
        "base": base_failed(n, measured("n_repeat_words"), rules),
        "symbols": measured("n_symbols") * 100 > n * rules.max_symbol_percent,
        "dup_lines": measured("n_dup_lines") * 100 > n * rules.max_dup_lines_percent,
        "word_length": (measured("word_chars") < n * low) | (measured("word_chars") > n * high),
    }


def _strength(k: int, n: float, n_squares: float, between: float, within: float) -> float | None:
    """Weight of the prior in documents, from the variance of rates between hosts less that which
    their sizes explain (one-way analysis of variance). None: hosts do not differ."""
    if k < 2 or n <= k:
        return None
    msb, msw = between / (k - 1), within / (n - k)
    alike = (msb - msw) / (msb + ((n - n_squares / n) / (k - 1) - 1) * msw) if msb > msw else 0.0
    return 1 / alike - 1 if alike > 0 else None


def host_verdicts(judged: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """From ``host`` and a flag per rule: ``host, n, failures`` and ``shrunk`` rate of each rule, and
    ``rejected``, per host. Where hosts do not differ, or there is one, all have the common rate."""
    hosts = store(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in RULES]))
    n = F.col("n").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    mean = {r: (sums[r] or 0) / (sums["n"] or 1.0) for r in RULES}
    rate = lambda r: F.col(f"f_{r}") / n
    spread = hosts.agg(
        *[F.sum(n * (rate(r) - mean[r]) * (rate(r) - mean[r])).alias(f"b_{r}") for r in RULES],
        *[F.sum(n * rate(r) * (1 - rate(r))).alias(f"w_{r}") for r in RULES],
    ).first()
    rejected = F.lit(False)
    for r in RULES:
        weight = _strength(sums["k"], sums["n"] or 0.0, sums["squares"] or 0.0, spread[f"b_{r}"] or 0.0, spread[f"w_{r}"] or 0.0)
        shrunk = F.lit(mean[r]) if weight is None else (F.col(f"f_{r}") + F.lit(mean[r] * weight)) / (n + F.lit(weight))
        hosts = hosts.withColumn(f"shrunk_{r}", shrunk)
        rejected = rejected | (F.col(f"shrunk_{r}") > rules.host_limit)
    return hosts.withColumn("rejected", rejected)


def judge(measured: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """``measured`` (columns ``source`` and the measures, read twice) with ``base_failed`` and ``kept``."""
    failed = failures(F.col, rules)
    judged = measured.withColumn("base_failed", failed["base"])
    hosts = host_verdicts(measured.select(F.col("source").alias("host"), *[c.alias(r) for r, c in failed.items()]), rules)
    bad = small(hosts.filter("rejected").select("host", F.lit(True).alias("bad_host")))
    joined = judged.join(bad, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("host", "bad_host")


def keep_documents(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Documents that pass the base rule and whose host is not rejected, with the columns they
    came with. Texts are read twice (hosts first, then documents) and never shuffled."""
    name = fresh(docs, "measured")
    with_measures = docs.withColumn(name, measures(docs["text"]))
    failed = failures(lambda m: F.col(f"{name}.{m}"), rules)
    hosts = host_verdicts(with_measures.select(F.col("source").alias("host"), *[c.alias(r) for r, c in failed.items()]), rules)
    bad_name = fresh(docs, "bad_host")
    bad = small(hosts.filter("rejected").select(F.col("host").alias(bad_name)))
    passed = with_measures.filter(~failed["base"])
    return passed.join(bad, passed["source"].eqNullSafe(bad[bad_name]), "left_anti").select(*[passed[c] for c in docs.columns])
