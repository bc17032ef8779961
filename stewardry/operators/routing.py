"""Routing of files: filter, extract, empty, unchanged, classify."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import passes_file_filters, sensitive_keyword
from ..functions.text import basename, has_text
from .classify import quality_flags

# Outcome names of the two public forms.
OUTCOME_OF_PREFIX = {
    "skip_filter": "skipped_filter",
    "skip_extract": "skipped_extract",
    "skip_empty": "skipped_empty",
    "skip_hash": "skipped_unchanged",
    "classify": "analyzed",
}


def route(
    files: DataFrame,
    current: DataFrame,
    extensions: Sequence[str],
    min_bytes: int = 0,
    max_bytes: int = 2**62,
) -> DataFrame:
    """Add ``outcome`` (and the stored hash as ``prev_sha256``) to ``files(path, length, text, skip_reason, sha256)``.

    ``current(path, sha256)`` has one row per path. The checks run in this order, the first that
    holds decides: filter, extraction, empty text, unchanged hash, classify.
    """
    known = current.select("path", F.col("sha256").alias("prev_sha256"))
    outcome = (
        F.when(~passes_file_filters("path", "length", extensions, min_bytes, max_bytes), "skip_filter")
        .when(F.coalesce(F.col("skip_reason"), F.lit("")) != "", "skip_extract")
        .when(~has_text("text"), "skip_empty")
    )
    judged = files.withColumn("outcome", outcome)
    decided = F.when(F.col("prev_sha256") == F.col("sha256"), "skip_hash").otherwise("classify")
    return judged.join(known, "path", "left").withColumn("outcome", F.coalesce("outcome", decided))


def single_outcome(outcome: Column) -> Column:
    """Public outcome name for a routing prefix."""
    named = F.lit(None).cast("string")
    for prefix, name in OUTCOME_OF_PREFIX.items():
        named = F.when(outcome == prefix, name).otherwise(named)
    return named


def checked(routed: DataFrame, as_of: Column) -> DataFrame:
    """``check_events``: rows whose hash did not change only move their check time."""
    return routed.filter(F.col("outcome") == "skip_hash").select("path", "sha256", as_of.alias("checked_utc"))


def skip_events(routed: DataFrame, as_of: Column, keywords: Sequence[str] | None = None) -> DataFrame:
    """One row per extraction skip, with the first sensitive word of the file name."""
    keyword = sensitive_keyword("path", keywords) if keywords else sensitive_keyword("path")
    return routed.filter(F.col("outcome") == "skip_extract").select(
        "path", F.col("skip_reason").alias("reason"), keyword.alias("keyword"), as_of.alias("ts")
    )


def skip_notes(events: DataFrame) -> DataFrame:
    """Note lines for skipped files, the sensitive word in front."""
    note = F.concat("reason", F.lit(" - `"), "path", F.lit("`"))
    marked = F.concat(F.lit("sensitive file name ("), "keyword", F.lit("): "), note)
    return events.select("ts", "path", F.coalesce(marked, note).alias("note"))


def batch_evaluation(
    files: DataFrame,
    root: str,
    extensions: Sequence[str],
    min_bytes: int = 0,
    max_bytes: int = 2**62,
    extract_only: bool = False,
    limit: int = 0,
) -> DataFrame:
    """Status per file of an evaluation run: ``filtered_out, extract_skip, empty_text, extract_ok, infer_error, ok``.

    ``files`` needs ``path, length, text, skip_reason`` and, unless ``extract_only``, the columns
    ``result, inference_source, inference_reason, infer_error`` of a classification. ``limit`` ends
    the run, in path order, at the first file past the filter that exceeds it.
    """
    status = (
        F.when(~passes_file_filters("path", "length", extensions, min_bytes, max_bytes), "filtered_out")
        .when(F.coalesce(F.col("skip_reason"), F.lit("")) != "", "extract_skip")
        .when(~has_text("text"), "empty_text")
    )
    if extract_only:
        status = status.otherwise("extract_ok")
    else:
        status = status.when(F.col("infer_error").isNotNull(), "infer_error").otherwise("ok")
    rows = files.withColumn("status", status)
    if limit > 0:
        # The path of the file right after the last admitted one; at most limit + 1 rows are looked at.
        beyond = (
            rows.filter(F.col("status") != "filtered_out").select("path").orderBy("path").offset(limit).limit(1)
        )
        stop = beyond.select(F.col("path").alias("_stop"))
        rows = rows.join(F.broadcast(stop), F.col("path") >= F.col("_stop"), "left_anti")
    extracted = F.col("status").isin("extract_ok", "ok", "infer_error")
    base = root.rstrip("/") + "/"
    rel = F.when(F.col("path").startswith(base), F.substring("path", F.lit(len(base) + 1), F.length("path"))).otherwise(
        basename("path")
    )
    columns = [
        F.col("path"),
        rel.alias("rel_path"),
        F.col("status"),
        F.when(F.col("status") != "filtered_out", F.col("length")).alias("file_size_bytes"),
        F.when(extracted, F.length("text")).when(F.col("status") != "filtered_out", F.lit(0)).alias("extract_chars"),
        F.when(F.col("status") == "extract_skip", F.col("skip_reason"))
        .when(F.lit(not extract_only) & (F.col("status") == "infer_error"), F.col("infer_error") if not extract_only else F.lit(None))
        .otherwise("")
        .alias("skip_or_error"),
    ]
    if not extract_only:
        ok = F.col("status") == "ok"
        flags = quality_flags("inference_source", "result.tags", "result.security_level")
        columns += [
            F.when(ok, F.array_join("result.tags", ";")).otherwise("").alias("infer_tags"),
            F.when(ok, F.col("result.security_level")).otherwise("").alias("security_level"),
            F.when(ok, F.col("inference_source")).otherwise("").alias("inference_source"),
            F.when(ok, F.col("inference_reason")).otherwise("").alias("inference_reason"),
            F.when(ok, flags["likely_mock"].cast("string")).otherwise("").alias("likely_mock"),
            F.when(ok, flags["shape_ok"].cast("string"))
            .when(F.col("status") == "infer_error", "false")
            .otherwise("")
            .alias("shape_ok"),
        ]
    return rows.select(*columns)


def status_tally(evaluation: DataFrame) -> DataFrame:
    return evaluation.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
