"""Counts, status tables and the action digest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import DEFAULT_LABELS, clean_level
from ..functions.times import as_timestamp, utc_day
from .cadence import CadenceRule, evaluate_cadence
from .groups import top_per_group
from .threads import threads_top
from ..session import cut_lineage
from .versions import recent_changes


def level_counts(files: DataFrame) -> DataFrame:
    return (
        files.select(clean_level("security_level").alias("level"))
        .filter(F.col("level") != "")
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def backend_counts(files: DataFrame, per_level: int = 4) -> DataFrame:
    """The most frequent inference sources of each level."""
    counted = (
        files.select(
            clean_level("security_level").alias("level"),
            F.coalesce(F.nullif(F.col("inference_source"), F.lit("")), F.lit("unknown")).alias("source"),
            "ord",
        )
        .filter(F.col("level") != "")
        .groupBy("level", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    )
    return top_per_group(counted, ["level"], [F.col("n").desc(), F.col("first_ord")], per_level, "rank").drop("first_ord")


def classified_today(files: DataFrame, as_of: datetime | str) -> DataFrame:
    today = utc_day(as_timestamp(as_of))
    return files.agg(F.count_if(utc_day("last_analyzed_utc") == today).alias("today_classified"))


def category_counts(files: DataFrame, limit: int = 12) -> DataFrame:
    return (
        files.select("ord", F.posexplode("category_ids").alias("pos", "category_id"))
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
        .orderBy(F.col("n").desc(), F.col("first"))
        .limit(limit)
        .select("category_id", "n")
    )


def skip_counts(events: DataFrame) -> DataFrame:
    """Extraction skips by reason; events are counted, not files."""
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unknown"))
    return events.groupBy(F.substring(reason, 1, 120).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count("keyword").alias("sensitive")
    )


def recent_sensitive_skips(events: DataFrame, shown: int | None = None) -> DataFrame:
    newest = events.filter(F.col("keyword").isNotNull()).orderBy(F.col("ts").desc(), F.col("path").desc())
    return newest if shown is None else newest.limit(shown)


def sharing_counts(audit: DataFrame) -> DataFrame:
    """Sharing advice codes found in the audit notes."""
    found = F.regexp_extract_all("note", F.lit(r"(?i)\[sharing:\s*([a-z_]+)\]"), F.lit(1))
    return (
        audit.select(F.explode(found).alias("code"))
        .groupBy(F.lower("code").alias("sharing"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_mismatch() -> Column:
    """No owner entry, and the rules or something else moved the level away from the model's."""
    model, level, floor = clean_level("model_security_level"), clean_level("security_level"), clean_level("rule_floor")
    by_rule = (floor != "") & (floor != model) & (level == floor)
    moved = (model != "") & (level != "") & (model != level)
    return ~F.coalesce("owner_override", F.lit(False)) & (by_rule | moved)


def _long(df: DataFrame, **metrics: Column) -> DataFrame:
    """One aggregate row of ``df`` as ``metric, value`` rows."""
    row = df.agg(*[v.cast("long").alias(k) for k, v in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(k), F.lit(0)).alias("value")) for k in metrics])
    return row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def metrics(files: DataFrame, skips: DataFrame, audit: DataFrame, as_of: datetime | str) -> DataFrame:
    """All counters of the digest as ``metric, value``; one pass over each table."""
    today = utc_day(as_timestamp(as_of))
    level = clean_level("security_level")
    codes = sharing_counts(audit)
    parts = [
        _long(
            files,
            tracked_files=F.count(F.lit(1)),
            p1=F.count_if(level == "P1"),
            p2=F.count_if(level == "P2"),
            today_classified=F.count_if(utc_day("last_analyzed_utc") == today),
            mismatch=F.count_if(level_mismatch()),
            with_related=F.count_if(F.size(F.coalesce("related_paths", F.array())) > 0),
        ),
        _long(skips, skip_extract=F.count(F.lit(1)), skip_sensitive=F.count("keyword")),
        _long(
            codes,
            redact=F.sum(F.when(F.col("sharing") == "redact_before_external", F.col("n"))),
            internal_only=F.sum(F.when(F.col("sharing") == "internal_only", F.col("n"))),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


METRICS = (
    "tracked_files", "p1", "p2", "today_classified", "mismatch", "with_related", "skip_extract", "skip_sensitive",
    "redact", "internal_only",
)


def metrics_row(long: DataFrame) -> DataFrame:
    """The counters side by side, in one row."""
    return long.agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)).alias(m) for m in METRICS])


def blind_spot(skip_extract: Column, skip_sensitive: Column) -> Column:
    total, sensitive = skip_extract.cast("string"), skip_sensitive.cast("string")
    base = F.concat(F.lit("unclassified (no text extracted): "), total)
    return (
        F.when(skip_extract <= 0, "")
        .when(skip_sensitive > 0, F.concat(base, F.lit(", of which sensitive file names: "), sensitive))
        .otherwise(base)
    )


def action_lines(
    row: DataFrame,
    cadence: DataFrame | None = None,
    max_lines: int = 6,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """``priority, code, message`` of what to do next, at most ``max_lines``."""
    names = {**DEFAULT_LABELS, **(labels or {})}

    def line(priority: int, code: str, when: Column, *parts: object) -> Column:
        text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.when(
            when, F.struct(F.lit(priority).alias("priority"), F.lit(code).alias("code"), text.alias("message"))
        )

    c = F.col
    built = F.array_compact(
        F.array(
            line(1, "sensitive", (c("p1") > 0) | (c("p2") > 0), f"sensitive files: {names['P1']} (P1) ", c("p1"), f", {names['P2']} (P2) ", c("p2")),
            line(2, "redact", c("redact") > 0, "check before external sharing: ", c("redact")),
            line(3, "internal_only", c("internal_only") > 0, "internal use advised: ", c("internal_only")),
            line(4, "mismatch", c("mismatch") > 0, "level differs from the model: ", c("mismatch")),
            line(5, "skip_sensitive", c("skip_sensitive") > 0, "unclassified with a sensitive name: ", c("skip_sensitive")),
            line(5, "skip", (c("skip_sensitive") == 0) & (c("skip_extract") > 0), "unclassified: ", c("skip_extract")),
            line(6, "related", c("with_related") > 0, "files with related candidates: ", c("with_related")),
        )
    )
    lines = row.select(F.explode(built).alias("l")).select("l.*")
    if cadence is not None:
        misses = cadence.filter(F.col("status") == "miss")
        lines = lines.unionByName(
            misses.select(
                (F.lit(100) + F.col("ord")).cast("int").alias("priority"),
                F.lit("cadence").alias("code"),
                F.concat(F.lit("periodic document missing: "), "message").alias("message"),
            )
        )
    default = row.select(F.lit(1_000_000).alias("priority"), F.lit("none").alias("code"), F.lit("nothing to do").alias("message"))
    # Configuration-sized: seven counters and one line per cadence rule.
    every = F.sort_array(F.collect_list(F.struct("priority", "code", "message")))
    found = F.filter("every", lambda e: e["code"] != "none")
    shown = F.slice(F.when(F.size(found) > 0, found).otherwise(F.col("every")), 1, max(1, max_lines))
    gathered = lines.unionByName(default).agg(every.alias("every"))
    return gathered.select(F.explode(shown).alias("l")).select("l.*")


def last_inference(files: DataFrame) -> DataFrame:
    """Source and time of the newest classification."""
    newest = F.max_by("inference_source", F.struct("last_analyzed_utc", "ord"))
    return files.agg(newest.alias("last_inference_backend"), F.max("last_analyzed_utc").alias("last_inference_utc"))


def digest_payload(
    files: DataFrame,
    skips: DataFrame,
    audit: DataFrame,
    as_of: datetime | str,
    rules: Sequence[CadenceRule] = (),
    threads: DataFrame | None = None,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row: counters, banner, last inference, up to four actions, cadence misses, top threads.

    All parts are one row or a handful of rows by construction, and are brought together by one
    aggregate over their union.
    """
    names = {**DEFAULT_LABELS, **(labels or {})}
    # One row, and one per rule, read by several parts: counted once.
    row = cut_lineage(metrics_row(metrics(files, skips, audit, as_of)))
    cadence = cut_lineage(evaluate_cadence(files, rules, as_of)) if rules else None
    empty = F.lit(None)
    text = lambda kind, df, order, value: df.select(
        F.lit(kind).alias("kind"), order.cast("long").alias("at"), value.cast("string").alias("text")
    )
    parts = [row.select(F.lit("metric").alias("kind"), F.posexplode(F.array(*[F.col(m) for m in METRICS])).alias("at", "v")).select("kind", F.col("at").cast("long"), F.col("v").cast("string").alias("text"))]
    parts.append(text("action", action_lines(row, cadence, 4, labels), F.col("priority"), F.col("message")))
    last = last_inference(files)
    parts.append(text("backend", last, F.lit(0), F.col("last_inference_backend")))
    parts.append(text("utc", last, F.lit(0), F.col("last_inference_utc")))
    if cadence is not None:
        parts.append(text("miss", cadence.filter(F.col("status") == "miss"), F.col("ord"), F.col("message")))
    if threads is not None:
        top = threads_top(threads, 3).withColumn("_at", F.monotonically_increasing_id())
        parts.append(text("thread", top, F.col("_at"), F.to_json(F.struct("title", "count", "today_n"))))
    union = reduce(DataFrame.unionByName, parts)

    def listed(kind: str) -> Column:
        return F.transform(
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "text")))), lambda e: e["text"]
        )

    def one(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("text")))

    def metric(i: int) -> Column:
        return F.max(F.when((F.col("kind") == "metric") & (F.col("at") == i), F.col("text"))).cast("long")

    gathered = union.agg(
        *[metric(i).alias(m) for i, m in enumerate(METRICS)],
        F.coalesce(one("backend"), F.lit("")).alias("last_inference_backend"),
        F.coalesce(one("utc"), F.lit("")).alias("last_inference_utc"),
        listed("action").alias("actions"),
        listed("miss").alias("cadence_misses"),
        listed("thread").alias("threads_top"),
    )
    return gathered.select(
        as_timestamp(as_of).alias("generated_utc"),
        "today_classified",
        "p1",
        "p2",
        "tracked_files",
        "skip_extract",
        "skip_sensitive",
        blind_spot(F.col("skip_extract"), F.col("skip_sensitive")).alias("blind_spot"),
        "last_inference_backend",
        "last_inference_utc",
        "actions",
        "cadence_misses",
        F.lit(f"{names['P1']} (P1)").alias("p1_label"),
        F.lit(f"{names['P2']} (P2)").alias("p2_label"),
        "threads_top",
    )


def status(
    files: DataFrame,
    skips: DataFrame,
    audit: DataFrame,
    as_of: datetime | str,
    rules: Sequence[CadenceRule] = (),
    threads: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables of the status page."""
    row = metrics_row(metrics(files, skips, audit, as_of))
    cadence = evaluate_cadence(files, rules, as_of) if rules else None
    tables = {
        "counters": row,
        "banner": row.select(blind_spot(F.col("skip_extract"), F.col("skip_sensitive")).alias("banner")),
        "actions": action_lines(row, cadence),
        "levels": level_counts(files),
        "backends": backend_counts(files),
        "changes": recent_changes(files, 6),
        "categories": category_counts(files),
        "sensitive_skips": recent_sensitive_skips(skips, 8),
        "last_inference": last_inference(files),
    }
    if cadence is not None:
        tables["cadence"] = cadence
    if threads is not None:
        tables["threads"] = threads_top(threads, 10)
    return tables
