"""Writers. All of them append files in parallel; none brings a table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from ..functions.times import iso_utc


def append_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own folder; a repeated batch replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_activity(rows: DataFrame, path: str) -> None:
    append_table(rows, path, "day")


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = report.write.mode("append")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_evaluation(evaluation: DataFrame, csv_path: str, jsonl_path: str | None = None) -> None:
    evaluation.write.mode("overwrite").option("header", True).csv(csv_path)
    if jsonl_path:
        evaluation.write.mode("overwrite").json(jsonl_path)


def export_state(files: DataFrame, path: str) -> None:
    """State as JSON lines, one ``{"path": {record}}`` object per file, so that the export is
    written by all tasks instead of being built as one object in one of them."""
    record = F.struct(*[c for c in files.columns if c != "path"])
    files.select(F.to_json(F.create_map("path", record)).alias("value")).write.mode("overwrite").text(path)


def last_classification(files: DataFrame) -> DataFrame:
    """The newest classification as one JSON row."""
    payload = F.struct(
        F.col("path"),
        basename("path").alias("basename"),
        F.col("security_level"),
        F.col("tags"),
        F.col("summary"),
        F.col("inference_source"),
        F.col("sha256"),
        iso_utc("last_analyzed_utc").alias("utc"),
        F.coalesce("category_ids", F.array().cast("array<string>")).alias("category_ids"),
        F.coalesce("last_change_summary", F.lit("")).alias("change_summary"),
    )
    return (
        files.orderBy(F.col("last_analyzed_utc").desc_nulls_last(), F.col("ord").desc())
        .limit(1)
        .select(F.to_json(payload).alias("value"))
    )


def write_last_classification(files: DataFrame, path: str) -> None:
    last_classification(files).write.mode("overwrite").text(path)


def write_payload(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").json(path)
