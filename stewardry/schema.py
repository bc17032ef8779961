"""Declared schemas of the governance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.ArrayType(T.StringType())

HISTORY_ENTRY = T.StructType(
    [
        T.StructField("sha256", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("utc", T.TimestampType()),
        T.StructField("change_summary", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("ord", T.LongType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("last_analyzed_utc", T.TimestampType()),
        T.StructField("last_checked_utc", T.TimestampType()),
        T.StructField("summary", T.StringType()),
        T.StructField("model_tags", TAGS),
        T.StructField("model_security_level", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("security_level", T.StringType()),
        T.StructField("owner_override", T.BooleanType()),
        T.StructField("inference_source", T.StringType()),
        T.StructField("inference_reason", T.StringType()),
        T.StructField("rule_hits", TAGS),
        T.StructField("rule_floor", T.StringType()),
        T.StructField("category_ids", TAGS),
        T.StructField("category_needs_review", T.BooleanType()),
        T.StructField("summary_history", T.ArrayType(HISTORY_ENTRY)),
        T.StructField("last_change_summary", T.StringType()),
        T.StructField("last_change_utc", T.TimestampType()),
        T.StructField("related_paths", TAGS),
    ]
)

FS_EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("event_ts", T.TimestampType(), False),
        T.StructField("ord", T.LongType()),
    ]
)

BUNDLES = T.StructType(
    [
        T.StructField("bundle_id", T.StringType()),
        T.StructField("anchor_path", T.StringType()),
        T.StructField("anchor_event_utc", T.TimestampType()),
        T.StructField("related_paths", TAGS),
        T.StructField("window_minutes", T.IntegerType()),
        T.StructField("ord", T.LongType()),
    ]
)

OVERRIDES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("tags", TAGS),
        T.StructField("security_level", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)

SKIP_EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

AUDIT_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("file", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order, missing ones as nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
