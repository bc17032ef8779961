"""Stored state and the small configuration catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.times import parse_utc
from ..operators.governance import Catalog, Category

# `tags` may be a list or one bare text, so they are read as raw text first.
_STATE_FILE = (
    "struct<file_id:string,sha256:string,summary:string,tags:string,model_tags:string,security_level:string,"
    "model_security_level:string,last_analyzed_utc:string,last_checked_utc:string,owner_override:boolean,"
    "inference_source:string,inference_reason:string,rule_hits:array<string>,rule_floor:string,"
    "category_ids:array<string>,category_needs_review:boolean,last_change_summary:string,"
    "last_change_utc:string,related_paths:array<string>>"
)
_STATE_BUNDLE = (
    "array<struct<bundle_id:string,anchor_path:string,anchor_event_utc:string,"
    "related_paths:array<string>,window_minutes:int>>"
)
_OVERRIDE = T.MapType(T.StringType(), T.StringType())


def _string_list(raw: str) -> F.Column:
    text = F.col(raw)
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(files, bundles)`` of state documents, one JSON object per file. Records that are no
    objects come out with ``bad_meta`` set."""
    doc = _documents(spark, path).select(F.from_json("value", "struct<files:string,context_bundles:string>").alias("s"))
    entries = doc.select(F.posexplode(F.from_json("s.files", "map<string,string>")).alias("ord", "path", "raw"))
    parsed = entries.withColumn("m", F.from_json("raw", _STATE_FILE))
    times = ("last_analyzed_utc", "last_checked_utc", "last_change_utc")
    lists = ("tags", "model_tags")
    names = [f.name for f in T._parse_datatype_string(_STATE_FILE).fields]
    files = parsed.select(
        "path",
        F.col("ord").cast("long").alias("ord"),
        *[F.col(f"m.{n}").alias(n) for n in names],
        (~F.col("raw").startswith("{")).alias("bad_meta"),
    )
    for name in times:
        files = files.withColumn(name, parse_utc(name))
    for name in lists:
        files = files.withColumn(name, _string_list(name))
    bundles = doc.select(
        F.posexplode(F.from_json("s.context_bundles", _STATE_BUNDLE)).alias("ord", "b")
    ).select(
        "b.bundle_id",
        "b.anchor_path",
        parse_utc("b.anchor_event_utc").alias("anchor_event_utc"),
        "b.related_paths",
        "b.window_minutes",
        F.col("ord").cast("long").alias("ord"),
    )
    return files, bundles


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Owner overrides; a document that cannot be read as one gives no rows."""
    doc = _documents(spark, path).select(F.from_json("value", "struct<entries:string>").alias("s"))
    entries = doc.select(F.posexplode(F.from_json("s.entries", _OVERRIDE)).alias("ord", "path", "raw"))
    fields = F.from_json("raw", "struct<tags:string,security_level:string>")
    return (
        entries.withColumn("e", fields)
        .withColumn("tags", F.col("e.tags"))
        .filter(F.col("raw").startswith("{"))
        .select("path", _string_list("tags").alias("tags"), "e.security_level", F.col("ord").cast("long").alias("ord"))
    )


def read_category_table(spark: SparkSession, path: str) -> DataFrame:
    """``mode, ord, id, label`` of the categories of a catalog of any size, for
    :func:`operators.category_tables.resolve_category_table`."""
    doc = _documents(spark, path).select(
        F.from_json("value", "struct<mode:string,categories:array<struct<id:string,label:string>>>").alias("s")
    )
    rows = doc.select(F.coalesce("s.mode", F.lit("single")).alias("mode"), F.posexplode("s.categories").alias("ord", "c"))
    named = rows.select("mode", "ord", strip("c.id").alias("id"), F.coalesce("c.label", F.lit("")).alias("label"))
    return named.filter(F.coalesce("id", F.lit("")) != "")


def read_categories(spark: SparkSession, path: str, limit: int = 10_000) -> Catalog | None:
    """The category catalog as configuration, or None without categories. Expressions carry it, so
    more than ``limit`` entries are an error; :func:`read_category_table` has no limit."""
    rows = read_category_table(spark, path).orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories: use them as a table")
    if not rows:
        return None
    return Catalog(tuple(Category(r.id, r.label) for r in rows), rows[0].mode or "single")
