"""Threads: version groups and folder conversations, newest first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_of, level_rank
from ..functions.paths import fold_path, parent_depth
from ..functions.text import basename, clip, dirname, strip, tag_set
from ..functions.times import as_timestamp, utc_day
from .bundles import bundle_paths
from .groups import top_per_group
from .lineage import group_members, member_time

MEMBER_FIELDS = ("path", "file_id", "sha12", "utc", "summary", "security_level", "role", "basename")


def conversation_id(folder: Column) -> Column:
    return F.concat(F.lit("conv:"), F.substring(F.sha2(F.lower(folder), 256), 1, 16))


def version_id(group_key: Column) -> Column:
    return F.concat(F.lit("ver:"), F.substring(F.regexp_replace(strip(group_key), r"(?U)\s+", "_"), 1, 80))


def member_text() -> Column:
    """Change line if there is one, else the summary, at most 160 characters."""
    change = F.nullif(F.coalesce(F.col("last_change_summary"), F.lit("")), F.lit(""))
    return clip(strip(F.coalesce(change, F.col("summary"), F.lit(""))), 160)


def folder_files(members: DataFrame, roots: Sequence[str], min_depth: int = 1) -> DataFrame:
    """Files at least ``min_depth`` directories below a root, with their ``folder``."""
    return (
        members.withColumn("_depth", parent_depth("path", roots))
        .filter(F.col("_depth") >= min_depth)
        .drop("_depth")
        .withColumn("folder", dirname("path"))
    )


def qualifying_folders(in_folders: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """``folder, first_ord`` of folders with two copy keys or more and either a tag on two files or
    one bundle that lists two of their files."""
    mixed = (
        in_folders.groupBy("folder")
        .agg(F.min("group_key").alias("lo"), F.max("group_key").alias("hi"), F.min("ord").alias("first_ord"))
        .filter(F.col("lo") != F.col("hi"))
        .select("folder", "first_ord")
    )
    shared = (
        in_folders.select("folder", F.explode(tag_set("tags")).alias("tag"))
        .groupBy("folder", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= 2)
        .select("folder")
    )
    if bundles is not None:
        listed = bundle_paths(bundles).select("bundle_id", fold_path("path").alias("_folded"))
        together = (
            in_folders.select("folder", fold_path("path").alias("_folded"))
            .join(listed, "_folded")
            .groupBy("folder", "bundle_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= 2)
            .select("folder")
        )
        shared = shared.unionByName(together)
    return mixed.join(shared.distinct(), "folder", "left_semi")


def _newest(df: DataFrame, key: str, n: int) -> DataFrame:
    return top_per_group(df, [key], [member_time().desc_nulls_last(), F.col("ord").asc()], n, "pos")


def _assemble(items: DataFrame, key: Sequence[str], today: Column) -> DataFrame:
    member = F.struct(
        F.col("pos"),
        F.col("path"),
        F.coalesce("file_id", F.lit("")).alias("file_id"),
        F.substring("sha256", 1, 12).alias("sha12"),
        member_time().alias("utc"),
        member_text().alias("summary"),
        F.coalesce("security_level", F.lit("")).alias("security_level"),
        F.col("role"),
        basename("path").alias("basename"),
    )
    # At most max_members rows per thread are left here.
    rows = items.groupBy(*key).agg(
        F.sort_array(F.collect_list(member)).alias("_m"),
        F.count(F.lit(1)).cast("int").alias("member_count"),
        F.count_if(utc_day(member_time()) == today).cast("int").alias("today_n"),
        level_of(F.max(level_rank("security_level"))).alias("max_security"),
        F.bool_or("in_version").alias("_any_version"),
    )
    members = F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in MEMBER_FIELDS]))
    first = F.element_at("_m", 1)
    return (
        rows.filter(F.col("member_count") >= 2)
        .withColumn("latest_path", first["path"])
        .withColumn("latest_file_id", first["file_id"])
        .withColumn("last_utc", first["utc"])
        .withColumn("one_liner", first["summary"])
        .withColumn("members", members)
        .drop("_m")
    )


_THREAD_COLUMNS = (
    "id", "kind", "title", "folder", "latest_path", "latest_file_id", "last_utc", "member_count", "today_n",
    "max_security", "one_liner", "members",
)


def build_threads(
    members: DataFrame,
    roots: Sequence[str],
    as_of: datetime | str,
    bundles: DataFrame | None = None,
    include_conversations: bool = True,
    min_rel_depth: int = 1,
    max_members: int = 12,
    max_threads: int | None = None,
) -> DataFrame:
    """Threads of ``members`` (files with ``group_key`` and ``component``).

    A version group is left out only if every one of its files already shows in a conversation.
    Counts and levels are those of the members shown, qualification looks at whole folders.
    """
    today = utc_day(as_timestamp(as_of))
    versions = group_members(members).withColumn("in_version", F.lit(True))
    rank = [F.col("last_utc").desc_nulls_last(), F.col("_kind"), F.col("_size").desc(), F.col("_first"), F.col("_key")]

    conversations = None
    if include_conversations and roots:
        in_folders = folder_files(members, roots, min_rel_depth)
        folders = qualifying_folders(in_folders, bundles)
        shown = _newest(in_folders.join(folders, "folder"), "folder", max_members)
        shown = (
            shown.join(versions.select("path", "in_version"), "path", "left")
            .withColumn("in_version", F.coalesce("in_version", F.lit(False)))
            .withColumn("role", F.when(F.col("pos") == 1, "latest").when(F.col("in_version"), "version").otherwise("peer"))
        )
        conversations = _assemble(shown, ["folder", "first_ord"], today).select(
            conversation_id(F.col("folder")).alias("id"),
            F.when(F.col("_any_version"), "mixed").otherwise("conversation").alias("kind"),
            F.coalesce(F.nullif(basename("folder"), F.lit("")), F.col("folder")).alias("title"),
            *_THREAD_COLUMNS[3:],
            F.lit(0).alias("_kind"),
            F.lit(0).cast("long").alias("_size"),
            F.col("first_ord").alias("_first"),
            F.lit("").alias("_key"),
        )
        outside = versions.join(shown.filter(F.col("in_version")).select("path"), "path", "left_anti")
        versions = versions.join(outside.select("component").distinct(), "component", "left_semi")

    listed = _newest(versions, "component", max_members).withColumn(
        "role", F.when(F.col("pos") == 1, "latest").otherwise("version")
    )
    threads = _assemble(listed, ["component", "label_key", "size"], today).select(
        version_id(F.col("label_key")).alias("id"),
        F.lit("version").alias("kind"),
        F.col("label_key").alias("title"),
        F.lit(None).cast("string").alias("folder"),
        *_THREAD_COLUMNS[4:],
        F.lit(1).alias("_kind"),
        F.col("size").alias("_size"),
        F.lit(0).cast("long").alias("_first"),
        F.col("label_key").alias("_key"),
    )
    if conversations is not None:
        threads = conversations.unionByName(threads)
    if max_threads is not None:
        threads = threads.orderBy(*rank).limit(max_threads)
    return threads.withColumn(
        "rank", F.struct(*[F.col(c) for c in ("_kind", "_size", "_first", "_key")])
    ).drop("_kind", "_size", "_first", "_key")


def in_order(threads: DataFrame) -> DataFrame:
    return threads.orderBy(
        F.col("last_utc").desc_nulls_last(), F.col("rank._kind"), F.col("rank._size").desc(), F.col("rank._first"), F.col("rank._key")
    )


def threads_top(threads: DataFrame, limit: int = 8) -> DataFrame:
    return in_order(threads).limit(max(1, limit)).select(
        "id",
        "kind",
        "title",
        basename("latest_path").alias("latest"),
        "latest_path",
        F.col("member_count").alias("count"),
        "today_n",
        "max_security",
    )


def find_thread(threads: DataFrame, thread_id: str = "", path: str = "", file_id: str = "") -> DataFrame:
    """The first thread with this id; failing that, the first that lists the file."""
    wanted = path.strip().lower()
    tests = []
    if file_id.strip():
        tests.append(F.exists("members", lambda m: m["file_id"] == file_id.strip()))
    if wanted:
        tests.append(F.exists("members", lambda m: F.lower(m["path"]) == wanted))
    by_member = F.lit(False)
    for test in tests:
        by_member = by_member | test
    by_id = F.col("id") == thread_id.strip() if thread_id.strip() else F.lit(False)
    found = threads.withColumn("_pref", F.when(by_id, 0).when(by_member, 1)).filter(F.col("_pref").isNotNull())
    return found.orderBy(
        "_pref", F.col("last_utc").desc_nulls_last(), F.col("rank._kind"), F.col("rank._size").desc(),
        F.col("rank._first"), F.col("rank._key"),
    ).limit(1).drop("_pref")
