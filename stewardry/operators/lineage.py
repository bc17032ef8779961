"""Lineage groups: copies and versions of one document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, label_safe, lineage_group_key, one_line, sha_prefix, tags_cell
from ..session import cut_lineage, written
from .classify import Scorer, _score, extract_json
from .components import connected_components
from .groups import previous_in_group, row_number_in_group
from .similarity import SimilaritySettings, feature_class, similar_classes, similarity_features

# Accepted names of the clustering modes.
_MODES = {
    "filename_key": "filename_key",
    "filename": "filename_key",
    "copy_key": "filename_key",
    "similarity": "similarity",
    "fuzzy": "similarity",
}


def clustering_mode(name: str | None) -> str:
    return _MODES.get((name or "both").strip().lower(), "both")


def member_time() -> Column:
    return F.coalesce("last_analyzed_utc", "last_checked_utc")


def hashed_files(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce(F.col("sha256"), F.lit("")) != "")


def assign_components(
    files: DataFrame,
    clustering: str = "both",
    settings: SimilaritySettings = SimilaritySettings(),
) -> DataFrame:
    """Add ``group_key`` and ``component`` to every file that has a hash.

    With copy keys alone a component is its key, and nothing is joined.
    """
    rows = hashed_files(files)
    mode = clustering_mode(clustering)
    keyed = rows.withColumn("group_key", lineage_group_key(basename("path")))
    if mode == "filename_key":
        return keyed.withColumn("component", F.col("group_key"))

    features = similarity_features(rows).withColumn("cls", feature_class(settings))
    features = written(features.withColumn("row", F.monotonically_increasing_id()))
    edges = cut_lineage(similar_classes(features, settings))
    if mode == "similarity":
        links = edges
        node = F.col("cls")
    else:
        # A key is a node too; only a class that spans keys or has a similar class adds an edge.
        spread = features.groupBy("cls").agg(F.min("group_key").alias("lo"), F.max("group_key").alias("hi"))
        linked = edges.select(F.col("u").alias("cls")).unionByName(edges.select(F.col("v").alias("cls")))
        needed = spread.filter(F.col("lo") != F.col("hi")).select("cls").unionByName(linked).distinct()
        key_edges = (
            features.select("cls", "group_key").distinct().join(needed, "cls", "left_semi")
            .select(F.concat(F.lit("key\x1f"), "group_key").alias("u"), F.col("cls").alias("v"))
        )
        links = edges.unionByName(key_edges)
        node = F.concat(F.lit("key\x1f"), "group_key")
    labels = connected_components(links)
    placed = features.select("path", node.alias("node")).join(labels, "node", "left")
    return keyed.join(placed.select("path", F.coalesce("component", "node").alias("component")), "path")


def groups(members: DataFrame) -> DataFrame:
    """One row per component: size, label key of its earliest member, distinct contents, variant note."""
    earliest = F.struct(member_time(), F.lower("path"), F.col("path"))
    contents = F.count_distinct("sha256")
    return members.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by("group_key", earliest).alias("group_key"),
        F.min_by("path", earliest).alias("label_path"),
        contents.alias("variants"),
        F.min("ord").alias("first_ord"),
        F.max(member_time()).alias("last_utc"),
    ).withColumn(
        "variant_note",
        F.when(F.col("variants") == 1, "same content").otherwise(
            F.concat(F.col("variants").cast("string"), F.lit(" content variants"))
        ),
    )


def multi_groups(members: DataFrame) -> DataFrame:
    return groups(members).filter(F.col("size") >= 2)


def ordered_groups(members: DataFrame) -> DataFrame:
    return multi_groups(members).orderBy(F.col("size").desc(), F.col("group_key"), F.col("component"))


def summary_counts(members: DataFrame) -> DataFrame:
    """One row: files, groups of two and more, single files."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.count_if(F.col("n") >= 2).alias("groups"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


def group_members(members: DataFrame) -> DataFrame:
    """Members of the groups of two and more, with ``size``, ``label_key`` and ``variant_note``."""
    kept = multi_groups(members).select(
        "component", "size", F.col("group_key").alias("label_key"), "label_path", "variant_note"
    )
    return members.join(kept, "component")


def _timeline(members: DataFrame) -> DataFrame:
    return members.withColumn("_time", F.coalesce(member_time(), F.timestamp_seconds(F.lit(0)))).withColumn(
        "_folded", F.lower("path")
    )


_TIMELINE_ORDER = ["_time", "_folded", "path"]


def timeline(members: DataFrame) -> DataFrame:
    """Add ``position`` in the order (time, path) within the component."""
    return row_number_in_group(_timeline(members), ["component"], _TIMELINE_ORDER, "position").drop("_time", "_folded")


def version_edges(members: DataFrame) -> DataFrame:
    """Steps between consecutive members; ``same_content`` tells a copy from an edit."""
    slim = members.select("component", "path", "sha256", "last_analyzed_utc", "last_checked_utc")
    stepped = previous_in_group(
        _timeline(slim),
        ["component"],
        _TIMELINE_ORDER,
        {"from_path": F.col("path"), "_from_sha": F.col("sha256")},
    )
    return stepped.filter(F.col("from_path").isNotNull()).select(
        "component",
        "from_path",
        F.col("path").alias("to_path"),
        (F.col("_from_sha") == F.col("sha256")).alias("same_content"),
    )


def singletons(members: DataFrame, limit: int | None = None) -> DataFrame:
    """Files in no group of two or more, by path."""
    rest = members.join(multi_groups(members).select("component"), "component", "left_anti")
    shown = rest.orderBy(F.lower("path"), "path").select("path", "security_level")
    return shown if limit is None else shown.limit(limit)


def lineage_detail(members: DataFrame) -> DataFrame:
    """Per-member rows of the lineage map."""
    return timeline(group_members(members)).select(
        "component",
        "label_key",
        "size",
        "position",
        label_safe(basename("path"), 120).alias("file"),
        sha_prefix("sha256", 16).alias("sha16"),
        label_safe(F.coalesce("security_level", F.lit("")), 20).alias("security"),
        label_safe(tags_cell("tags"), 80).alias("tags"),
        F.col("last_analyzed_utc"),
    )


def description_lines(members: DataFrame, max_groups: int | None = None) -> DataFrame:
    """``component, size, label_key, position, line``: one JSON line per member of the groups of
    two and more, of the first ``max_groups`` in display order where that is given."""
    kept = multi_groups(members).select("component", "size", F.col("group_key").alias("label_key"))
    if max_groups is not None:
        kept = F.broadcast(kept.orderBy(F.col("size").desc(), "label_key", "component").limit(max_groups))
    facts = F.struct(
        basename("path").alias("file"),
        F.col("security_level").alias("level"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")).alias("about"),
    )
    return timeline(members.join(kept, "component")).select("component", "size", "label_key", "position", F.to_json(facts).alias("line"))


def group_hints(lines: DataFrame, scorer: Scorer, lines_per_question: int = 50) -> DataFrame:
    """``component, part, hint``: one-line guesses about how the members of a group relate, from the
    user's scorer. A large group is asked about in parts, ``lines_per_question`` members at a time."""
    part = F.floor((F.col("position") - 1) / lines_per_question).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct("position", "line")))
    asked = (
        lines.groupBy("component", part.alias("part"))
        .agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("text"))
        .select(F.to_json(F.struct("component", "part")).alias("sha256"), "text", F.lit("relationship").alias("hint"))
    )
    answer = F.try_variant_get(F.try_parse_json(extract_json("raw")), "$.hint", "string")
    of = F.from_json("sha256", "component string, part int")
    return (
        _score(asked, scorer)
        .select(of["component"].alias("component"), of["part"].alias("part"), one_line(answer).alias("hint"))
        .filter(F.coalesce(F.col("hint"), F.lit("")) != "")
    )


def by_hash_groups(files: DataFrame, keys: Sequence[str] = ("sha256",)) -> DataFrame:
    """Contents stored under more than one path: how many and the first of them."""
    return (
        hashed_files(files)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by("path", "ord").alias("first_path"))
        .filter(F.col("copies") > 1)
    )
