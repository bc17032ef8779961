"""Derived tables that follow the ingest batch by batch.

Lineage: file keys and contents are the nodes, every version ever taken in links its key to its
content. A batch brings new links only; they are resolved to the components known so far, whose
graph is small, and of the components that meet all but the largest are relabelled. Counters:
what the files of a batch counted for before is taken off, what they count for now is added.

Everything is kept in :class:`Snapshot` tables: a refresh reads the buckets of the nodes it meets
and of the components it relabels, no others, and a repeated batch replaces what it did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, lineage_group_key
from ..operators.components import connected_components
from ..session import cut_lineage
from ..sources.sinks import write_batch
from .ingest import current_files
from .snapshot import Snapshot, read_table

LABELS = T.StructType([T.StructField("node", T.StringType()), T.StructField("component", T.StringType())])
COUNTED = ("security_level", "inference_source")


def _by_node(spark: SparkSession, root: str) -> Snapshot:
    return Snapshot(spark, root, "lineage_by_node", LABELS, key="node", identity="node")


def _by_component(spark: SparkSession, root: str) -> Snapshot:
    return Snapshot(spark, root, "lineage_by_component", LABELS, key="component", identity="node")


def key_node(path: str = "path"):
    return F.concat(F.lit("key:"), lineage_group_key(basename(path)))


def merge_links(spark: SparkSession, root: str, batch_id: int, links: DataFrame) -> None:
    """Bring ``links(u, v)`` into the stored components. Nodes not seen before come along."""
    by_node, by_component = _by_node(spark, root), _by_component(spark, root)
    links = cut_lineage(links.select("u", "v").distinct())
    nodes = cut_lineage(links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct())
    known = by_node.read(batch_id, by_node.touched(nodes))
    # A node that was not seen before is a component by itself.
    placed = nodes.join(known, "node", "left").withColumn("fresh", F.col("component").isNull())
    placed = cut_lineage(placed.withColumn("component", F.coalesce("component", "node")))
    side = lambda c: placed.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = links.join(side("u"), "u").join(side("v"), "v").select(F.col("u_of").alias("u"), F.col("v_of").alias("v"))
    joined = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("met"))
    met = cut_lineage(joined.join(placed.groupBy("component").agg(F.max("fresh").alias("fresh")), "component"))
    # Components that were stored before and meet another one: the largest keeps its label.
    old = by_component.read(batch_id, by_component.touched(met.filter(~F.col("fresh")).select("component")))
    old = cut_lineage(old.join(met.filter(~F.col("fresh")).select("component"), "component", "left_semi"))
    sizes = met.join(old.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component", "left")
    keeper = sizes.groupBy("met").agg(F.max_by("component", F.struct(F.coalesce("size", F.lit(0)), "component")).alias("label"))
    moves = cut_lineage(met.join(keeper, "met").filter(F.col("component") != F.col("label")).select("component", "label"))
    relabelled = old.join(moves, "component")
    fresh = placed.filter("fresh").select("node", "component").join(moves, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    new = cut_lineage(fresh.unionByName(relabelled.select("node", F.col("label").alias("component"))))
    by_node.replace(batch_id, new)
    by_component.replace(batch_id, new, relabelled.select("component", "node"))


def lineage_links(versions: DataFrame) -> DataFrame:
    """``u, v`` of each version: the key of its file and its content."""
    held = versions.filter(F.coalesce(F.col("sha256"), F.lit("")) != "")
    return held.select(key_node().alias("u"), F.concat(F.lit("hash:"), "sha256").alias("v"))


def lineage_labels(spark: SparkSession, root: str) -> DataFrame:
    """``node, component`` of everything taken in so far."""
    return _by_node(spark, root).read()


def _counts(rows: DataFrame, sign: int) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("")).alias("value")) for c in COUNTED]))
    return rows.select(each.alias("e")).groupBy("e.kind", "e.value").agg((F.count(F.lit(1)) * sign).alias("n"))


def status_counts(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """``kind, value, n``: files per level and per inference source, as of the newest refresh."""
    log = read_table(spark, root, "status_counts", before)
    newest = None if log is None else log.agg(F.max("batch")).first()[0]
    if newest is None:
        return spark.createDataFrame([], "kind string, value string, n long")
    return log.filter(F.col("batch") == newest).select("kind", "value", "n")


def refresh(spark: SparkSession, root: str, batch_id: int) -> None:
    """Bring the derived tables up to the ingest's batch ``batch_id``; use it as ``after_batch``."""
    written = read_table(spark, root, "file_versions")
    written = spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])) if written is None else written.filter(F.col("batch") == batch_id)
    merge_links(spark, root, batch_id, lineage_links(written))
    files = current_files(spark, root)
    paths = written.select("path")
    moves = read_table(spark, root, "file_moves")
    if moves is not None:
        paths = paths.unionByName(moves.filter(F.col("batch") == batch_id).select(F.col("old_path").alias("path")))
    paths = cut_lineage(paths.distinct())
    buckets = files.touched(paths)
    now, then = (files.read(before, buckets).join(paths, "path", "left_semi") for before in (batch_id + 1, batch_id))
    counts = status_counts(spark, root, batch_id).unionByName(_counts(now, 1)).unionByName(_counts(then, -1))
    write_batch(counts.groupBy("kind", "value").agg(F.sum("n").alias("n")).filter("n <> 0"), f"{root}/status_counts", batch_id)
