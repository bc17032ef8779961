"""Ordered work within groups of any size.

A plain ``lag`` or ``row_number`` sorts one whole group in one task. Here rows are cut into ranges
along groups and their order; a task holds one range, and one row per group and range carries
the state from range to range. Top-n per group needs no such help: a ``row_number() <= n``
filter keeps n rows per group on the map side already (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_bucket``, which does not decrease along ``order`` within ``keys``: ranges of about
    equal size over both, so that a group of any size, and rows of one time, spread over many."""
    spread = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order)
    return cut_lineage(spread.withColumn("_bucket", F.spark_partition_id()))


def previous_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Add ``values`` of the row before, in ascending ``order`` within ``keys``. Rows are written
    once and sorted, so ``df`` should not carry texts."""
    keyed = _ranged(df.withColumn("_row", F.struct(*[v.alias(k) for k, v in values.items()])), keys, order)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = keyed.withColumn("_before", F.lag("_row").over(inside))
    last = keyed.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    joined = local.join(carried, [*keys, "_bucket"], "left")
    previous = F.coalesce("_before", "_carried")
    return joined.select(*df.columns, *[previous.getField(k).alias(k) for k in values])


def row_number_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position in ascending ``order`` within ``keys``."""
    keyed = _ranged(df, keys, order)
    local = keyed.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return local.join(offsets, [*keys, "_bucket"], "left").select(
        *df.columns, (F.col("_pos") + F.col("_offset")).alias(name)
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
