"""Mixing sources to target weights by repetition.

The words of each source are added up, the targets follow from weights with a limit on
repetition, and a document is emitted ``floor(rate)`` times plus once more with the
probability of the remaining fraction, decided by a hash of seed and ``doc_id``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shuffle_partitions
from .common import BROADCAST_ROWS, fresh, small, store


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat along the sources in code point order, null last; ``percent`` of all
    words are shared out; a source gets at most ``limit`` times its words."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    limit: int = 2
    seed: str = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(per_source: DataFrame) -> DataFrame:
    """``per_source`` with the 0-based rank of each source. Sorted by ranges, so that no task
    holds all sources; only the row counts of the ranges meet."""
    parts = shuffle_partitions(per_source.sparkSession)
    order = F.col("source").asc_nulls_last()
    ranged = store(per_source.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    local = ranged.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    return local.join(F.broadcast(offsets), "part").select(
        "source", "source_size", (F.col("local") + F.col("offset")).alias("rank")
    )


def source_rates(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """From ``source, size`` per document: ``source, source_size, target, rate`` per source.

    The common level rises by what sources at their limit leave over, until none is above it;
    each round is one aggregate over the table of sources. A source without words has target
    and rate 0.
    """
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.lit(mix.weights[0])
    for i, w in enumerate(mix.weights):
        weight = F.when(F.col("rank") % len(mix.weights) == i, F.lit(w)).otherwise(weight)
    cap = F.col("source_size") * mix.limit
    sources = store(ranked.select("source", "source_size", weight.cast("long").alias("weight"), cap.alias("cap")))
    totals = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget = (totals.s or 0) * mix.percent / 100
    level = budget / totals.w if totals.w else 0.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("c"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w"),
        ).first()
        higher = (budget - row.c) / row.w if row.w else math.inf
        if higher <= level or math.isinf(higher):
            break
        level = higher
    wanted = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") < wanted, F.col("cap").cast("double")).otherwise(wanted)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def copies(doc_id: Column, rate: Column, mix: Mix = Mix()) -> Column:
    """How often a document is taken. Rows with equal ``doc_id`` share the draw."""
    digest = F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, F.lit(1)).otherwise(F.lit(0))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` per row of ``docs`` (``doc_id, text, source``).

    Null text has size 0; null is a source of its own. Texts are read once.
    """
    sized = store(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")))
    rates = small(store(source_rates(sized.select("source", "size"), mix)).withColumnRenamed("source", "of"), BROADCAST_ROWS // 10)
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "size", "source_size", "target", copies(F.col("doc_id"), F.col("rate"), mix).alias("copies"))


def emit(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Each document as many times as the mix takes it, with its columns and the number ``copy``
    (``copy_`` and so on where ``docs`` has such a column), from 1 on."""
    sized = docs.select("source", word_count(docs["text"]).alias("size"))
    of, rate, copy = fresh(docs, "mix_source"), fresh(docs, "mix_rate"), fresh(docs, "copy")
    rates = small(
        store(source_rates(sized, mix)).select(F.col("source").alias(of), F.col("rate").alias(rate)), BROADCAST_ROWS // 10
    )
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[of]))
    times = copies(docs["doc_id"], F.col(rate), mix).cast("int")
    return joined.filter(times > 0).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times)).alias(copy))
