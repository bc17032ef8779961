"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on; all of them can be set on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many-to-one joins (documents to their component, files to their folder) may have hot
    # keys on the many side; AQE splits such partitions even where that costs a shuffle later.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL settings, and send this package's functions along with the tasks, so that the
    workers need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "stewardry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where none is named, a local session
    uses a folder in its warehouse; a cluster must name one that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from a table in the checkpoint folder, where repeated words take little room."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input comes in fewer pieces than there are cores.

    For expensive expressions over a few unsplittable files. Input that already fills the cluster
    is left as it is, so that texts are never shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
