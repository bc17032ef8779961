"""A table of current rows in buckets; a batch reads and rewrites only the buckets it touches.

Each bucket is a folder named by the batch that wrote it. A pointer table, written last and once
per batch, names the newest folder of every bucket: it is the commit. A batch that is repeated
starts from the pointers of the batches before it and replaces its own folders, so it changes
nothing. What no pointer names any more may be deleted at any time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..sources.sinks import write_batch

POINTERS = "bucket int, writer long"


def read_table(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table written batch by batch; ``before`` leaves out the batch being written again."""
    try:
        table = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return table if before is None else table.filter(F.col("batch") < before)


class Snapshot:
    """Rows of ``schema`` below ``root``, bucketed by ``key``; ``identity`` names a row.

    ``buckets`` is fixed for the life of a table; choose it so that a bucket is a good file.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType, key: str = "path", identity: str = "path", buckets: int = 64):
        self.spark, self.root, self.name, self.schema = spark, root, name, schema
        self.key, self.identity, self.buckets = key, identity, buckets

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def pointers(self, before: int | None = None) -> dict[int, int]:
        """The batch that wrote each bucket, as of the newest commit (before ``before``)."""
        log = read_table(self.spark, self.root, f"{self.name}_pointers", before)
        newest = None if log is None else log.agg(F.max("batch")).first()[0]
        if newest is None:
            return {}
        # One row per bucket.
        return {r.bucket: r.writer for r in log.filter((F.col("batch") == newest) & F.col("bucket").isNotNull()).collect()}

    def touched(self, *keys: DataFrame) -> set[int]:
        """Buckets of the rows of tables that have the key column."""
        found = set()
        for df in keys:
            found |= {r.b for r in df.select(self.bucket_of(F.col(self.key)).alias("b")).distinct().collect()}
        return found

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All current rows, or those of the buckets ``only``: other folders are not opened."""
        where = self.pointers(before)
        paths = [f"{self.root}/{self.name}/batch={w}/bucket={b}" for b, w in sorted(where.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, batch_id: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Put ``rows`` in the place of those with their identity, and take out those of ``gone``
        (key and identity). A row that moves to another bucket is ``gone`` from its old one."""
        rows = cut_lineage(rows.select(self.schema.names))
        named = list(dict.fromkeys([self.key, self.identity]))
        out = rows.select(named)
        if gone is not None:
            out = cut_lineage(out.unionByName(gone.select(named)).distinct())
        touched = self.touched(out)
        where = self.pointers(batch_id)
        kept = self.read(batch_id, touched).join(out.select(self.identity).distinct(), self.identity, "left_anti")
        folder = f"{self.root}/{self.name}/batch={batch_id}"
        merged = kept.select(self.schema.names).unionByName(rows).withColumn("bucket", self.bucket_of(F.col(self.key)))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        filled = set()
        if touched:
            written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
            filled = {r.bucket for r in written.select("bucket").distinct().collect()}
        where = {b: w for b, w in where.items() if b not in touched} | {b: batch_id for b in filled}
        # An empty table has a commit too.
        log = self.spark.createDataFrame(sorted(where.items()) or [(None, None)], POINTERS)
        write_batch(log.coalesce(1), f"{self.root}/{self.name}_pointers", batch_id)
