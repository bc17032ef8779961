"""Files laid out for questions about single ones.

One copy is written in ranges of the folded path, one in ranges of the hash, each sorted within its
files and cut into small row groups. Their statistics, and Bloom filters on file ids, tell Spark
which row groups a look-up has to read; the others are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_allowed
from ..operators import search
from ..session import shuffle_partitions

# Bytes of a row group: a look-up reads one or two of them.
GROUP_BYTES = 1 << 20


class FileLookup:
    def __init__(self, spark: SparkSession, root: str, group_bytes: int = GROUP_BYTES):
        self.spark, self.root, self.group_bytes = spark, root, group_bytes

    def write(self, files: DataFrame, partitions: int | None = None) -> None:
        """Lay out ``files``, in the place of what was there."""
        parts = partitions or shuffle_partitions(self.spark)
        folded = files.withColumn("_folded", F.lower("path"))
        for name, order in (("by_path", ["_folded", "path"]), ("by_hash", ["sha256", "ord"])):
            ranged = folded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            writer = ranged.write.mode("overwrite").option("parquet.block.size", self.group_bytes)
            # The size is checked against rows rarely by default; small groups need it more often.
            writer = writer.option("parquet.page.size.row.check.min", 16).option("parquet.block.size.row.check.min", 16).option("parquet.block.size.row.check.max", 512)
            writer.option("parquet.bloom.filter.enabled#file_id", "true").parquet(f"{self.root}/{name}")

    def table(self, name: str = "by_path") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def locate(self, path: str = "", file_id: str = "") -> DataFrame:
        """As :func:`search.locate`: by id, else by the path, else by the path in another case."""
        by_path, fid, path = self.table(), file_id.strip(), path.strip()
        found = by_path.filter(F.col("file_id") == fid).withColumn("_pref", F.lit(0)) if fid else None
        if path:
            # Both spellings have one folded path, which is what the table is sorted by.
            same = by_path.filter(F.col("_folded") == path.lower()).withColumn("_pref", F.when(F.col("path") == path, 1).otherwise(2))
            found = same if found is None else found.unionByName(same)
        if found is None:
            return by_path.limit(0).drop("_folded")
        return found.orderBy("_pref", "ord").limit(1).drop("_pref", "_folded")

    def get(self, path: str = "", file_id: str = "", roots: Sequence[str] = (), labels: Mapping[str, str] | None = None) -> DataFrame:
        return search.get_columns(self.locate(path, file_id), roots, labels)

    def by_hash(self, prefix: str, limit: int = 20, roots: Sequence[str] = ()) -> DataFrame:
        """As :func:`search.by_hash`; a prefix is a range of hashes."""
        digits = search.hash_digits(prefix)
        size, _ = search.page_arguments(limit)
        hits = self.table("by_hash").filter((F.col("sha256") >= digits) & (F.col("sha256") <= digits + "g")).filter(path_allowed("path", roots))
        return hits.orderBy("ord").limit(size).select(*search.file_row())
