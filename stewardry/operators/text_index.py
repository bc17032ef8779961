"""A stored index over the searched text of files, so that a search opens few of them.

Each segment holds rows, numbered, and for every gram of three characters the numbers of the rows
that have it: per block of 65,536 numbers one posting of gaps between neighbours, sorted by gram, so
that Parquet statistics lead to the few row groups of a question. A question asks for the grams
of its text, or of the texts that every match of its pattern holds; the rarest grams are read and
intersected block by block, and the rows that are left are checked by the criteria themselves.

Segments are added as files come; a newer row of a path hides the older ones, and :meth:`merge`
makes one segment of all. The list of valid segments is written last and is the commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import required_literals
from ..functions.text import distinct_grams
from ..session import cut_lineage, shuffle_partitions
from ..sources.sinks import write_batch
from .search import matching, search_blob

GRAM = 3
BLOCK_BITS = 16
# Grams of one text that are intersected; the check of the rows does the rest.
RAREST = 4


def _gaps(numbers: Column) -> Column:
    """A sorted array as its first number and the distances between neighbours."""
    return F.transform(numbers, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(numbers, i - 1)))


class TextIndex:
    """The index below ``root``; ``batch`` numbers the changes made to it, in rising order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def segments(self) -> list[int]:
        log = self.spark.read.option("basePath", f"{self.root}/segments").parquet(f"{self.root}/segments")
        newest = log.agg(F.max("batch")).first()[0]
        return sorted(r.segment for r in log.filter(F.col("batch") == newest).collect())

    def create(self, files: DataFrame, batch: int = 0) -> None:
        self._write(files, batch)
        self._commit([batch], batch)

    def add(self, files: DataFrame, batch: int) -> None:
        """New or changed files as a segment of their own."""
        self._write(files, batch)
        self._commit([*(s for s in self.segments() if s != batch), batch], batch)

    def merge(self, batch: int) -> None:
        """One segment of the newest row of each path."""
        self._write(self._newest(self.rows()).drop("segment", "n"), batch)
        self._commit([batch], batch)

    def _commit(self, segments: list[int], batch: int) -> None:
        write_batch(self.spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1), f"{self.root}/segments", batch)

    def _write(self, files: DataFrame, segment: int) -> None:
        folder = f"{self.root}/rows/segment={segment}"
        files.withColumn("n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder)
        single = rows.select("n", F.explode(distinct_grams(F.lower(search_blob()), GRAM)).alias("gram"))
        low = F.col("n").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        posting = single.groupBy("gram", F.shiftright("n", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(low)).alias("ns"))
        coded = posting.select("gram", "block", F.size("ns").alias("size"), _gaps(F.col("ns")).alias("gaps"))
        ranged = coded.repartitionByRange(shuffle_partitions(self.spark), "gram", "block").sortWithinPartitions("gram", "block")
        ranged.write.mode("overwrite").parquet(f"{self.root}/postings/segment={segment}")

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{name}/segment={s}" for s in self.segments()]
        return self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._table("rows")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Rows that no later segment has another row of. Only paths of other rows are read."""
        if len(self.segments()) == 1:
            return rows
        last = self._table("rows").select("path", "segment").groupBy("path").agg(F.max("segment").alias("_last"))
        return rows.join(last, "path").filter(F.col("segment") == F.col("_last")).drop("_last")

    def candidates(self, texts: list[str]) -> DataFrame:
        """``segment, n`` of the rows that have the rarest grams of one of the lower-case ``texts``."""
        wanted = {t: sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) for t in texts}
        postings = self._table("postings")
        every = sorted({g for grams in wanted.values() for g in grams})
        # One number per gram of the question.
        sizes = {r.gram: r.n for r in postings.filter(F.col("gram").isin(every)).groupBy("gram").agg(F.sum("size").alias("n")).collect()}
        found = None
        for grams in wanted.values():
            rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
            if not all(g in sizes for g in rarest):
                continue
            lists = postings.filter(F.col("gram").isin(rarest))
            # Blocks that lack one of the grams are not decoded.
            whole = lists.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(rarest)).drop("k")
            steps = lists.join(whole, ["segment", "block"]).select("segment", "block", "gram", F.posexplode("gaps").alias("at", "gap"))
            low = F.sum("gap").over(Window.partitionBy("segment", "block", "gram").orderBy("at"))
            numbers = steps.select("segment", (F.shiftleft("block", BLOCK_BITS) + low).alias("n"))
            part = numbers.groupBy("segment", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(rarest)).drop("k")
            found = part if found is None else found.unionByName(part)
        empty = self.rows().select("segment", "n").limit(0)
        return empty if found is None else found.distinct()

    def search(self, query: str = "", regex: bool = False, **criteria: object) -> DataFrame:
        """The rows that :func:`search.matching` finds among all newest rows."""
        stated = query.strip()
        texts = required_literals(stated) if regex else ([stated.lower()] if len(stated) >= GRAM else None)
        rows = self.rows()
        if texts and all(len(t) >= GRAM for t in texts):
            rows = rows.join(cut_lineage(self.candidates(texts)), ["segment", "n"])
        found = matching(rows, query=query, regex=regex, **criteria)
        return self._newest(found).drop("segment", "n")
