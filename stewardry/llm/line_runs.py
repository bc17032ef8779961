"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A run holds line keys, hashed into buckets and sorted in each, with the number of documents that
hold the key and the document that owns it. A batch of documents is reduced to one row per key,
merged with the runs of every level, and becomes a run itself: keys that no run holds (the
anti-join) get an owner from the batch, the others only add to the count. As soon as a level has
``fan_out`` runs they are merged to one run of the next level, so a key is rewritten once per
level. A level is a bucketed table in the shared folder that runs are appended to: neither the
anti-join nor a merge shuffles what is in it.

The owner of a line is the largest id of the first batch that held it; :func:`shared_lines` deals
the documents by falling id, so that it is the largest id of all.

Odd input. Null or empty text is one empty line. Every row is a document, also where ids repeat;
rows with the owner's id all keep the line. A null id is below all others. Lines are told apart by
MD5. A document of many lines is an array in one row; nothing else grows with a text. Further
columns of the documents are kept as they are. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, shuffle_partitions
from .common import fresh, prepare, store, text_of

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A key that this share of all rows or more hold is looked up where the rows are; there are at
# most as many such keys.
HOT_KEYS = 1000


def fold(text: Column) -> Column:
    """Only A to Z in lower case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column, least_chars: int) -> Column:
    """Position and key of every line of at least ``least_chars`` characters without the blanks around it."""
    bare = F.transform(lines_of(text), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    long_ones = F.filter(bare, lambda x: F.char_length(x["line"]) >= least_chars)
    return F.transform(long_ones, lambda x: F.struct(x["pos"].alias("pos"), F.md5(fold(x["line"])).alias("h")))


class LineRuns:
    """The runs of a growing corpus: :meth:`add` a batch at a time, then read :meth:`totals`.

    The runs of a level are files of one table, ``h, n_docs, owner, first``; of all rows with a key, one is ``first``
    and has the owner.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 4, buckets: int | None = None):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list] = []  # name of the table and number of runs

    def add(self, keys: DataFrame) -> None:
        """``keys``: ``h`` and the id ``doc`` of each document of the batch that holds it."""
        own = keys.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc").alias("owner"))
        first = F.lit(True)
        for i, (name, n_runs) in enumerate(self.levels):
            if n_runs:
                held = self.spark.table(name).filter("first").select("h", F.col("first").alias(f"held_{i}"))
                own = own.join(held, "h", "left")
                first = first & F.col(f"held_{i}").isNull()
        self._append(0, own.select("h", "n_docs", F.when(first, F.col("owner")).alias("owner"), first.alias("first")))
        level = 0
        while self.levels[level][1] >= self.fan_out:
            self._push_down(level)
            level += 1

    def totals(self) -> DataFrame:
        """Every key once, with its documents and owner. Leaves a single level with runs."""
        for level in range(len(self.levels) - 1):
            if self.levels[level][1]:
                self._push_down(level)
        return self._merged(len(self.levels) - 1)

    def _merged(self, level: int) -> DataFrame:
        return self.spark.table(self.levels[level][0]).groupBy("h").agg(
            F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"), F.max("first").alias("first")
        )

    def _push_down(self, level: int) -> None:
        self._append(level + 1, self._merged(level))
        self.levels[level] = [self._name(), 0]

    @staticmethod
    def _name() -> str:
        return f"line_runs_{uuid.uuid4().hex}"

    def _append(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([self._name(), 0])
        name = self.levels[level][0]
        to = run.write.mode("append").format("parquet").bucketBy(self.buckets, "h").sortBy("h")
        to.option("path", f"{checkpoint_dir(self.spark)}/{name}").saveAsTable(name)
        self.levels[level][1] += 1


def _row_name(docs: DataFrame, key: str) -> Column:
    """The same for rows with the same id and text."""
    return F.md5(F.concat(F.coalesce(docs[key].cast("string"), F.lit("null")), F.lit(":"), text_of(docs)))


def _batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Ranges of ids with about as many rows each, the largest ids first; a null id comes last."""
    steps = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(key, steps, 10_000)).first()[0] or []
    above = sum((F.coalesce(docs[key] > F.lit(b), F.lit(False)).cast("int") for b in bounds), F.lit(0))
    return F.lit(len(bounds)) - above


def shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 8, fan_out: int = 4, key: str = "doc_id") -> DataFrame:
    """``row`` and the positions ``gone`` of its lines that go, for rows that lose some.

    ``docs`` has a numeric ``key`` and ``text``. A key goes that at least ``least_docs`` rows hold, but from
    the rows of its owner.
    """
    spark = prepare(docs.sparkSession)
    cut = docs.select(
        F.col(key).alias("doc"), _batch_of(docs, key, batches).alias("batch"), _row_name(docs, key).alias("row"),
        line_keys(text_of(docs), least_chars).alias("keys"),
    )
    cut = store(cut.filter(F.size("keys") > 0), "batch")
    runs = LineRuns(spark, fan_out)
    for batch in range(batches):
        own = cut.filter(F.col("batch") == batch)
        runs.add(own.select("doc", F.explode(F.array_distinct(F.transform("keys", lambda k: k["h"]))).alias("h")))
    shared = store(runs.totals().filter(F.col("n_docs") >= least_docs))
    lines = cut.select("doc", "row", F.explode("keys").alias("at")).select("doc", "row", "at.pos", "at.h")
    every = cut.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    is_hot = F.col("n_docs") * HOT_KEYS >= every
    hot = F.broadcast(shared.filter(is_hot).select("h", "owner"))
    cold = shared.filter(~is_hot).select("h", "owner")
    met = lines.join(hot, "h").unionByName(lines.join(hot, "h", "left_anti").join(cold, "h"))
    lost = met.filter(~F.col("doc").eqNullSafe(F.col("owner")))
    return store(lost.groupBy("row").agg(F.collect_set("pos").alias("gone")))


def drop_shared_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 8, fan_out: int = 4, key: str = "doc_id",
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``, and the numbers of lines before and dropped."""
    gone = shared_lines(docs.select(key, "text"), least_chars, least_docs, batches, fan_out, key)
    row, lost, lines = fresh(docs, "row"), fresh(docs, "gone"), fresh(docs, "lines")
    met = docs.withColumn(row, _row_name(docs, key)).join(gone.select(F.col("row").alias(row), F.col("gone").alias(lost)), row, "left")
    met = met.withColumns({lines: lines_of(text_of(met)), lost: F.coalesce(F.col(lost), F.array().cast("array<int>"))})
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    picked = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    own = [F.when(F.size(lost) > 0, picked).otherwise(text_of(met)).alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns]
    counts = [F.size(lines).cast("long").alias(fresh(docs, n_lines)), F.size(lost).cast("long").alias(fresh(docs, n_dropped))]
    return met.select(*own, *counts)
