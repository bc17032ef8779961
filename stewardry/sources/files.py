"""Scans of raw files and bulk text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import in_excluded_dir, passes_file_filters
from ..functions.text import suffix

# Bytes of one file to its text; ValueError with a reason means "skip", not failure.
Extractor = Callable[[bytes], str]

PLAIN_TEXT = (".txt", ".md")
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _local_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))


def scan_files(
    spark: SparkSession,
    roots: Sequence[str],
    extensions: Sequence[str],
    exclude_dirs: Sequence[str] = (),
    min_bytes: int = 0,
    max_bytes: int = 2**62,
    modified_after: datetime | None = None,
) -> DataFrame:
    """Recursive listing with content. Unless ``content`` is selected, no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    found = _local_path(reader.load(list(roots)))
    return found.filter(passes_file_filters("path", "length", extensions, min_bytes, max_bytes)).filter(
        ~in_excluded_dir("path", exclude_dirs)
    )


def watch_files(spark: SparkSession, root: str, max_files_per_trigger: int = 10_000) -> DataFrame:
    """Stream of new paths under ``root``; existing files come first. A changed file under an
    old path is not emitted again by the file source: see :func:`scan_incremental`."""
    return _local_path(
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(root)
    )


def with_sha256(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def scan_incremental(files: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of a scan whose path is new or whose content differs from ``current(path, sha256)``."""
    known = current.select("path", F.col("sha256").alias("_known"))
    return (
        with_sha256(files)
        .join(known, "path", "left")
        .filter(F.col("_known").isNull() | (F.col("_known") != F.col("sha256")))
        .drop("_known")
    )


def read_text(files: DataFrame) -> DataFrame:
    """``content`` of plain-text files as text, bad bytes as replacement characters."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def extract(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Add ``text, skip_reason``. Plain text stays in the JVM; other extensions go through the
    user's extractors in Arrow batches; the rest are skipped with a reason."""
    handlers = {k.lower(): v for k, v in (extractors or {}).items()}
    ext = suffix("path")
    plain = ext.isin(*[e for e in PLAIN_TEXT if e not in handlers]) if set(PLAIN_TEXT) - set(handlers) else F.lit(False)
    handled = ext.isin(*handlers) if handlers else F.lit(False)
    as_text = read_text(files.filter(plain)).withColumn("skip_reason", F.lit(None).cast("string"))
    unsupported = (
        files.filter(~plain & ~handled)
        .withColumn("text", F.lit(None).cast("string"))
        .withColumn("skip_reason", F.concat(F.lit("unsupported extension: "), ext))
    )
    out = as_text.unionByName(unsupported)
    if not handlers:
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, reasons = [], []
            for path, content in zip(batch["path"], batch["content"]):
                text, reason = None, None
                try:
                    text = handlers["." + path.rsplit(".", 1)[-1].lower()](bytes(content))
                except ValueError as err:
                    reason = str(err) or "extraction refused"
                except Exception as err:  # one broken file must not fail the job
                    reason = f"extraction failed: {err}"
                texts.append(text)
                reasons.append(reason)
            yield batch.assign(text=texts, skip_reason=reasons)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    parsed = files.filter(handled).mapInPandas(run, f"{schema}, text string, skip_reason string")
    return out.unionByName(parsed)
