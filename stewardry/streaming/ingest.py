"""Incremental classification: new files in, append-only tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import in_excluded_dir, passes_file_filters
from ..functions.times import as_timestamp
from ..operators.classify import Scorer, classify, handling_hints
from ..operators.governance import (
    Catalog,
    Rule,
    activity_rows,
    apply_governance,
    audit_note,
    build_audit_rows,
    build_report,
    match_rules,
    resolve_categories,
    rule_hint_block,
)
from ..operators.groups import previous_in_group, top_per_group
from ..operators.routing import checked, route, skip_events
from ..operators.versions import adopt_renames
from ..schema import FILES, OVERRIDES, with_columns_of
from ..session import cut_lineage
from ..sources.files import Extractor, extract, scan_files, watch_files, with_sha256
from ..sources.sinks import write_batch
from .snapshot import Snapshot, read_table


@dataclass
class IngestSettings:
    """What to take in, and how to judge it."""

    extensions: Sequence[str] = (".txt", ".md")
    exclude_dirs: Sequence[str] = ()
    min_bytes: int = 0
    max_bytes: int = 2**62
    extractors: Mapping[str, Extractor] = field(default_factory=dict)
    scorer: Scorer | None = None
    source: str = "scorer"
    handling_scorer: Scorer | None = None
    history_entries: int = 8
    part_chars: int = 12_000
    rules: Sequence[Rule] = ()
    catalog: Catalog | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    # Column of the found rows with the time at which each was taken in. A batch may then hold several versions
    # of a file, each judged against the one before it, as if every time had been a batch of its own.
    at: str | None = None


HASHES = T.StructType([f for f in FILES.fields if f.name in ("path", "sha256", "file_id", "last_analyzed_utc", "last_checked_utc")])
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modificationTime", T.TimestampType())])


def current_files(spark: SparkSession, root: str) -> Snapshot:
    return Snapshot(spark, root, "files", FILES)


def _by_hash(spark: SparkSession, root: str) -> Snapshot:
    """Who has a content: read where renames are looked for."""
    return Snapshot(spark, root, "files_by_hash", HASHES, key="sha256")


def _listing(spark: SparkSession, root: str) -> Snapshot:
    """Size and time of every file that a scan has met, taken in or not."""
    return Snapshot(spark, root, "listing", LISTING)


def stored_files(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return current_files(spark, root).read(before)


def process_batch(
    found: DataFrame,
    batch_id: int,
    root: str,
    settings: IngestSettings,
    overrides: DataFrame | None = None,
    live: DataFrame | None = None,
) -> None:
    """Route, classify, govern and append one micro-batch of ``binaryFile`` rows.

    Every table gets its own folder per batch, so that a repeated batch replaces itself. What is
    known of the files is read from the buckets of their paths only, and with ``live(path)``, the
    paths that exist now, from the buckets of their hashes: renamed files keep their id.
    """
    spark = found.sparkSession
    if settings.at is not None and live is not None:
        raise ValueError("renames are looked for in batches of one version a file")
    now = settings.clock()
    at = as_timestamp(now) if settings.at is None else F.col(settings.at)
    files, by_hash = current_files(spark, root), _by_hash(spark, root)
    current = files.read(batch_id, files.touched(found))
    listed = found.filter(~in_excluded_dir("path", settings.exclude_dirs))
    admitted = passes_file_filters("path", "length", settings.extensions, settings.min_bytes, settings.max_bytes)
    none = F.lit(None).cast("string")
    texts = (
        extract(with_sha256(listed.filter(admitted)), settings.extractors)
        .drop("content")
        .unionByName(listed.filter(~admitted).drop("content").withColumns({"sha256": none, "text": none, "skip_reason": none}))
    )
    # Extraction runs once; everything below reads its written result.
    routed = cut_lineage(route(texts, current.select("path", "sha256"), settings.extensions, settings.min_bytes, settings.max_bytes))
    if settings.at is not None:
        routed = cut_lineage(_stepwise(routed, settings.at))
    order = F.lit(batch_id) * F.lit(2**40) + F.pmod(F.xxhash64("path"), F.lit(2**40))
    routed = routed.withColumn("ord", order)

    moves = None
    if live is not None:
        fresh = routed.filter(F.col("outcome") == "classify").select("path", "sha256", "ord")
        holders = by_hash.read(batch_id, by_hash.touched(fresh)).join(current.select("path"), "path", "left_anti")
        known_or_same = current.select(HASHES.names).unionByName(holders.select(HASHES.names))
        moves = cut_lineage(adopt_renames(fresh, known_or_same, live, now).select("old_path", "new_path", "file_id", "sha256"))
        moved = moves.select(F.col("new_path").alias("path"), F.lit(True).alias("_moved"))
        # A renamed file has its stored content, so it counts as unchanged.
        routed = (
            routed.join(moved, "path", "left")
            .withColumn("outcome", F.when(F.col("_moved"), "skip_hash").otherwise(F.col("outcome")))
            .drop("_moved")
        )

    hits = match_rules("text", settings.rules)
    waiting = routed.filter(F.col("outcome") == "classify").withColumn("hits", hits).withColumn("hint", rule_hint_block("hits"))
    scored = classify(waiting, settings.scorer, settings.source, settings.part_chars)
    judged = scored.withColumns(
        {
            "model_tags": F.col("result.tags"),
            "model_security_level": F.col("result.security_level"),
            "summary": F.col("result.summary"),
        }
    )
    catalog_rows = overrides if overrides is not None else spark.createDataFrame([], OVERRIDES)
    governed = apply_governance(judged, catalog_rows)
    if settings.catalog is not None:
        chosen = resolve_categories(settings.catalog, "result.category_ids", "result.category_id", "model_tags")
        governed = governed.withColumn("category_ids", chosen["ids"]).withColumn("category_needs_review", chosen["needs_review"])
    known = current.select("path", *[F.col(c).alias(f"_old_{c}") for c in ("file_id", "sha256", "summary", "summary_history")])
    made_id = F.substring(F.sha2(F.concat_ws("\x1f", "path", "sha256", F.lit(str(batch_id))), 256), 1, 32)
    versions = (
        _with_old(governed, known, made_id, settings.at)
        .withColumn("file_id", F.coalesce("_old_file_id", made_id))
        .withColumns(_change_columns(at))
        .withColumn("summary_history", _history(settings.history_entries, settings.at))
        .withColumn("last_analyzed_utc", at)
        .withColumn("last_checked_utc", at)
    )
    new_versions = cut_lineage(with_columns_of(versions, FILES))
    written, gone = new_versions, None
    if moves is not None:
        old = moves.select(F.col("old_path").alias("path"), "new_path", "sha256")
        carried = (
            files.read(batch_id, files.touched(old)).join(old.select("path", "new_path"), "path")
            .withColumn("path", F.col("new_path"))
            .withColumn("last_checked_utc", at)
        )
        written, gone = cut_lineage(with_columns_of(carried, FILES).unionByName(new_versions)), old.select("path", "sha256")
        write_batch(moves, f"{root}/file_moves", batch_id)
    write_batch(written, f"{root}/file_versions", batch_id)
    if settings.at is None:
        seen = checked(routed, at).select("path")
        rechecked = current.join(seen, "path", "left_semi").withColumn("last_checked_utc", at)
        state = written.unionByName(rechecked.select(FILES.names))
    else:
        written = cut_lineage(top_per_group(written, ["path"], [F.col("last_analyzed_utc").desc(), F.col("sha256").desc()], 1).drop("rn"))
        seen = checked(routed, at).groupBy("path").agg(F.max("checked_utc").alias("_seen"))
        rechecked = current.join(seen, "path", "left_semi").join(written, "path", "left_anti")
        state = (
            written.unionByName(rechecked.select(FILES.names)).join(seen, "path", "left")
            .withColumn("last_checked_utc", F.greatest("last_checked_utc", "_seen")).select(FILES.names)
        )
    files.replace(batch_id, state, gone)
    # The hash that a new version replaces, and the one that a renamed file leaves, are given up.
    given_up = current.select("path", "sha256").join(written.select("path"), "path", "left_semi")
    by_hash.replace(batch_id, written.select(HASHES.names), given_up if gone is None else given_up.unionByName(gone))
    write_batch(checked(routed, at), f"{root}/check_events", batch_id)
    write_batch(skip_events(routed, at), f"{root}/skip_events", batch_id)
    write_batch(activity_rows(routed, at), f"{root}/activity_log", batch_id)
    write_batch(_audit_rows(new_versions, waiting, settings), f"{root}/audit_log", batch_id)
    write_batch(build_report(new_versions, settings.catalog), f"{root}/classification_report", batch_id)


def _stepwise(routed: DataFrame, at: str) -> DataFrame:
    """Outcomes of a batch with several versions of a file: unchanged is what equals the version before."""
    readable = F.col("outcome").isin("skip_hash", "classify")
    version = ["path", at, "sha256"]
    # Versions that cannot be read or are empty are passed over.
    steps = routed.filter(readable).select(*version, "prev_sha256").distinct()
    before = previous_in_group(steps, ["path"], [at, "sha256"], {"_before": F.col("sha256")})
    held = before.select(*version, F.coalesce("_before", "prev_sha256").alias("_held"))
    decided = F.when(F.col("_held") == F.col("sha256"), "skip_hash").otherwise("classify")
    return routed.join(held, version, "left").withColumn("outcome", F.when(readable, decided).otherwise(F.col("outcome"))).drop("_held")


def _with_old(governed: DataFrame, known: DataFrame, made_id: Column, at: str | None) -> DataFrame:
    """The version that each new one follows, as ``_old_`` columns: the stored one, or one of the batch."""
    joined = governed.join(known, "path", "left")
    if at is None:
        return joined
    order = Window.partitionBy("path").orderBy(at, "sha256")
    first = F.row_number().over(order) == 1
    old = {f"_old_{c}": F.when(first, F.col(f"_old_{c}")).otherwise(F.lag(c).over(order)) for c in ("sha256", "summary")}
    return joined.drop("text").withColumns({"_old_file_id": F.coalesce("_old_file_id", F.first(made_id).over(order)), **old})


def _change_columns(at: Column) -> dict[str, Column]:
    """Change line and history entry of a new version, against the version that it follows.

    Old texts are not kept, so a change is told by the summary, else by the hash alone.
    """
    changed = F.coalesce(F.col("_old_sha256") != F.col("sha256"), F.lit(False))
    old, new = F.coalesce("_old_summary", F.lit("")), F.coalesce("summary", F.lit(""))
    reworded = (old != "") & (new != "") & (old != new)
    line = F.when(reworded, F.concat(F.lit("summary: "), F.substring(old, 1, 80), F.lit(" -> "), F.substring(new, 1, 80))).otherwise("other content")
    entry = F.struct(
        F.col("sha256").alias("sha256"), F.col("summary").alias("summary"), at.alias("utc"), F.when(changed, line).alias("change_summary")
    )
    return {"last_change_summary": F.when(changed, line), "last_change_utc": F.when(changed, at), "_entry": entry}


def _history(entries: int, at: str | None) -> Column:
    """The stored history and the entries up to the version's own, the newest ``entries`` of them."""
    added = F.array("_entry")
    if at is not None:
        added = F.collect_list("_entry").over(Window.partitionBy("path").orderBy(at, "sha256").rowsBetween(1 - entries, 0))
    before = F.coalesce("_old_summary_history", F.array().cast(FILES["summary_history"].dataType))
    whole = F.concat(before, added)
    return F.slice(whole, -F.least(F.size(whole), F.lit(entries)), entries)


def _audit_rows(versions: DataFrame, texts: DataFrame, settings: IngestSettings) -> DataFrame:
    """Audit rows of a batch, with the handling note of each sensitive content where a scorer gives one."""
    if settings.handling_scorer is None:
        return build_audit_rows(versions)
    levels = versions.select("path", "security_level")
    notes = handling_hints(texts.select("path", "sha256", "text").join(levels, "path"), settings.handling_scorer)
    noted = versions.join(notes, ["sha256", "security_level"], "left")
    return build_audit_rows(noted, audit_note("handling.handling_note", "handling.sharing"))


def ingest_scan(
    spark: SparkSession,
    roots: Sequence[str],
    root: str,
    batch_id: int,
    settings: IngestSettings,
    overrides: DataFrame | None = None,
) -> None:
    """What was created, modified or renamed since the last scan, as a batch.

    The listing is compared with that of the last scan by size and time; only files that differ are
    opened. Renamed files keep their id; a file that is gone keeps its record, as it may turn up.
    """
    before = _listing(spark, root)
    scan = lambda **k: scan_files(spark, roots, settings.extensions, settings.exclude_dirs, settings.min_bytes, settings.max_bytes, **k)
    listing = cut_lineage(scan().select(LISTING.names))
    known = before.read(batch_id).withColumn("_known", F.lit(True))
    changed = cut_lineage(listing.join(known, LISTING.names, "left").filter(F.col("_known").isNull()).select(LISTING.names))
    oldest = changed.agg(F.min("modificationTime")).first()[0]
    if oldest is not None:
        # Spark lists by time, so that hardly a file that did not change is opened.
        found = scan(modified_after=oldest - timedelta(seconds=2)).join(changed.select("path"), "path", "left_semi")
        process_batch(found, batch_id, root, settings, overrides, live=listing.select("path"))
    before.replace(batch_id, changed, known.join(listing.select("path"), "path", "left_anti"))


def start_watch(
    spark: SparkSession,
    roots: Sequence[str],
    root: str,
    checkpoint: str,
    settings: IngestSettings,
    overrides: DataFrame | None = None,
    after_batch: Callable[[SparkSession, str, int], None] | None = None,
    every: str = "1 minute",
    once: bool = False,
) -> StreamingQuery:
    """Scan ``roots`` again and again: created, modified and renamed files are all taken in.

    The ticks of a rate source number the scans; a scan that was cut short is repeated under its number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_scan(batch.sparkSession, roots, root, batch_id, settings, overrides)
        if after_batch is not None:
            after_batch(batch.sparkSession, root, batch_id)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 1000).load()
    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    settings: IngestSettings,
    overrides: DataFrame | None = None,
    after_batch: Callable[[SparkSession, str, int], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Take in the files that turn up in ``folder``, each path once; :func:`start_watch` also sees edits
    and renames. Existing files come first; ``once`` handles what is there and stops.
    ``after_batch`` refreshes derived tables, once per micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, settings, overrides)
        if after_batch is not None:
            after_batch(batch.sparkSession, root, batch_id)

    writer = watch_files(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
