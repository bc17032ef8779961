"""Context bundles kept up to date from a stream of file events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bundles import context_bundles, newest_bundles
from ..session import cut_lineage
from ..sources.sinks import write_batch
from .ingest import read_table


def latest_bundles(events: DataFrame, root: str, before: int | None = None) -> DataFrame | None:
    """The bundle table as of the last finished micro-batch."""
    stored = read_table(events.sparkSession, root, "bundles", before)
    if stored is None:
        return None
    last = stored.agg(F.max("batch").alias("b")).first().b
    return None if last is None else stored.filter(F.col("batch") == last).drop("batch")


def update_bundles(
    events: DataFrame,
    batch_id: int,
    root: str,
    window_minutes: int = 30,
    max_bundles: int = 60,
    extra_roots: Sequence[str] = (),
    lateness_minutes: int = 10,
) -> None:
    """Append the events, rebuild the bundles their arrival can change, keep the newest.

    An event changes the bundles of anchors up to one window away. The events table is the buffer;
    only the stretch within two windows and the allowed lateness of this batch is read.
    """
    new = cut_lineage(events.select("path", "event_ts", "ord"))
    write_batch(new, f"{root}/fs_events", batch_id)
    edge = new.agg(F.min("event_ts").alias("lo")).first().lo
    if edge is None:
        return
    window = max(1, min(240, int(window_minutes)))
    everything = read_table(events.sparkSession, root, "fs_events", batch_id + 1).drop("batch")
    reach = F.lit(edge) - F.expr(f"interval {window + lateness_minutes} minutes")
    anchors = everything.filter(F.col("event_ts") >= reach)
    around = everything.filter(F.col("event_ts") >= reach - F.expr(f"interval {window} minutes"))
    fresh = context_bundles(anchors, around, window, max_bundles, extra_roots)
    old = latest_bundles(events, root, batch_id)
    if old is not None:
        fresh = newest_bundles(old.filter(F.col("anchor_event_utc") < reach), fresh, max_bundles=max_bundles)
    write_batch(fresh, f"{root}/bundles", batch_id)


def start_bundles(events: DataFrame, root: str, checkpoint: str, once: bool = False, **settings: object) -> StreamingQuery:
    writer = (
        events.writeStream.foreachBatch(lambda df, i: update_bundles(df, i, root, **settings))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
