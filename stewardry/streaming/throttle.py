"""Leading-edge throttle per path: an event passes if the last one that passed is old enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _first_allowed(us: np.ndarray, last: int | None, gap: int) -> int:
    return 0 if last is None else int(np.searchsorted(us, last + gap))


def passing(us: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Positions in sorted ``us`` that pass, given the time of the last event that passed."""
    out, i = [], _first_allowed(us, last, gap)
    while i < len(us):
        out.append(i)
        i = int(np.searchsorted(us, us[i] + gap))
    return out


def throttle(events: DataFrame, seconds: float = 2.0, bucket_seconds: int = 3600) -> DataFrame:
    """The events of ``events(path, event_ts, ord)`` that pass, as ``path, event_ts, ord``.

    A path is cut into time buckets that are worked on independently: each bucket first says how
    it would end for every way it can be entered (only its first ``seconds`` matter for that), the
    few numbers per bucket are followed along the path, and then each bucket is thinned with its
    true entry. No task holds more than one bucket of one path.
    """
    gap = int(max(0.0, seconds) * 1_000_000)
    width = int(max(bucket_seconds, seconds, 1) * 1_000_000)
    if gap == 0:
        return events.select("path", "event_ts", "ord")
    us = F.unix_micros("event_ts")
    buckets = (
        events.groupBy("path", F.floor(us / F.lit(width)).cast("long").alias("bucket"))
        .agg(F.sort_array(F.collect_list(F.struct(us.alias("us"), F.col("ord")))).alias("seen"))
    )
    times = F.transform("seen", lambda e: e["us"])
    step = lambda last, t: F.when(t >= last + gap, t).otherwise(last)
    # An entry decides which event passes first: one of those early in the bucket or the first
    # after them. Later first events never end the bucket earlier.
    early = (F.col("bucket") * width) + gap
    firsts = F.array_distinct(F.filter(times, lambda t: (t < early) | (t == F.array_min(F.filter(times, lambda x: x >= early)))))
    ways = F.transform(
        firsts, lambda f: F.struct(f.alias("first"), F.aggregate(F.filter(times, lambda t: t >= f), f, step).alias("end"))
    )
    none = F.lit(None).cast("long")
    entries_type = "array<struct<bucket:bigint,entry:bigint>>"

    def follow(state: Column, b: Column) -> Column:
        last = state["last"]
        taken = F.filter(b["ways"], lambda w: last.isNull() | (w["first"] >= last + gap))
        end = F.when(F.size(taken) > 0, F.element_at(taken, 1)["end"])
        return F.struct(
            F.coalesce(end, last).alias("last"),
            F.concat(state["entries"], F.array(F.struct(b["bucket"].alias("bucket"), last.alias("entry")))).alias("entries"),
        )

    start = F.struct(none.alias("last"), F.array().cast(entries_type).alias("entries"))
    along = F.sort_array(F.collect_list(F.struct(F.col("bucket"), ways.alias("ways"))))
    entries = (
        buckets.groupBy("path")
        .agg(F.aggregate(along, start, follow)["entries"].alias("e"))
        .select("path", F.explode("e").alias("e"))
        .select("path", "e.bucket", "e.entry")
    )

    def thin(state: Column, e: Column) -> Column:
        passes = state["last"].isNull() | (e["us"] >= state["last"] + gap)
        return F.struct(
            F.when(passes, e["us"]).otherwise(state["last"]).alias("last"),
            F.when(passes, F.concat(state["kept"], F.array(e))).otherwise(state["kept"]).alias("kept"),
        )

    begin = F.struct(F.col("entry").alias("last"), F.array().cast("array<struct<us:bigint,ord:bigint>>").alias("kept"))
    kept = buckets.join(entries, ["path", "bucket"]).select("path", F.explode(F.aggregate("seen", begin, thin)["kept"]).alias("e"))
    return kept.select("path", F.timestamp_micros("e.us").alias("event_ts"), F.col("e.ord").alias("ord"))


def throttle_stream(events: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Streaming form over ``events(path, event_ts)``: the state is one time per path, forgotten
    ``max(60, 10 * seconds)`` seconds of event time after the last event that passed. Events that
    arrive later than that are left out."""
    gap = int(max(0.0, seconds) * 1_000_000)
    forget = int(max(60.0, 10 * seconds))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        us = np.sort(np.concatenate([b["us"].to_numpy() for b in batches]))
        last = state.get[0] if state.exists else None
        kept = us[passing(us, last, gap)] if gap else us
        if len(kept):
            last = int(kept[-1])
            state.update((last,))
        due = last // 1000 + forget * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"path": key[0], "us": kept})

    marked = events.withWatermark("event_ts", f"{forget} seconds")
    slim = marked.select("path", "event_ts", F.unix_micros("event_ts").alias("us"))
    out = slim.groupBy("path").applyInPandasWithState(
        step, "path string, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("path", F.timestamp_micros("us").alias("event_ts"))
