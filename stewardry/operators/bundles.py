"""Context bundles: files touched around the same time in the same folder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import under_root
from ..functions.text import basename, dirname, label_safe
from .groups import top_per_group


def _with_groups(events: DataFrame, extra_roots: Sequence[str]) -> DataFrame:
    """One row per event and group it can be found in: its folder, and ``*`` below an extra root."""
    folder = dirname("path")
    if not extra_roots:
        return events.withColumn("grp", folder)
    extra = reduce(lambda a, b: a | b, [under_root("path", r) for r in extra_roots])
    return events.withColumn("grp", F.explode(F.when(extra, F.array(folder, F.lit("*"))).otherwise(F.array(folder))))


def _neighbour_sketch(grouped: DataFrame, cell: Column) -> DataFrame:
    """Per group and time cell: its two latest and two earliest paths, with their times.

    Two paths are enough to answer "is there an event of another path close by": at most one of
    them is the asking path itself.
    """
    per_path = grouped.groupBy("grp", cell.alias("cell"), "path").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    latest = top_per_group(per_path, ["grp", "cell"], [F.col("hi").desc(), F.col("path")], 2)
    earliest = top_per_group(per_path, ["grp", "cell"], [F.col("lo").asc(), F.col("path")], 2)
    pick = lambda df, t, name: df.groupBy("grp", "cell").agg(
        F.collect_list(F.struct(F.col("path"), F.col(t).alias("us"))).alias(name)
    )
    return pick(latest, "hi", "latest").join(pick(earliest, "lo", "earliest"), ["grp", "cell"])


def anchors_with_company(anchors: DataFrame, events: DataFrame, window_minutes: int, extra_roots: Sequence[str] = ()) -> DataFrame:
    """The ``anchors(path, event_ts, ord)`` that have an event of another path within the window.

    Events are looked at per group and cell of one window length: anything in the own cell is
    close enough, of the two cells beside it only the nearest two paths matter. No pairs are built.
    """
    width = window_minutes * 60_000_000
    cell = F.floor(F.col("us") / F.lit(width)).cast("long")
    grouped = _with_groups(events.withColumn("us", F.unix_micros("event_ts")), extra_roots)
    sketch = _neighbour_sketch(grouped, cell)
    reaches = sketch.select(
        "grp", F.explode(F.array(*[F.struct((F.col("cell") + d).alias("at"), F.lit(-d).alias("side")) for d in (-1, 0, 1)])).alias("x"),
        "latest", "earliest",
    ).groupBy("grp", F.col("x.at").alias("cell")).agg(
        # One sketch per side; a cell has at most three.
        F.max(F.when(F.col("x.side") == -1, F.col("latest"))).alias("before"),
        F.max(F.when(F.col("x.side") == 0, F.col("latest"))).alias("here"),
        F.max(F.when(F.col("x.side") == 1, F.col("earliest"))).alias("after"),
    )
    located = anchors.withColumn("us", F.unix_micros("event_ts")).withColumn("cell", cell)
    groups = F.array(dirname("path"), F.lit("*")) if extra_roots else F.array(dirname("path"))
    asked = located.withColumn("grp", F.explode(groups))

    def other(side: str, near: Column | None) -> Column:
        def test(e: Column) -> Column:
            ok = e["path"] != F.col("path")
            return ok if near is None else ok & (F.abs(e["us"] - F.col("us")) <= F.lit(width))

        return F.coalesce(F.exists(F.col(side), test), F.lit(False))

    found = asked.join(reaches, ["grp", "cell"]).filter(
        other("here", None) | other("before", F.lit(1)) | other("after", F.lit(1))
    )
    hits = found.select(*anchors.columns)
    return hits.distinct() if extra_roots else hits


def _seconds_text(micros: Column) -> Column:
    """Seconds with three decimals, rounded as the binary number of seconds is, for times from March 1970 on.

    A tie in microseconds is not one for the nearest binary number: that is compared exactly, in
    units of 2^-30 seconds.
    """
    unit = 1 << 30
    exact = lambda c: c.cast("decimal(20,0)").cast("decimal(38,0)")
    binary = exact((micros / F.lit(1e6) * F.lit(float(unit))).cast("bigint")) * F.lit(1_000_000)
    decimal = exact(micros) * F.lit(unit)
    millis, rest = F.floor(micros / 1000), F.pmod(micros, F.lit(1000))
    up = (rest > 500) | ((rest == 500) & ((binary > decimal) | ((binary == decimal) & (millis % 2 == 1))))
    rounded = millis + up.cast("long")
    return F.concat(F.floor(rounded / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(rounded, F.lit(1000)).cast("string"), 3, "0"))


def context_bundles(
    anchors: DataFrame,
    events: DataFrame,
    window_minutes: int = 30,
    max_bundles: int | None = None,
    extra_roots: Sequence[str] = (),
    same_folder_only: bool = False,
) -> DataFrame:
    """Bundles of ``anchors(path, event_ts, ord)`` over ``events(path, event_ts, ord)``, all or the
    ``max_bundles`` newest.

    Which anchors have company is decided without pairs; they then meet the events of their
    window by folder and time cell. :func:`bundle_members` gives the same one row per path.
    """
    members = bundle_members(anchors, events, window_minutes, max_bundles, extra_roots, same_folder_only)
    bundles = members.groupBy("anchor_path", "anchor_event_utc", "ord").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seen", "path"))), lambda e: e["path"]).alias("related_paths")
    )
    stamp = _seconds_text(F.unix_micros("anchor_event_utc"))
    signature = F.concat_ws("|", "anchor_path", stamp, F.array_join("related_paths", ","))
    return bundles.select(
        F.substring(F.sha2(signature, 256), 1, 12).alias("bundle_id"),
        "anchor_path",
        "anchor_event_utc",
        "related_paths",
        F.lit(window_minutes).alias("window_minutes"),
        "ord",
    )


def bundle_members(
    anchors: DataFrame,
    events: DataFrame,
    window_minutes: int = 30,
    max_bundles: int | None = None,
    extra_roots: Sequence[str] = (),
    same_folder_only: bool = False,
) -> DataFrame:
    """``anchor_path, anchor_event_utc, ord, path, seen`` of every path touched within the window
    of an anchor; ``seen`` is the first time and event there."""
    if window_minutes < 1:
        raise ValueError("the window must be a minute or more")
    extra = [] if same_folder_only else list(extra_roots)
    kept = anchors_with_company(anchors, events, window_minutes, extra)
    if max_bundles is not None:
        kept = kept.orderBy(F.col("event_ts").desc(), F.col("ord").desc()).limit(max_bundles)
    span = window_minutes * 60_000_000
    kept = kept.select(
        F.col("path").alias("anchor_path"), F.col("event_ts").alias("anchor_event_utc"), "ord", F.unix_micros("event_ts").alias("_us")
    )
    groups = F.array(dirname("anchor_path"), F.lit("*")) if extra else F.array(dirname("anchor_path"))
    cell = F.floor(F.col("_us") / span)
    asked = kept.withColumn("grp", F.explode(groups)).withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    seen = _with_groups(events.select("path", F.unix_micros("event_ts").alias("us"), F.col("ord").alias("event_ord")), extra)
    near = seen.withColumn("_cell", F.floor(F.col("us") / span)).join(asked, ["grp", "_cell"]).filter(
        (F.col("path") != F.col("anchor_path")) & (F.abs(F.col("us") - F.col("_us")) <= span)
    )
    return near.groupBy("anchor_path", "anchor_event_utc", "ord", "path").agg(F.min(F.struct("us", "event_ord")).alias("seen"))


def newest_bundles(*parts: DataFrame, max_bundles: int = 60) -> DataFrame:
    """Merge stored and new bundles and keep the newest."""
    merged = reduce(DataFrame.unionByName, parts).dropDuplicates(["bundle_id", "ord"])
    return merged.orderBy(F.col("anchor_event_utc").desc(), F.col("ord").desc()).limit(max_bundles)


def bundle_rows(bundles: DataFrame, limit: int = 60) -> DataFrame:
    """Display rows: six related names and how many more there are."""
    count = F.size("related_paths")
    names = F.array_join(
        F.transform(F.slice("related_paths", 1, 6), lambda p: label_safe(basename(p), 60)), ", "
    )
    more = F.when(count > 6, F.concat(F.lit(", ... (+"), (count - 6).cast("string"), F.lit(" more)"))).otherwise("")
    return (
        bundles.orderBy(F.col("anchor_event_utc").desc(), F.col("ord").desc())
        .limit(limit)
        .select(
            "bundle_id",
            label_safe(basename("anchor_path"), 80).alias("anchor"),
            "anchor_event_utc",
            "window_minutes",
            count.alias("related_count"),
            F.concat(names, more).alias("preview"),
        )
    )


def bundle_paths(bundles: DataFrame) -> DataFrame:
    """``bundle_id, path`` of the anchor and of every related path, as listed."""
    return bundles.select("bundle_id", F.explode(F.concat(F.array("anchor_path"), "related_paths")).alias("path"))
