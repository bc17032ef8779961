"""Removal of repeated byte strings with sparse suffixes.

Every string of ``length`` bytes holds an anchor: the position with the smallest hash of the
``GRAM`` bytes there, the last one of equals. Equal strings have equal anchors, so that only
suffixes that start at anchors need to be compared, about one in eighty.

Strings around anchors with one hash are settled by counting where all bytes around the anchor
are alike, and by sorting where they are not: within a task the contexts of one anchor hash are
suffix-sorted (see ``suffix_sort``), and neighbours in that order tell which strings repeat.
Where very many different contexts share an anchor, slices of them, and strings, are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import small, store
from .suffix_sort import repeated_offsets
from .words import mix, pieces, prefix_sums, span_hashes, text_bytes

GRAM = 40
CROWD = 256  # different contexts of one anchor that are sorted together
SLICE = 8  # distances counted together where there are more
SEGMENT = 1 << 18
_LOW = np.uint64((1 << 22) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per anchor: text, place, first and last start of the strings that have it, hash of its
    bytes, hash of all bytes of these strings and of the place among them."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    hashes = span_hashes(sums, at, at + GRAM)
    keys = (hashes & ~_LOW) | (_LOW - at.astype(np.uint64))
    place = (_LOW - (_sliding_min(keys, length - GRAM + 1) & _LOW)).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + length <= ends)
    if not len(starts):
        return none, none, none, none, none, none
    chosen = place[starts]
    cut = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    p = chosen[np.concatenate([[0], cut])]
    around = mix(span_hashes(sums, first, last + length) + (p - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return np.searchsorted(bounds, p, "right") - 1, p, first, last, hashes[p].view(np.int64), around.view(np.int64)


def _segments(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Number of the first text, offset in it, bytes and bounds. A long text comes in segments
    that share ``length - 1`` bytes, so that every string lies in one of them."""
    for i, j in pieces(bounds, SEGMENT):
        size = bounds[j] - bounds[i]
        if j == i + 1 and size > SEGMENT:
            for start in range(0, int(size) - length + 1, SEGMENT):
                end = min(int(size), start + SEGMENT + length - 1)
                yield i, start, data[bounds[i] + start : bounds[i] + end], np.array([0, end - start])
        else:
            yield i, 0, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def _pack(place: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return place << 16 | most << 8 | least


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``key, weight, place, h, g`` per anchor of ``texts(key, weight, text)``. ``place`` packs the
    position in the text and the distances of the first and last string to it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, bounds = text_bytes(batch.column(2))
            for i, offset, some, inner in _segments(data, bounds, length):
                text, p, first, last, h, g = anchors(some, inner, length)
                owner = text + i
                place = _pack(p - inner[text] + offset, p - first, p - last)
                columns = (key[owner], weight[owner], place, h, g)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "weight", "place", "h", "g"])

    return texts.select("key", "weight", "text").mapInArrow(rows, "key bigint, weight bigint, place bigint, h bigint, g bigint")


def _anchor_hashes(texts: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column(0).to_numpy(zero_copy_only=False)
            data, bounds = text_bytes(batch.column(1))
            for i, _, some, inner in _segments(data, bounds, length):
                text, _, _, _, h, _ = anchors(some, inner, length)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(weight[text + i])], names=["h", "weight"])

    return texts.select("weight", "text").mapInArrow(rows, "h bigint, weight bigint")


def _sorted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """``key, start, end`` of repeated bytes, from contexts dealt by anchor hash."""

    def judged(group: list[dict]) -> Iterator[tuple[int, int, int]]:
        parts = [(r["context"], r["place"] >> 8 & 255, r["place"] & 255) for r in group]
        for r, ranges in zip(group, repeated_offsets(parts, [r["single"] for r in group], length)):
            p = r["place"] >> 16
            for near, far in ranges:
                yield r["key"], p - far, p - near + length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["key", "start", "end"])

        group: list[dict] = []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for r in batch.to_pylist():
                if group and group[0]["h"] != r["h"]:
                    found += judged(group)
                    group = []
                group.append(r)
            yield put(found)
        yield put(list(judged(group)) if group else [])

    dealt = contexts.repartition(shuffle_partitions(contexts.sparkSession) * 2, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(rows, "key bigint, start bigint, end bigint")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within the owner of so many things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _hash_in(sums: np.ndarray, start: np.ndarray, end: np.ndarray, with_: np.ndarray) -> np.ndarray:
    return mix(span_hashes(sums, start, end) + with_.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)


def _slices(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts cut by the distance of a string to the anchor, ``SLICE`` distances at a time:
    ``core`` names the bytes that all strings of a slice share, ``whole`` all bytes they have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "place", "h"))
            single = batch.column("single").to_numpy(zero_copy_only=False)
            data, bounds = text_bytes(batch.column("context"))
            sums = prefix_sums(data)
            most, least = place >> 8 & 255, place & 255
            owner, nth = _spread(most // SLICE - least // SLICE + 1)
            slice_ = least[owner] // SLICE + nth
            near, far = slice_ * SLICE, slice_ * SLICE + SLICE - 1
            at = bounds[owner] + most[owner]  # the anchor
            core = _hash_in(sums, at - near, at + length - far, h[owner] + slice_)
            low, high = np.maximum(near, least[owner]), np.minimum(far, most[owner])
            whole = _hash_in(sums, at - high, at + length - low, core + low * 256 + high)
            columns = (key[owner], place[owner], single[owner], slice_, core, whole)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "place", "single", "slice", "core", "whole"])

    schema = "key bigint, place bigint, single boolean, slice bigint, core bigint, whole bigint"
    return contexts.select("key", "place", "h", "single", "context").mapInArrow(rows, schema)


def _strings(asked: DataFrame, length: int) -> DataFrame:
    """``key, start, ask, string`` for every string of the asked slices (``slices`` of a context)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "place"))
            data, bounds = text_bytes(batch.column("context"))
            slices = batch.column("slices")
            inner = slices.flatten()
            context, _ = _spread(np.diff(slices.offsets.to_numpy()))
            slice_, ask = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            most, least = (place >> 8 & 255)[context], (place & 255)[context]
            low, high = np.maximum(slice_ * SLICE, least), np.minimum(slice_ * SLICE + SLICE - 1, most)
            owner, nth = _spread(high - low + 1)
            distance = low[owner] + nth
            of = context[owner]
            start = bounds[of] + most[owner] - distance
            string = span_hashes(prefix_sums(data), start, start + length).view(np.int64)
            columns = (key[of], (place[of] >> 16) - distance, ask[owner], string)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "ask", "string"])

    return asked.select("key", "place", "context", "slices").mapInArrow(rows, "key bigint, start bigint, ask boolean, string bigint")


def _counted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with a crowd of contexts. Slices of contexts are counted; strings are
    counted one by one only in slices that are alike in part."""
    contexts = store(contexts)
    each = store(_slices(contexts, length))
    kinds = each.groupBy("core", "whole", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("first"), F.max("single").alias("single")
    )
    kinds = store(kinds)
    alike = each.filter("single").join(kinds.filter("n > 1").select("whole"), "whole", "left_semi")
    position, most, least = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    high = F.least(most, F.col("slice") * SLICE + SLICE - 1)
    low = F.greatest(least, F.col("slice") * SLICE)
    whole = alike.select("key", (position - high).alias("start"), (position - low + length).alias("end"))
    ask = (F.col("n") == 1) & F.col("single")
    open_ = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.max(ask).alias("asked")).filter((F.col("k") > 1) & F.col("asked"))
    parts = kinds.join(open_.select("core"), "core", "left_semi").select("first.*", F.struct("slice", ask.alias("ask")).alias("s"))
    parts = parts.groupBy("key", "place").agg(F.collect_list("s").alias("slices"))
    strings = store(_strings(contexts.join(parts, ["key", "place"]), length))
    again = strings.groupBy("string").count().filter("count > 1").select("string")
    single = strings.filter("ask").join(again, "string", "left_semi")
    return whole.unionByName(single.select("key", "start", (F.col("start") + length).alias("end")))


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text, spans):
    """Struct of what is left of a text: removed bytes, runs, digest of the rest, and the runs."""

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string,runs:array<struct<start:bigint,end:bigint>>>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        removed, counts, digests, all_runs = [], [], [], []
        for t, s in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist()):
            runs = _runs(s)
            rest, at = hashlib.sha256(), 0
            for a, b in runs:
                rest.update(t[at:a])
                at = b
            rest.update(t[at:])
            removed.append(sum(b - a for a, b in runs))
            counts.append(len(runs))
            digests.append(rest.hexdigest())
            all_runs.append([{"start": a, "end": b} for a, b in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays(
            [pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(all_runs, kind)],
            names=["n_removed", "n_spans", "kept_sha256", "runs"],
        )

    return cut(text, spans)


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``key, start, end`` of bytes in strings that occur again, for ``texts(key, weight, text)``
    with one row per distinct text; ``weight`` is above 1 where the text itself has copies."""
    often = store(_anchor_hashes(texts, length).groupBy("h").agg(F.sum("weight").alias("n")).filter("n > 1").select("h"))
    rows = store(_anchor_rows(texts, length).join(often, "h", "left_semi"))
    alike = rows.groupBy("h", "g").agg(
        F.sum("weight").alias("n"), F.min(F.struct("key", "place")).alias("first"), F.max("weight").alias("most")
    )
    alike = store(alike)
    crowd = alike.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("singles"))
    unsettled = crowd.filter((F.col("kinds") > 1) & (F.col("singles") > 0)).select("h", (F.col("kinds") > CROWD).alias("crowded"))
    lo = (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)).alias("start")
    hi = (F.shiftright("place", 16) - F.col("place").bitwiseAND(255) + length).alias("end")
    whole = rows.filter("weight = 1").join(alike.filter("n > 1").select("h", "g"), ["h", "g"], "left_semi").select("key", lo, hi)
    # One context of each kind stands for all that are alike.
    asked = store(alike.join(unsettled, "h").select("h", "crowded", "first.key", "first.place", (F.col("n") == 1).alias("single")))
    per_text = asked.groupBy("key").agg(F.collect_list(F.struct("h", "place", "crowded", "single")).alias("asked"))
    some = texts.join(small(asked.select("key").distinct()), "key", "left_semi").select("key", F.col("text").cast("binary").alias("bytes"))
    place = lambda x: F.shiftright(x["place"], 16)
    most = lambda x: F.shiftright(x["place"], 8).bitwiseAND(255)
    least = lambda x: x["place"].bitwiseAND(255)

    def piece(x):
        start = (place(x) - most(x) + 1).cast("int")
        return F.struct(
            x["h"].alias("h"), x["place"].alias("place"), x["crowded"].alias("crowded"), x["single"].alias("single"),
            F.substr(F.col("bytes"), start, (most(x) - least(x) + length).cast("int")).alias("context"),
        )

    cut_out = some.join(per_text, "key").select("key", F.transform("asked", piece).alias("pieces"))
    contexts = store(cut_out.select("key", F.explode("pieces").alias("c")).select("key", "c.*"))
    found = _sorted_matches(contexts.filter(~F.col("crowded")), length)
    if contexts.filter("crowded").limit(1).count():
        found = found.unionByName(_counted_matches(contexts.filter("crowded"), length))
    return whole.unionByName(found)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs`` per row of ``docs`` (``doc_id, text``).

    Removed is each byte of a string of ``length`` bytes that also starts elsewhere, in the same
    or another document; ``runs`` are the removed runs. Null is an empty text. Rows with one
    text are copies of each other, whatever their ids.
    """
    if not GRAM < length < GRAM + 256:
        raise ValueError(f"length must be between {GRAM + 1} and {GRAM + 255}")
    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    docs = docs.select("doc_id", text.alias("text"), digest.alias("sha"), F.xxhash64(digest).alias("key"))
    rows = store(docs.select("doc_id", "sha", "key", F.octet_length("text").cast("long").alias("n_bytes")))
    copies = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")).filter("n > 1").select(F.col("key").alias("copied"), "rep"))
    long_docs = docs.filter(F.octet_length("text") >= length)
    one = long_docs.join(small(copies), long_docs["key"] == copies["copied"], "left").filter(
        F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))
    )
    texts = one.select("key", F.when(F.col("copied").isNull(), 1).otherwise(2).cast("long").alias("weight"), "text")
    spans = store(repeated_spans(texts, length).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    single = texts.filter("weight = 1").join(small(spans.select("key")), "key", "left_semi")
    cut = store(single.join(spans, "key").select("key", _cut(F.col("text"), F.col("spans")).alias("c")).select("key", "c.*"))
    out = rows.join(copies.select(F.col("copied").alias("key"), F.lit(True).alias("is_copy")), "key", "left").join(cut, "key", "left")
    gone = F.col("is_copy").isNotNull() & (F.col("n_bytes") >= length)
    whole_run = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, whole_run).otherwise(F.coalesce("runs", F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>"))).alias("runs"),
    )
