"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

The windows of all benchmark items (questions and answers) are the patterns: ``width``
consecutive normalised words, or the whole item where it has fewer. A text is normalised and
scanned once; a match is mapped back to the characters of the original text.

Benchmark texts reach the tasks in blocks of bounded size, each with an automaton of its own.
One block is the usual case; results of several are put together per distinct text.
"""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Bytes of benchmark text in one automaton.
BLOCK_BYTES = 16 << 20

# ASCII letters folded to lower case, digits and all bytes of other characters kept, the rest a space.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = "array<struct<first:int,last:int>>"
MATCH = f"struct<n_words:bigint,hits:{SPAN},items:array<string>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def build_automaton(items: list[tuple[str, bytes]], width: int) -> tuple[dict[bytes, int], ahocorasick.Automaton | None]:
    """Word numbers (from 1 on, 0 is any other word) and the automaton; its values are the
    length of the window and the items that hold it."""
    numbers: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        row = tuple(numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text))
        if row:
            for i in range(max(1, len(row) - width + 1)):
                holders.setdefault(row[i : i + width], set()).add(item)
    if not holders:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, owners in holders.items():
        automaton.add_word(window, (len(window), owners))
    automaton.make_automaton()
    return numbers, automaton


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(text: bytes, numbers: dict, automaton) -> tuple[int, list, list]:
    words = normal_words(text)
    if automaton is None or not words:
        return len(words), [], []
    row = tuple(map(numbers.get, words, repeat(0)))
    spans, items = [], set()
    for end, (length, owners) in automaton.iter(row):
        spans.append((end - length + 1, end))
        items |= owners
    return len(words), _merged(spans), sorted(items)


def _matches(text: Column, block, width: int) -> Column:
    @F.arrow_udf(MATCH)
    def matched(texts: pa.Array) -> pa.Array:
        held = block.value  # one automaton per worker process, kept with the block
        if "automaton" not in held:
            held["automaton"] = build_automaton(held["items"], width)
        numbers, automaton = held["automaton"]
        found = [_scan(t or b"", numbers, automaton) for t in texts.cast(pa.binary()).to_pylist()]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in f[1]] for f in found], kind),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ],
            names=["n_words", "hits", "items"],
        )

    return matched(text)


def _blocks(benchmark: DataFrame) -> list:
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    out = []
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        out.append(spark.sparkContext.broadcast({"items": [(r.item_id, r.text.encode()) for r in part.toLocalIterator()]}))
    return out


def match_items(docs: DataFrame, benchmark: DataFrame, width: int = 13, as_name: str = "match") -> DataFrame:
    """``docs`` with a struct column ``as_name``: words of the text, hit runs of words, items.

    ``benchmark`` has ``item_id, text``, ids of any type, given as texts; items without an id or text have no
    windows. Null text has no words. Repeated items and ids are allowed. A text of any length is
    scanned as a whole in one row. An empty table gives an empty one, an empty benchmark no hits.
    """
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return docs.withColumn(as_name, _matches(docs["text"], blocks[0], width))
    key, other = fresh(docs, "text_key"), fresh(docs, "match_key")
    found = None
    for block in blocks:
        part = docs.select(F.md5("text").alias(other), _matches(docs["text"], block, width).alias("m"))
        part = part.filter(F.size("m.hits") > 0).groupBy(other).agg(F.first("m").alias("m"))
        found = part if found is None else found.unionByName(part)
    joint = found.groupBy(other).agg(
        merged_runs(F.flatten(F.collect_list("m.hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.items")))).alias("items"),
    )
    counted = docs.withColumn(key, F.md5("text"))
    n_words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD.pattern)).cast("long")
    joined = counted.join(joint, counted[key] == joint[other], "left")
    empty = F.from_json(F.lit("[]"), SPAN)
    value = F.struct(
        n_words.alias("n_words"),
        F.coalesce(joint["hits"], empty).alias("hits"),
        F.coalesce(joint["items"], F.array().cast("array<string>")).alias("items"),
    )
    return joined.select(*[docs[c] for c in docs.columns], value.alias(as_name))


def merged_runs(runs: Column) -> Column:
    """Runs of words that overlap or touch, made one."""

    @F.arrow_udf(SPAN)
    def merged(rows: pa.Array) -> pa.Array:
        return pa.array(
            [[{"first": a, "last": b} for a, b in _merged([(x["first"], x["last"]) for x in r])] for r in rows.to_pylist()],
            rows.type,
        )

    return merged(runs)


def n_hit(match: Column) -> Column:
    runs = match.getField("hits")
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1).cast("long"))


def contaminated(match: Column, percent: int = 5) -> Column:
    """True where at least ``percent`` of the words are hit, and at least one."""
    hit = n_hit(match)
    return (hit > 0) & (hit * 100 >= match.getField("n_words") * percent)


def original_spans(text: Column, match: Column) -> Column:
    """Hit runs as character spans ``start, end`` (end exclusive) of the original text."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def mapped(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), runs.to_pylist()):
            if not found:
                out.append([])
                continue
            at = np.array([m.span() for m in WORD.finditer(t)])
            out.append([{"start": int(at[r["first"]][0]), "end": int(at[r["last"]][1])} for r in found])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return mapped(text, match.getField("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """Documents that are not contaminated, with the columns they came with."""
    name = fresh(docs, "match")
    matched = match_items(docs, benchmark, width, name)
    return matched.filter(~contaminated(F.col(name), percent)).select(*docs.columns)
