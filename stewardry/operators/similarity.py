"""Exact set-similarity joins and the blended file-name and summary score.

Candidates come from prefix filtering: items are ordered from rare to frequent, and two sets that
overlap enough must share an item among their first few (Chaudhuri et al. 2006; Vernica et al. 2010
for the distributed form), or several among a few more (Wang et al. 2012). Word sets of whole texts
meet as numbers, chunk by chunk, and what two chunks have in common stays in one task. Name parts,
which are short, travel with their postings; where one is frequent, its rows are salted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    basename,
    extension,
    has_text,
    jaccard,
    lineage_group_key,
    normalize_stem,
    numbered_grams,
    summary_tokens,
)
from ..session import cut_lineage, shuffle_partitions, written

EPS = 1e-9
SALT_ROWS = 2_000
BROADCAST_ROWS = 500_000
# Part of the items a pair must share that it must share among its rare ones.
EARLY_SHARE = 0.1
# Items in a place that has more than one FREQUENT_SHARE-th of all sets come last, as far as so many do.
FREQUENT_SHARE = 1_000
FREQUENT_ITEMS = 200_000
# Items of the sets of a chunk; a block with more than one SPREAD-th of that is dealt into several chunks.
CHUNK_ITEMS = 16_000_000
SPREAD = 32
MIN_CHUNKS = 8
# A set with fewer meetings, or with fewer than one WIDE_REACH-th of the sets in reach, is counted along with others.
FEW_HITS = 400
WIDE_REACH = 64


def overlap_join(
    sets: DataFrame,
    block: Sequence[str],
    prefix_length: Column,
    keep: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    carry: Sequence[str] = (),
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Unordered pairs of ``sets(id, items, *block, *carry)`` that share an item of their prefixes
    and satisfy ``keep(a, b)``. Each pair comes out once, as ``a_id < b_id``.

    ``prefix_length`` may use ``items`` and ``carry``. ``keep`` gets two functions from column name
    to the column of that side; it is part of the join condition, so rejected candidates are never
    shuffled.
    """
    block, carry = list(block), list(carry)
    single = sets.select(*block, "id", F.explode("items").alias("item"))
    frequency = single.groupBy(*block, "item").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        single.join(frequency, [*block, "item"])
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("ranked"))
    )
    prefixed = sets.join(ranked, "id").withColumn(
        "prefix", F.slice("ranked", F.lit(1), F.greatest(prefix_length, F.lit(0)))
    )
    posted = (
        prefixed.withColumn("prefix_items", F.transform("prefix", lambda p: p["item"]))
        .select(*block, "id", "items", *carry, "prefix_items", F.explode("prefix").alias("p"))
        .filter(F.col("p.n") > 1)  # an item of one set only has no partner
        .select(
            *block,
            "id",
            "items",
            *carry,
            "prefix_items",
            F.col("p.item").alias("item"),
            F.ceil(F.col("p.n") / F.lit(salt_rows)).cast("int").alias("salts"),
        )
    )
    left = posted.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = posted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = [*block, "item", "salt"]
    # Few bytes make many comparisons here, so partitions must not be merged by their size.
    parts = shuffle_partitions(sets.sparkSession)
    left, right = left.repartition(parts, *key), right.repartition(parts, *key)
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns])

    def side(prefix: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{prefix}_{name}")

    condition = F.col("a_id") < F.col("b_id")
    for name in key:
        condition = condition & (F.col(f"a_{name}") == F.col(f"b_{name}"))
    # A pair that shares several prefix items is kept at the first of them only.
    first_shared = F.element_at(F.array_intersect("a_prefix_items", "b_prefix_items"), 1)
    condition = condition & keep(side("a"), side("b")) & (first_shared == F.col("a_item"))
    out = ["id", "items", *carry]
    return a.join(b, condition).select(*[f"a_{c}" for c in out], *[f"b_{c}" for c in out])


def jaccard_pairs(
    sets: DataFrame,
    threshold: float | str,
    block: Sequence[str] = (),
    carry: Sequence[str] = (),
    also: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    early: float = EARLY_SHARE,
    chunk_items: int = CHUNK_ITEMS,
    row: str | None = None,
) -> DataFrame:
    """Pairs ``a_id, b_id, jaccard`` and ``carry`` of both sides, of ``sets(id, items, *block, *carry)`` with a
    Jaccard index of at least ``threshold`` (> 0; a number, or a column with one value per block) for which
    ``also(a, b)`` holds, as ``a_id < b_id``.

    ``row`` numbers the rows of sets that are read from a stored table, others are written once; where it is ``id``,
    and nothing is carried, pairs need no join. Items are told apart by hashes of 63 bits that were seen to be distinct.
    A large block is packed, where it lies, into chunks of sets as ascending numbers, rare items first;
    each two chunks meet in one task of a cartesian product, which gives the pairs themselves
    (:func:`_near_in_cell`). Small blocks are dealt whole. Neither shared items nor candidates nor
    the sets of a large block are shuffled, only counts of items and pairs.
    """
    block, carry = list(block), list(carry)
    own = [threshold] if isinstance(threshold, str) else []
    t = F.col(threshold) if own else F.lit(float(threshold))
    known = sets.filter(F.size("items") > 0).dropna(subset=block) if block else sets.filter(F.size("items") > 0)
    number = F.col(row) if row else F.monotonically_increasing_id()
    numbered = known.select(*block, "id", "items", *carry, t.alias("_t"), F.size("items").alias("_size"), number.alias("_n"))
    numbered = numbered if row else written(numbered)
    found = _near_pairs(numbered, block, early, chunk_items)
    out = ["id", *carry]
    for side in "ab":
        if row == "id" and not carry:
            found = found.withColumnRenamed(f"{side}_n", f"{side}_id")
            continue
        of_side = numbered.select(F.col("_n").alias(f"{side}_n"), *[F.col(c).alias(f"{side}_{c}") for c in out])
        found = found.join(of_side, f"{side}_n")
    if also is not None:
        found = found.filter(also(lambda name: F.col(f"a_{name}"), lambda name: F.col(f"b_{name}")))
    turned = F.col("a_id") > F.col("b_id")
    sides = [F.when(turned, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in out]
    return found.select(*sides, "jaccard")


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of a stored table with equal ``key``, the one with the least ``row``. Wide rows stay where they
    lie unless very many are left out."""
    slim = rows.select(key, "row")
    others = cut_lineage(slim.join(slim.groupBy(key).agg(F.min("row").alias("_least")), key).filter(F.col("row") > F.col("_least")).select("row"))
    if others.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(others), "row", "left_anti")
    return written(rows.join(others, "row", "left_anti"))


def _item_hash(item: Column, seed: int) -> Column:
    return F.xxhash64(item, F.lit(seed)).bitwiseOR(F.lit(-(2**63)))


def _distinct_hashes(numbered: DataFrame, sets: int) -> tuple[int, np.ndarray]:
    """A seed under which no two items have the same hash, and the hashes of the frequent items, rare ones first.
    Which items count as frequent changes the order of work alone."""
    counts = numbered.select(F.explode("items").alias("item")).filter(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    for seed in range(8):
        hashed = counts.groupBy(_item_hash(F.col("item"), seed).alias("h")).agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("clash"))
        often = hashed.filter(F.col("clash") | (F.col("n") >= max(2, sets // FREQUENT_SHARE)))
        top = often.orderBy(F.col("clash").desc(), F.col("n").desc(), "h").limit(FREQUENT_ITEMS).toArrow()
        if not top.num_rows or not top["clash"][0].as_py():
            return seed, top["h"].to_numpy()[::-1].copy()
    raise RuntimeError("items have equal hashes under every seed")


def _near_pairs(numbered: DataFrame, block: list[str], early: float, chunk_items: int) -> DataFrame:
    """``a_n, b_n, jaccard`` of the near pairs of ``numbered``. A block of more than one SPREAD-th of ``chunk_items``
    items is large: it is dealt into chunks of at most ``chunk_items``, more of them where that keeps all cores at work."""
    spark, parts = numbered.sparkSession, shuffle_partitions(numbered.sparkSession)
    some = max(1, chunk_items // SPREAD)
    sized = numbered.groupBy(*block).agg(F.sum("_size").alias("total"), F.count(F.lit(1)).alias("n"))
    sums = lambda name, large: [F.coalesce(F.sum(F.when((F.col("total") > some) == large, F.col(name))), F.lit(0)) for name in ("total", "n")]
    much, many, rest, few = sized.agg(*sums("total", True), *sums("total", False)).first()
    seed, frequent = _distinct_hashes(numbered, many + few)
    words = F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: _item_hash(x, seed)).alias("words")
    # As many rows as the input has stretches of that many items, at most.
    named = sized.filter(F.col("total") > some).select(*block).collect() if block and much else []
    large = spark.createDataFrame([(*r, i) for i, r in enumerate(named)], numbered.select(*block, F.lit(0).alias("place")).schema) if named else None

    made = []
    if rest:
        apart = numbered.join(F.broadcast(large), block, "left_anti") if named else numbered
        name = F.to_json(F.struct(*block)) if block else F.lit("")
        # Few bytes make many comparisons here, so partitions must not be merged by their size.
        bins = F.pmod(F.xxhash64(*block) if block else F.lit(0), F.lit(max(parts, -(-rest // chunk_items))))
        dealt = apart.select(bins.alias("bin"), name.alias("name"), "_n", "_t", "_size", words).repartition(parts, "bin")

        def near_in_bin(rows: pa.Table) -> pa.Table:
            return _near_in_bin(rows, early)

        made.append(dealt.groupBy("bin").applyInArrow(near_in_bin, _FOUND))
    if much:
        placed = numbered.join(F.broadcast(large), block) if named else numbered.withColumn("place", F.lit(0))
        chunks = max(min(MIN_CHUNKS, -(-much // some)), -(-much // chunk_items))
        rows = placed.select("place", "_n", "_t", "_size", words)
        rows = rows.coalesce(chunks) if rows.rdd.getNumPartitions() >= chunks else rows.repartition(chunks)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _packed(batches, frequent, chunk_items)

        def near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _near_in_cells(batches, early)

        chunk = cut_lineage(rows.mapInArrow(packed, _CHUNK).withColumn("chunk", F.monotonically_increasing_id()))
        a, b = (chunk.select([F.col(c).alias(f"{s}_{c}") for c in chunk.columns]) for s in "ab")
        # As two bounds, so that chunks are not dealt by their place but met where they are read.
        same = (F.col("a_place") <= F.col("b_place")) & (F.col("a_place") >= F.col("b_place"))
        made.append(a.join(b, same & (F.col("a_chunk") <= F.col("b_chunk"))).mapInArrow(near_in_cells, _FOUND))
    if not made:
        return spark.createDataFrame([], _FOUND)
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


_FOUND = "a_n long, b_n long, jaccard double"
_FOUND_ARROW = pa.schema([("a_n", pa.int64()), ("b_n", pa.int64()), ("jaccard", pa.float64())])
_CHUNK = "place int, n binary, t binary, size binary, held binary, own binary, words binary"


class _Sets(NamedTuple):
    """Sets in ascending size, with their numbers and thresholds. ``held`` of the items of each lie in ``words``, as
    positions in ``own``, ascending within a set; those not held are in no other set."""

    n: np.ndarray
    t: np.ndarray
    size: np.ndarray
    held: np.ndarray
    own: np.ndarray
    words: np.ndarray


def _in_order(words: np.ndarray, owner: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """``ranks[words]``, by owner and ascending within each."""
    return (np.sort((owner << 32) | ranks[words]) & (2**32 - 1)).astype(np.int32)


def _by_size(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the sets in ascending size, and the place of each set in it."""
    order = np.argsort(size, kind="stable")
    place = np.empty(len(size), dtype=np.int64)
    place[order] = np.arange(len(size))
    return order, place


def _packed(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, chunk_items: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the sets of a partition, by place, as :class:`_Sets`. ``own`` has the chunk's items in ascending
    order: hashes of rare ones, then ranks of frequent ones; ``words`` are steps between the positions in it."""
    by_hash = np.argsort(frequent)
    sorted_hashes = frequent[by_hash]

    def chunk(place: int, kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        n, t, size, held, hashes = (np.concatenate(c) for c in zip(*kept))
        own, words = np.unique(hashes, return_inverse=True)
        if len(frequent):
            at = np.minimum(np.searchsorted(sorted_hashes, own), len(frequent) - 1)
            own = np.where(sorted_hashes[at] == own, by_hash[at], own)
        order = np.argsort(own)
        ranks = np.empty(len(own), dtype=np.int64)
        ranks[order] = np.arange(len(own))
        ascending, places = _by_size(size)
        words = _in_order(words, np.repeat(places, held), ranks)
        steps = np.diff(words, prepend=np.int32(0)).astype(np.int32)
        values = [*(v[ascending] for v in (n, t, size, held)), own[order]]
        made = [*(v.tobytes() for v in values), pa.compress(steps.tobytes(), "zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *[pa.array([v], pa.binary()) for v in made]], ["place", "n", "t", "size", "held", "own", "words"])

    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    filled: dict[int, int] = {}
    for batch in batches:
        places = batch["place"].to_numpy(zero_copy_only=False)
        for place in np.unique(places).tolist():
            rows = batch.filter(pa.array(places == place))
            sets = rows["words"]
            held = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int32)
            values = (*(rows[c].to_numpy(zero_copy_only=False) for c in ("_n", "_t", "_size")), held, pc.list_flatten(sets).to_numpy(zero_copy_only=False))
            ends = np.cumsum(held, dtype=np.int64)
            start = 0
            while start < len(held):
                before = ends[start - 1] if start else 0
                room = chunk_items - filled.get(place, 0)
                stop = int(np.searchsorted(ends, before + room, "right"))
                if stop == start and filled.get(place, 0):
                    yield chunk(place, waiting.pop(place))
                    filled[place] = 0
                    continue
                stop = max(stop, start + 1)
                waiting.setdefault(place, []).append((*(v[start:stop].copy() for v in values[:4]), values[4][before:ends[stop - 1]].copy()))
                filled[place] = filled.get(place, 0) + int(ends[stop - 1] - before)
                start = stop
    for place, kept in waiting.items():
        yield chunk(place, kept)


def _unpacked(row: dict, side: str) -> _Sets:
    kinds = {"n": np.int64, "t": np.float64, "size": np.int32, "held": np.int32, "own": np.int64}
    n, t, size, held, own = (np.frombuffer(row[f"{side}_{c}"], kind) for c, kind in kinds.items())
    steps = pa.decompress(row[f"{side}_words"], 4 * int(held.sum(dtype=np.int64)), "zstd", asbytes=True)
    return _Sets(n, t, size, held, own, np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int32))


def _near_in_cells(batches: Iterator[pa.RecordBatch], early: float) -> Iterator[pa.RecordBatch]:
    """Near pairs between two chunks in each row; of one chunk with itself, each pair once."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            a = _unpacked(row, "a")
            if row["a_chunk"] == row["b_chunk"]:
                yield from _near_in_cell(a, a, np.arange(len(a.n)), early)
            else:
                b = _unpacked(row, "b")
                yield from _near_in_cell(a, b, np.searchsorted(a.size, b.size, "right"), early)
                yield from _near_in_cell(b, a, np.searchsorted(b.size, a.size, "left"), early)


def _near_in_bin(rows: pa.Table, early: float) -> pa.Table:
    """Near pairs of the whole blocks that share a bin. A number stands for one item of one block."""
    rows = rows.combine_chunks()
    n, t, size = (rows[c].to_numpy() for c in ("_n", "_t", "_size"))
    held = pc.list_value_length(rows["words"]).to_numpy().astype(np.int32)
    owner = np.repeat(np.arange(len(n)), held)
    _, hashes = np.unique(pc.list_flatten(rows["words"]).to_numpy(), return_inverse=True)
    blocks = rows["name"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    _, words, counts = np.unique((blocks[owner] << 32) | hashes, return_inverse=True, return_counts=True)
    # An item of one set only has no partner.
    shared = counts[words] > 1
    held, owner, words = np.bincount(owner[shared], minlength=len(n)).astype(np.int32), owner[shared], words[shared]
    ranks = np.empty(len(counts), dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ascending, places = _by_size(size)
    words = _in_order(words, places[owner], ranks)
    sets = _Sets(n[ascending], t[ascending], size[ascending], held[ascending], np.arange(len(counts)), words)
    found = list(_near_in_cell(sets, sets, np.arange(len(n)), early))
    return pa.Table.from_batches(found, _FOUND_ARROW)


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``first[i]`` and the numbers after it, ``lengths[i]`` in all, one run after the other."""
    out = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _first_items(sets: _Sets, need: np.ndarray, early: float) -> np.ndarray:
    """How many of the held items of a set hold ``ceil(early * need)`` of those that it shares with a partner, if
    it shares ``need`` or more: of the items in common, the k-th has ``need - k`` behind it on both sides."""
    least = np.maximum(np.ceil(need - 2 * EPS), 1).astype(np.int64)
    return np.maximum(sets.held - least + _early_need(least, early), 0)


def _early_need(need: np.ndarray, early: float) -> np.ndarray:
    return np.maximum(np.ceil(need * early), 1).astype(np.int64)


def _near_in_cell(x: _Sets, y: _Sets, until: np.ndarray, early: float, probe_items: int = 500_000, hits_at_once: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Near pairs of each set of ``y`` and those before its ``until`` in ``x``, which are not larger than it.

    The larger set of a pair asks for ``t`` of its size in common, the smaller one, knowing that it is the
    smaller, for ``2t / (1 + t)`` of its own: so much fewer of its items, rare ones first, are posted. As the
    sets of ``y`` grow, postings of sets of ``x`` that became too small are left behind and those of larger ones
    are reached. Meetings are counted set by set, in an array of the sets in reach: a chance meeting on one frequent
    item makes no candidate, nor does one that cannot gain enough behind the early items of that side
    which ends first. Candidates are confirmed on full sets.
    """
    x_size, y_size = x.size.astype(np.int64), y.size.astype(np.int64)
    x_begin, y_begin = _sums(x.held), _sums(y.held)
    x_first = _first_items(x, 2 * x.t / (1 + x.t) * x_size, early)
    y_first = _first_items(y, y.t * y_size, early)
    least = _early_need(np.ceil(y.t * y_size - 2 * EPS), early)

    posted, posts = x.words[_runs(x_begin[:-1], x_first)], _sums(x_first)
    owners = np.sort((posted.astype(np.int64) << 32) | np.repeat(np.arange(len(x_size)), x_first))
    owners = (owners & (2**32 - 1)).astype(np.int32)
    # Of each item, the postings in reach; the last one stands for the items that x does not have.
    absent = len(x.own)
    begin = _sums(np.bincount(posted, minlength=absent))
    end = begin.copy()
    in_x = None
    if y is not x:
        at = np.minimum(np.searchsorted(x.own, y.own), max(absent - 1, 0))
        in_x = np.where(x.own[at] == y.own, at, absent) if absent else np.zeros(len(y.own), dtype=np.int64)
    # Thresholds differ between blocks, so the first set in reach is that of all later ones too.
    since = np.minimum.accumulate(np.searchsorted(x_size, y.t * y_size - EPS, "left")[::-1])[::-1]
    flags = np.zeros(absent + 1, dtype=bool)
    probes = _sums(y_first)
    i = left = reached = 0
    while i < len(y_size):
        j = max(int(np.searchsorted(probes, probes[i] + probe_items, "right")) - 1, i + 1)
        low, high = left, reached
        reached = max(int(until[j - 1]), reached)
        left = max(min(int(since[i]), reached), left)
        end += np.bincount(posted[posts[high]:posts[reached]], minlength=absent + 1)
        begin += np.bincount(posted[posts[low]:posts[left]], minlength=absent + 1)
        items = y.words[_runs(y_begin[i:j], y_first[i:j])]
        items = items if in_x is None else in_x[items]
        first, meets = begin[items], end[items] - begin[items]
        kept = np.flatnonzero(meets)
        first, meets = first[kept], meets[kept]
        # Where the postings of each probe begin, and the meetings before them.
        mine = np.searchsorted(kept, probes[i:j + 1] - probes[i])
        sums = _sums(meets)
        before = sums[mine]
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        r = 0
        while r < j - i:
            s = max(int(np.searchsorted(before, before[r] + hits_at_once, "right")) - 1, r + 1)
            hits = int(before[s] - before[r])
            if hits > hits_at_once:
                counts, k = np.zeros(reached, dtype=np.int64), int(mine[r])
                while k < mine[s]:
                    m = min(max(int(np.searchsorted(sums, sums[k] + hits_at_once, "right")) - 1, k + 1), int(mine[s]))
                    counts += np.bincount(owners[_runs(first[k:m], meets[k:m])], minlength=reached)
                    k = m
                theirs = np.flatnonzero(counts[:until[i + r]] >= least[i + r])
                met.append((theirs, np.full(len(theirs), i + r), counts[theirs]))
            elif hits:
                their = owners[_runs(first[mine[r]:mine[s]], meets[mine[r]:mine[s]])]
                if hits < (s - r) * max(FEW_HITS, (reached - left) // WIDE_REACH):
                    pair = np.sort(np.repeat(np.arange(i + r, i + s), np.diff(before[r:s + 1])) * len(x_size) + their)
                    at = np.flatnonzero(np.diff(pair, prepend=-1))
                    b, a = np.divmod(pair[at], len(x_size))
                    counts = np.diff(at, append=len(pair))
                    often = (counts >= least[b]) & (a < until[b])
                    met.append((a[often], b[often], counts[often]))
                else:
                    their -= np.int32(left)
                    parts = (before[r:s + 1] - before[r]).tolist()
                    for b, lo, hi in zip(range(i + r, i + s), parts[:-1], parts[1:]):
                        counts = np.bincount(their[lo:hi])
                        theirs = np.flatnonzero(counts[:max(until[b] - left, 0)] >= least[b])
                        if len(theirs):
                            met.append((theirs + left, np.full(len(theirs), b), counts[theirs]))
            r = s
        if met:
            a, b, counts = (np.concatenate(m) for m in zip(*met))
            need = np.ceil(y.t[b] / (1 + y.t[b]) * (x_size[a] + y_size[b]) - EPS)
            fits = x_size[a] >= y.t[b] * y_size[b] - EPS
            fits &= counts + _behind(x, x_begin, x_first, a, y, y_begin, y_first, b) >= need
            yield _confirmed(x, x_begin, a[fits], y, y_begin, b[fits], in_x, flags)
        i = j


def _behind(x: _Sets, x_begin: np.ndarray, x_first: np.ndarray, a: np.ndarray, y: _Sets, y_begin: np.ndarray, y_first: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many more items sets can share than those that are early on both sides: those behind the early ones of
    the side where these end first."""

    def next_item(sets: _Sets, begin: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = sets.held[of] - first[of]
        item = sets.own[sets.words[np.minimum(begin[of] + first[of], len(sets.words) - 1)]]
        return rest, np.where(rest > 0, item, np.iinfo(np.int64).max)

    (x_rest, x_item), (y_rest, y_item) = next_item(x, x_begin, x_first, a), next_item(y, y_begin, y_first, b)
    return np.where(x_item <= y_item, x_rest, y_rest)


def _confirmed(x: _Sets, x_begin: np.ndarray, a: np.ndarray, y: _Sets, y_begin: np.ndarray, b: np.ndarray, in_x: np.ndarray | None, flags: np.ndarray) -> pa.RecordBatch:
    """Those of the candidates, which are in the order of ``b``, that are near. ``flags`` is clear before and after."""
    shared = np.zeros(len(a), dtype=np.int64)
    edges = np.flatnonzero(np.diff(b, prepend=-1, append=-1)).tolist() if len(b) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = y.words[y_begin[b[lo]]:y_begin[b[lo] + 1]]
        own = own if in_x is None else in_x[own]
        flags[own], flags[-1] = True, False
        held = x.held[a[lo:hi]].astype(np.int64)
        shared[lo:hi] = np.add.reduceat(flags[x.words[_runs(x_begin[a[lo:hi]], held)]], np.cumsum(held) - held, dtype=np.int64)
        flags[own] = False
    jaccards = shared / (x.size[a].astype(np.int64) + y.size[b] - shared)
    near = jaccards >= y.t[b] - EPS
    return pa.RecordBatch.from_arrays([pa.array(x.n[a[near]], pa.int64()), pa.array(y.n[b[near]], pa.int64()), pa.array(jaccards[near], pa.float64())], schema=_FOUND_ARROW)


def stem_ratio_udf() -> Callable[[Column, Column], Column]:
    """Ratcliff-Obershelp ratio; it depends on the order of its arguments."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def _with_ratios(pairs: DataFrame) -> DataFrame:
    """Add the ratio of ``a_stem, b_stem`` in both orders. Equal stems need no Python."""
    ratio = stem_ratio_udf()
    pairs = cut_lineage(pairs)  # read twice below
    stems = pairs.select("a_stem", "b_stem").filter(F.col("a_stem") != F.col("b_stem")).distinct()
    scored = stems.select(
        F.col("a_stem").alias("_sa"),
        F.col("b_stem").alias("_sb"),
        ratio(F.col("a_stem"), F.col("b_stem")).alias("ratio_ab"),
        ratio(F.col("b_stem"), F.col("a_stem")).alias("ratio_ba"),
    )
    joined = pairs.join(scored, (F.col("a_stem") == F.col("_sa")) & (F.col("b_stem") == F.col("_sb")), "left")
    return joined.select(
        *pairs.columns, F.coalesce("ratio_ab", F.lit(1.0)).alias("ratio_ab"), F.coalesce("ratio_ba", F.lit(1.0)).alias("ratio_ba")
    )


def stem_pairs(stems: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs ``ext, a_stem, b_stem, ratio_ab, ratio_ba`` of distinct ``stems(ext, stem)`` of one
    extension whose ratio can reach ``min_ratio``, each stem with itself included.

    A ratio of r means at least r(la+lb)/2 characters matched in order. Hence the character
    multisets share that many, and the stems share at least (la+lb)(1.5r-1)-1 numbered bigrams.
    Bigrams are used where that bound is at least one for both stems, single characters otherwise.
    """
    r = float(min_ratio)
    length = F.length("stem")
    # The smallest bound over all lengths of a partner.
    bigram_bound = F.ceil(F.length("stem") * F.lit(2 * (1.5 * r - 1) / (2 - r)) - F.lit(1 + EPS)).cast("int")
    no_grams = 10_000
    bounded = (n for n in range(2, no_grams) if 2 * n * (1.5 * r - 1) / (2 - r) - 1 > EPS)
    gram_min = next(bounded, no_grams) if r > 2 / 3 else no_grams
    reach = int(gram_min * (2 / r - 1)) + 1
    base = stems.select("ext", "stem").distinct().withColumn("id", F.concat_ws("\x1f", "ext", "stem"))

    def bound_ok(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        total = (F.size(a("chars")) + F.size(b("chars"))).cast("double")
        shared = F.size(F.array_intersect(a("chars"), b("chars"))).cast("double")
        return (F.lit(2.0) * shared / total) >= F.lit(r - EPS)

    chars = numbered_grams("stem", 1)
    longer = base.filter(length >= gram_min).select("ext", "id", "stem", numbered_grams("stem", 2).alias("items"), chars.alias("chars"))
    by_bigram = overlap_join(longer, ["ext"], F.size("items") - bigram_bound + 1, bound_ok, ["stem", "chars"])
    shorter = base.filter((length > 0) & (length < reach)).select("ext", "id", "stem", chars.alias("items"), chars.alias("chars"))
    char_bound = F.ceil(F.length("stem") * F.lit(r / (2 - r)) - F.lit(EPS)).cast("int")
    one_short = lambda a, b: bound_ok(a, b) & (F.least(F.length(a("stem")), F.length(b("stem"))) < gram_min)
    by_char = overlap_join(shorter, ["ext"], F.size("items") - char_bound + 1, one_short, ["stem", "chars"])
    found = (by_char if gram_min == no_grams else by_bigram.unionByName(by_char)).select(
        F.element_at(F.split("a_id", "\x1f"), 1).alias("ext"), "a_stem", "b_stem"
    )
    scored = _with_ratios(found).filter(F.greatest("ratio_ab", "ratio_ba") >= F.lit(r - EPS))
    same = base.select(
        "ext",
        F.col("stem").alias("a_stem"),
        F.col("stem").alias("b_stem"),
        F.lit(1.0).alias("ratio_ab"),
        F.lit(1.0).alias("ratio_ba"),
    )
    return scored.unionByName(same)


@dataclass(frozen=True)
class SimilaritySettings:
    """Fixed default values of the blended score."""

    threshold: float = 0.58
    filename_weight: float = 0.55
    summary_weight: float = 0.45

    def weights(self) -> tuple[float, float]:
        total = self.filename_weight + self.summary_weight
        if total > 0:
            return self.filename_weight / total, self.summary_weight / total
        return self.filename_weight, self.summary_weight


def pair_score(ratio: Column, shared: Column, both_summaries: Column, settings: SimilaritySettings) -> Column:
    """Weighted sum where both files have a summary, the name ratio alone otherwise."""
    w_name, w_summary = settings.weights()
    return F.when(both_summaries, F.lit(w_name) * ratio + F.lit(w_summary) * shared).otherwise(ratio)


def similarity_features(files: DataFrame) -> DataFrame:
    """``path, ord, group_key, ext, stem, tokens, has_summary`` of each file."""
    name = basename("path")
    tail = extension(name)
    return files.select(
        "path",
        "ord",
        lineage_group_key(name).alias("group_key"),
        F.lower(tail).alias("ext"),
        normalize_stem(name).alias("stem"),
        summary_tokens("summary").alias("tokens"),
        has_text("summary").alias("has_summary"),
    )


def feature_class(settings: SimilaritySettings) -> Column:
    """Id shared by files the score cannot tell apart. Files of one class are similar to each other,
    so a class is one node however many copies it has; where they are not (a summary without words
    under a threshold above the name weight), each file is its own class."""
    w_name, w_summary = settings.weights()
    own = F.when(
        F.col("has_summary"),
        F.lit(w_name) * F.lit(1.0) + F.lit(w_summary) * F.when(F.size("tokens") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    ).otherwise(F.lit(1.0))
    alike = own >= F.lit(settings.threshold)
    return F.sha2(
        F.to_json(F.struct("ext", "stem", "tokens", "has_summary", F.when(~alike, F.col("path")).alias("path"))), 256
    )


def similar_classes(features: DataFrame, settings: SimilaritySettings = SimilaritySettings()) -> DataFrame:
    """Edges ``u, v`` that connect the feature classes (column ``cls``) holding similar files, of the features in
    a stored table whose rows are numbered by ``row``. Words stay in it; classes go without them.

    Lossless: a pair below ``cut`` in the name ratio needs a summary overlap of at least
    ``(threshold - w_name * cut) / w_summary`` and is found by its words; a pair at or above it is
    found by its stem, the words then only confirming it.
    """
    thr = float(settings.threshold)
    if thr <= 0:
        raise ValueError("threshold must be positive")
    w_name, w_summary = settings.weights()
    classes = cut_lineage(
        features.groupBy("cls", "ext", "stem", "has_summary", (F.size("tokens") > 0).alias("worded")).agg(
            F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
        )
    )
    described = classes.filter(F.col("has_summary"))
    words = first_rows(features.filter(F.col("has_summary")), "cls") if w_summary > 0 or w_name >= thr else None
    if w_name <= 0:
        cut = None
    elif w_summary <= 0:
        cut = thr
    else:
        cut = min(0.85, max((thr - 0.1 * w_summary) / w_name, thr / (2 * w_name)))

    pairs, stars = [], []
    if w_summary > 0:
        low = (thr - w_name * (cut or 0.0)) / w_summary
        if low <= 1 + EPS:
            pairs.append(_pairs_by_words(words, described, low, settings))
    if cut is not None:
        near = cut_lineage(stem_pairs(described, cut))
        if w_summary > 0:
            pairs.append(_pairs_by_stem_and_word(near, words, described, settings))
        if w_name >= thr:
            stars.append(_stem_stars(near, described, settings))
            pairs.append(_one_way_pairs(near, words, described, settings))
    if not classes.filter(~F.col("has_summary")).isEmpty():
        pairs.append(_pairs_without_summary(classes, thr))

    merged = pairs[0]
    for more in pairs[1:]:
        merged = merged.unionByName(more)
    forward = pair_score(F.col("ratio_ab"), F.col("jaccard"), F.col("both"), settings) >= F.lit(thr)
    backward = pair_score(F.col("ratio_ba"), F.col("jaccard"), F.col("both"), settings) >= F.lit(thr)
    # The ratio takes the earlier file first; either order must really occur between the classes.
    similar = (forward & (F.col("a_first_ord") < F.col("b_last_ord"))) | (
        backward & (F.col("b_first_ord") < F.col("a_last_ord"))
    )
    edges = merged.filter(similar).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    for star in stars:
        edges = edges.unionByName(star)
    return edges.distinct()


_ORDERS = ("first_ord", "last_ord")
_PAIR = ["a_id", "b_id", "jaccard", "both", "ratio_ab", "ratio_ba", *[f"{s}_{o}" for s in "ab" for o in _ORDERS]]


def _with_orders(pairs: DataFrame, described: DataFrame) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(described.select(F.col("cls").alias(f"{s}_id"), *[F.col(o).alias(f"{s}_{o}") for o in _ORDERS]), f"{s}_id")
    return pairs


def _pairs_by_words(words: DataFrame, described: DataFrame, low: float, settings: SimilaritySettings) -> DataFrame:
    """Pairs found by their words. The characters two stems share bound their ratio from above, so
    that hardly any pair without a chance goes further. Without a weight the ratio is not asked for."""
    sets = words.select(F.col("row").alias("id"), F.col("tokens").alias("items"), "ext")
    near = jaccard_pairs(sets, low, ["ext"], row="id")
    w_name, _ = settings.weights()
    if w_name != 0:
        chars = written(words.select("row", "stem", numbered_grams("stem", 1).alias("chars")))
        near = _of_rows(near, chars, ["stem", "chars"])
        total = (F.length("a_stem") + F.length("b_stem")).cast("double")
        shared = F.size(F.array_intersect("a_chars", "b_chars")).cast("double")
        best_ratio = F.when(total > 0, F.lit(2.0) * shared / total).otherwise(F.lit(1.0))
        reachable = pair_score(best_ratio, F.col("jaccard"), F.lit(True), settings) >= F.lit(settings.threshold - EPS)
        near = near.filter(reachable).select("a_id", "b_id", "jaccard")
    names = ["cls", "stem", *_ORDERS]
    near = _of_rows(near, cut_lineage(words.select("row", "cls").join(described.select(*names), "cls")), names).drop("a_id", "b_id")
    turned = F.col("a_cls") > F.col("b_cls")
    sides = [F.when(turned, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{'id' if c == 'cls' else c}") for x, y in ("ab", "ba") for c in names]
    near = near.select(*sides, "jaccard", F.lit(True).alias("both"))
    return (_with_ratios(near) if w_name != 0 else near.withColumns({"ratio_ab": F.lit(1.0), "ratio_ba": F.lit(1.0)})).select(*_PAIR)


def _of_rows(pairs: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``named(row, ...)`` for both sides of the pairs, whose ids are rows."""
    for s in "ab":
        pairs = pairs.join(named.select(F.col("row").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns]), f"{s}_id")
    return pairs


def _pairs_by_stem_and_word(near: DataFrame, words: DataFrame, described: DataFrame, settings: SimilaritySettings) -> DataFrame:
    """Pairs whose stems are close and whose words close the rest of the gap; the gap, and with it
    the number of words that act as keys, differs from stem pair to stem pair."""
    w_name, w_summary = settings.weights()
    best = F.greatest("ratio_ab", "ratio_ba")
    gap = (F.lit(settings.threshold) - F.lit(w_name) * best) / F.lit(w_summary if w_summary > 0 else 1.0)
    wanted = (
        near.withColumn("gap", gap)
        .filter((F.col("gap") > EPS) & (F.col("gap") <= 1 + EPS) & F.lit(w_summary > 0))
        .withColumn("stem_pair", F.concat_ws("\x1f", "ext", "a_stem", "b_stem"))
        .withColumn("same", F.col("a_stem") == F.col("b_stem"))
        .select("ext", "a_stem", "b_stem", "stem_pair", "same", "gap", "ratio_ab", "ratio_ba")
    )
    worded = described.filter("worded").select("ext", "stem", "cls", *_ORDERS)
    left = wanted.join(worded.withColumnRenamed("stem", "a_stem"), ["ext", "a_stem"]).withColumn("role", F.lit("a"))
    right = (
        wanted.filter(~F.col("same"))
        .join(worded.withColumnRenamed("stem", "b_stem"), ["ext", "b_stem"])
        .withColumn("role", F.lit("b"))
    )
    carry = ["role", "cls", "same", "ratio_ab", "ratio_ba", *_ORDERS]
    met = left.unionByName(right).select("stem_pair", "gap", *carry)
    # A class alone in its stem pair has no partner; only the words of the others are fetched.
    met = cut_lineage(met.join(met.groupBy("stem_pair").count().filter(F.col("count") > 1), "stem_pair", "left_semi"))
    sets = met.join(words.select("cls", F.col("tokens").alias("items")), "cls").withColumn("id", F.concat_ws("\x1f", "role", "cls", "stem_pair"))
    other = lambda a, b: (a("role") != b("role")) | a("same")
    joined = jaccard_pairs(sets, "gap", ["stem_pair"], carry, other)
    # Ids start with the role, so side a of the join is side a of the stem pair.
    return joined.select(
        F.col("a_cls").alias("a_id"),
        F.col("b_cls").alias("b_id"),
        "jaccard",
        F.lit(True).alias("both"),
        F.col("a_ratio_ab").alias("ratio_ab"),
        F.col("a_ratio_ba").alias("ratio_ba"),
        *[f"{s}_{o}" for s in "ab" for o in _ORDERS],
    )


def _strong(near: DataFrame, settings: SimilaritySettings, both_ways: bool) -> DataFrame:
    w_name, _ = settings.weights()
    ab = F.lit(w_name) * F.col("ratio_ab") >= F.lit(settings.threshold)
    ba = F.lit(w_name) * F.col("ratio_ba") >= F.lit(settings.threshold)
    return near.filter((ab & ba) if both_ways else (ab != ba))


def _stem_node(stem: str) -> Column:
    return F.concat_ws("\x1f", F.lit("stem"), F.col("ext"), F.col(stem))


def _stem_stars(near: DataFrame, described: DataFrame, settings: SimilaritySettings) -> DataFrame:
    """Where the names alone reach the threshold, all files of both stems are connected: one edge
    from each class to a node for its stem, one between the stems."""
    strong = _strong(near, settings, both_ways=True)
    between = strong.select(_stem_node("a_stem").alias("u"), _stem_node("b_stem").alias("v"))
    members = described.select(F.col("cls").alias("u"), _stem_node("stem").alias("v"))
    return between.filter(F.col("u") != F.col("v")).unionByName(members)


def _one_way_pairs(near: DataFrame, words: DataFrame, described: DataFrame, settings: SimilaritySettings) -> DataFrame:
    """Stem pairs that reach the threshold in one order only; the order of the files then decides."""
    strong = _strong(near, settings, both_ways=False)
    side = lambda s: words.select(
        "ext", F.col("stem").alias(f"{s}_stem"), F.col("cls").alias(f"{s}_id"), F.col("tokens").alias(f"{s}_tokens"),
    )
    joined = strong.join(side("a"), ["ext", "a_stem"]).join(side("b"), ["ext", "b_stem"])
    return _with_orders(joined, described).withColumn("jaccard", jaccard("a_tokens", "b_tokens")).withColumn("both", F.lit(True)).select(*_PAIR)


def _pairs_without_summary(classes: DataFrame, thr: float) -> DataFrame:
    """A file without a summary is compared by name alone, with every file of its extension. Such
    files form one class per stem, so no stem meets itself many times."""
    bare = classes.filter(~F.col("has_summary"))
    near = stem_pairs(classes.join(bare.select("ext").distinct(), "ext", "left_semi"), thr)
    turned = near.filter(F.col("a_stem") != F.col("b_stem")).select(
        "ext",
        F.col("b_stem").alias("a_stem"),
        F.col("a_stem").alias("b_stem"),
        F.col("ratio_ba").alias("ratio_ab"),
        F.col("ratio_ab").alias("ratio_ba"),
    )
    side = lambda df, s: df.select(
        "ext", F.col("stem").alias(f"{s}_stem"), F.col("cls").alias(f"{s}_id"), F.col("has_summary").alias(f"{s}_has"),
        *[F.col(o).alias(f"{s}_{o}") for o in _ORDERS],
    )
    joined = near.unionByName(turned).join(side(bare, "a"), ["ext", "a_stem"]).join(side(classes, "b"), ["ext", "b_stem"])
    return (
        joined.filter((F.col("a_id") != F.col("b_id")) & (F.col("b_has") | (F.col("a_id") < F.col("b_id"))))
        .withColumn("jaccard", F.lit(0.0))
        .withColumn("both", F.lit(False))
        .select(*_PAIR)
    )
