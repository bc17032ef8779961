"""Near-duplicate documents with SetSketch registers.

The sketch of a set of shingles holds, for each of its registers, the smallest point that any
element has there, on a logarithmic scale with base ``exp(0.1)`` and truncated to one byte
(Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog", 2021). Registers of a union
are the larger ones of both. An element is a Poisson process of points, each dealt to one
register by hash, so that all registers of a set are independent and only its first points
need to be made.

Bands of registers find candidates. A pair is then judged three times: by size, by the joint
likelihood of its registers, and on the full sets of shingles. Equal sets are one class from
the start. In a bucket every class first meets one pivot; whole pairs are made only of classes
that are still in different components after that.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import small, store
from .words import LOWER, SPACED, find_words, mix, pieces, prefix_sums, span_hashes, text_bytes, windows

LN_BASE = 0.1
TOP = 3.0  # logarithm of the largest point told apart
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDup:
    """Sets of ``shingle`` consecutive words are linked where 100 times the intersection is at
    least ``percent`` times the union. ``miss``: chance to miss a pair that is just similar
    enough, from which the number of registers in a band follows. ``doubt``: pairs less likely
    than ``exp(-doubt)`` times the best estimate are not looked at further."""

    shingle: int = 5
    percent: int = 80
    registers: int = 256
    miss: float = 1e-9
    doubt: float = 15.0

    def band(self) -> tuple[int, int]:
        """Registers in a band, and bands."""
        same = 1 - 2 * float(step_share(np.float64((1 - self.percent / 100) / 2)))
        for rows in range(self.registers, 1, -1):
            if (1 - same**rows) ** (self.registers // rows) <= self.miss:
                return rows, self.registers // rows
        return 1, self.registers

    def least(self) -> int:
        """The smallest set that can be linked to a different set."""
        union = math.ceil(100 / (100 - self.percent)) if self.percent < 100 else 1 << 60
        return union - 1


def step_share(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is larger, by the share of elements it has alone."""
    b = math.exp(LN_BASE)
    return -np.log1p(-x * (b - 1) / b) / LN_BASE


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; fewer words than ``width`` are one shingle."""
    data = LOWER[data]
    starts, ends, first = find_words(data, bounds, SPACED)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    _, text, joint = windows(hashes, first, width)
    cuts = np.searchsorted(text, np.arange(len(bounds)))
    out = []
    for i, n in enumerate(np.diff(first)):
        if 0 < n < width:
            whole = hashlib.blake2b(hashes[first[i] : first[i + 1]].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.unique(joint[cuts[i] : cuts[i + 1]]))
    return out


def sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` byte registers per set; an empty set has zeros."""
    n = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * m, np.inf)
    if n.sum() == 0:
        return np.zeros((len(sets), m), np.uint8)
    all_h = np.concatenate(sets)
    all_set = np.repeat(np.arange(len(sets)), n)
    time, made = np.zeros(len(all_h)), np.zeros(len(all_h), np.uint64)
    until = (math.log(m) + 4) / np.maximum(n, 1)
    todo = np.arange(len(all_h))
    while len(todo):
        rest = todo
        while len(rest):
            block = 1 if len(rest) > 20_000 else 8 if len(rest) > 2_000 else 32
            k = made[rest, None] + np.arange(block, dtype=np.uint64)[None, :]
            drawn = mix(all_h[rest, None] + (k + np.uint64(1)) * STEP)
            waits = np.log(((drawn >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / -m
            at = time[rest, None] + np.cumsum(waits, axis=1)
            owner = all_set[rest]
            early = at <= until[owner][:, None]
            register = ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, (owner[:, None] * m + register)[early], at[early])
            used = early.sum(axis=1)
            made[rest] += used.astype(np.uint64)
            some = used > 0
            time[rest[some]] = at[np.flatnonzero(some), used[some] - 1]
            rest = rest[used == block]
        bare = np.isinf(least.reshape(-1, m)).any(axis=1) & (n > 0)
        until[bare] *= 1.5
        todo = np.flatnonzero(bare[all_set])
    with np.errstate(divide="ignore"):
        levels = np.floor((TOP - np.log(least)) / LN_BASE)
    return np.clip(np.where(np.isinf(least), 0, levels), 0, 255).astype(np.uint8).reshape(-1, m)


def _sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    data, bounds = text_bytes(texts)
    out: list[np.ndarray] = []
    for i, j in pieces(bounds):
        out += shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], width)
    return out


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def profile(text: Column, spec: NearDup) -> Column:
    """Struct of the set's size, its name (128 bits of its content) and its registers."""

    @F.arrow_udf("struct<n:bigint,name:binary,sketch:binary>")
    def profiled(texts: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        sets: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for i, j in pieces(bounds, 1 << 20):  # sketches of many sets at once
            some = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], spec.shingle)
            rows += list(sketches(some, spec.registers))
            sets += [(len(s), _name(s)) for s in some]
        return pa.StructArray.from_arrays(
            [
                pa.array([s[0] for s in sets], pa.int64()),
                pa.array([s[1] for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in rows], pa.binary()),
            ],
            names=["n", "name", "sketch"],
        )

    return profiled(text)


def named_set(text: Column, spec: NearDup) -> Column:
    @F.arrow_udf("struct<name:binary,shingles:binary>")
    def sets(texts: pa.Array) -> pa.Array:
        found = _sets_of(texts, spec.shingle)
        return pa.StructArray.from_arrays(
            [pa.array([_name(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
            names=["name", "shingles"],
        )

    # Else a filter on the name would be pushed below the choice of texts, and make all sets.
    return sets.asNondeterministic()(text)


def similarity_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of each pair of register rows, given the set sizes, and how much
    less likely (in logarithms) a similarity of at least ``percent`` is."""
    m = a.shape[1]
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = step_share(np.maximum(u - v * j, 1e-9)), step_share(np.maximum(v - u * j, 1e-9))
        equal = np.maximum(1 - more - less, 1e-12)
        return above * np.log(more) + below * np.log(less) + (m - above - below) * np.log(equal)

    best, best_j = np.full(len(a), -np.inf), np.zeros(len(a))
    enough = np.full(len(a), -np.inf)
    for share in np.linspace(0, 1, 101):
        j = most * share
        value = likelihood(j)
        better = value > best
        best, best_j = np.where(better, value, best), np.where(better, j, best_j)
        enough = np.where((j * 100 >= percent) & (value > enough), value, enough)
    at_limit = likelihood(np.minimum(most, percent / 100))
    return best_j, best - np.maximum(enough, at_limit)


def _likely(spec: NearDup) -> Column:
    @F.arrow_udf("boolean")
    def likely(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.bool_())
        rows = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (a, b)]
        _, lost = similarity_estimate(*rows, n_a.to_numpy(zero_copy_only=False), n_b.to_numpy(zero_copy_only=False), spec.percent)
        return pa.array(lost <= spec.doubt)

    return likely(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"))


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    p, q = (p, q) if len(p) <= len(q) else (q, p)
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return int((q[at] == p).sum())


def common_shingles(a: str, b: str) -> Column:
    """Size of the intersection of two sets, sorted and as bytes."""

    @F.arrow_udf("bigint")
    def common(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [shared(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right)]
        return pa.array(out, pa.int64())

    return common(a, b)


def _with_ends(pairs: DataFrame, of_node: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with columns of ``of_node(node, …)`` for both ends."""
    for end in ("b", "a"):
        side = of_node.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, spec: NearDup) -> DataFrame:
    """``node, shingles`` of the wanted classes, made anew from one text each."""
    texts = docs.join(small(wanted.select("rep")), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.select(named_set(texts["text"], spec).alias("s")).select("s.*").dropDuplicates(["name"])
    return store(sets.join(small(wanted.select("node", "name")), "name").select("node", "shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, spec: NearDup) -> DataFrame:
    """The pairs whose full sets are similar enough. Texts are read again only where a pair needs them."""
    met = store(classes.join(small(_ends(pairs)), "node", "left_semi"))
    near = _with_ends(pairs, met, "n", "sketch")
    near = near.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * spec.percent)
    near = store(near.filter(_likely(spec)).select("a", "b", "n_a", "n_b"))
    sets = _sets(docs, store(met.join(small(_ends(near)), "node", "left_semi")), spec)
    both = _with_ends(near, sets, "shingles")
    judged = both.select("a", "b", "n_a", "n_b", common_shingles("shingles_a", "shingles_b").alias("common"))
    return store(judged.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * spec.percent).select("a", "b"))


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _buckets(classes: DataFrame, spec: NearDup) -> DataFrame:
    """``band, node, n`` of the buckets that hold more than one class."""
    rows, bands = spec.band()
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * rows + 1, rows)) for i in range(bands)])
    each = classes.filter(F.col("n") >= spec.least()).select("node", "n", F.posexplode(keys).alias("i", "band"))
    shared = each.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    return store(each.join(shared.select("band"), "band"))


def _live(buckets: DataFrame, component: DataFrame | None) -> DataFrame:
    """Buckets that still hold several components, with the component of each class."""
    if component is None:
        return buckets.withColumn("c", F.col("node"))
    known = buckets.join(small(component), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    open_ = known.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    return store(known.join(open_, "band"))


def _pivots(live: DataFrame, used: DataFrame | None) -> DataFrame:
    """``band, pivot, pivot_c``: of each bucket the class that meets most others in all its
    buckets, as the original of many altered copies does; not one that was a pivot before."""
    sizes = live.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    company = live.join(sizes, "band").groupBy("node").agg(F.sum("k").alias("company"))
    if used is not None:
        company = company.join(used.distinct(), company["node"] == used["pivot"], "left_anti")
    best = live.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node", "c")).alias("p"))
    return store(best.select("band", F.col("p.node").alias("pivot"), F.col("p.c").alias("pivot_c")))


SELF_JOIN = 16  # classes in a bucket whose pairs are made by a join
BLOCK = 256  # classes in a block of a larger bucket


def _links_in_block(spec: NearDup):
    """Links between two blocks of a bucket (or within one), as numbers of their classes.

    A pair is judged in the first band that it shares only.
    """
    rows_in_band, bands = spec.band()

    def found(rows: pa.Table) -> pa.Table:
        node, c, n, block = (rows.column(k).to_numpy() for k in ("node", "c", "n", "block"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        low, high, band = (rows.column(k)[0].as_py() for k in ("low", "high", "i"))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        limit = sketch.shape[1] * (1 - 2 * float(step_share(np.float64((1 - spec.percent / 100) / 2))) - 0.2)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left:
            other = right[node[right] > node[k]] if low == high else right
            other = other[(c[other] != c[k]) & (np.minimum(n[other], n[k]) * 100 >= np.maximum(n[other], n[k]) * spec.percent)]
            other = other[(sketch[other] == sketch[k]).sum(axis=1) >= limit]
            a.append(np.full(len(other), k))
            b.append(other)
        a, b = np.concatenate(a), np.concatenate(b)
        same = (sketch[a, : rows_in_band * bands] == sketch[b, : rows_in_band * bands]).reshape(len(a), bands, rows_in_band).all(axis=2)
        first = same.argmax(axis=1) == band if len(a) else np.zeros(0, bool)
        a, b = a[first], b[first]
        if len(a):
            _, lost = similarity_estimate(sketch[a], sketch[b], n[a], n[b], spec.percent)
            a, b = a[lost <= spec.doubt], b[lost <= spec.doubt]
        common = np.array([shared(sets[x], sets[y]) for x, y in zip(a, b)], np.int64)
        linked = common * 100 >= (n[a] + n[b] - common) * spec.percent
        a, b = node[a[linked]], node[b[linked]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return found


def _open_buckets(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components in the smaller buckets; the classes of the larger ones."""
    shares = live.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    sizes = shares.groupBy("band").agg(
        F.sum("n").alias("k"), F.max("n").alias("most"), F.max(F.struct("n", "c"))["c"].alias("main")
    )
    sized = store(live.select("band", "i", "node", "c", "n").join(sizes, "band"))
    few = sized.filter(F.col("k") <= SELF_JOIN)
    x = few.select("band", F.col("node").alias("a"), F.col("c").alias("ca"))
    y = few.select("band", F.col("node").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(y, "band").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b")
    return pairs, sized.filter(F.col("k") > SELF_JOIN)


def _links_in_large(many: DataFrame, docs: DataFrame, classes: DataFrame, spec: NearDup) -> DataFrame:
    """Links of different components in large buckets. Blocks of about ``BLOCK`` classes are
    compared within tasks, and only links come out. Blocks of the largest component of a bucket
    meet those of the others only."""
    nodes = many.select("node").distinct()
    wanted = store(classes.join(small(nodes), "node", "left_semi"))
    held = wanted.join(_sets(docs, wanted, spec), "node").select("node", "sketch", "shingles")
    in_main = F.col("c") == F.col("main")
    others = F.ceil((F.col("k") - F.col("most")) / BLOCK).cast("int")
    mains = F.ceil(F.col("most") / BLOCK).cast("int")
    drawn = F.xxhash64("node")
    block = F.when(in_main, others + F.pmod(drawn, mains)).otherwise(F.pmod(drawn, others)).cast("int")
    last = F.when(in_main, others).otherwise(others + mains) - 1
    placed = many.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    keyed = placed.select("band", "i", "node", "c", "n", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    groups_ = keyed.join(held, "node").groupBy("band", "low", "high")
    return store(groups_.applyInArrow(_links_in_block(spec), "a bigint, b bigint"))


def links(docs: DataFrame, classes: DataFrame, spec: NearDup) -> DataFrame | None:
    """Edges ``a, b`` between classes, as many as their components need.

    Rounds of pivots (one class of each bucket, another one in each round) settle copies of one
    text in work proportional to the bucket. When the pairs left are no more than in proportion
    to the classes, or a round links few, all pairs of different components in a bucket that
    were not tested yet are.
    """
    if spec.least() >= 1 << 50:
        return None
    buckets = _buckets(classes, spec)
    enough = 8 * classes.count()
    component = edges = tested = pivots = None
    for turn in range(4):
        live = _live(buckets, component)
        spread = live.groupBy("band").agg(F.count(F.lit(1)).alias("k")).agg(
            F.sum("k").alias("rows"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs")
        ).first()
        if not spread.rows:
            break
        last = turn > 0 and (spread.pairs <= enough or turn == 3 or few)
        if last:
            pairs, many = _open_buckets(live)
        else:
            chosen = _pivots(live, pivots)
            met = live.join(chosen, "band").filter(F.col("pivot_c") != F.col("c"))
            pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            pivots = chosen.select("pivot") if pivots is None else pivots.unionByName(chosen.select("pivot"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = store(pairs)
        found = _verified(pairs, docs, classes, spec)
        linked = found.count()
        few = linked * 50 < pairs.count()
        edges = found if edges is None else edges.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if last:
            if many.limit(1).count():
                edges = edges.unionByName(_links_in_large(many, docs, classes, spec))
            break
        if linked:
            component = store(_components(edges))
    return edges


def groups(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` says whether it is the
    row's own. A text without words has an empty set and is linked with nothing. A null
    ``doc_id`` stands for no document of its own: it takes the smallest id of its group, null if
    the group has none. Rows that repeat an id are told apart by their texts.
    """
    docs = docs.select("doc_id", "text")
    rows = store(docs.select("doc_id", profile(docs["text"], spec).alias("p")).select("doc_id", "p.*"))
    held = rows.filter(F.col("n") > 0).groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = store(held.withColumn("node", F.monotonically_increasing_id()))
    edges = links(docs, classes, spec)
    component = _components(edges) if edges is not None else None
    if component is None:
        named = classes.select("name", F.col("rep").alias("component_id"))
    else:
        joined = classes.select("node", "name", "rep").join(small(store(component)), "node", "left")
        joined = store(joined.withColumn("component", F.coalesce("component", "node")))
        least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = joined.join(least, "component").select("name", "component_id")
    out = rows.select("doc_id", "n", "name").join(named, "name", "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """One document of each group, with the columns it came with. Documents without an id stay;
    of rows that repeat an id one stays."""
    found = store(groups(docs, spec).filter(F.col("doc_id").isNotNull()))
    dropped = found.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(small(dropped), "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").count().filter("count > 1").limit(1).count() == 0:
        return kept
    single = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return single.unionByName(kept.filter(F.col("doc_id").isNull()))
