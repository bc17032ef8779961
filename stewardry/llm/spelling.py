"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

The letters are dealt to groups, and a word is the vector of its letters per group. The words of a
shard stand in a trie by successive counts. A word looks for its near ones depth first: on the way
down it may meet one count that is one higher than its own (the surplus) and one that is one lower
(the deficit), which is what a single inserted, deleted or replaced letter does to the vector. The
words of a leaf are then compared letter by letter.

The trie is cut into shards by its first counts, so that no shard has more than ``shard_words``
words. Where words share all their counts beyond that, a shard is dealt into chunks that are all
searched. A word is sent to the shards that its budget reaches.

Odd input. Null or empty text has no words. Every row counts, also repeated ones; a null id is the
empty text in the hash. Words of any length are compared. Among near words of equal count the
smallest in code-point order is the form. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, store, text_of
from .line_runs import fold

RUN = "[A-Za-zÀ-ÿ]+"

# Letters of the groups, frequent ones by themselves; every other letter is in a last group.
GROUPS = ("e", "t", "a", "n", "o", "i", "r", "s", "hl", "du", "cmfp", "gwybv")


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``least_chars`` letters and ``least_count`` occurrences; a form occurs
    ``times`` as often as its variant. ``every``: one of so many runs of letters in a text loses a
    letter by hash (0: none does)."""

    least_chars: int = 6
    least_count: int = 5
    times: int = 5
    every: int = 199
    shard_words: int = 50_000


def count_words(docs: DataFrame, rules: Spelling = Spelling(), key: str = "doc_id") -> DataFrame:
    """``word, n``: the words of all texts with their occurrences."""
    name = F.coalesce(docs[key].cast("string"), F.lit(""))
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(text_of(docs), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= rules.least_chars).select("name", fold(F.col("run")).alias("run"))
    word = F.col("run")
    if rules.every:
        h, size = F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")), F.char_length("run")
        at = (h % size).cast("int")
        word = F.when(h % rules.every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= rules.least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.least_count)


def group_counts(word: Column) -> Column:
    """Letters of the word per group."""
    own = [F.char_length(word) - F.char_length(F.translate(word, letters, "")) for letters in GROUPS]
    return F.array(*own, F.char_length(F.translate(word, "".join(GROUPS), "")))


def _budget(depth: int) -> list[list[int]]:
    """Changes to the first ``depth`` counts with at most one surplus and one deficit."""
    out = []
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up != down or up < 0:
                out.append([(i == up) - (i == down) for i in range(depth)])
    return out


def _depth(words: DataFrame, rules: Spelling) -> tuple[int, int]:
    """Counts that part the shards, and the chunks of a shard."""
    n = len(GROUPS) + 1
    columns = [F.col("c")[i].alias(f"c{i}") for i in range(n)]
    sizes = words.select(*columns).rollup(*[f"c{i}" for i in range(n)]).agg(F.count("*").alias("size"), F.grouping_id().alias("level"))
    most = {level: size for level, size in sizes.groupBy("level").agg(F.max("size")).collect()}
    for depth in range(1, n + 1):
        largest = most.get((1 << n - depth) - 1, 0)
        if largest <= rules.shard_words:
            return depth, 1
    return n, -(-largest // rules.shard_words)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each begins."""
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), bounds


class Trie:
    """Words sorted by their counts; a node is a range of them that share their first counts."""

    def __init__(self, words: list[str], counts: np.ndarray, leaf_words: int = 16, block: int = 1 << 18):
        order = np.lexsort(counts.T[::-1])
        self.order, self.counts = order, counts[order]
        self.codes, self.bounds = _codes([words[i] for i in order])
        self.leaf_words, self.block = leaf_words, block

    def near(self, words: list[str], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a given word and a word of the trie one edit apart, by number."""
        codes, bounds = _codes(words)
        for query, member in self._leaves(counts):
            # At most a block of pairs is compared at a time.
            step = max(1, self.block // len(member))
            for i in range(0, len(query), step):
                part = query[i : i + step]
                q, m = np.repeat(part, len(member)), np.tile(member, len(part))
                off = self.counts[m] - counts[q]
                fits = (np.maximum(off, 0).sum(axis=1) <= 1) & (np.maximum(-off, 0).sum(axis=1) <= 1)
                q, m = q[fits], m[fits]
                good = _one_edit(codes, bounds, q, self.codes, self.bounds, m)
                if good.any():
                    yield q[good], self.order[m[good]]

    def _leaves(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: words that reach a leaf within their budget, and the words of the leaf."""
        depth = counts.shape[1]
        free = np.zeros(len(counts), bool)
        stack = [(0, 0, len(self.counts), np.arange(len(counts)), free, free)]
        while stack:
            level, low, high, alive, surplus, deficit = stack.pop()
            if high - low <= self.leaf_words or level == depth:
                yield alive, np.arange(low, high)
                continue
            values = self.counts[low:high, level]
            cuts = np.flatnonzero(np.diff(values)) + 1
            own = counts[alive, level]
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(values)]):
                off = values[a] - own
                go = (off == 0) | (off == 1) & ~surplus | (off == -1) & ~deficit
                if go.any():
                    stack.append((level + 1, low + a, low + b, alive[go], surplus[go] | (off[go] == 1), deficit[go] | (off[go] == -1)))


def _one_edit(codes_a: np.ndarray, bounds_a: np.ndarray, a: np.ndarray, codes_b: np.ndarray, bounds_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether word ``a`` is word ``b`` with one letter inserted, deleted or replaced."""
    begin_a, begin_b = bounds_a[a], bounds_b[b]
    size_a, size_b = bounds_a[a + 1] - begin_a, bounds_b[b + 1] - begin_b
    shorter, longer = np.minimum(size_a, size_b), np.maximum(size_a, size_b)

    def alike(from_a: np.ndarray, from_b: np.ndarray, step: int) -> np.ndarray:
        """Letters that agree from there on, ``shorter`` at most."""
        n = np.zeros(len(a), np.int64)
        going = np.flatnonzero(shorter > 0)
        k = 0
        while len(going):
            going = going[codes_a[from_a[going] + step * k] == codes_b[from_b[going] + step * k]]
            k += 1
            n[going] = k
            going = going[shorter[going] > k]
        return n

    head = alike(begin_a, begin_b, 1)
    tail = alike(begin_a + size_a - 1, begin_b + size_b - 1, -1)
    # Equal words agree all over; else head and tail leave one letter of the longer word.
    return (longer - shorter <= 1) & ((head < longer) & (head + tail >= longer - 1))


def near_words(words: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """``word, n_near, form_n, form``: near words of each word that has some, and the most frequent."""
    words = store(words.select("word", "n", group_counts(F.col("word")).alias("c")))
    depth, chunks = _depth(words, rules)
    members = words.select(F.slice("c", 1, depth).alias("shard"), F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int").alias("chunk"), "word", "n", "c")
    changes = F.explode(F.array(*[F.array(*map(F.lit, change)) for change in _budget(depth)]))
    seeking = words.select("word", "c", changes.alias("change"), F.slice("c", 1, depth).alias("own"))
    seeking = seeking.select(F.zip_with("own", "change", lambda x, y: x + y).alias("shard"), F.explode(F.array(*map(F.lit, range(chunks)))).alias("chunk"), "word", "c")
    seeking = seeking.filter(F.forall("shard", lambda x: x >= 0))

    def search(there: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"word": [], "n_near": [], "form_n": [], "form": []}
        if there.num_rows and asked.num_rows:
            vector = lambda t: t["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.int64)
            names, n, words = there["word"].to_pylist(), there["n"].to_numpy(), asked["word"].to_pylist()
            place = np.empty(len(names), np.int64)
            place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            found = list(Trie(names, vector(there)).near(words, vector(asked)))
            if found:
                q, m = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((place[m], -n[m], q))
                q, m = q[order], m[order]
                one, at, n_near = np.unique(q, return_index=True, return_counts=True)
                out = {"word": [words[i] for i in one], "n_near": n_near, "form_n": n[m[at]], "form": [names[i] for i in m[at]]}
        return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                         "form_n": pa.array(out["form_n"], pa.int64()), "form": pa.array(out["form"], pa.string())})

    met = members.groupBy("shard", "chunk").cogroup(seeking.groupBy("shard", "chunk")).applyInArrow(search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    per_word = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return per_word.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def variants(words: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (``word``, ``n``)."""
    prepare(words.sparkSession)
    words = store(words)
    met = words.join(near_words(words, rules), "word", "left")
    has_form = F.coalesce(F.col("form_n") >= rules.times * F.col("n"), F.lit(False))
    met = store(
        met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n"))
    )
    # A form has at least twice its variant's count, so there are fewer than 64 steps to the last
    # one, and six rounds of doubling reach it.
    if rules.times < 2:
        raise ValueError("times: 2 at least")
    links = met.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(6):
        links = store(links)
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return met.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
