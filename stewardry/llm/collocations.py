"""Phrases whose words stand together, counted from padded windows of the longest phrase alone.

Every word position gives one window: the word and its next four in lead columns, padded after the
last word of its piece. Equal windows are counted, and one ROLLUP over the columns sums the
prefixes, which are all shorter phrases, the words and the total. No shorter n-gram is ever made.

A phrase that occurs ``least`` times has words and neighbouring pairs that do, so a window may be
padded from the first rarer one on without a change to any count that is reported. Rare words and
pairs are told by bit filters of a fixed size (``MOST_BITS``), built from exact counts: a filter
keeps more than it must where it is full, never less.

Words are counted by language and text; windows hold 64-bit hashes of language and word.

Odd input. Null or empty text has no words, a null language is ``und``. Every row counts, also
repeated ones. Texts and words of any length are hashed in parts. Equal scores and counts are
ranked by phrase. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, store, text_of
from .words import LOWER, find_words, mix, pieces, prefix_sums, span_hashes, text_bytes

# Bytes that end a piece, and those that part words within one.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~ENDS
IN_WORD[[0x20, 0x09]] = False

MOST_BITS = 1 << 27  # of a filter: 16 MB
BITS_A_KEY = 24
PAIR, STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)
SALTS = 16


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more; one whose words lie in a
    longer one goes if that has ``cover`` percent of its occurrences or more; ``top`` a language."""

    longest: int = 5
    least: int = 100
    cover: int = 100
    top: int = 2000


def _bits(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of every key in a filter."""
    mask = np.uint64(n_bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) * PAIR >> np.uint64(16) & mask).astype(np.int64)


class Filter:
    """Set of 64-bit keys with false positives: at most ``MOST_BITS`` bits, sent to the tasks once."""

    def __init__(self, keys: DataFrame):
        """``keys``: a table with a column ``key``."""
        wanted = BITS_A_KEY * keys.count()
        self.n_bits = n_bits = min(MOST_BITS, max(1 << 16, 1 << wanted.bit_length()))

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), n_bits)) + 1  # counted from 1
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], ["at"])

        at = keys.select("key").mapInArrow(positions, "at long")
        maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        data = np.zeros(n_bits // 8, np.uint8)
        # At most MOST_BITS / 32768 rows of 4 kB.
        for bucket, bits in maps.collect():
            begin = (bucket - 1) * 4096
            part = np.frombuffer(bytes(bits), np.uint8)[: len(data) - begin]
            data[begin : begin + len(part)] = part
        self.sent: Broadcast = keys.sparkSession.sparkContext.broadcast(data)

    def has(self, keys: np.ndarray) -> np.ndarray:
        data = self.sent.value
        a, b = _bits(keys, self.n_bits)
        return (data[a >> 3] >> (a & 7).astype(np.uint8) & data[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        first = starts[i]
        out[i:j] = span_hashes(prefix_sums(data[first : ends[j - 1]]), starts[i:j] - first, ends[i:j] - first)
        i = j
    return out


@dataclass
class _Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # number of the text in the batch
    key: np.ndarray  # hash of language and word
    joined: np.ndarray  # whether the next word is in the same piece

    def pairs(self) -> np.ndarray:
        """Key of each word and its next one."""
        return mix(self.key[:-1] * STEP + self.key[1:])


def _split(texts: pa.Array, langs: np.ndarray, limit: int = 1 << 22) -> Iterator[_Words]:
    """Words of the texts, a few megabytes at a time; ``langs``: hash of each text's language."""
    all_data, all_bounds = text_bytes(texts)
    for i, j in pieces(all_bounds, limit):
        data = LOWER[all_data[all_bounds[i] : all_bounds[j]]]
        starts, ends, first = find_words(data, all_bounds[i : j + 1] - all_bounds[i], IN_WORD)
        doc = np.repeat(np.arange(i, j), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(ENDS[data]), starts)
        key = mix(_hashes(data, starts, ends) ^ langs[doc])
        yield _Words(data, starts, ends, doc, key, (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]))


def _over_words(docs: DataFrame, fn: Callable[[_Words, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` of the words of each part of ``docs`` (``lang``, ``code``, ``text``) and of its languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, code, text = batch.columns
            for words in _split(text, code.to_numpy().view(np.uint64)):
                if len(words.key):
                    yield fn(words, lang)

    return docs.mapInArrow(run, schema)


def _word_counts(words: _Words, lang: pa.Array) -> pa.RecordBatch:
    key, at, n = np.unique(words.key, return_index=True, return_counts=True)
    texts = pa.array([words.data[a:b].tobytes() for a, b in zip(words.starts[at], words.ends[at])], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang.take(pa.array(words.doc[at])), texts, pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])


def _pair_counts(frequent: Filter):
    def fn(words: _Words, lang: pa.Array) -> pa.RecordBatch:
        known = frequent.has(words.key)
        key, n = np.unique(words.pairs()[words.joined & known[1:] & known[:-1]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return fn


def _window_counts(frequent: Filter, longest: int):
    def fn(words: _Words, lang: pa.Array) -> pa.RecordBatch:
        size = len(words.key)
        # Number of words from here to the first pair that is rare or in two pieces.
        stop = np.flatnonzero(~np.append(words.joined & frequent.has(words.pairs()), False))
        here = np.arange(size)
        reach = np.minimum(stop[np.searchsorted(stop, here)] - here + 1, longest)
        columns = [np.where(reach > k, words.key[np.minimum(here + k, size - 1)], np.uint64(0)) for k in range(longest)]
        joint = np.zeros(size, np.uint64)
        for column in columns:
            joint = joint * STEP + column
        _, one, n = np.unique(mix(joint), return_index=True, return_counts=True)
        leads = [pa.array(column[one].view(np.int64)) for column in columns]
        return pa.RecordBatch.from_arrays([lang.take(pa.array(words.doc[one])), *leads, pa.array(n)], ["lang", *_leads(longest), "n"])

    return fn


def _leads(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def _counted(docs: DataFrame, rules: Phrases) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, totals, phrases)``: how frequent words are spelt, all words of each language, and the
    phrases (single words too) that occur ``least`` times, as the array ``p`` of their words' keys."""
    vocabulary = _over_words(docs, _word_counts, "lang string, word string, key long, n long").groupBy("lang", "word")
    words = store(vocabulary.agg(F.max("key").alias("key"), F.sum("n").alias("n")).filter(F.col("n") >= rules.least).drop("n"))
    known = Filter(words)
    pairs = store(_over_words(docs, _pair_counts(known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.least))
    leads = _leads(rules.longest)
    schema = ", ".join(["lang string", *(f"{w} long" for w in leads), "n long"])
    windows = _over_words(docs, _window_counts(Filter(pairs), rules.longest), schema).groupBy("lang", *leads).agg(F.sum("n").alias("n"))
    rolled = windows.rollup("lang", *leads).agg(F.sum("n").alias("a"), F.grouping_id().alias("level")).withColumn("k", _length_of(rules.longest))
    # Padding ends a phrase.
    whole = (F.col("k") == 0) | (F.col("a") >= rules.least) & (F.get(F.array(*leads), F.col("k") - 1) != 0)
    counted = store(rolled.filter((F.col("k") >= 0) & whole).select("lang", "k", F.slice(F.array(*leads), 1, F.col("k")).alias("p"), "a"))
    return words, counted.filter("k = 0").select("lang", F.col("a").alias("n")), counted.filter("k > 0").drop("k")


def _length_of(longest: int) -> Column:
    """Words of a prefix whose other columns are summed up; -1 for the sum of all languages."""
    out = F.lit(-1)
    for i in range(longest + 1):
        out = F.when(F.col("level") == (1 << longest - i) - 1, F.lit(i)).otherwise(out)
    return out


def _scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrases`` of two words and more with ``l``, ``r``, ``n`` and ``score`` of the cut that scores lowest."""
    # A frequent word begins or ends many phrases: single words are spread over salts.
    salts = F.when(F.size("p") == 1, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    parts = phrases.select("lang", F.col("p").alias("part"), F.col("a").alias("f"), F.explode(salts).alias("salt"))
    salt = lambda part: F.when(F.size(part) == 1, F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int")).otherwise(0)
    cuts = phrases.filter(F.size("p") > 1).select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("cut"))
    for side, part in (("l", F.slice("p", 1, F.col("cut"))), ("r", F.slice("p", F.col("cut") + 1, F.size("p")))):
        cuts = cuts.withColumn("part", part).withColumn("salt", salt(F.col("part")))
        cuts = cuts.join(parts, ["lang", "part", "salt"]).drop("part", "salt").withColumnRenamed("f", side)
    exact = cuts.join(totals, "lang").withColumns({c: F.col(c).cast("decimal(17,0)") for c in "alrn"})
    score = F.expr("(1000 * a * n) div (l * r)")
    lowest = exact.groupBy("lang", "p").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "n")).alias("best"))
    return lowest.select("lang", "p", "best.score", *[F.col(f"best.{c}").cast("long").alias(c) for c in "alrn"])


def _uncovered(phrases: DataFrame, rules: Phrases) -> DataFrame:
    """``lang, p`` of the phrases that no longer one accounts for."""
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("p") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("p") - k + 1), lambda i: F.slice("p", i, k)),
        )
    )
    inner = phrases.filter(F.size("p") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("p"), "a")
    longer = inner.groupBy("lang", "p").agg(F.max("a").alias("most"))
    covered = F.coalesce(100 * F.col("most") >= rules.cover * F.col("a"), F.lit(False))
    return phrases.filter(F.size("p") > 1).join(longer, ["lang", "p"], "left").filter(~covered).select("lang", "p")


def top_phrases(docs: DataFrame, rules: Phrases = Phrases(), lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    ``a`` occurrences among ``n`` words, parted into ``l`` of the first and ``r`` of the rest where the score
    ``floor(1000 * a * n / (l * r))`` is lowest.
    """
    prepare(docs.sparkSession)
    name = F.coalesce(docs[lang].cast("string"), F.lit("und"))
    texts = docs.select(name.alias("lang"), F.xxhash64(name).alias("code"), text_of(docs).alias("text"))
    words, totals, phrases = _counted(texts, rules)
    scored = store(_scored(totals, phrases).join(_uncovered(phrases, rules), ["lang", "p"]))
    order = [F.desc("score"), F.desc("a")]
    # Ties of the last place go on until their words are known.
    first = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= rules.top).drop("place")
    spelt = first.select("lang", "p", F.posexplode("p").alias("i", "key")).join(words.select("lang", "key", "word"), ["lang", "key"])
    texts = spelt.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = first.join(texts, ["lang", "p"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= rules.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
