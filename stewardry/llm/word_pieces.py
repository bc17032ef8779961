"""Token counts by greedy longest match, in time linear in the text.

The automaton is the trie of the vocabulary with failure links: where no edge fits, the link
leads to the state that holds what is left after the tokens that are then certain, and their
number is stored with it (Song et al., "Fast WordPiece Tokenization", 2021). Counts come out
without any piece being built.
"""

from __future__ import annotations

import base64
from collections import Counter, deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Distinct words whose counts a task remembers; the memory is emptied when full.
REMEMBERED = 200_000
UNKNOWN = -1


class LongestMatch:
    """``heads`` begin a word, ``tails`` go on within it (without the marker of a continuation).

    A word that cannot be cut greedily into pieces is one unknown token.
    """

    def __init__(self, heads: Iterable[str], tails: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # states 0 and 1: start of a word, start of a tail
        whole: list[bool] = [False, False]
        for root, pieces in enumerate((heads, tails)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    at = self.edges[at][c]
                if piece:
                    whole[at] = True
        n = len(self.edges)
        self.link, self.popped = [UNKNOWN] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, state in self.edges[parent].items():
                queue.append(state)
                if whole[state]:
                    self.link[state], self.popped[state] = 1, 1
                    continue
                back, count = self.link[parent], self.popped[parent]
                while back != UNKNOWN and c not in self.edges[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back != UNKNOWN:
                    self.link[state], self.popped[state] = self.edges[back][c], count
        # Tokens that end a word in each state; -1 if what is left cannot be cut.
        self.close = [UNKNOWN] * n
        self.close[0] = self.close[1] = 0
        for state in range(2, n):
            at, count = state, 0
            while at not in (0, 1, UNKNOWN):
                count += self.popped[at]
                at = self.link[at]
            self.close[state] = count if at != UNKNOWN else UNKNOWN

    def count(self, word: str) -> int:
        """Number of tokens of ``word``; -1 if it is unknown."""
        edges, link, popped = self.edges, self.link, self.popped
        at = tokens = 0
        for c in word:
            while c not in edges[at]:
                tokens += popped[at]
                at = link[at]
                if at == UNKNOWN:
                    return UNKNOWN
            at = edges[at][c]
        return tokens + self.close[at] if self.close[at] != UNKNOWN else UNKNOWN


def byte_ranks(lines: Iterable[bytes]) -> list[bytes]:
    """Tokens of a rank file: a base-64 token and its rank on each line."""
    return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def counts(docs: DataFrame, tokens: list[bytes], as_name: str = "counts") -> DataFrame:
    """``docs`` with a struct column: words, tokens and unknown words of ``text``.

    ``tokens`` is a vocabulary of bytes in which a leading space marks the start of a word. A
    word is a run of characters other than space and the controls tab to carriage return.
    Null and blank texts have no words. The vocabulary is what is broadcast: its size does not
    depend on the texts.
    """
    as_text = [t.decode("latin-1") for t in tokens]
    heads = [t for t in as_text if t[:1] == " "]
    tails = [t for t in as_text if t[:1] != " "]
    held = docs.sparkSession.sparkContext.broadcast({"heads": heads, "tails": tails})

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        kept = held.value
        if "automaton" not in kept:
            kept["automaton"], kept["seen"] = LongestMatch(kept["heads"], kept["tails"]), {}
        count, seen = kept["automaton"].count, kept["seen"]
        words, sums, unknown = [], [], []
        for text in texts.cast(pa.binary()).to_pylist():
            each = Counter(text.split()) if text else {}
            total = missing = 0
            for word, times in each.items():
                n = seen.get(word)
                if n is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    n = seen[word] = count(" " + word.decode("latin-1"))
                total += times * (n if n != UNKNOWN else 1)
                missing += times * (n == UNKNOWN)
            words.append(sum(each.values()))
            sums.append(total)
            unknown.append(missing)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (words, sums, unknown)], names=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(as_name, counted(docs["text"]))


def read_vocabulary(spark, path: str) -> list[bytes]:
    """A rank file, read by Spark from wherever its path points."""
    return byte_ranks(r.value.encode() for r in spark.read.text(path).toLocalIterator())


def add_counts(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``docs`` with columns ``n_words, n_tokens, n_unknown`` (longer names where these exist)."""
    name = fresh(docs, "counts")
    counted = counts(docs, tokens, name)
    return counted.select(*docs.columns, *[F.col(f"{name}.{c}").alias(fresh(docs, c)) for c in ("n_words", "n_tokens", "n_unknown")])
