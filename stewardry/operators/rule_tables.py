"""Many rules over many texts, the rules being a table.

Every match of a rule holds one of its literals (keywords, or texts read off the pattern). Each
literal is filed under one of its grams, texts look up the grams they have, and a pattern is run
only where one of its literals was found. The plan is the same for any number of rules. Rules
without a literal are run on every text, all of them in one pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import RANK
from ..functions.literals import required_literals
from ..functions.patterns import PatternError, java_pattern
from ..functions.text import distinct_grams
from ..session import cut_lineage, shuffle_partitions
from .governance import HITS_TYPE

GRAM = 4
# So many filed grams, a number and a few bytes each, are broadcast.
SMALL = 500_000
_PREPARED = "pattern string, literals array<string>"


def _prepared(rules: DataFrame) -> DataFrame:
    """``rules(ord, id, pattern, keywords, min_level, hint)`` with Java patterns and literals; rules that
    the parser rejects, and rules without any test, are gone."""

    @F.pandas_udf(_PREPARED)
    def prepare(patterns: pd.Series, keywords: pd.Series) -> pd.DataFrame:
        out = []
        for pattern, words in zip(patterns, keywords):
            words = [w.strip().lower() for w in (words if words is not None else []) if w and w.strip()]
            java, literals = None, list(words)
            if pattern:
                try:
                    java = java_pattern(pattern)
                    found = required_literals(pattern)
                    literals = None if found is None else literals + found
                except PatternError:
                    words, literals = [], []
            # A literal below the size of a gram cannot be filed; non-ASCII ones fold in other ways.
            if literals is not None and any(len(w) < GRAM or not w.isascii() for w in literals):
                literals = None
            out.append((java, literals, words))
        return pd.DataFrame({"pattern": [o[0] for o in out], "literals": [o[1] for o in out]})

    made = prepare(F.col("pattern"), F.coalesce("keywords", F.array().cast("array<string>")))
    level = F.upper(F.trim(F.coalesce("min_level", F.lit(""))))
    rid = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.lit("rule"))
    words = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    named = rules.select(
        "ord", rid.alias("id"), F.coalesce(F.nullif(F.trim("hint"), F.lit("")), rid).alias("hint"),
        F.when(level.isin(*RANK), level).otherwise("").alias("min_level"), made.alias("made"), words.alias("keywords"), F.col("pattern").alias("stated"),
    )
    rejected = (F.coalesce("stated", F.lit("")) != "") & F.col("made.pattern").isNull()
    kept = named.filter(~rejected).select("ord", "id", "hint", "min_level", F.col("made.pattern").alias("pattern"), F.col("made.literals").alias("literals"), "keywords")
    return cut_lineage(kept.filter(F.col("pattern").isNotNull() | (F.size("keywords") > 0)))


def _test(rule: Column, text: Column, lowered: Column) -> Column:
    there = rule["literals"].isNull() | F.exists(rule["literals"], lambda w: F.contains(lowered, w))
    by_pattern = F.coalesce(F.regexp_like(text, F.concat(F.lit("(?imUd)"), rule["pattern"])), F.lit(False))
    return there & (F.exists(rule["keywords"], lambda w: F.contains(lowered, w)) | by_pattern)


def _small(filed: DataFrame) -> DataFrame:
    """With few rows, sent to every task: the grams of the texts, which are many, are then not shuffled."""
    return F.broadcast(filed) if filed.limit(SMALL + 1).count() <= SMALL else filed


def match_rule_table(texts: DataFrame, rules: DataFrame, key: str = "path") -> DataFrame:
    """``key, hits`` of the rows of ``texts(key, text)`` that rules hit; hits in the order of ``ord``.

    ``rules(ord, id, pattern, keywords, min_level, hint)`` as :class:`governance.Rule`. ``key`` is unique.
    """
    rules = _prepared(rules)
    literals = rules.filter(F.col("literals").isNotNull()).select("ord", F.explode("literals").alias("literal")).select(
        "ord", "literal", F.explode(distinct_grams("literal", GRAM)).alias("gram")
    )
    # Of a literal's grams the one that fewest literals have, so that no gram stands for many.
    load = literals.groupBy("gram").agg(F.count(F.lit(1)).alias("load"))
    least = literals.join(load, "gram").groupBy("ord", "literal").agg(F.min(F.struct("load", "gram"))["gram"].alias("gram"))
    # Every text looks up one of the grams that no text has, where the rules without literals are.
    salts = shuffle_partitions(rules.sparkSession)
    open_rules = rules.filter(F.col("literals").isNull()).select("ord", F.explode(F.array(*[F.lit(f"\0{i}") for i in range(salts)])).alias("gram"))
    filed = _small(cut_lineage(least.select("ord", "gram").unionByName(open_rules).distinct()))
    any_gram = F.concat(F.lit("\0"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("string"))
    own = F.concat(F.array(any_gram), distinct_grams(F.lower("text"), GRAM))
    wanted = texts.select(key, F.explode(own).alias("gram")).join(filed, "gram").select(key, "ord").distinct()
    rule = F.struct("ord", "id", "hint", "min_level", "pattern", "literals", "keywords")
    asked = wanted.join(rules, "ord").groupBy(key).agg(F.sort_array(F.collect_list(rule)).alias("_asked"))
    met = texts.select(key, F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("text", F.lit(""))).alias("lowered")).join(asked, key)
    hit = F.filter("_asked", lambda r: _test(r, F.col("text"), F.col("lowered")))
    shown = F.transform(hit, lambda r: F.struct(r["id"].alias("id"), r["hint"].alias("hint"), r["min_level"].alias("min_level")))
    # As a generated column: a filter on a computed one would run the patterns a second time.
    return met.select(key, F.explode(F.array(shown.cast(HITS_TYPE))).alias("hits")).filter(F.size("hits") > 0)
