"""Related documents: same copy key, similar summary, or touched together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, jaccard, lineage_group_key, once, summary_tokens
from ..session import cut_lineage, written
from .bundles import bundle_paths
from .groups import top_per_group
from .similarity import first_rows, jaccard_pairs

BUNDLE_SCORE = 0.55


def _order(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}score").desc(), F.lower(f"{prefix}peer"), F.col(f"{prefix}peer")]


def related_docs(
    files: DataFrame, bundles: DataFrame | None = None, max_n: int = 5, min_jaccard: float = 0.28
) -> DataFrame:
    """``path, peer, score, rank``: the best ``max_n`` peers of every file.

    A peer scores 1 for the same copy key plus its summary overlap where that reaches
    ``min_jaccard``; sharing a bundle counts as at least 0.55. Order: score, then path.

    Files with the same key and the same words have the same peers and scores, up to leaving out
    themselves. So the best ``max_n + 1`` peers are found once per such class, and of any set of
    equally good peers only the first ``max_n + 1`` paths can matter.
    """
    n = max(0, max_n)
    take = n + 1
    rows = files.select(
        "path",
        lineage_group_key(basename("path")).alias("group_key"),
        summary_tokens("summary").alias("tokens"),
    ).withColumn("words", F.sha2(F.to_json(F.struct("tokens")), 256))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    sets = first_rows(rows.filter(F.size("tokens") > 0), "words").select(F.col("row").alias("id"), F.col("tokens").alias("items"))
    # From here on a word set goes by the number of its first row.
    slim = rows.select("path", "group_key", F.col("words").alias("told"), "row")
    rows = cut_lineage(slim.join(slim.groupBy("told").agg(F.min("row").alias("words")), "told").select("path", "group_key", "words"))
    classes = rows.select("words", "group_key").distinct()
    by_path = [F.lower("path"), F.col("path")]

    way = lambda a, b: F.struct(F.col(f"{a}_id").alias("words"), F.col(f"{b}_id").alias("peer_words"), "jaccard")
    near = cut_lineage(
        jaccard_pairs(sets, min_jaccard, row="id").select(F.inline(F.array(way("a", "b"), way("b", "a"))))
        .unionByName(sets.select(F.col("id").alias("words"), F.col("id").alias("peer_words"), F.lit(1.0).alias("jaccard")))
        .filter(F.col("jaccard") >= F.lit(float(min_jaccard)))
    )
    first_of_words = top_per_group(rows, ["words"], by_path, take).select(
        F.col("words").alias("peer_words"), F.col("group_key").alias("peer_key"), F.col("path").alias("peer")
    )
    first_of_class = top_per_group(rows, ["words", "group_key"], by_path, take).select(
        F.col("words").alias("peer_words"), "group_key", F.col("path").alias("peer")
    )
    first_of_key = top_per_group(rows, ["group_key"], by_path, take).select("group_key", F.col("path").alias("peer"))
    # Peers by words first per word set: which of them share the key is settled per class.
    word_peers = top_per_group(
        near.join(first_of_words, "peer_words").withColumn("score", F.col("jaccard")), ["words"], _order(), take
    ).select("words", "peer", "peer_key", "jaccard")
    same_key = F.when(F.col("group_key") == F.col("peer_key"), F.lit(1.0)).otherwise(F.lit(0.0))
    by_words = classes.join(word_peers, "words").select("words", "group_key", "peer", (same_key + F.col("jaccard")).alias("score"))
    by_both = (
        classes.join(near, "words")
        .join(first_of_class, ["peer_words", "group_key"])
        .select("words", "group_key", "peer", (F.lit(1.0) + F.col("jaccard")).alias("score"))
    )
    by_key = classes.join(first_of_key, "group_key").select("words", "group_key", "peer", F.lit(1.0).alias("score"))
    scored = by_words.unionByName(by_both).unionByName(by_key).groupBy("words", "group_key", "peer").agg(
        F.max("score").alias("score")
    )
    best = top_per_group(scored, ["words", "group_key"], _order(), take)
    lists = best.groupBy("words", "group_key").agg(F.collect_list(F.struct("peer", "score")).alias("peers"))
    found = rows.join(lists, ["words", "group_key"]).select("path", F.explode("peers").alias("p")).select(
        "path", "p.peer", "p.score"
    )
    if bundles is not None:
        found = found.unionByName(_bundle_peers(files, bundles, take))
    ranked = (
        found.filter(F.col("path") != F.col("peer")).groupBy("path", "peer").agg(F.max("score").alias("score"))
    )
    return top_per_group(ranked, ["path"], _order(), n, "rank")


def _bundle_peers(files: DataFrame, bundles: DataFrame, take: int) -> DataFrame:
    """Tracked files of each bundle with its first tracked paths; a bundle never meets itself in full."""
    tracked = bundle_paths(bundles).distinct().join(files.select("path"), "path", "left_semi")
    first = top_per_group(tracked, ["bundle_id"], [F.lower("path"), F.col("path")], take).select(
        "bundle_id", F.col("path").alias("peer")
    )
    return tracked.join(first, "bundle_id").select("path", "peer", F.lit(BUNDLE_SCORE).alias("score")).distinct()


def related_to(
    files: DataFrame,
    path: str,
    bundles: DataFrame | None = None,
    max_n: int = 5,
    min_jaccard: float = 0.28,
) -> DataFrame:
    """``peer, score`` for one file: one scan, the anchor's key and words as literals."""
    anchor = (
        files.filter(F.col("path") == path)
        .select(lineage_group_key(basename("path")).alias("k"), summary_tokens("summary").alias("t"))
        .limit(1)
        .collect()
    )
    if not anchor:
        return files.limit(0).select(F.col("path").alias("peer"), F.lit(0.0).alias("score"))
    words = F.array(*[F.lit(t) for t in anchor[0].t]).cast("array<string>")
    overlap = once(summary_tokens("summary"), lambda tokens: jaccard(words, tokens))
    score = F.when(lineage_group_key(basename("path")) == anchor[0].k, 1.0).otherwise(0.0) + once(
        overlap, lambda share: F.when(share >= min_jaccard, share).otherwise(0.0)
    )
    # As a generated column: a filter on a computed one would take the words of each text a second time.
    scored = files.filter(F.lower("path") != path.lower()).select(F.col("path").alias("peer"), F.explode(F.array(score)).alias("score"))
    if bundles is not None:
        mine = bundle_paths(bundles).filter(F.lower("path") == path.lower()).select("bundle_id").distinct()
        peers = bundle_paths(bundles).join(mine, "bundle_id", "left_semi").select(F.col("path").alias("peer")).distinct()
        scored = scored.join(peers.withColumn("together", F.lit(True)), "peer", "left").select(
            "peer", F.when(F.col("together"), F.greatest("score", F.lit(BUNDLE_SCORE))).otherwise(F.col("score")).alias("score")
        )
    return scored.filter(F.col("score") > 0).orderBy(*_order()).limit(max(0, max_n))
