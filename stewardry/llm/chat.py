"""Chat formatting of logged conversations, with column functions only.

A conversation that is logged after every turn appears as many snapshots, each a prefix of the
next. A rolling hash of the turns so far names every prefix; a conversation whose own hash is a
proper prefix of a longer one is dropped by an anti-join, and of equal ones the smallest id
stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

# Turns in one stretch of the rolling hash.
STRETCH = 1024
# Turns in one rendered part: the row of a part holds its text, whatever the length of the conversation.
PART_TURNS = 1024


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their position (from 0) in the conversation.

    A conversation is cut into stretches of turn numbers; a task orders one stretch, and only
    the sizes of stretches meet per conversation.
    """
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    cut = clean.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "skip")
    local = cut.withColumn("local", F.row_number().over(inside) - 1)
    joined = local.join(sizes, local["conv_id"].eqNullSafe(sizes["c"]) & (local["stretch"] == sizes["s"]))
    return joined.select("conv_id", "role", "text", (F.col("local") + F.col("skip")).alias("at"))


def _prefixes(placed: DataFrame) -> DataFrame:
    """``conv_id, n, hash`` for every prefix: the hashes of position, role and text of its turns,
    combined by exclusive or, which adds up over stretches in any order."""
    h = F.struct(*[F.xxhash64(F.lit(k), "at", "role", "text").alias(f"h{k}") for k in (1, 2)])
    turns = placed.select("conv_id", "at", F.floor(F.col("at") / STRETCH).alias("stretch"), h.alias("h")).select("conv_id", "at", "stretch", "h.*")
    whole = turns.groupBy("conv_id", "stretch").agg(F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = whole.select(
        F.col("conv_id").alias("c"), F.col("stretch").alias("s"),
        *[F.coalesce(F.bit_xor(f"w{k}").over(before), zero).alias(f"b{k}") for k in (1, 2)],
    )
    so_far = Window.partitionBy("conv_id", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.select("conv_id", "at", "stretch", *[F.bit_xor(f"h{k}").over(so_far).alias(f"r{k}") for k in (1, 2)])
    joined = rolled.join(carried, rolled["conv_id"].eqNullSafe(carried["c"]) & (rolled["stretch"] == carried["s"]))
    return joined.select("conv_id", (F.col("at") + 1).alias("n"), *[F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n`` of the conversations that no longer one begins with, one of equal ones."""
    length = prefixes.groupBy(F.col("conv_id").alias("c")).agg(F.max("n").alias("length"))
    with_length = prefixes.join(length, prefixes["conv_id"].eqNullSafe(length["c"]))
    ends = with_length.filter("n = length").select("conv_id", "n", "h1", "h2")
    inner = with_length.filter("n < length").select("n", "h1", "h2").distinct()
    single = ends.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    return single.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "n_equal")


def _inert(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn with markers; markers inside a role or text are taken apart, and a role is one line,
    so that no turn can be forged."""
    said = F.regexp_replace(_inert(role), r"[\r\n]+", " ")
    return F.concat(F.lit("<|im_start|>"), said, F.lit("\n"), _inert(text), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, n_turns, n_equal, text``: the maximal conversations, rendered.

    ``n_turns`` is that of the conversation, ``n_equal`` how many ids logged exactly these
    turns. A conversation of more than ``part_turns`` turns is rendered in several parts, from 0
    on, so that no row grows with a conversation; its parts in order are its whole text. Repeated
    rows count once; null ``conv_id`` is a conversation of its own; turns are ordered by number
    (null first), then role and text, several of one number all count; null role and text are
    empty. Other columns are not read; an empty table gives an empty one.
    """
    placed = store(_placed(turns))
    kept = store(maximal(_prefixes(placed))).select(F.col("conv_id").alias("c"), F.col("n").alias("n_turns"), "n_equal")
    lines = placed.join(kept, placed["conv_id"].eqNullSafe(kept["c"]))
    part = F.floor(F.col("at") / part_turns)
    turn = F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("line"))
    parts = lines.groupBy("conv_id", part.alias("part"), "n_turns", "n_equal").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return parts.select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"))
