"""Chat formatting with cumulative-snapshot collapse.

A logged conversation often is a snapshot of a longer one: its turns are the first turns of the other. Rolling hashes of
turn prefixes (running XORs of two hashes of place, role and text) identify conversations that prefix longer ones; equal
conversations keep their least conv_id; anti-joins leave the maximal conversations, which are rendered.

Turns are ordered by `turn`; rows that repeat in all of conv_id, turn, role and text count once, and turns that tie are
ordered by role and text. A null role counts as "unknown", a null text as empty, a null turn comes first; rows with a
null conv_id belong to no conversation and are left out. An empty table gives an empty one; other columns are left alone.
Built-in functions only; one exchange by conv_id serves the hashes. Texts travel for the maximal conversations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import durable, quoted

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    return conversations.filter(quoted(conv_col).isNotNull()).select(
        quoted(conv_col).cast("long").alias("conv_id"),
        quoted(turn_col).cast("long").alias("turn"),
        F.coalesce(quoted(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )


def prefixes(rows: DataFrame) -> DataFrame:
    """`conv_id, place, n, h1, h2`: of each conversation, each prefix's length and rolling hash, and its number of turns."""
    hashed = rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"))
    # Texts order turns that tie; without ties, which are found by hashes alone, they don't travel.
    ties = durable(hashed.groupBy("conv_id", "turn").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).filter("low <> high").select("conv_id", "turn"), "ties")
    tied = rows.join(ties, (rows.conv_id == ties.conv_id) & rows.turn.eqNullSafe(ties.turn), "left_semi").distinct()
    among = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    ranks = tied.withColumn("rank", F.row_number().over(among)).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), "rank")
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    hashed = hashed.distinct().join(ranks, same, "left").select("conv_id", "turn", "a", "b", "rank")
    own = Window.partitionBy("conv_id")
    ordered = own.orderBy(F.asc_nulls_first("turn"), "rank")
    placed = hashed.withColumn("place", F.row_number().over(ordered).cast("long"))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id",
        "place",
        F.count("*").over(own).alias("n"),
        F.bit_xor(F.xxhash64("place", "a")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64("b", "place")).over(upto).alias("h2"),
    )


def maximal(conversations: DataFrame, **columns: str) -> DataFrame:
    """`conv_id, n_turns, n_copies`: conversations that prefix no longer one, equal ones as their least conv_id."""
    all_prefixes = prefixes(turns(conversations, **columns))
    whole = all_prefixes.filter("place = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = all_prefixes.filter("place < n").select(F.col("place").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per maximal conversation: `conv_id, n_turns, n_copies, chat`."""
    kept = maximal(conversations, **columns)
    turn = F.struct("turn", "role", "text")
    rows = turns(conversations, **columns).join(kept.select("conv_id"), "conv_id", "left_semi")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit("\n" + END)))
    return kept.join(chats.select("conv_id", F.array_join(rendered, "").alias("chat")), "conv_id")
