"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation many times: after each turn it is written again, longer.
Every conversation gets a rolling hash over its turns, so that each of its beginnings has a
hash. A conversation whose whole hash is that of a beginning of another one is a snapshot of
it; an anti-join leaves the conversations that nothing continues, and those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingestctl.scratch import materialise

#: How a turn is written.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _digests(role: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a turn."""
    return F.xxhash64(role, F.lit("first"), text), F.xxhash64(F.lit("second"), text, F.lit("of"), role)


def _turns(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    role = F.coalesce(F.col(role_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    first, second = _digests(role, text)
    return conversations.select(
        F.col(id_column).alias("conv_id"),
        F.struct(F.isnotnull(turn_column), F.col(turn_column).alias("turn"), first.alias("first"), second.alias("second")).alias("at"),
        role.alias("role"),
        text.alias("text"),
    )


def beginnings(turns: DataFrame) -> DataFrame:
    """One row per conversation and length: conv_id, n_turns, length and the rolling hash (first, second) of so many turns.

    Each turn's hash is mixed with its place, and the mixed ones are combined turn by turn. Turns
    without a conversation id need no window: each is a conversation of its own.
    """
    ordered = Window.partitionBy("conv_id").orderBy("at")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named, alone = turns.where("conv_id IS NOT NULL"), turns.where("conv_id IS NULL")
    placed = named.select("conv_id", "at").distinct().withColumn("length", F.row_number().over(ordered))
    rolling = placed.select(
        "conv_id",
        "length",
        F.bit_xor(F.xxhash64("at.first", "length")).over(so_far).alias("first"),
        F.bit_xor(F.xxhash64("length", "at.second")).over(so_far).alias("second"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    single = alone.select("conv_id", F.lit(1).alias("length"), *_hash_of_one_turn(), F.lit(1).cast("long").alias("n_turns"))
    return rolling.unionByName(single)


def _hash_of_one_turn() -> tuple[Column, Column]:
    """The rolling hash of a conversation of one turn."""
    place = F.lit(1)
    return F.xxhash64("at.first", place).alias("first"), F.xxhash64(place, "at.second").alias("second")


def collapse(turns: DataFrame) -> DataFrame:
    """The conversations that no other one continues: conv_id (smallest of the same ones), n_turns, copies, first, second."""
    every = materialise(beginnings(turns), "beginnings")
    key = ["length", "first", "second"]
    whole = every.where("length = n_turns").groupBy(key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    continued = every.where("length < n_turns").select(key).distinct()
    return whole.join(continued, key, "leftanti").select(
        "conv_id", F.col("length").alias("n_turns"), "copies", "first", "second"
    )


def format_chats(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, text (all turns as rendered).

    Turns are in ascending order of ``turn``, null first, and by a hash of their content among
    equals. A turn that is repeated with the same number and content counts once. Null roles and
    texts count as empty. Each row without a conversation id is a conversation of one turn, whose
    id is null. Conversations with the same turns are one, with the smallest id; ``copies`` says how
    many there were. Other columns are ignored; an empty table gives an empty result.
    """
    turns = _turns(conversations, id_column, turn_column, role_column, text_column)
    maximal = materialise(collapse(turns).withColumnRenamed("conv_id", "kept_id"), "maximal")

    def rendered(role: Column, text: Column) -> Column:
        return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE))

    in_order = F.array_sort(F.collect_set(F.struct("at", "role", "text")))
    named = (
        turns.join(maximal.drop("first", "second"), F.col("conv_id") == F.col("kept_id"))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_join(F.transform(in_order, lambda t: rendered(t["role"], t["text"])), "").alias("text"))
    )
    alone = (
        turns.where("conv_id IS NULL")
        .select("conv_id", *_hash_of_one_turn(), rendered(F.col("role"), F.col("text")).alias("text"))
        .join(maximal.where("kept_id IS NULL").drop("kept_id"), ["first", "second"])
        .groupBy("first", "second", "conv_id", "n_turns", "copies")
        .agg(F.min("text").alias("text"))
    )
    return named.unionByName(alone.drop("first", "second"))


#: The same rows in DuckDB's SQL, by comparing lists of turns.
SQL = """
WITH chats AS (
    SELECT conv_id, count(*) AS n_turns,
           list(struct_pack(role := role, text := text) ORDER BY turn) AS turns,
           string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    UNION ALL
    SELECT conv_id, 1, [struct_pack(role := role, text := text)],
           '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
    FROM conversations WHERE conv_id IS NULL
), whole AS (
    SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, turns, min(text) AS text
    FROM chats GROUP BY n_turns, turns
), continued AS (
    SELECT DISTINCT list_slice(turns, 1, length) AS turns
    FROM (SELECT turns, unnest(range(1, n_turns)) AS length FROM chats)
)
SELECT conv_id, n_turns, copies, text FROM whole
WHERE turns NOT IN (SELECT turns FROM continued)
"""
