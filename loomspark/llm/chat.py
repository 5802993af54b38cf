"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time with the turns so far. Each conversation's turns, in order,
give a chain of hashes: the hash of a prefix is the SHA-256 of the shorter prefix's hash and the next turn's. A
conversation whose last hash is the hash of a proper prefix of another one is only a snapshot of that one. An
anti-join keeps the conversations that prefix no longer one, and these are rendered.

Both sides of the anti-join hold each hash once (the conversations by their last hash, with the smallest conv_id; the
prefixes after a distinct), so a first turn or a conversation that very many logs share is one row by then.

Defined results: turns are ordered by turn (null first), then role, then text; rows that repeat a turn altogether
count once; null roles and texts count as empty. Conversations with the same turns are copies: the smallest conv_id
stays. Conversations of one row, empty texts and empty tables are fine; a null conv_id is a conversation like others.
A rendered conversation is one string, so it must fit in a row. Markers in a text are escaped and can't open a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`"), F.lit(""))


def prefix_chains(turns: DataFrame) -> DataFrame:
    """(conv_id, hashes): for every conversation the hash of each of its prefixes, shortest first."""
    rows = turns.select("conv_id", F.struct("turn", _plain("role").alias("role"), _plain("text").alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))  # by text, not by its hash

    def digest(t: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256))

    def step(hashes: Column, t: Column) -> Column:
        return F.array_append(hashes, F.unhex(F.sha2(F.concat(F.element_at(hashes, -1), digest(t)), 256)))

    chain = F.aggregate("ts", F.array(F.lit(b"")), step)
    return ordered.select("conv_id", F.slice(chain, 2, F.size("ts")).alias("hashes"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that are no prefix of a longer one, copies once."""
    chains = written(prefix_chains(turns), "chat-chains")
    last = chains.select(F.element_at("hashes", -1).alias("hash"), F.size("hashes").alias("n_turns"), "conv_id")
    convs = last.groupBy("hash", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    longer = chains.select(F.posexplode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("at", "hash"))
    longer = longer.select("hash", (F.col("at") + 1).alias("n_turns")).distinct()
    return convs.join(longer, ["hash", "n_turns"], "left_anti").drop("hash")


def escaped(text: Column) -> Column:
    """The text with `<|` as `< |` and `|>` as `| >`."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """kept (conv_id, ...) with `rendered`: every turn as its start marker, role, text and end marker."""
    mine = kept.select("*", F.col("conv_id").alias("kept_id"))
    t = F.struct("turn", _plain("role").alias("role"), _plain("text").alias("text"))
    rows = turns.select(F.col("conv_id").alias("of"), t.alias("t"))
    rows = rows.join(mine.select("kept_id"), F.col("of").eqNullSafe(F.col("kept_id")), "left_semi")
    lines = F.transform(
        F.sort_array(F.collect_set("t")),
        lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n")),
    )
    whole = rows.groupBy("of").agg(F.array_join(lines, "").alias("rendered"))
    return mine.join(whole, F.col("of").eqNullSafe(F.col("kept_id"))).drop("of", "kept_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the maximal conversations, rendered."""
    turns = turns.select("conv_id", "turn", "role", "text")
    return render(turns, written(maximal(turns), "chat-kept"))
