"""Exact dedup by a tree-merge of sorted digest runs.

Each row becomes a digest (SHA-256 of the text without white space) with two independent witnesses of the same text,
its byte length and its XXH64. The input's partitions form runs; a run holds each digest once, with the row that
stays and the number of rows. In every round, `fan_in` neighbouring runs meet, digest by digest, and are merged into
one, which keeps the smallest of their identifiers where digest and witnesses agree. One run is left after
log(runs) rounds. A round deals its runs out by digest, so no task gets a whole run, and a digest that very many rows
share has become one row of each run before the first exchange.

Of equal texts the row with the most code points stays, then the one with the smallest doc_id (null last), then the
one read first. Defined results: null text counts as empty; empty texts are equal to each other and to texts of white
space alone; repeated rows are members of one group and one of them stays; an empty table gives an empty result;
other columns are left alone, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import text_or_empty, whole_row, written

RUNS, FAN_IN = 16, 4
KEY = ["digest", "n_bytes", "witness"]


def without_space(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _key(text: Column) -> list[Column]:
    plain = without_space(text)
    return [F.unhex(F.sha2(plain, 256)).alias("digest"), F.octet_length(plain).alias("n_bytes"), F.xxhash64(plain).alias("witness")]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each row of docs, written once: its key, id, length, place and run."""
    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.char_length(text).alias("n_chars"), *_key(text))
    rows = rows.withColumns({"place": F.monotonically_increasing_id(), "run": F.pmod(F.spark_partition_id(), F.lit(RUNS))})
    return written(rows, "exact-digests")


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """rows of digest_rows -> one row for each key: `best` (the row that stays) and `n` (how many rows)."""
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "place")
    merged = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        merged = merged.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return merged.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256. One row of each group is kept."""
    rows = digest_rows(docs, id_col, text_col)
    groups = written(merge_runs(rows), "exact-groups")  # so that both sides of the join are dealt, and hot keys split
    joined = rows.join(groups, KEY)
    return joined.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = written(merge_runs(digest_rows(docs, id_col, text_col)), "exact-groups")
    stay = groups.select(*[F.col(c).alias(f"at_{c}") for c in KEY], F.col("best.id").alias("at_id"), (-F.col("best.shorter")).alias("at_chars"))
    text = text_or_empty(f"row.`{text_col}`")
    rows = docs.select(whole_row(docs)).select("row", F.col(f"row.`{id_col}`").alias("id"), F.char_length(text).alias("n_chars"), *_key(text))
    match = F.col("id").eqNullSafe(F.col("at_id")) & (F.col("n_chars") == F.col("at_chars"))
    for c in KEY:
        match &= F.col(c) == F.col(f"at_{c}")
    # the join leaves one id of each group; only rows that repeat that id and text are still told apart
    return rows.join(stay, match, "left_semi").dropDuplicates([*KEY, "id"]).select("row.*")
