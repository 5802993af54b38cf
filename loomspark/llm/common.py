"""Helpers that the operators share: small batches, safe names and word expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.scratch import discard, written

__all__ = ["discard", "let", "small_batches", "text_or_empty", "uniform", "whole_row", "word_count", "written"]

#: ASCII white space, as the contracts state it, and its complement, for Java and Python regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of texts that go to a Python worker at a time, so that a batch is a few MB and not some tens.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that computed columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; the pattern gives nothing back, which doesn't change what it finds."""
    return F.regexp_count(c, F.lit(WORD + "+")).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)
