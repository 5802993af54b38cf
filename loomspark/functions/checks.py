"""Conditions that rows must meet, checked whatever is read of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """df, or an error if `ok` doesn't hold (or is null) for a row. The check is a filter, so it also runs where its
    columns aren't read, as in count()."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
