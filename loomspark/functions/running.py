"""Running sums and maxima, and neighbours in order, without one task for each whole partition.

Rows are dealt by (partition, chunk), where chunks follow the order. A chunk's own rows are scanned by a window; what
came before the chunk is a running total over one row for each chunk, which is joined back. A contig or a whole table
in order is thus spread over as many tasks as it has chunks. The rows are written once, as the totals and the scan both
read them, so what they come from is computed once and the scan exchanges them once.

Rows whose order value is null come before all others; no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.scratch import written

_KINDS = {"sum": F.sum, "max": F.max}


def _joined(rows: DataFrame, firsts: DataFrame, part: Sequence[str]) -> DataFrame:
    """rows with what firsts (part, _chunk, ...) says of their chunk."""
    there = firsts.withColumnsRenamed({p: f"_p_{p}" for p in part} | {"_chunk": "_c"})
    same = F.col("_chunk").eqNullSafe(F.col("_c"))
    for p in part:
        same &= F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    return rows.join(there, same)


def running(df: DataFrame, part: Sequence[str], chunk: Column, order: Sequence[Column | str], values: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """df with, for each name, the sum or max of a value over the rows of its partition up to it (or before it)."""
    rows = written(df.select("*", chunk.alias("_chunk"), *[v.alias(f"_v_{n}") for n, (_, v) in values.items()]), "running")
    totals = rows.groupBy(*part, "_chunk").agg(*[_KINDS[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*part, "_chunk", *[_KINDS[k](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (k, _) in values.items()])
    within = Window.partitionBy(*part, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    scanned = rows.withColumns({f"_w_{n}": _KINDS[k](f"_v_{n}").over(within) for n, (k, _) in values.items()})
    out = {}
    for n, (k, _) in values.items():
        w, b = F.col(f"_w_{n}"), F.col(f"_b_{n}")
        out[n] = F.coalesce(w, F.lit(0)) + F.coalesce(b, F.lit(0)) if k == "sum" else F.greatest(w, b)
    return _joined(scanned, firsts, part).withColumns(out).select(*df.columns, *values)


def neighbour(df: DataFrame, part: Sequence[str], chunk: Column, order: Sequence[str], value: str, name: str, following: bool = False) -> DataFrame:
    """df with the value of the row before (or after) each row in its partition; null at the end."""
    shift, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    rows = written(df.select("*", chunk.alias("_chunk")), "neighbour")
    edges = rows.groupBy(*part, "_chunk").agg(edge(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_edge"))
    firsts = edges.select(*part, "_chunk", shift("_edge").over(Window.partitionBy(*part).orderBy("_chunk")).alias("_beyond"))
    near = shift(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*part, "_chunk").orderBy(*order))
    joined = _joined(rows.withColumn("_near", near), firsts, part)
    return joined.withColumn(name, F.coalesce("_near", "_beyond")["v"]).select(*df.columns, name)
