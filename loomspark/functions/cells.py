"""Typed views of text cells: a cell is a finite number or a string; unlike types never compare as true."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_number(cell: Column) -> Column:
    """The cell's value if it is written as a finite number, else null."""
    value = F.when(cell.rlike(NUMBER), cell.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def compared(a: Column, op: str, b: Column) -> Column:
    """a op b (one of == != < <= > >=) for text cells: numbers by value, strings by bytes, unlike types never."""
    x, y = as_number(a), as_number(b)

    def apply(p: Column, q: Column) -> Column:
        return {"==": p == q, "!=": p != q, "<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]

    both, neither = x.isNotNull() & y.isNotNull(), x.isNull() & y.isNull()
    return F.when(both, apply(x, y)).when(neither, F.coalesce(apply(a, b), F.lit(False))).otherwise(F.lit(False))


def is_in(cell: Column, values: Sequence[Column]) -> Column:
    """Whether the cell equals one of the values, by the rules of `==`."""
    out = F.lit(False)
    for v in values:
        out = out | compared(cell, "==", v)
    return out


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """a op b (one of + - * / %) for text cells. A cell that isn't a number, a division by zero and a result that isn't
    finite are errors, for null cells too."""
    x, y = as_number(a.cast("string")), as_number(b.cast("string"))
    fail = lambda why, cell: F.raise_error(F.concat(F.lit(f"{op}: {why}: "), F.coalesce(cell.cast("string"), F.lit("null")))).cast("double")
    x, y = F.coalesce(x, fail("not a number", a)), F.coalesce(y, fail("not a number", b))
    if op in "/%":
        y = F.when(y != 0, y).otherwise(fail("division by zero", b))
    value = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op]()
    return F.when(F.abs(value) < float("inf"), value).otherwise(fail("not finite", b))


def natural_key(cell: Column) -> Column:
    """A list that sorts as the cell does with its runs of digits, however long, taken as numbers."""
    parts = F.regexp_extract_all(cell, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(part: Column, i: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=.)", "")
        last = i == F.size(parts) - 1
        text = F.when(last, part).otherwise(F.concat(part, F.lit("0")))  # what follows a text is a digit
        is_number = part.rlike("^[0-9]")
        return F.struct(F.when(is_number, "0").otherwise(text).alias("text"), F.when(is_number, F.length(number)).otherwise(0).alias("n"), F.when(is_number, number).otherwise("").alias("digits"))

    return F.transform(parts, key)
