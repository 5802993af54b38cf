"""Relational operators over tables: selection, typed sorts, joins, grouped reducers, pivots and reshaping.

Order is part of a table's contract, so operators that depend on it take the name of an order column. Nothing is
sorted but at the end, by whoever writes the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.cells import as_number, natural_key
from loomspark.functions.running import neighbour, running
from loomspark.scratch import written


def fields(columns: Sequence[str], selectors: Sequence[str]) -> list[str]:
    """Columns named by selectors: a name, a position from 1, a range `2-4` or `3-`, a pattern with `*`, or `-` and
    one of these to leave columns out. Unknown names are errors."""
    chosen, dropped = [], set()
    for s in selectors:
        out, what = s.startswith("-") and len(s) > 1, s[1:] if s.startswith("-") and len(s) > 1 else s
        if what in columns:
            found = [what]
        elif m := re.fullmatch(r"(\d+)(-(\d*))?", what):
            first = int(m[1])
            last = int(m[3]) if m[3] else (len(columns) if m[2] else first)
            if not 1 <= first <= last <= len(columns):
                raise ValueError(f"no columns {what}")
            found = list(columns[first - 1 : last])
        elif "*" in what:
            found = [c for c in columns if re.fullmatch(re.escape(what).replace(r"\*", ".*"), c)]
        else:
            raise ValueError(f"no column {what}")
        if out:
            dropped |= set(found)
        else:
            chosen += found
    return [c for c in (chosen or columns) if c not in dropped]


def select(df: DataFrame, *selectors: str) -> DataFrame:
    """The columns that the selectors name, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in fields(df.columns, selectors)])


def sort_keys(keys: Sequence[tuple[str, str, bool]], order: str) -> list[Column]:
    """Sort columns for keys (column, mode, descending); ties by the order column. Modes: bytes, nocase, number
    (others last) and natural."""
    out = []
    for name, mode, down in keys:
        cell = F.col(name)
        if mode == "number":
            value = as_number(cell.cast("string"))
            out += [value.isNull().asc(), value.desc() if down else value.asc()]
            continue
        key = {"bytes": cell, "nocase": F.lower(cell), "natural": natural_key(cell)}[mode]
        out.append(key.desc() if down else key.asc())
    return [*out, F.col(order).asc()]


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", fill: str | None = None, nocase: bool = False, null_matches: bool = True) -> DataFrame:
    """Equi-join on columns of the same names; a right-only row's keys take the left's place. Other names must differ."""
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    key = (lambda c: F.lower(c)) if nocase else (lambda c: c)
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for c in on:
        a, b = key(F.col(c)), key(F.col(f"_r_{c}"))
        same &= a.eqNullSafe(b) if null_matches else a == b
    both = left.join(r, same, how)
    out = both.select(*[F.coalesce(c, f"_r_{c}").alias(c) if c in on else F.col(c) for c in left.columns], *[c for c in right.columns if c not in on])
    return out.na.fill(fill) if fill is not None else out


def _moment_skew(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def _moment_kurt(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _geometric_mean(x: Column) -> Column:
    """Null if a number is negative, else 0 if one is zero."""
    logs = F.exp(F.avg(F.when(x > 0, F.log(x))))
    return F.when(F.count_if(x < 0) > 0, F.lit(None)).when(F.count_if(x == 0) > 0, 0.0).otherwise(logs)


def _harmonic_mean(x: Column) -> Column:
    """0 if a number is zero; null if the reciprocals add up to zero."""
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(F.try_divide(F.count(x), F.sum(F.when(x != 0, 1 / x))))


def _percentile(p: float) -> Callable[[Column], Column]:
    return lambda x: F.percentile(x, p)


REDUCERS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "absmin": lambda x: F.min(F.abs(x)),
    "absmax": lambda x: F.max(F.abs(x)),
    "range": lambda x: F.max(x) - F.min(x),
    "geomean": _geometric_mean,
    "harmmean": _harmonic_mean,
    "pvar": F.var_pop,
    "svar": F.var_samp,
    "pstdev": F.stddev_pop,
    "sstdev": F.stddev_samp,
    "pskew": F.skewness,
    "sskew": _moment_skew,
    "pkurt": F.kurtosis,
    "skurt": _moment_kurt,
    "median": _percentile(0.5),
    "q1": _percentile(0.25),
    "q3": _percentile(0.75),
    "iqr": lambda x: F.percentile(x, 0.75) - F.percentile(x, 0.25),
    "rms": lambda x: F.sqrt(F.avg(x * x)),
    "ms": lambda x: F.avg(x * x),
    "countunique": F.count_distinct,
    "unique": lambda x: F.array_join(F.sort_array(F.collect_set(x.cast("string"))), ","),
    "jarque": lambda x: F.count(x) / 6 * (F.skewness(x) ** 2 + F.kurtosis(x) ** 2 / 4),
}


def reducer(op: str, column: str, order: str | None = None) -> Column:
    """The named reducer of a column; `perc:N` is the N-th percentile; first, last and collapse need an order."""
    x = F.col(column)
    if op.startswith("perc:"):
        return F.percentile(x, float(op[5:]) / 100)
    if op in ("first", "last"):
        return (F.min_by if op == "first" else F.max_by)(x, F.col(order))
    if op == "collapse":
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), x.cast("string").alias("x")))), lambda s: s["x"]), ",")
    return REDUCERS[op](x)


def group_by(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str, str]], order: str | None = None) -> DataFrame:
    """Reducers (column, op, alias) of each group; no keys make one group."""
    return df.groupBy(*keys).agg(*[reducer(op, c, order).alias(a) for c, op, a in specs])


def median_deviation(df: DataFrame, keys: Sequence[str], column: str, scale: float = 1.0) -> DataFrame:
    """`mad` of each group: the median distance from the median, times scale (1.4826 for the normal's sd)."""
    mid = df.groupBy(*keys).agg(F.percentile(column, 0.5).alias("_mid"))
    off = df.join(mid, list(keys)) if keys else df.crossJoin(mid)  # without keys the median is one row
    return off.groupBy(*keys).agg((F.percentile(F.abs(F.col(column) - F.col("_mid")), 0.5) * scale).alias("mad"))


def numbered(df: DataFrame, keys: Sequence[Column], name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row in the order of keys, which should leave no ties. Rows are sorted by
    range and numbered in their partitions; the partitions' first places are running sums over one row for each."""
    at = written(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return at.withColumn("_part", part).join(firsts, "_part").select(*df.columns, (F.col("_first") + F.col("_at") - F.shiftleft("_part", 33)).alias(name))


def reverse(df: DataFrame, order: str) -> DataFrame:
    """The rows from the last to the first."""
    return df.orderBy(F.col(order).desc())


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows."""
    return df.orderBy(order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows by the order of their keys' hashes: the same ones however the table is dealt out."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def split(df: DataFrame, path: str, *keys: str) -> None:
    """The table as one folder for each value of the keys; a value's rows may be in several files."""
    df.write.partitionBy(*keys).csv(path, header=True)


def validate(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """One row: how many rows, distinct keys, rows whose key others have too, and rows that lack a required cell."""
    lacking = F.lit(False)
    for c in required:
        lacking |= F.col(c).isNull() | (F.col(c).cast("string") == "")
    of = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(lacking).alias("lacking"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return of.agg(some("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), some(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeated"), some("lacking").alias("n_lacking"))


def by_frequency(df: DataFrame, keys: Sequence[str], value: str, ascending: bool = False) -> DataFrame:
    """`frequencies` of each group: its values as `value:count`, most frequent first (or last), then by value. Values are
    counted before a group is gathered, so a group is as long as it has distinct values."""
    counts = df.groupBy(*keys, F.col(value).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    item = F.struct((F.col("_n") if ascending else -F.col("_n")).alias("k"), F.col("_v").alias("v"), F.concat_ws(":", "_v", F.col("_n").cast("string")).alias("s"))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), ",").alias("frequencies"))


def distinct_numbers(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """`numbers` of each group: its distinct numbers in order."""
    once = df.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL").distinct()
    return once.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_v"), not descending).cast("array<string>"), ",").alias("numbers"))


def modes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`mode` and `antimode` of each group: its most and its least frequent value, of equals the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), "_v"))["_v"].alias("mode"), F.min(F.struct("_n", "_v"))["_v"].alias("antimode"))


def group_runs(df: DataFrame, keys: Sequence[str], order: str, specs: Sequence[tuple[str, str, str]], chunk_rows: int = 100_000, once: bool = False) -> DataFrame:
    """Reducers of each run of rows in order with the same keys: `run` numbers the runs from 0.

    order holds whole numbers; chunks of chunk_rows numbers are scanned apart, and rows without one come first. With
    `once`, keys that come back in a later run are an error.
    """
    chunk = F.floor(F.col(order) / chunk_rows)
    packed = df.withColumn("_key", F.struct(*keys))
    before = neighbour(packed, [], chunk, [order], "_key", "_before")
    change = F.when(F.col("_before").isNull() | ~F.col("_key").eqNullSafe(F.col("_before")), 1).otherwise(0)
    runs = running(before, [], chunk, [order], {"_run": ("sum", change)}).withColumn("run", (F.col("_run") - 1).cast("long"))
    out = runs.groupBy("run", *keys).agg(*[reducer(op, c, order).alias(a) for c, op, a in specs])
    if once:
        out = written(out, "runs")
        back = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        if back:
            raise ValueError(f"a key comes back in a later run: {back}")
    return out


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, cell: Column, filler: str = "N/A") -> DataFrame:
    """A pivot with the given column values, in byte order; cells without rows hold the filler."""
    wide = df.groupBy(row).pivot(column, sorted(values)).agg(cell)
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`").cast("string"), F.lit(filler)).alias(str(v)) for v in sorted(values)])


def concat(*tables: DataFrame) -> DataFrame:
    """Rows of tables with the same columns, in the same order of columns."""
    first, *rest = tables
    for t in rest:
        if t.columns != first.columns:
            raise ValueError(f"columns differ: {first.columns} and {t.columns}")
        first = first.unionAll(t)
    return first


def uniq(df: DataFrame, keys: Sequence[str], order: str, n: int = 1) -> DataFrame:
    """The first n rows of each key, by order. One row is kept by aggregation, so hot keys shrink before the shuffle."""
    if n == 1:
        first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
        return first.select("_row.*")
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.where(F.col("_n") <= n).drop("_n")


def freq(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))


def hash_order(seed: int, *keys: str) -> Column:
    """A reproducible random order that doesn't depend on how rows are dealt out."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """The rows whose key's hash is below the fraction: the same ones however the table is dealt out."""
    low = F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("long")
    return df.where(low < int(fraction * (1 << 32)))


def gather(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def spread(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value))


def fold(df: DataFrame, keys: Sequence[str], value: str, order: str, sep: str = ";") -> DataFrame:
    """The values of each key in one cell, in order."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("x"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["x"]), sep).alias(value))


def unfold(df: DataFrame, value: str, sep: str = ";") -> DataFrame:
    return df.withColumn(value, F.explode(F.split(value, re.escape(sep))))


def expand(df: DataFrame, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """List cells side by side, one row for each place; lists of unlike lengths are errors."""
    lists = [F.split(F.col(c), re.escape(sep)) for c in columns]
    alike = F.lit(True)
    for x in lists[1:]:
        alike &= F.size(x) == F.size(lists[0])
    zipped = F.when(alike, F.arrays_zip(*[x.alias(c) for x, c in zip(lists, columns)])).otherwise(F.raise_error(F.lit("lists of unlike lengths")))
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(zipped).alias("_z")).select(*others, *[F.col("_z")[c].alias(c) for c in columns])


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    parts = F.split(F.col(column), re.escape(sep), len(into))
    return df.select("*", *[F.get(parts, i).alias(n) for i, n in enumerate(into)])
