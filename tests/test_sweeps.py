import random

import pytest

from loomspark.functions.cells import arithmetic, natural_key
from loomspark.operators import intervals as I
from loomspark.operators import table as T
from pyspark.sql import functions as F


def test_rows_without_an_order_value_are_kept(spark):
    df = spark.createDataFrame([("c", None, 5, 1), ("c", 3, 9, 2), ("c", 4, 6, 3), (None, 7, 8, 4), ("c", None, None, 5)], "chrom string, start long, end long, ord long")
    got = {r.ord: r.island for r in I.islands(df).collect()}
    assert len(got) == 5 and got[2] == got[3] and len({got[1], got[2], got[5]}) == 3
    runs = T.group_runs(df, ["chrom"], "start", [("ord", "count", "n")])
    assert sum(r.n for r in runs.collect()) == 5


def test_keys_that_come_back(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabba")], "ord long, k string")
    assert T.group_runs(df, ["k"], "ord", [("ord", "count", "n")]).count() == 3
    with pytest.raises(ValueError, match="comes back"):
        T.group_runs(df, ["k"], "ord", [("ord", "count", "n")], once=True)


@pytest.mark.parametrize("wide", [False, True])
def test_overlaps_of_any_length(spark, wide):
    rnd = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            start = rnd.randrange(60_000)
            out.append(("c%d" % (i % 2), start, start + rnd.choice([0, 1, 40, 700] + [30_000, 250_000_000] * wide), i))
        return [*out, ("c0", None, 5, 900), ("c0", 5, None, 901)]

    a, b = some(150), some(150)
    schema = "chrom string, start long, end long, ord long"
    got = sorted((r.a.ord, r.b.ord) for r in I.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    full = lambda rows: [r for r in rows if None not in r]
    want = sorted((x[3], y[3]) for x in full(a) for y in full(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_natural_order_of_long_numbers(spark):
    want = ["a", "a!", "a0", "a1b", "a02", "a10", "ab", "x2", "x" + "1" * 25]
    rows = spark.createDataFrame([(w,) for w in reversed(want)], "c string")
    assert [r.c for r in rows.orderBy(natural_key(F.col("c"))).collect()] == want


def test_arithmetic_of_cells(spark):
    df = spark.createDataFrame([("6", "4")], "a string, b string")
    got = [df.select(arithmetic(F.col("a"), op, F.col("b"))).first()[0] for op in "+-*/%"]
    assert got == [10, 2, 24, 1.5, 2]
    for op, b in (("/", "0"), ("%", "0"), ("+", "x"), ("*", None), ("*", "1e308")):
        with pytest.raises(Exception):
            df.select(arithmetic(F.lit("1e9"), op, F.lit(b).cast("string"))).collect()


def test_split_and_places(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    T.split(df, str(tmp_path / "s"), "k")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1000
    assert all(r.v == r.place for r in T.numbered(df, [F.col("v")]).collect())
    assert T.numbered(df.limit(0), [F.col("v")]).isEmpty()
