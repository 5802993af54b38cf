"""What operators do to large tables, seen on small ones: plans, rows written and shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import alignments as A
from loomspark.operators import intervals as I
from loomspark.operators import nearest
from loomspark.operators import normalize as N
from loomspark.operators import reference as R
from loomspark.operators import trees as T


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alleles_are_compared_once(spark):
    pieces = spark.createDataFrame([("c", 0, "ACGTTTTTTTACGAC")], "chrom string, at long, piece string")
    rows = spark.createDataFrame([("c", 9, "TT", "T", 1), ("c", 2, "C", "G", 2)], "chrom string, pos long, ref string, alt string, ord long")
    out = N.left_aligned(rows, R.tiles(pieces))
    assert "aggregate(" not in optimized(out)  # the search for what alleles share, once for each place of its result
    assert sorted((r.ord, r.pos, r.ref, r.alt) for r in out.collect()) == [(1, 3, "GT", "G"), (2, 2, "C", "G")]


def test_pd_writes_no_row_for_each_branch_above_a_sample(spark, monkeypatch):
    """200 tips on a tree as deep, 30 samples of 4: a sample touches most branches, 4 rows of it are enough."""
    deep, found = 200, []
    nodes = [(0, None, None, None)] + [(-i, -i + 1 if i > 1 else 0, None, 0.5) for i in range(1, deep + 1)] + [(i, -i, str(i), 1.0) for i in range(1, deep + 1)]
    counts = [(str((s * 37 + j * 61) % deep + 1), s, 1) for s in range(30) for j in range(4)]
    write = T.written
    monkeypatch.setattr(T, "written", lambda df, label: [out := write(df, label), found.append(out.count())][0])
    got = {r["sample"]: r.pd for r in T.faith_pd(spark.createDataFrame(counts, "feature string, sample long, x long"), spark.createDataFrame(nodes, "node long, parent long, label string, length double")).collect()}
    want = {}
    for s in range(30):
        tips = {int(f) for f, sample, _ in counts if sample == s}
        want[s] = len(tips) + 0.5 * max(tips)
    assert got == want and max(found) < 8 * (2 * deep + 1)  # the ranges are eight levels of the tips


ROWS = "chrom string, start long, end long, ord long"


def some_rows(seed, n):
    rnd = random.Random(seed)
    rows = [("c%d" % rnd.randrange(2), s := rnd.randrange(5_000), s + rnd.choice([0, 0, 1, 40, 700, 90_000]), i) for i in range(n)]
    return [*rows, *[("c0", 512 * i, 512 * i + d, n + 2 * i + (d > 0)) for i in range(3) for d in (0, 512)], ("c0", None, 5, 900), ("c0", 5, None, 901), (None, 1, 9, 902), ("c9", 1, 3, 903)]


def pairs_of(a, b):
    full = lambda rows: [r for r in rows if None not in r]
    return [(x, y) for x in full(a) for y in full(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]


def test_counted_overlaps(spark):
    a, files = some_rows(1, 200), {"one": some_rows(2, 150), "two": some_rows(3, 40), "none": []}
    frames = {n: spark.createDataFrame(rows, ROWS) for n, rows in files.items()}
    got = {r.ord: r for r in I.counted(spark.createDataFrame(a, ROWS), frames, covered=True).collect()}
    for n, rows in files.items():
        found = pairs_of(a, rows)
        for x in a:
            assert (got[x[3]][f"n_{n}"] if x[3] in got else 0) == sum(p[0] is x for p in found)
            over = {i for p in found if p[0] is x for i in range(max(x[1], p[1][1]), min(x[2], p[1][2]))}
            assert (got[x[3]][f"bases_{n}"] if x[3] in got else 0) == len(over)


def test_all_overlaps(spark):
    a, b = some_rows(4, 120), some_rows(5, 90)
    got = sorted(((r.a_ord, r.b_ord, r.shared) for r in I.all_overlaps(*(spark.createDataFrame(x, ROWS) for x in (a, b))).collect()), key=str)
    found = pairs_of(a, b)
    want = [(x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x, y in found] + [(x[3], None, 0) for x in a if not any(p[0] is x for p in found)]
    assert got == sorted(want, key=str)


def crowd(spark, n=300, at=1000):
    """As many rows that all overlap each other."""
    return spark.createDataFrame([("c", at + i % 7, at + 50, i) for i in range(n)], ROWS)


def exchanged(df):
    """The most rows that a shuffle of the final plan writes, and that a table of it holds."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        plan = nodes.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(plan.plan())
        if name == "ShuffleExchangeExec":
            most = max(most, plan.metrics().apply("shuffleRecordsWritten").value())
        nodes += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_pairs_of_a_crowd_are_not_exchanged(spark):
    a, genome = crowd(spark), spark.createDataFrame([("c", 9000)], "chrom string, size long")
    assert exchanged(I.all_overlaps(a, a)) < 3000


def test_crowds_are_counted_without_pairs(spark, monkeypatch):
    a, genome = crowd(spark), spark.createDataFrame([("c", 9000)], "chrom string, size long")
    monkeypatch.setattr(I, "overlaps", None)
    assert I.overlap_table(a, a, genome).first().n_both == 300 * 300
    assert {r.n for r in I.coverage(a, a).collect()} == {300}
    assert {(r.x_n, r.x_fraction) for r in I.annotate(a, {"x": a}).collect()} == {(300, 1.0)}


def test_contacts_copy_no_table_to_the_driver(spark):
    grid = spark.range(150).selectExpr("id", "cast(id * 7 % 19 AS DOUBLE) AS x", "cast(id * 5 % 13 AS DOUBLE) - 6 AS y", "id / 20.0D AS z")
    rows = [tuple(r) for r in grid.collect()]
    found = A.contacts(grid, 4.0)  # Spark knows that the table is small
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b): r.distance for r in found.collect()}
    apart = {(p[0], q[0]): math.dist(p[1:], q[1:]) for p in rows for q in rows if p[0] < q[0]}
    assert got == pytest.approx({k: d for k, d in apart.items() if d <= 4.0}) and found.count() == len(got)


def test_nearest_of_a_crowd_exchanges_no_pairs(spark, monkeypatch):
    a, found = crowd(spark), []
    monkeypatch.setattr(nearest, "written", lambda df, label, write=nearest.written: [out := write(df, label), found.append(out.count())][0])
    monkeypatch.setattr(I, "written", lambda df, label, write=I.written: [out := write(df, label), found.append(out.count())][0])
    strand = a.withColumn("strand", F.lit("+"))
    assert exchanged(nearest.nearest(strand, strand, 3)) < 3000 and exchanged(I.closest(a, a)) < 3000
    apart = strand.withColumns({"start": F.col("start") + 500, "end": F.col("end") + 500})
    got = nearest.nearest(apart, strand, 2, "first", False, oriented="a", downstream=False)
    assert exchanged(got) < 3000 and max(found) < 3000
    assert {r.a_ord: 2 for r in got.collect()} == {i: 2 for i in range(300)} and sorted({r.b_ord for r in got.collect()}) == [0, 1]


def test_values_of_a_crowd_are_not_exchanged(spark):
    a = crowd(spark)
    b = a.withColumn("score", F.when(F.col("ord") % 5 > 0, F.col("ord") % 70))
    got = I.map_values(a, b, {"n": F.count(F.lit(1))}, {"kinds": "score"})
    assert exchanged(got) < 3000 and {(r.n, r.kinds) for r in got.collect()} == {(300, 56)}
    wide = I.map_values(a, a.withColumn("score", F.col("ord") * 7), {}, {"kinds": "score"})
    assert {r.kinds for r in wide.collect()} == {300}


def test_more_values_than_words(spark, monkeypatch):
    monkeypatch.setattr(I, "WORDS", 1)
    a = crowd(spark)
    assert {(r.n, r.kinds) for r in I.map_values(a, a, {"n": F.count(F.lit(1))}, {"kinds": "ord"}).collect()} == {(300, 300)}


def test_genes_of_a_crowd_are_not_sorted(spark):
    reads = crowd(spark).withColumns({"flag": F.lit(0), "mapq": F.lit(9)}).unionByName(spark.createDataFrame([("c", 1, 5, 900, 4, 9), ("d", 1, 5, 901, 0, 9)], ROWS + ", flag int, mapq int"))
    for genes, want in ((("g", "g"), {"g": 300}), (("g", "h"), {"__ambiguous": 300})):
        features = crowd(spark).withColumn("gene", F.when(F.col("ord") % 2 == 0, genes[0]).otherwise(genes[1]))
        got = A.assign(reads, features)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("SortAggregate" in line and "min(" in line for line in plan.split("\n"))
        assert {r.gene: r.n for r in got.collect()} == {**want, "__unmapped": 1, "__no_feature": 1}
