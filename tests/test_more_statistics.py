import math

import pytest

from loomspark.operators import genotypes as G
from loomspark.operators import matrix as M
from loomspark.operators import sequences as S

CELLS = "feature string, sample long, x double"


def test_ratios(spark):
    m = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 4.0), ("a", 2, 2.0), ("b", 2, 0.0), ("b", 3, 1.0)], CELLS)
    assert [(r["sample"], round(r["x"], 6)) for r in M.alr(m.where("x > 0"), "a").collect()] == [(1, round(math.log(4), 6))]
    with pytest.raises(Exception, match="positive"):
        M.alr(m, "a").collect()
    assert {(r["feature"], r["sample"]): round(r["x"], 6) for r in M.robust_clr(m).collect()}[("a", 2)] == 0.0
    assert M.robust_clr(m.limit(0)).count() == 0
    one = {r["feature"]: r["x"] for r in M.powered(m.where("sample = 1"), 0.5).collect()}
    assert one["a"] == pytest.approx(1 / 3)


def test_canberra_counts_lone_features(spark):
    m = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 4.0), ("a", 2, 3.0), ("c", 2, 5.0), ("d", 3, 1.0)], CELLS)
    assert sorted((r["a"], r["b"], r["canberra"]) for r in M.canberra(m).collect()) == [(1, 2, 2.5), (1, 3, 3.0), (2, 3, 3.0)]


def test_samples_without_counts(spark):
    m = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("a", 2, 1.0), ("b", 2, 3.0)], CELLS)
    lengths = spark.createDataFrame([("a", 0), ("b", 1000)], "feature string, length long")
    shares = {(r["feature"], r["sample"]): r["x"] for r in M.closure(m).collect()}
    assert shares == {("a", 1): None, ("b", 1): None, ("a", 2): 0.25, ("b", 2): 0.75}
    assert {r["x"] for r in M.powered(m.where("sample = 1"), 2.0).collect()} == {None}
    norm = {(r["feature"], r["sample"]): (r["cpm"], r["fpkm"], r["tpm"]) for r in M.normalized(m, lengths).collect()}
    assert norm[("b", 1)] == (None, None, None) and norm[("a", 2)] == (250000.0, None, None) and norm[("b", 2)] == (750000.0, 750000.0, 1e6)


def test_joint_spectrum_takes_complete_sites(spark):
    counts = spark.createDataFrame([(1, 10, "p", 1, 4), (1, 10, "q", 2, 4), (2, 20, "p", 1, 4), (2, 20, "q", 2, 2)], "site long, pos long, pop string, ac long, an long")
    assert [tuple(r) for r in G.joint_spectrum(counts).collect()] == [("p", "q", 1, 2, 1)]


def test_reads_are_judged(spark):
    rows = [(0, "ACGT" * 5, "I" * 20), (1, "ACGT", "IIII"), (2, "ACGT" * 5, "!" * 20), (3, "N" * 6 + "ACGT" * 4, "I" * 22), (4, "A" * 20, "I" * 20), (5, None, None), (6, "", "")]
    reads = spark.createDataFrame(rows, "id long, seq string, qual string")
    got = [r["verdict"] for r in S.judged(reads, complex_share=0.3).orderBy("id").collect()]
    assert got == ["pass", "length", "quality", "n", "complexity", "length", "length"]
    poly = spark.createDataFrame([(0, "ACGTGGGG", "IIIIIIII"), (1, "GGGG", "IIII"), (2, "ACGG", "IIII"), (3, None, None)], "id long, seq string, qual string")
    assert [(r["seq"], r["qual"]) for r in S.trim_poly(poly, "G", 3).orderBy("id").collect()] == [("ACGT", "IIII"), ("", ""), ("ACGG", "IIII"), (None, None)]
