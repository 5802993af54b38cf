"""Rows at the edge of what the operators are for: empty intervals, unknown chroms, zeros, lower case, null keys."""

import pytest

from loomspark.operators import intervals as I
from loomspark.operators import table as T
from loomspark.operators import variants as V

ROWS = "chrom string, start long, end long, ord long, strand string"


def test_empty_rows_are_annotated(spark):
    a = spark.createDataFrame([("c", 5, 5, 0, "+"), ("c", 0, 10, 1, "+")], ROWS)
    b = spark.createDataFrame([("c", 0, 5, 0, "+")], ROWS)
    got = {r["ord"]: (r["b_n"], r["b_fraction"]) for r in I.annotate(a, {"b": b}).collect()}
    assert got[1] == (1, 0.5) and got[0][1] == 0.0


def test_chroms_that_the_genome_lacks_are_errors(spark):
    a = spark.createDataFrame([("c", 5, 9, 0, "+"), ("d", 0, 10, 1, "+")], ROWS)
    genome = spark.createDataFrame([("c", 10)], "chrom string, size long")
    known = a.where("chrom = 'c'")
    assert [(r["start"], r["end"]) for r in I.slop(known, genome, 2, 3).collect()] == [(3, 10)]
    for made in (I.slop(a, genome, 1, 1), I.flank(a, genome, 1, 1), I.shift(a, genome, 1)):
        with pytest.raises(Exception, match="not in the genome: d"):
            made.count()


def test_scores_of_united_graphs_come_back_as_given(spark):
    scored = "chrom string, start long, end long, score double"
    one = spark.createDataFrame([("c", i * 3, i * 3 + 3 - i % 2, round(0.1 * i + 0.07, 2)) for i in range(300)], scored)
    two = spark.createDataFrame([("c", 0, 1 << 17, 0.3)], scored)
    got = I.union_graphs({"one": one, "two": two}, -1).collect()
    assert {r["start"]: r["one"] for r in got if r["one"] != -1} == {r["start"]: r["score"] for r in one.collect()}
    assert {r["two"] for r in got} == {0.3} and sum(r["end"] - r["start"] for r in got) == 1 << 17


def test_means_of_zeros_and_negatives(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 8.0), ("b", 2.0), ("b", 8.0), ("b", None), ("c", -1.0), ("c", 1.0), ("d", None)], "k string, x double")
    got = {r["k"]: (r["g"], r["h"]) for r in T.group_by(rows, ["k"], [("x", "geomean", "g"), ("x", "harmmean", "h")]).collect()}
    assert got["a"] == (0.0, 0.0) and got["b"] == (pytest.approx(4.0), pytest.approx(3.2)) and got["c"] == (None, None) and got["d"] == (None, None)


def test_alleles_of_either_case(spark):
    rows = spark.createDataFrame([("a", "G"), ("A", "g"), ("ac", "A"), ("a", "A"), ("a", "<DEL>")], "ref string, alt string")
    assert [r[0] for r in rows.select(V.kind()).collect()] == ["snp", "snp", "indel", "ref", "other"]
    assert [tuple(r) for r in V.substitutions(rows).collect()] == [("A", "G", 2)]
    assert V.report(rows).first()["ts"] == 2


def test_keys_of_joins(spark):
    left = spark.createDataFrame([("A", "1"), (None, "2"), ("b", "3")], "k string, x string")
    right = spark.createDataFrame([("a", "p"), (None, "q"), ("C", "r")], "k string, y string")
    rows = lambda **how: sorted((str(r["k"]), str(r["x"]), str(r["y"])) for r in T.join(left, right, ["k"], **how).collect())
    assert rows() == [("None", "2", "q")]
    assert rows(nocase=True) == [("A", "1", "p"), ("None", "2", "q")]
    assert rows(null_matches=False) == []
    assert rows(how="full", nocase=True, null_matches=False, fill="-") == [("-", "-", "q"), ("-", "2", "-"), ("A", "1", "p"), ("C", "-", "r"), ("b", "3", "-")]
