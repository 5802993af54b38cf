from pyspark.sql import functions as F

from loomspark.operators import intervals as I
from loomspark.operators import variants as V

COLUMNS = "chrom string, pos long, ref string, alt string, qual double, ord long"


def table(spark, *rows):
    return spark.createDataFrame([(c, p, r, a, q, i) for i, (c, p, r, a, q) in enumerate(rows)], COLUMNS)


def test_trim_keeps_a_base(spark):
    v = table(spark, ("1", 10, "GCAT", "GCGT", 1.0), ("1", 10, "CAA", "CA", 1.0), ("1", 5, "A", "A", 1.0), ("1", 7, None, "A", 1.0))
    got = {r["ord"]: (r["pos"], r["ref"], r["alt"]) for r in V.trimmed(v).collect()}
    assert got[0] == (12, "A", "G") and got[1] == (10, "CA", "C") and got[2] == (5, "A", "A") and got[3][1] is None


def test_kinds_and_rules(spark):
    v = table(spark, ("1", 1, "A", "G", 5.0), ("1", 2, "AC", "GT", 50.0), ("1", 3, "A", "AT", None), ("1", 4, "A", None, 50.0), ("1", 5, "A", "<DEL>", 50.0), ("1", 6, "A", "A", 1.0))
    assert [r[0] for r in v.select(V.kind().alias("k"), "ord").orderBy("ord").collect()] == ["snp", "mnp", "indel", "other", "other", "ref"]
    marked = V.soft_filter(v, {"low": F.col("qual") < 10, "indel": V.kind() == "indel"})
    assert [r["filter"] for r in marked.orderBy("ord").collect()] == ["low", "PASS", "indel", "PASS", "PASS", "low"]
    one = V.report(v).collect()[0]
    assert (one["records"], one["snps"], one["mnps"], one["indels"], one["others"], one["ts"], one["ts_tv"]) == (6, 1, 1, 1, 2, 1, None)


def test_gaps(spark):
    v = table(spark, ("1", 10, "A", "AT", 5.0), ("1", 12, "A", "AT", 9.0), ("1", 15, "C", "T", 1.0), ("1", 40, "C", "T", 1.0), ("1", 60, "A", "AT", None), ("1", 61, "A", "AT", None))
    assert {r["ord"] for r in V.near_indels(v, 3).collect()} == {2}
    assert {r["ord"] for r in V.crowded_indels(v, 5).collect()} == {0, 5}


def test_transfer_concat_and_empty(spark):
    v = table(spark, ("1", 1, "A", "G", 5.0), ("1", 1, "A", "G", 6.0), ("2", 1, "A", "G", None))
    notes = table(spark, ("1", 1, "A", "G", 8.0), ("2", 1, "A", "G", 7.0))
    assert [r["qual"] for r in V.transferred(v, notes, ["qual"]).orderBy("ord").collect()] == [8.0, 8.0, 7.0]
    assert [r["qual"] for r in V.transferred(v, notes, ["qual"], replace=False).orderBy("ord").collect()] == [5.0, 6.0, 7.0]
    assert V.concatenated([v, notes]).count() == 2 and V.concatenated([v, notes], once=False).count() == 5
    none = v.limit(0)
    for f in (V.trimmed, V.substitutions, V.site_distances, V.joined_alleles, lambda x: V.near_indels(x, 3), lambda x: V.crowded_indels(x, 3)):
        assert f(none).count() == 0


def test_genotypes_are_set(spark):
    gt = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "site long, alts long")
    assert [r["alts"] for r in V.set_genotypes(gt, F.col("alts").isNull(), F.lit(0)).orderBy("site").collect()] == [0, 1, 2]


def test_lift(spark):
    df = spark.createDataFrame([("1", 0, 10, 0), ("1", 95, 115, 1), ("1", 300, 310, 2), ("1", 205, 215, 3), ("1", 190, 230, 4), ("1", 12, 20, 5)], "chrom string, start long, end long, ord long")
    blocks = spark.createDataFrame(
        [("1", 0, 100, "x", "n1", 1000, "+"), ("1", 110, 210, "x", "n1", 1100, "+"), ("1", 200, 220, "y", "n2", 0, "-"), ("1", 12, 20, "z", "n3", 0, "-")],
        "chrom string, start long, end long, chain string, to_chrom string, to_start long, way string",
    )
    got = {r["ord"]: (r["status"], r["to_chrom"], r["to_start"], r["to_end"]) for r in I.lifted(df, blocks, 0.9).collect()}
    assert got[0] == ("lifted", "n1", 1000, 1010)
    assert got[1] == ("partly", None, None, None)
    assert got[2][0] == "deleted" and got[4][0] == "split" and got[5][0] == "several"
    assert got[3] == ("lifted", "n2", 5, 15)
