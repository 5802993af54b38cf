"""Left alignment against a loop over bases, atoms, alleles split and joined, and ranges of a reference."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import normalize as N
from loomspark.operators import reference as R

V = "chrom string, pos long, ref string, alt string, ord long"


def shifted(genome, pos, ref, alt):
    """The plain rule, a base at a time."""
    at = pos - 1
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        ref, alt, at = ref[1:], alt[1:], at + 1
    if ref and alt:
        return at + 1, ref, alt
    while at > 0 and genome[at - 1] == (ref or alt)[-1]:
        ref, alt, at = ref and ref[-1] + ref[:-1], alt and alt[-1] + alt[:-1], at - 1
    if at == 0:
        base = genome[len(ref)]
        return 1, ref + base, alt + base
    base = genome[at - 1]
    return at, base + ref, base + alt


@pytest.mark.parametrize("width, halo", [(16, 4), (64, 0), (4096, 64)])
def test_left_alignment(spark, width, halo):
    rng = random.Random(width)
    genomes = {c: "".join(rng.choice(["A" * rng.randint(1, 30), "CA" * rng.randint(1, 20), "GTT" * rng.randint(1, 15), rng.choice("ACGT")]) for _ in range(60)) for c in ("x", "y")}
    pieces = spark.createDataFrame([(c, i, g[i : i + 7].lower() if i % 3 else g[i : i + 7]) for c, g in genomes.items() for i in range(0, len(g), 7)], "chrom string, at long, piece string")
    rows = []
    for k in range(400):
        c = rng.choice("xy")
        g = genomes[c]
        p, n = rng.randint(0, len(g) - 12), rng.randint(1, 8)
        ref, alt = (g[p : p + n + 1], g[p]) if k % 2 else (g[p], g[p] + rng.choice([g[p + 1 : p + 1 + n], "ACG"[:n]]))
        if k % 10 == 9:
            ref, alt = g[p : p + 3], "T" + g[p + 1 : p + 3] if g[p] != "T" else "CC" + g[p + 2]
        rows.append((c, p + 1, ref, alt, k))
    tiles = R.tiles(pieces, width, halo).cache()
    got = {r.ord: (r.pos, r.ref, r.alt) for r in N.left_aligned(spark.createDataFrame(rows, V), tiles, width, halo).collect()}
    assert got == {k: shifted(genomes[c], p, ref, alt) for c, p, ref, alt, k in rows}
    asked = spark.createDataFrame([(c, max(0, p - 20), p + 40, k) for c, p, _, _, k in rows], "chrom string, start long, end long, ord long")
    found = {r.ord: r.bases for r in R.fetched(asked, tiles, ["ord"], F.col("start"), F.col("end"), "bases", width).collect()}
    assert found == {k: genomes[c][max(0, p - 20) : p + 40] for c, p, _, _, k in rows}


def test_odd_records(spark):
    tiles = R.tiles(spark.createDataFrame([("c", 0, "AAAACG")], "chrom string, at long, piece string"), 4, 1)
    rows = [("c", 2, "A", "<DEL>", 1), ("c", 5, "C", "C", 2), ("c", 3, None, "A", 3), ("c", 3, "aa", "a", 4), ("c", 1, "A", "G", 5), ("z", 1, "A", "*", 6)]
    got = {r.ord: (r.pos, r.ref, r.alt) for r in N.left_aligned(spark.createDataFrame(rows, V), tiles, 4, 1).collect()}
    assert got == {1: (2, "A", "<DEL>"), 2: (5, "C", "C"), 3: (3, None, "A"), 4: (1, "AA", "A"), 5: (1, "A", "G"), 6: (1, "A", "*")}
    assert N.left_aligned(spark.createDataFrame([], V), tiles, 4, 1).count() == 0
    for bad in (("z", 2, "AA", "A", 1), ("c", 90, "AA", "A", 1)):
        with pytest.raises(Exception, match="no reference"):
            N.left_aligned(spark.createDataFrame([bad], V), tiles, 4, 1).count()
    wrong = N.with_reference(spark.createDataFrame([("c", 4, "AC", "A", 1), ("c", 4, "AG", "A", 2)], V), tiles, 4).where("ref <> reference").collect()
    assert [(r.ord, r.reference) for r in wrong] == [(2, "AC")]


def test_atoms(spark):
    rows = [("c", 10, "ACG", "TCT", 1), ("c", 10, "ATG", "CT", 2), ("c", 10, "A", "AGG", 3), ("c", 10, "A", "<X>", 4), ("c", 10, "A", "A", 5)]
    got = sorted((r.ord, r.atom, r.pos, r.ref, r.alt) for r in N.atoms(spark.createDataFrame(rows, V)).collect())
    assert got == [(1, 0, 10, "A", "T"), (1, 1, 12, "G", "T"), (2, 0, 10, "A", "C"), (2, 1, 11, "TG", "T"), (3, 0, 10, "A", "AGG"), (4, 0, 10, "A", "<X>"), (5, 0, 10, "A", "A")]


def test_alleles_split_and_joined(spark):
    schema = "chrom string, pos long, ref string, alts array<string>, ord long, af array<double>, ad array<int>, pl array<int>, gt array<int>"
    row = ("c", 5, "A", ["C", "G"], 1, [0.1, 0.2], [7, 8, 9], [0, 1, 2, 3, 4, 5], [1, 2])
    names = {"per_alt": ["af"], "per_allele": ["ad"], "per_genotype": ["pl"], "calls": ["gt"]}
    split = N.split_alleles(spark.createDataFrame([row, ("c", 9, "T", ["TA"], 2, None, [1, 2], [0, 1, 2], [None, 1])], schema), **names)
    got = sorted((r.pos, r.nth, r.alt, r.af, r.ad, r.pl, r.gt) for r in split.collect())
    assert got == [(5, 0, "C", [0.1], [7, 8], [0, 1, 2], [1, 0]), (5, 1, "G", [0.2], [7, 9], [0, 3, 5], [0, 1]), (9, 0, "TA", None, [1, 2], [0, 1, 2], [None, 1])]
    back = {r.pos: r for r in N.join_alleles(split.withColumn("ord", F.col("ord") * 10 + F.col("nth")), **names).collect()}
    assert (back[5].alts, back[5].af, back[5].ad, back[5].pl, back[5].gt) == (["C", "G"], [0.1, 0.2], [7, 8, 9], [0, 1, 2, 3, None, 5], [1, 2])
    with pytest.raises(Exception, match="not a value"):
        N.split_alleles(spark.createDataFrame([("c", 5, "A", ["C", "G"], 1, [0.1], None, None, None)], schema), **names).count()
