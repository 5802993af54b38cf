"""Variant and population statistics over genotypes in long form: (site, pos, sample, pop, alts), alts 0, 1, 2 or null.

Per-site counts are one aggregation; statistics of regions are sums over the sites' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_tags(gt: DataFrame) -> DataFrame:
    """AC, AN, AF, MAF, NS, missing share, genotype counts and the chi-square of Hardy-Weinberg of each site."""
    n = [F.count_if(F.col("alts") == k).alias(f"n{k}") for k in range(3)]
    tags = gt.groupBy("site").agg(*n, F.count("alts").alias("ns"), F.count(F.lit(1)).alias("all"))
    tags = tags.withColumns({"ac": F.col("n1") + 2 * F.col("n2"), "an": 2 * F.col("ns")})
    p = F.col("ac") / F.col("an")
    tags = tags.withColumns({"af": F.when(F.col("an") > 0, p), "f_missing": 1 - F.col("ns") / F.col("all")})
    expected = [F.col("ns") * F.pow(1 - F.col("af"), 2), 2 * F.col("ns") * F.col("af") * (1 - F.col("af")), F.col("ns") * F.pow("af", 2)]
    chi = sum((F.col(f"n{k}") - e) * (F.col(f"n{k}") - e) / e for k, e in enumerate(expected))
    inner = (F.col("af") > 0) & (F.col("af") < 1)
    return tags.withColumns({"maf": F.least("af", 1 - F.col("af")), "hwe_chi2": F.when(inner, chi)})


def sample_counts(gt: DataFrame) -> DataFrame:
    """For each sample its called, heterozygous and missing sites and its inbreeding F = 1 - observed / expected."""
    tags = site_tags(gt).where("an > 1").select("site", (2 * F.col("af") * (1 - F.col("af")) * F.col("an") / (F.col("an") - 1)).alias("e_het"))
    rows = gt.join(tags, "site")
    called = F.col("alts").isNotNull()
    out = rows.groupBy("sample").agg(F.count_if(called).alias("called"), F.count_if(F.col("alts") == 1).alias("het"), F.count_if(~called).alias("missing"), F.sum(F.when(called, F.col("e_het"))).alias("e"))
    return out.select("sample", "called", "het", "missing", F.when(F.col("e") > 0, 1 - F.col("het") / F.col("e")).alias("f"))


def filtered(gt: DataFrame, mind: float, geno: float, maf: float) -> DataFrame:
    """Sites left after samples with too many missing genotypes go, then sites with too many, then rare ones."""
    share = F.count_if(F.col("alts").isNull()) / F.count(F.lit(1))
    bad = gt.groupBy("sample").agg(share.alias("m")).where(F.col("m") > mind).select("sample")
    tags = site_tags(gt.join(bad, "sample", "left_anti"))
    return tags.where((F.col("f_missing") <= geno) & (F.col("maf") >= maf)).select("site", "ac", "an")


def population_counts(gt: DataFrame) -> DataFrame:
    return gt.groupBy("site", "pos", "pop").agg(F.sum("alts").alias("ac"), (2 * F.count("alts")).alias("an")).where("an > 0")


def _pi(ac: Column, an: Column) -> Column:
    """Share of pairs of chromosomes that differ at a site."""
    return F.when(an > 1, 2 * ac * (an - ac) / (an * (an - 1))).otherwise(0.0)


def diversity(counts: DataFrame, window: int) -> DataFrame:
    """For each population and window of positions: segregating sites, the sum of pi, Watterson's theta and Tajima's D
    (null below 3 segregating sites). n is the largest number of called chromosomes."""
    cut = counts.withColumn("window", F.floor(F.col("pos") / window))
    seg = (F.col("ac") > 0) & (F.col("ac") < F.col("an"))
    sums = cut.groupBy("pop", "window").agg(F.count_if(seg).alias("s"), F.sum(_pi(F.col("ac"), F.col("an"))).alias("pi"), F.max("an").cast("int").alias("n"))
    ones = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array(F.lit(1)))
    a1 = F.aggregate(ones, F.lit(0.0), lambda a, i: a + 1.0 / i)
    a2 = F.aggregate(ones, F.lit(0.0), lambda a, i: a + 1.0 / (i * i))
    t = sums.withColumns({"a1": a1, "a2": a2})
    n, s, a1, a2 = (F.col(c) for c in ("n", "s", "a1", "a2"))
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    d = (F.col("pi") - s / a1) / F.sqrt(e1 * s + e2 * s * (s - 1))
    return t.select("pop", "window", "s", "pi", (s / a1).alias("theta"), F.when((s >= 3) & (n > 2), d).alias("tajima_d"))


def between(counts: DataFrame) -> DataFrame:
    """For each pair of populations: Dxy, fixed differences and Hudson's FST as a ratio of sums over shared sites."""
    a = counts.select("site", F.col("pop").alias("a"), F.col("ac").alias("ca"), F.col("an").alias("na"))
    b = counts.select("site", F.col("pop").alias("b"), F.col("ac").alias("cb"), F.col("an").alias("nb"))
    pairs = a.join(b, "site").where("a < b AND na > 1 AND nb > 1")
    p, q = F.col("ca") / F.col("na"), F.col("cb") / F.col("nb")
    within = p * (1 - p) / (F.col("na") - 1) + q * (1 - q) / (F.col("nb") - 1)
    num, den = (p - q) * (p - q) - within, p * (1 - q) + q * (1 - p)
    fixed = ((p == 0) & (q == 1)) | ((p == 1) & (q == 0))
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"), F.sum(den).alias("dxy"), F.count_if(fixed).alias("fixed"), F.sum(num).alias("num"))
    return out.select("a", "b", "sites", "dxy", "fixed", F.when(F.col("dxy") > 0, F.col("num") / F.col("dxy")).alias("fst"))


def spectrum(counts: DataFrame, folded: bool = True) -> DataFrame:
    """How many complete sites of each population have each allele count."""
    most = counts.groupBy("pop").agg(F.max("an").alias("most"))
    rows = counts.join(most, "pop").where("an = most")
    k = F.least("ac", F.col("an") - F.col("ac")) if folded else F.col("ac")
    return rows.groupBy("pop", k.alias("count")).agg(F.count(F.lit(1)).alias("sites"))


def linkage(gt: DataFrame, reach: int) -> DataFrame:
    """r-squared of the dosages of sites at most reach positions apart, over samples called at both."""
    width = max(1, reach)
    rows = gt.where("alts IS NOT NULL").select("site", "pos", "sample", F.col("alts").cast("double").alias("x"))
    a = rows.select(F.col("site").alias("a"), F.col("pos").alias("pa"), "sample", F.col("x").alias("xa"), F.explode(F.array(F.floor(F.col("pos") / width), F.floor(F.col("pos") / width) + 1)).alias("bin"))
    b = rows.select(F.col("site").alias("b"), F.col("pos").alias("pb"), "sample", F.col("x").alias("xb"), F.floor(F.col("pos") / width).alias("bin"))
    near = (F.col("pb") >= F.col("pa")) & (F.col("pb") - F.col("pa") <= reach) & (F.col("a") != F.col("b")) & ((F.col("pb") > F.col("pa")) | (F.col("a") < F.col("b")))
    pairs = a.join(b, ["sample", "bin"]).where(near)
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("xa", "xb").alias("c"), (F.var_pop("xa") * F.var_pop("xb")).alias("v"))
    return both.where("v > 0").select("a", "b", "n", (F.col("c") * F.col("c") / F.col("v")).alias("r2"))


def presence(files: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For each record (pairing the first with the first of each file) which files hold it, as 0 and 1 in order."""
    every = None
    for i, df in enumerate(files.values()):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
        one = df.select(*keys, nth.alias("nth"), F.lit(1 << i).alias("bit"))
        every = one if every is None else every.unionByName(one)
    bits = every.groupBy(*keys, "nth").agg(F.bit_or("bit").alias("bits"))
    return bits.withColumn("files", F.reverse(F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), len(files), "0"))).drop("bits")


def joint_spectrum(counts: DataFrame) -> DataFrame:
    """For each pair of populations how many sites that are complete in both have each pair of allele counts."""
    most = counts.groupBy("pop").agg(F.max("an").alias("most"))
    rows = counts.join(most, "pop").where("an = most")
    a, b = (rows.select("site", F.col("pop").alias(s), F.col("ac").alias(f"count_{s}")) for s in "ab")
    return a.join(b, "site").where("a < b").groupBy("a", "b", "count_a", "count_b").agg(F.count(F.lit(1)).alias("sites"))
