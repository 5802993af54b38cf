"""Statistics of feature-by-sample matrices in long form (feature, sample, x), absent cells being zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alpha(counts: DataFrame) -> DataFrame:
    """Diversity of each sample: observed, Shannon (bits), Simpson, dominance, Pielou, Chao1 and Good's coverage."""
    n = F.sum("x").over(Window.partitionBy("sample"))
    p = F.col("x") / F.col("n")
    sums = counts.where("x > 0").withColumn("n", n).groupBy("sample").agg(
        F.count(F.lit(1)).alias("observed"), F.max("n").alias("n"), F.sum(-p * F.log2(p)).alias("shannon"), F.sum(p * p).alias("dominance"),
        F.count_if(F.col("x") == 1).alias("singles"), F.count_if(F.col("x") == 2).alias("doubles"),
    )
    f1, f2, s = F.col("singles"), F.col("doubles"), F.col("observed")
    return sums.select(
        "sample", "observed", "shannon", (1 - F.col("dominance")).alias("simpson"), "dominance",
        F.when(s > 1, F.col("shannon") / F.log2(s)).alias("pielou_e"), (s + f1 * (f1 - 1) / (2 * (f2 + 1))).alias("chao1"), (1 - f1 / F.col("n")).alias("goods"),
    )


def beta(counts: DataFrame) -> DataFrame:
    """Distances of each pair of samples: Bray-Curtis, Jaccard (of presence), Euclidean and city-block.

    Only features that both samples have are paired; the rest follows from the samples' own sums.
    """
    some = counts.where("x > 0")
    own = some.groupBy("sample").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count(F.lit(1)).alias("k"))
    a, b = some.select("feature", F.col("sample").alias("a"), F.col("x").alias("xa")), some.select("feature", F.col("sample").alias("b"), F.col("x").alias("xb"))
    shared = a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.sum(F.least("xa", "xb")).alias("low"), F.sum(F.col("xa") * F.col("xb")).alias("dot"), F.count(F.lit(1)).alias("both"))
    one = own.select(F.col("sample").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("k").alias("ka"))
    two = own.select(F.col("sample").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("k").alias("kb"))
    every = one.join(two, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").na.fill(0, ["low", "dot", "both"])
    city = F.col("a1") + F.col("b1") - 2 * F.col("low")
    return every.select(
        "a", "b", (city / (F.col("a1") + F.col("b1"))).alias("braycurtis"), (1 - F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))).alias("jaccard"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("a2") + F.col("b2") - 2 * F.col("dot"))).alias("euclidean"), city.alias("cityblock"),
    )


def closure(m: DataFrame) -> DataFrame:
    """Each sample's parts as shares of their sum; those of a sample whose sum is zero are null."""
    return m.withColumn("x", F.try_divide("x", F.sum("x").over(Window.partitionBy("sample"))))


def clr(m: DataFrame) -> DataFrame:
    """Centred log-ratio: the log over the sample's mean log. Zeros are errors."""
    value = F.when(F.col("x") > 0, F.log("x")).otherwise(F.raise_error(F.lit("log of a part that isn't positive")))
    return m.withColumn("l", value).withColumn("x", F.col("l") - F.avg("l").over(Window.partitionBy("sample"))).drop("l")


def multi_replace(m: DataFrame, delta: float) -> DataFrame:
    """Closed parts with zeros set to delta and the others scaled down by what that takes."""
    by = Window.partitionBy("sample")
    zeros = F.count_if(F.col("x") == 0).over(by)
    return closure(m).withColumn("z", zeros).withColumn("x", F.when(F.col("x") == 0, delta).otherwise(F.col("x") * (1 - F.col("z") * delta))).drop("z")


def log_ratio_variance(m: DataFrame) -> DataFrame:
    """Sample variance of the log-ratio of each pair of features, from sums of one join."""
    logs = m.select("feature", "sample", F.log("x").alias("l"))
    a, b = logs.select(F.col("feature").alias("a"), "sample", F.col("l").alias("la")), logs.select(F.col("feature").alias("b"), "sample", F.col("l").alias("lb"))
    return a.join(b, "sample").where("a < b").groupBy("a", "b").agg(F.var_samp(F.col("la") - F.col("lb")).alias("vlr"))


def anova(m: DataFrame) -> DataFrame:
    """One-way F of each feature over the samples' groups (column grp), from grouped sums."""
    per = m.groupBy("feature", "grp").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    out = per.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    return out.select("feature", F.when(within > 0, between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).alias("f"))


def normalized(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """CPM, FPKM and TPM of counts with the features' lengths (feature, length). All of a sample without counts and the
    last two of a feature without length are null."""
    by = Window.partitionBy("sample")
    rate = F.try_divide(F.col("x"), F.col("length"))
    return counts.join(lengths, "feature").withColumns({"total": F.sum("x").over(by), "rates": F.sum(rate).over(by)}).select(
        "feature", "sample", F.try_divide(F.col("x") * 1e6, "total").alias("cpm"), F.try_divide(rate * 1e9, "total").alias("fpkm"), F.try_divide(rate * 1e6, "rates").alias("tpm")
    )


def size_factors(counts: DataFrame, samples: int) -> DataFrame:
    """Median of ratios to the features' geometric means, over features counted in all of so many samples."""
    logs = counts.where("x > 0").withColumn("l", F.log("x"))
    means = logs.groupBy("feature").agg(F.avg("l").alias("m"), F.count(F.lit(1)).alias("k")).where(F.col("k") == samples)
    return logs.join(means, "feature").groupBy("sample").agg(F.exp(F.percentile(F.col("l") - F.col("m"), 0.5)).alias("size_factor"))


def linear_fit(m: DataFrame) -> DataFrame:
    """Ordinary least squares of x on t for each feature: slope, intercept, residual variance and t statistic."""
    s = m.groupBy("feature").agg(F.count("x").alias("n"), F.avg("t").alias("mt"), F.avg("x").alias("mx"), F.var_pop("t").alias("vt"), F.covar_pop("t", "x").alias("c"), F.var_pop("x").alias("vx"))
    slope = F.col("c") / F.col("vt")
    left = (F.col("vx") - slope * F.col("c")) * F.col("n") / (F.col("n") - 2)
    fit = s.where("vt > 0 AND n > 2").select("feature", "n", "vt", slope.alias("slope"), (F.col("mx") - slope * F.col("mt")).alias("intercept"), left.alias("s2"))
    return fit.select("feature", "slope", "intercept", "s2", F.when(F.col("s2") > 0, F.col("slope") / F.sqrt(F.col("s2") / (F.col("n") * F.col("vt")))).alias("t_stat"))


def adjusted(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg and Holm: tests with columns bh and holm. One row for each test is ordered as a whole, so this
    is for the list of tests, not for their data."""
    n = F.count(p).over(Window.partitionBy())
    up, down = Window.orderBy(F.col(p), "feature"), Window.orderBy(F.col(p).desc(), F.col("feature").desc())
    ranked = tests.withColumns({"_n": n, "_r": F.row_number().over(up)})
    bh = F.min(F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_r"))).over(down)
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.col("_r") + 1))).over(up)
    return ranked.withColumns({"bh": bh, "holm": holm}).drop("_n", "_r")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k most similar vectors of the same label (by cosine, then id) of each query; queries are a stated set."""
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pairs = queries.join(vectors, "label").where("q <> id").select("q", "id", F.round(dot, 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("cosine").desc(), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def alr(m: DataFrame, reference: str) -> DataFrame:
    """Additive log-ratio: the log of each other part over the reference's of its sample. Zeros are errors; a sample
    without the reference has no rows."""
    base = m.where(F.col("feature") == reference).select("sample", F.col("x").alias("_of"))
    rest = m.where(F.col("feature") != reference).join(base, "sample")
    value = F.when((F.col("x") > 0) & (F.col("_of") > 0), F.log(F.col("x") / F.col("_of"))).otherwise(F.raise_error(F.lit("log of a part that isn't positive")))
    return rest.withColumn("x", value).drop("_of")


def robust_clr(m: DataFrame) -> DataFrame:
    """Centred log-ratio over the positive parts of each sample; others are left out."""
    logs = m.where("x > 0").withColumn("x", F.log("x"))
    return logs.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("sample")))


def perturbed(m: DataFrame, by: DataFrame) -> DataFrame:
    """Closed products of each sample's parts with `by` (feature, y); features that either lacks are left out."""
    return closure(m.join(by, "feature").withColumn("x", F.col("x") * F.col("y")).drop("y"))


def powered(m: DataFrame, exponent: float) -> DataFrame:
    """Closed powers of each sample's closed parts."""
    return closure(closure(m).withColumn("x", F.pow("x", F.lit(exponent))))


def evenness(counts: DataFrame) -> DataFrame:
    """Inverse Simpson, its share of the observed features and the Berger-Parker share of the largest, of each sample."""
    sums = counts.where("x > 0").groupBy("sample").agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.max("x").alias("most"))
    inverse = F.col("n") * F.col("n") / F.col("s2")
    return sums.select("sample", inverse.alias("inv_simpson"), (inverse / F.col("k")).alias("simpson_e"), (F.col("most") / F.col("n")).alias("berger_parker"))


def canberra(counts: DataFrame) -> DataFrame:
    """Canberra distance of each pair of samples with any counts: only shared features are joined, as each feature of one
    sample alone counts 1. The pairs are as many as the square of the samples."""
    some = counts.where("x > 0")
    own = some.groupBy("sample").agg(F.count(F.lit(1)).alias("k"))
    a, b = (some.select("feature", F.col("sample").alias(s), F.col("x").alias(f"x{s}")) for s in "ab")
    gap = F.abs(F.col("xa") - F.col("xb")) / (F.col("xa") + F.col("xb"))
    both = a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.sum(gap).alias("d"), F.count(F.lit(1)).alias("shared"))
    one, two = (own.select(F.col("sample").alias(s), F.col("k").alias(f"k{s}")) for s in "ab")
    every = one.join(two, F.col("a") < F.col("b")).join(both, ["a", "b"], "left").na.fill(0, ["d", "shared"])
    return every.select("a", "b", (F.col("d") + F.col("ka") + F.col("kb") - 2 * F.col("shared")).alias("canberra"))
