"""Fixation indices of two populations with standard errors by leaving out one block of sites at a time.

Genotypes are in long form (site, pos, sample, pop, alts), alts 0, 1, 2 or null. Numerators and denominators are summed
before they are divided, never ratios averaged. What a site gives is one aggregation, what a block gives another, and
all that is left out of the whole is a block's sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.table import numbered


def parts(gt: DataFrame) -> DataFrame:
    """(a, b, site, pos, hudson_num, hudson_den, wc_num, wc_den) of each two populations and site that has at least one
    called sample of each; the estimators are those of Hudson and of Weir and Cockerham for two populations of diploids.
    The last two are null where there are two called samples in all, as these leave no degree of freedom."""
    own = gt.where("alts IS NOT NULL").groupBy("site", "pos", "pop").agg(F.count(F.lit(1)).alias("n"), F.sum("alts").alias("ac"), F.count_if(F.col("alts") == 1).alias("het"))
    one, two = (own.select("site", "pos", F.col("pop").alias(s), F.col("n").alias(f"n{s}"), (F.col("ac") / (2 * F.col("n"))).alias(f"p{s}"), F.col("het").alias(f"h{s}")) for s in "ab")
    pairs = one.join(two.drop("pos"), "site").where("a < b")
    p, q, m, n = (F.col(c) for c in ("pa", "pb", "na", "nb"))
    within = p * (1 - p) / (2 * m - 1) + q * (1 - q) / (2 * n - 1)
    pairs = pairs.withColumns({"hudson_num": (p - q) * (p - q) - within, "hudson_den": p * (1 - q) + q * (1 - p)})
    pairs = pairs.withColumns({"size": (m + n) / 2, "mean": (m * p + n * q) / (m + n), "het": (F.col("ha") + F.col("hb")) / (m + n)})
    size, mean, het = F.col("size"), F.col("mean"), F.col("het")
    spread = (m * (p - mean) * (p - mean) + n * (q - mean) * (q - mean)) / size
    pairs = pairs.withColumns({"spread": spread, "even": 2 * size - (m * m + n * n) / (2 * size)})
    rest = mean * (1 - mean) - F.col("spread") / 2
    among = size / F.col("even") * (F.col("spread") - (rest - het / 4) / (size - 1))
    inside = size / (size - 1) * (rest - (2 * size - 1) / (4 * size) * het)
    some = F.col("size") > 1
    return pairs.select("a", "b", "site", "pos", "hudson_num", "hudson_den", F.when(some, among).alias("wc_num"), F.when(some, among + inside + het / 2).alias("wc_den"))


def fst(gt: DataFrame, block: int) -> DataFrame:
    """Of each two populations both estimates over all sites, and the standard error and score (estimate over error) of
    each from blocks of so many sites that follow each other by (pos, site). Only full blocks count for the error, which
    is null below two blocks or without variation; sites that a pair has no estimate of take their places all the same."""
    if block < 1:
        raise ValueError("a block has at least 1 site")
    sites = numbered(gt.select("site", "pos").distinct(), ["pos", "site"], "place")
    cut = sites.select("site", F.floor(F.col("place") / block).alias("block"), F.lit(1).alias("there"))
    full = cut.groupBy("block").agg(F.sum("there").alias("k")).where(F.col("k") == block).select("block", F.lit(True).alias("full"))
    names = ("hudson_num", "hudson_den", "wc_num", "wc_den")
    sums = parts(gt).join(cut.drop("there"), "site").groupBy("a", "b", "block").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).join(full, "block", "left")
    whole, pair = Window.partitionBy("a", "b"), ["a", "b"]
    # Blocks in which a pair has nothing leave the whole as it is, but they are blocks. Their number is one row.
    number = full.agg(F.count(F.lit(1)).alias("blocks"))
    used = F.col("full").isNotNull()
    left = sums.select(*pair, "full", *names, *[(F.sum(F.when(used, F.col(c))).over(whole) - F.col(c)).alias(f"l_{c}") for c in names])
    out, ends = [], []
    for name in ("hudson", "wc"):
        without = F.when(used, F.try_divide(F.col(f"l_{name}_num"), F.col(f"l_{name}_den")))
        out += [F.try_divide(F.sum(f"{name}_num"), F.sum(f"{name}_den")).alias(name), F.sum(without).alias(f"{name}_s"), F.sum(without * without).alias(f"{name}_q")]
        out += [F.count(without).alias(f"{name}_n"), F.try_divide(F.sum(F.when(used, F.col(f"{name}_num"))), F.sum(F.when(used, F.col(f"{name}_den")))).alias(f"{name}_all")]
    per = left.groupBy(*pair).agg(F.count("full").alias("seen"), *out).join(F.broadcast(number))
    for name in ("hudson", "wc"):
        more, base = F.col("blocks") - F.col("seen"), F.col(f"{name}_all")
        s, q = F.col(f"{name}_s") + F.coalesce(more * base, F.lit(0.0)), F.col(f"{name}_q") + F.coalesce(more * base * base, F.lit(0.0))
        m = F.col("blocks")
        error = F.when((m > 1) & (F.col(f"{name}_n") == F.col("seen")), F.sqrt(F.greatest(F.lit(0.0), (m - 1) / m * (q - s * s / m))))
        per = per.withColumn(f"{name}_se", F.when(error > 0, error))
        ends += [name, f"{name}_se", F.try_divide(F.col(name), F.col(f"{name}_se")).alias(f"{name}_z")]
    return per.select(*pair, "blocks", *ends)
