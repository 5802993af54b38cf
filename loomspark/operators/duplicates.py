"""Duplicate templates by the places of both their ends.

A read's 5' end is where its first base would lie if nothing of it were clipped. A pair's signature is both mates' 5' ends
with their strands, the smaller one first; mates meet by name in one exchange, and pairs by signature in another. Reads
without a mapped mate meet pairs' ends and each other by their one end. Best ones are found by partial aggregation, so a
signature that very many templates share is a row or so from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.sources.text import PAIRED, QC_FAIL, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED

#: Only qualities from here on count.
COUNTED = 15


def quality_sum(qual: Column, least: int = COUNTED) -> Column:
    """The sum of the qualities of a read that are at least `least`; 0 without any."""
    values = F.transform(F.split(F.coalesce(qual, F.lit("*")), ""), lambda c: F.ascii(c) - 33)
    return F.when(qual != "*", F.aggregate(values, F.lit(0), lambda a, q: a + F.when(q >= least, q).otherwise(0))).otherwise(0)


def _clipped(cigar: Column) -> Column:
    """How many bases are clipped before a CIGAR's first other operation."""
    step = lambda a, o: F.struct(
        (a["on"] & o["op"].isin("S", "H")).alias("on"),
        (a["n"] + F.when(a["on"] & o["op"].isin("S", "H"), o["len"]).otherwise(0)).alias("n"),
    )
    return F.aggregate(cigar, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step)["n"]


def five_prime(reads: DataFrame) -> Column:
    """Where an alignment's 5' end would lie without clipping."""
    forward = F.col("start") - _clipped(F.col("cigar"))
    return F.when(F.col("flag").bitwiseAND(REVERSE) != 0, F.col("end") + _clipped(F.reverse("cigar"))).otherwise(forward)


def mark_templates(reads: DataFrame, with_failed: bool = False, clear: bool = True) -> DataFrame:
    """reads (qname, flag, chrom, start, end, cigar, qual, ord) with `duplicate`.

    Of pairs with one signature the best stays: one that passes quality control before one that doesn't, then the
    highest sum of base qualities, then the smaller name. A read without a mapped mate is a duplicate if a pair has
    its end, or a better read does (likewise, and at last by ord). Only mapped primary reads take part, with those that
    fail quality control only if with_failed. A name with more or fewer than two of them is reads alone. Reads that
    don't take part are no duplicates, or what their flag says if not `clear`."""
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    used = reads.where(~bit(UNMAPPED) & ~bit(SECONDARY) & ~bit(SUPPLEMENTARY) & F.col("start").isNotNull())
    if not with_failed:
        used = used.where(~bit(QC_FAIL))
    place = F.struct("chrom", five_prime(reads).alias("at"), bit(REVERSE).alias("rev"))
    ends = used.select("qname", "ord", bit(PAIRED).alias("paired"), place.alias("place"), quality_sum(F.col("qual")).cast("long").alias("score"), bit(QC_FAIL).alias("failed"))
    templates = ends.where("paired AND qname IS NOT NULL").groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("one"), F.max("place").alias("two"), F.sum("score").alias("score"), F.max("failed").alias("failed"), F.min("ord").alias("first"))
    pairs = templates.where("n = 2")
    best = pairs.groupBy("one", "two").agg(F.min_by("qname", F.struct("failed", -F.col("score"), "qname")).alias("best"))
    worse = pairs.join(best, ["one", "two"]).where("qname <> best").select("qname")
    of_pairs = ends.where("paired").join(worse, "qname", "left_semi").select("ord")
    alone = ends.join(pairs.select("qname", F.lit(True).alias("paired")), ["qname", "paired"], "left_anti")
    rank = F.struct("failed", -F.col("score"), "qname", "ord")
    held = alone.select("place", rank.alias("rank"), F.lit(False).alias("pair"))
    held = held.unionByName(pairs.select(F.explode(F.array("one", "two")).alias("place"), F.lit(None).cast(held.schema["rank"].dataType).alias("rank"), F.lit(True).alias("pair")))
    first = held.groupBy("place").agg(F.max("pair").alias("pair"), F.min("rank")["ord"].alias("best"))
    of_alone = alone.join(first, "place").where("pair OR ord <> best").select("ord")
    found = of_pairs.unionByName(of_alone).withColumn("_found", F.lit(True))
    out = reads.join(found, "ord", "left")
    before = F.lit(False) if clear else bit(1024)
    return out.withColumn("duplicate", F.coalesce("_found", F.lit(False)) | before).drop("_found")
