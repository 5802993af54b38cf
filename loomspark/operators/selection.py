"""Greedy choices among sites in linkage that equal the rule that goes through the sites one by one.

What a site's fate depends on are sites before it in the rule's order, so it is settled as soon as these are. Each round
settles every site whose fate follows from what is known, on all contigs at once; rounds grow with the longest chain of
sites that wait for each other and no site's neighbours are gathered in one row. Pairs that concern settled sites leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.scratch import discard, written


def independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site) of each node that the rule takes: in order, a node that isn't joined with one taken before it.
    edges are (site, earlier), the same pair any number of times; both must be nodes."""
    asks = written(edges.select("site", "earlier").distinct(), "asks")
    open_ = written(nodes.select("site").distinct(), "open")
    taken: list[DataFrame] = []
    while not open_.isEmpty():
        now = written(open_.join(asks.select("site").distinct(), "site", "left_anti"), "taken")
        out = written(asks.join(now.withColumnRenamed("site", "earlier"), "earlier", "left_semi").select("site").distinct(), "out")
        gone = now.unionByName(out)
        if now.isEmpty():
            raise ValueError("sites that wait for each other in a circle")
        left = written(open_.join(gone, "site", "left_anti"), "open")
        still = asks.join(left, "site", "left_semi")
        rest = written(still.join(out.withColumnRenamed("site", "earlier"), "earlier", "left_anti").select("site", "earlier"), "asks")
        for table in (open_, asks, out):
            discard(table)
        open_, asks = left, rest
        taken.append(now)
    discard(open_)
    discard(asks)
    every = nodes.select("site").limit(0)
    for table in taken:
        every = every.unionByName(table)
    return every


def clump(sites: DataFrame, pairs: DataFrame, index_p: float, member_p: float, least_r2: float) -> DataFrame:
    """(site, index, p) of every site in a clump, index sites too. In order of p (ties: pos, then site) a site with p of at
    most index_p that is in no clump so far begins one, of itself and all sites with p of at most member_p that are in
    linkage of at least least_r2 with it and in no clump yet.

    sites are (site, pos, p), pairs (a, b, r2) of whatever is near enough. Null p take no part; index_p must not exceed
    member_p, as then an index site could be in no clump.
    """
    if index_p > member_p:
        raise ValueError("index_p must not exceed member_p")
    known = written(sites.where(F.col("p") <= member_p).select("site", F.struct("p", "pos", "site").alias("at")), "clump-sites")
    linked = pairs.where(F.col("r2") >= least_r2)
    both = linked.select(F.col("a").alias("site"), F.col("b").alias("earlier")).unionByName(linked.select(F.col("b").alias("site"), F.col("a").alias("earlier")))
    ends = both.join(known, "site").join(known.select(F.col("site").alias("earlier"), F.col("at").alias("before")), "earlier")
    asks = written(ends.where((F.col("before") < F.col("at")) & (F.col("before.p") <= index_p)).select("site", "earlier", "at", "before"), "clump-pairs")
    index = written(independent(known.where(F.col("at.p") <= index_p), asks.where(F.col("at.p") <= index_p)), "clump-index")
    joined = asks.join(index.withColumnRenamed("site", "earlier"), "earlier", "left_semi").groupBy("site", "at").agg(F.min("before").alias("first"))
    members = joined.select("site", F.col("first.site").alias("index"), F.col("at.p").alias("p"))
    return index.join(known, "site").select("site", F.col("site").alias("index"), F.col("at.p").alias("p")).unionByName(members)


def pruned(sites: DataFrame, pairs: DataFrame, most_r2: float) -> DataFrame:
    """(site, kept) after pruning by linkage: each site as it comes (by pos, then site) is compared with those before it
    that are still there, in the same order, and of a pair with r2 above most_r2 the one with less maf leaves at once;
    of equals the later one.

    sites are (site, pos, maf), pairs (a, b, r2) of whatever is near enough. A site leaves at its first comparison with
    a better site that is still there then, and which sites are better doesn't depend on the order, so a site is settled
    when that comparison comes before all those with better sites that aren't settled.
    """
    known = sites.select("site", "maf", F.struct("pos", "site").alias("at"))
    one = known.select(F.col("site").alias("a"), F.col("maf").alias("ma"), F.col("at").alias("pa"))
    two = known.select(F.col("site").alias("b"), F.col("maf").alias("mb"), F.col("at").alias("pb"))
    near = pairs.where(F.col("r2") > most_r2).select("a", "b").join(one, "a").join(two, "b")
    first, last = F.least("pa", "pb"), F.greatest("pa", "pb")
    better = F.when(F.col("ma") > F.col("mb"), F.col("pa")).when(F.col("mb") > F.col("ma"), F.col("pb")).otherwise(first)
    loses = F.when(better == F.col("pa"), F.col("pb")).otherwise(F.col("pa"))
    waits = written(near.select(loses["site"].alias("site"), better["site"].alias("better"), F.struct(last.alias("j"), first.alias("i")).alias("at")).distinct(), "prune-waits")
    #: What is settled of sites that lose any comparison: when they leave, or null if they stay.
    settled: list[DataFrame] = []
    # A site that never loses is there at all times.
    calm = waits.select(F.col("better").alias("site")).distinct().join(waits.select("site").distinct(), "site", "left_anti")
    news = written(calm.withColumn("left", F.lit(None).cast(waits.schema["at"].dataType)), "prune-news")
    open_ = waits.withColumn("fires", F.lit(None).cast("boolean"))
    while not open_.isEmpty():
        told = news.select(F.col("site").alias("better"), "left", F.lit(True).alias("told"))
        asked = open_.join(told, "better", "left")
        there = F.col("left").isNull() | (F.col("left") > F.col("at"))
        marked = written(asked.select("site", "better", "at", F.coalesce("fires", F.when(F.col("told"), there)).alias("fires")), "prune-open")
        when = marked.groupBy("site").agg(F.min(F.when(F.col("fires"), F.col("at"))).alias("left"), F.min(F.when(F.col("fires").isNull(), F.col("at"))).alias("unsure"))
        sure = F.col("unsure").isNull() | (F.col("left") < F.col("unsure"))
        now = written(when.where(sure).select("site", "left"), "prune-news")
        if now.isEmpty():
            raise ValueError("sites that wait for each other in a circle")
        rest = written(marked.join(now, "site", "left_anti"), "prune-rest")
        for table in (marked, open_):
            discard(table)
        settled.append(now)
        open_, news = rest, now
    discard(open_)
    discard(waits)
    gone = sites.select("site").limit(0)
    for table in settled:
        gone = gone.unionByName(table.where("left IS NOT NULL").select("site"))
    return sites.select("site").join(gone.withColumn("gone", F.lit(True)), "site", "left").select("site", F.col("gone").isNull().alias("kept"))
