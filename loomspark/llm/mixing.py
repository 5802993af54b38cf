"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by a hash of its rows. A source whose target is r times its size gives floor(r)
whole epochs of all its blocks and a part of one more, whose blocks are drawn in a permuted order until the target
is reached; in the block that crosses it, rows are taken in hash order up to the row that comes nearest. The number
of blocks of each source that each output shard gets is drawn from the multivariate hypergeometric distribution, by
splitting the shards in halves again and again, so that shards hold equally many blocks and every source's counts
add up exactly. Each shard then takes its own run of the source's permuted blocks, and its rows are ordered by a hash.

Defined results: a null source is a source of its own, last in order. Null text counts no word. Rows without words
are kept as often as their block is, and take nothing. Repeated rows share a hash and are taken alike. A source
without words has the target 0 and gives no rows. An empty table gives an empty result. All of the input's own
columns stay as they are, whatever they are called. There may be at most MAX_SOURCES sources, as a node of the tree holds
the counts of all of them in one row; more are an error. Only tables of sources and blocks are gathered (sources x
`blocks` rows); rows themselves are never sorted or shuffled, unless the plan is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import let, text_or_empty, uniform, whole_row, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCKS = 64
SHARDS = 16
MAX_SOURCES = 5000
#: Within a block, rows are ordered by the other bits of their hash; the top ones of these make a histogram first.
BLOCK_BITS, FINE_BITS = 12, 46


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> with ix, weight and target.

    Sources by code point, null last, get the weights in turn. Targets are proportional to weight and add up to all
    sizes, but none is above cap times its source's size: with sources in order of size / weight, the first k are
    capped, and the others share what is left by weight.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), F.col("ix"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        sizes.withColumn("ix", F.row_number().over(in_order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ix") % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(after))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("limit") / F.col("weight")).alias("need"), "ix", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "ix", "weight", "target")
    )


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The u-quantile of how many of `drawn` items out of `total` are among the `marked` ones."""
    least, most = F.greatest(F.lit(0), drawn - (total - marked)), F.least(marked, drawn)

    def step(logs: Column, k: Column) -> Column:
        ratio = (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
        return F.array_append(logs, F.element_at(logs, -1) + F.log(ratio))

    steps = F.when(most > least, F.sequence(least, most - 1)).otherwise(F.array().cast("array<bigint>"))
    def quantile(sums: Column) -> Column:
        return let(u * F.element_at(sums, -1), lambda at: least + F.size(F.filter(sums, lambda c: c <= at)).cast("long") - 1)

    def scaled(logs: Column) -> Column:
        return let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))

    sums = lambda mass: F.aggregate(mass, F.array(F.lit(0.0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return let(F.aggregate(steps, F.array(F.lit(0.0)), step), lambda logs: let(sums(scaled(logs)), quantile))


def split_quotas(counts: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """counts (ix, n) -> (ix, shard, quota): how many of the n blocks of each source each shard gets.

    A node of the tree holds the counts of all sources and a range of shards. Its left half's counts are drawn
    source by source, each from the hypergeometric distribution given what the sources before it took.
    """
    item = "array<struct<ix:int,n:bigint>>"
    nodes = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("ix").cast("int"), F.col("n").cast("long")))).cast(item).alias("items"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "items")
    depth = 0
    while (1 << depth) < shards:
        depth += 1
    for _ in range(depth):
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        blocks = F.aggregate("items", F.lit(0).cast("long"), lambda a, s: a + s["n"])
        room = F.floor(blocks * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")

        def draw(a: Column, s: Column) -> Column:
            u = uniform(F.lit(seed), F.col("lo"), F.col("hi"), s["ix"])
            x = _hypergeometric(a["rest"], s["n"], a["room"], u)
            taken = F.concat(a["taken"], F.array(F.struct(s["ix"].alias("ix"), x.alias("n"))))
            return F.struct((a["rest"] - s["n"]).alias("rest"), (a["room"] - x).alias("room"), taken.alias("taken"))

        # a draw is used three times below, so each source's is made once and kept in the list
        start = F.struct(F.col("blocks").alias("rest"), F.col("room"), F.array().cast(item).alias("taken"))
        drawn = nodes.select("lo", "hi", "items", mid.alias("mid"), blocks.alias("blocks"), room.alias("room")).withColumn("left", F.aggregate("items", start, draw)["taken"])
        right = F.zip_with("items", "left", lambda s, x: F.struct(s["ix"].alias("ix"), (s["n"] - x["n"]).alias("n")))
        leaf = F.array(F.struct("lo", "hi", F.col("items").alias("items")))
        halves = F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("items")), F.struct(F.col("mid").alias("lo"), "hi", right.alias("items")))
        nodes = drawn.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(leaf)).alias("node")).select("node.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("items").alias("item")).select("item.ix", "shard", F.col("item.n").alias("quota"))


class Mixture:
    """The plan of one mix; `sized` and `rows` tell what it does with every input row, `mixed` gives the mix."""

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap=MAX_EPOCHS, blocks=BLOCKS, shards=SHARDS, seed=0):
        self.docs, self.seed, self.blocks, self.shards, self.cap = docs, seed, blocks, shards, cap
        self._cols = (id_col, text_col, source_col)
        narrow = self._keyed(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "source", "id", "text")
        self._sized = written(narrow.select("id", "source", "block", "order", word_count(text_or_empty()).alias("size")), "mix-sizes")
        self.sources = written(source_targets(self._sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-sources")
        if self.sources.count() > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; group small ones first")
        self.plan = written(self._plan(), "mix-plan")

    def _keyed(self, df: DataFrame, source: str, id_: str, text: str) -> DataFrame:
        h = F.xxhash64(F.lit(self.seed), F.col(source), F.col(id_), F.col(text))
        bits = BLOCK_BITS + FINE_BITS
        return df.select("*", F.pmod(h, F.lit(self.blocks)).cast("int").alias("block"), F.shiftrightunsigned(h, 64 - bits).alias("order"))

    def _plan(self) -> DataFrame:
        seed = F.lit(self.seed)
        part = F.col("target") - F.col("epochs") * F.col("source_size")
        targets = self.sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("part", F.when(F.col("source_size") > 0, part).otherwise(0.0))
        sums = self._sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
        permuted = Window.partitionBy("ix").orderBy(F.xxhash64(seed, F.lit("part"), "ix", "block"), "block")
        blocks = (
            sums.join(targets, sums["source"].eqNullSafe(targets["source"])).drop(sums["source"])
            .withColumn("upto", F.sum("block_size").over(permuted))
            .withColumn("left", F.col("part") - (F.col("upto") - F.col("block_size")))
            .withColumn("whole", (F.col("upto") <= F.col("part")) & (F.col("part") > 0))
            .withColumn("crossing", ~F.col("whole") & (F.col("left") > 0))
        )
        blocks = written(blocks.select("source", "ix", "block", "epochs", "left", "whole", "crossing"), "mix-blocks")
        limits = self._limits(blocks.where("crossing").select(F.col("source").alias("at_source"), F.col("block").alias("at_block"), "ix", "left"))
        # every draw of a block is a token; the crossing block's last token holds a limit on the rows' order
        tokens = (
            blocks.join(limits, "ix", "left")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.cap))))
            .where((F.col("epoch") < F.col("epochs")) | ((F.col("epoch") == F.col("epochs")) & (F.col("whole") | F.col("crossing"))))
            .withColumn("limit", F.when((F.col("epoch") == F.col("epochs")) & F.col("crossing"), F.coalesce(F.col("limit"), F.lit(-1))))
        )
        order = Window.partitionBy("ix").orderBy(F.xxhash64(seed, F.lit("deal"), "ix", "block", "epoch"), "block", "epoch")
        tokens = written(tokens.select("source", "ix", "block", "epoch", "limit", F.row_number().over(order).cast("long").alias("rank")), "mix-tokens")
        quotas = split_quotas(tokens.groupBy("ix").agg(F.count(F.lit(1)).alias("n")), self.shards, self.seed)
        upto = F.sum("quota").over(Window.partitionBy("ix").orderBy("shard"))
        runs = quotas.withColumn("upto", upto).where("quota > 0").select("ix", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("rank"))
        dealt = tokens.join(runs, ["ix", "rank"])
        draws = F.sort_array(F.collect_list(F.struct("epoch", "shard", "limit")))
        return dealt.groupBy("source", "block").agg(draws.alias("draws"))

    def _limits(self, crossing: DataFrame) -> DataFrame:
        """(ix, limit): the largest order taken from each crossing block, by a histogram and then one of its bins."""
        same = self._sized["source"].eqNullSafe(crossing["at_source"]) & (self._sized["block"] == crossing["at_block"])
        rows = self._sized.join(crossing, same).select("ix", "order", "size", "left", F.shiftrightunsigned("order", FINE_BITS).alias("bin"))
        bins = rows.groupBy("ix", "bin").agg(F.sum("size").alias("bin_size"), F.first("left").alias("left"))
        bins = bins.withColumn("upto", F.sum("bin_size").over(Window.partitionBy("ix").orderBy("bin")))
        at = bins.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("bin_size") <= F.col("left"))).select("ix", "bin", (F.col("left") - F.col("upto") + F.col("bin_size")).alias("rest"))
        fine = rows.join(at, ["ix", "bin"]).groupBy("ix", "bin", "order").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        fine = fine.withColumn("upto", F.sum("n").over(Window.partitionBy("ix").orderBy("order")))
        nearest = fine.groupBy("ix").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), "order")).alias("best"), F.first("rest").alias("rest"), F.first("bin").alias("bin"))
        none = F.shiftleft(F.col("bin"), FINE_BITS) - 1  # nothing of the bin, if that is nearer
        return nearest.select("ix", F.when(F.col("best.off") < F.col("rest"), F.col("best.order")).otherwise(none).alias("limit"))

    def _drawn(self, keyed: DataFrame, source: str) -> DataFrame:
        """keyed (block, order and a source column) with `draws`: (epoch, shard) of each copy that the mix takes."""
        plan = self.plan.select(F.col("source").alias("at_source"), F.col("block").alias("at_block"), F.col("draws").alias("all_draws"))
        joined = keyed.join(plan, F.col(source).eqNullSafe(F.col("at_source")) & (F.col("block") == F.col("at_block")), "left")
        drawn = F.filter("all_draws", lambda d: d["limit"].isNull() | (F.col("order") <= d["limit"]))
        drawn = F.transform(F.coalesce(drawn, F.array().cast(plan.schema["all_draws"].dataType)), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard")))
        return joined.withColumn("draws", drawn).drop("all_draws", "at_source", "at_block", "block")

    def sized(self) -> DataFrame:
        """Of every input row the id, source, size (words) and draws, without reading the texts again."""
        return self._drawn(self._sized, "source").select("id", "source", "size", "draws")

    def rows(self) -> DataFrame:
        """Every input row as `row`, with its draws and its order."""
        id_, text, source = self._cols
        packed = self._keyed(self.docs.select(whole_row(self.docs)), f"row.`{source}`", f"row.`{id_}`", f"row.`{text}`")
        return self._drawn(packed, f"row.`{source}`")

    def mixed(self) -> DataFrame:
        """The mix: `row` once for each copy, with its `shard`, `epoch` and `place`, a random order within the shard."""
        one = self.rows().select("row", "order", F.explode("draws").alias("draw"))
        return one.select("row", "draw.shard", "draw.epoch", F.xxhash64(F.lit(self.seed), "order", "draw.epoch").alias("place"))


def shuffled(mixture: Mixture) -> DataFrame:
    """The mix with its input's columns alone: the rows of every partition by shard, and in random order within it, so
    that copies of a document don't stay side by side."""
    return mixture.mixed().sortWithinPartitions("shard", "place").select("row.*")


def write_shards(mixture: Mixture, path: str) -> None:
    """The mix as one folder of Parquet files for each shard, the rows of a file in random order."""
    mix = mixture.mixed().repartition(mixture.shards * 4, "shard", F.pmod("place", F.lit(64)))
    mix.sortWithinPartitions("shard", "place").select("row.*", F.col("shard").alias("mix_shard")).write.partitionBy("mix_shard").parquet(path)
