"""Interval algebra over tables with chrom, start and end (0-based, half-open) and an order column.

Overlap joins meet in bins and keep each pair in one bin only. Bins have four widths: an interval is listed in bins of
the first width that it fits in FEW of, and in bins of the wider ones that the other table's intervals need, so a
contig-wide interval is a few rows too. Sweeps (merge, cluster, depth, nearest) are running maxima and sums over (chrom,
chunk of positions), so one chromosome is many tasks. Rows without a start overlap nothing, and are islands of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.checks import required
from loomspark.functions.running import neighbour, running
from loomspark.scratch import written

#: Width of the bins of overlap joins, and of the chunks of positions that sweeps scan apart.
BIN, CHUNK = 512, 1 << 16
#: Bins are so many times as wide at every level; an interval has at most FEW bins at its own level but the last one.
LEVELS, STEP, FEW = 4, 64, 8
#: A row keeps so many words of 64 bits at most for the distinct values that it meets.
WORDS = 16


def _bins(start: Column, end: Column, width) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def _level(width: int) -> Column:
    """The number of the first width of which the interval needs at most FEW bins."""
    length = F.col("end") - F.col("start")
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= width * STEP**k * FEW, k).otherwise(out)
    return out


def _levels(df: DataFrame, width: int) -> list[int]:
    return sorted(r[0] for r in df.select(_level(width)).distinct().collect())  # at most LEVELS


def _at_level(bins: Column, level: int) -> Column:
    return F.transform(bins, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))


def _binned(df: DataFrame, name: str, on: Sequence[str], width: int, levels: Sequence[int]) -> DataFrame:
    """df as a struct, in the bins of its own level and of those above it among levels."""
    own = _level(width)
    bins = F.lit(None).cast("array<struct<level:int,bin:bigint>>")
    for k in reversed(levels):
        here = _at_level(_bins(F.col("start"), F.col("end"), width * STEP**k), k)
        bins = F.when(own <= k, F.concat(here, F.coalesce(bins, F.array().cast("array<struct<level:int,bin:bigint>>")))).otherwise(bins)
    listed = df.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return listed.select(F.struct("*").alias(name), *[F.col(c).alias(f"_{c}") for c in on], own.alias(f"_{name}"), F.explode(bins).alias("_at")).select("*", "_at.*").drop("_at")


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str] = ("chrom",), width: int = BIN) -> DataFrame:
    """Pairs of rows of a and b that share at least one base, as structs `a` and `b`. An empty interval overlaps what
    holds its position inside. A pair meets at the level of the wider one of the two."""
    a, b = (x if hasattr(x, "_written_at") else written(x, "intervals") for x in (a, b))  # read for the levels and the join
    levels = sorted({*_levels(a, width), *_levels(b, width)})
    pairs = _binned(a, "a", on, width, levels).join(_binned(b, "b", on, width, levels), [*[f"_{c}" for c in on], "level", "bin"])
    touch = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    if len(levels) > 1:
        touch &= F.col("level") == F.greatest("_a", "_b")
    widths = F.element_at(F.array(*[F.lit(width * STEP**k) for k in range(LEVELS)]), F.col("level") + 1) if len(levels) > 1 else F.lit(width * STEP ** (levels or [0])[0])
    once = F.col("bin") == F.floor(F.greatest("a.start", "b.start") / widths)
    return pairs.where(touch & once).select("a", "b")


def counted(a: DataFrame, files: dict[str, DataFrame], covered: bool = False) -> DataFrame:
    """(ord, n_<file>, bases_<file>): for each row of a how many rows of each table overlap it, if any does, and, if
    `covered`, how many of its bases they cover. Starts are at most ends; overlap is that of overlaps().

    No pairs are made. Rows of b overlap a if they begin before its end, less those that end by its start, so sums over
    positions are enough: a bin of positions is a row with the sums up to each of its positions where something begins or ends, at most
    BIN of them. A row of a is joined to the bins of its own start and end only, and looks its positions up by halves.
    """
    a = a if hasattr(a, "_written_at") else written(a.select("chrom", "start", "end", "ord"), "intervals")
    whole = lambda df: df.where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    edge = lambda pos, x: F.struct(F.col(pos).cast("long").alias("pos"), *[v.cast("long").alias(k) for k, v in {**dict.fromkeys(("begun", "ended", "empty", "open", "at"), F.lit(0)), **x}.items()])
    events, sums = None, []
    for i, (name, df) in enumerate(files.items()):
        df = whole(df).select("chrom", "start", "end")
        bare = (F.col("start") == F.col("end")).cast("long")
        rows = df.select("chrom", F.explode(F.array(edge("start", {"begun": F.lit(1)}), edge("end", {"ended": 1 - bare, "empty": bare}))).alias("e"))
        if covered:
            flat = merge(df.withColumn("ord", F.lit(0)))
            rows = rows.unionAll(flat.select("chrom", F.explode(F.array(edge("start", {"open": F.lit(1), "at": -F.col("start")}), edge("end", {"open": F.lit(-1), "at": F.col("end")}))).alias("e")))
        own = [f"{c}_{i}" for c in ("begun", "ended", "empty", *(("open", "at") if covered else ()))]
        rows = rows.groupBy("chrom", F.col("e.pos").alias("pos")).agg(*[F.sum(f"e.{c[: c.rindex('_')]}").alias(c) for c in own])
        events = rows if events is None else events.unionByName(rows, allowMissingColumns=True)
        sums += own
    marks = written(events.groupBy("chrom", "pos").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).withColumn("bin", F.floor(F.col("pos") / BIN)), "marks")
    probes = whole(a).select("chrom", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "ord")
    bins = [F.floor(F.col(c) / BIN) for c in "se"]
    probes = probes.withColumn("bin", F.explode(F.when(bins[0] == bins[1], F.array(bins[0])).otherwise(F.array(*bins))))
    none = [F.lit(0).cast("long").alias(c) for c in sums]
    each = marks.groupBy("chrom", "bin").agg(*[F.sum(c).alias(c) for c in sums]).unionByName(probes.select("chrom", "bin").distinct().select("chrom", "bin", *none))
    each = each.groupBy("chrom", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    before = running(each, ["chrom"], F.floor(F.col("bin") / 4096), ["bin"], {f"b_{c}": ("sum", F.col(c)) for c in sums}, exclusive=True)
    before = before.select("chrom", "bin", (F.col("bin") * BIN - 1).alias("pos"), *[F.col(f"b_{c}").alias(c) for c in sums])
    upto = Window.partitionBy("chrom", "bin").orderBy("pos")
    rows = marks.select(before.columns).unionByName(before).select("chrom", "bin", "pos", *[F.sum(c).over(upto).alias(c) for c in sums])
    table = written(rows.groupBy("chrom", "bin").agg(F.sort_array(F.collect_list(F.struct("pos", *sums))).alias("marks")), "marks")  # at most BIN + 1 in a list
    steps = F.array(*[F.lit(1 << k) for k in range(BIN.bit_length(), -1, -1)])
    place = lambda x: F.aggregate(steps, F.lit(0), lambda k, n: F.when((k + n <= F.size("marks")) & (F.get("marks", k + n - 1)["pos"] <= x), k + n).otherwise(k)) - 1
    s, e, here = F.col("s"), F.col("e"), F.col("bin")
    places = {"_s": (here == bins[0], s), "_z": ((here == bins[0]) & (s == e), s - 1), "_b": (here == bins[1], e - 1), "_e": ((here == bins[1]) & F.lit(covered), e)}
    met = probes.join(table, ["chrom", "bin"]).withColumns({n: F.when(there, place(x)) for n, (there, x) in places.items()})
    at = lambda n, c: F.coalesce(F.get("marks", F.col(n))[c], F.lit(0))
    out = {}
    for i, name in enumerate(files):
        out[f"n_{name}"] = at("_b", f"begun_{i}") - at("_s", f"ended_{i}") - F.when(s == e, at("_z", f"empty_{i}")).otherwise(at("_s", f"empty_{i}"))
        if covered:
            out[f"bases_{name}"] = at("_e", f"open_{i}") * e + at("_e", f"at_{i}") - at("_s", f"open_{i}") * s - at("_s", f"at_{i}")
    return met.select("ord", *[v.alias(n) for n, v in out.items()]).groupBy("ord").agg(*[F.sum(n).alias(n) for n in out])


def overlap_length() -> Column:
    """Shared bases of a pair from overlaps()."""
    return F.least("a.end", "b.end") - F.greatest("a.start", "b.start")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every overlap of a row of a with one of b, clipped, with both order numbers."""
    return overlaps(a, b).select("a.chrom", F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"), F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"))


def overlapping(a: DataFrame, b: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows of a with (or without) any overlap in b."""
    a = written(a, "intervals")
    hit = overlaps(a, b).select(F.col("a.ord").alias("ord")).distinct()
    return a.join(hit, "ord", "left_semi" if wanted else "left_anti")


def reported(a: DataFrame, b: DataFrame, of_a: float = 0.0, of_b: float = 0.0, either: bool = False, strand: str | None = None) -> DataFrame:
    """Pairs from overlaps() that share at least the fraction of_a of a's row and of_b of b's (or one of the two with
    `either`), on the `same` or the `opposite` strand if wanted, with `shared`, the shared bases."""
    pairs = overlaps(a, b).withColumn("shared", overlap_length())
    enough_a = F.col("shared") >= of_a * (F.col("a.end") - F.col("a.start"))
    enough_b = F.col("shared") >= of_b * (F.col("b.end") - F.col("b.start"))
    pairs = pairs.where((enough_a | enough_b) if either else (enough_a & enough_b))
    if strand:
        alike = F.col("a.strand") == F.col("b.strand")
        pairs = pairs.where(alike if strand == "same" else ~alike)
    return pairs


def all_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with each of b that overlaps it and the shared bases; without any, b_ord is null and shared 0. Pairs
    are handed on as they are found; which rows have none is counted."""
    a, b = written(a.select("chrom", "start", "end", "ord"), "intervals"), written(b.select("chrom", "start", "end", "ord"), "intervals")
    hits = reported(a, b).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "shared")
    alone = a.select("ord").join(counted(a, {"b": b}).where("n_b > 0"), "ord", "left_anti")
    return hits.unionByName(alone.select(F.col("ord").alias("a_ord"), F.lit(None).cast(hits.schema["b_ord"].dataType).alias("b_ord"), F.lit(0).cast(hits.schema["shared"].dataType).alias("shared")))


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of a how many rows of b overlap it."""
    a = written(a, "intervals")
    hits = overlaps(a, b).groupBy(F.col("a.ord").alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    return a.select("ord").join(hits, "ord", "left").na.fill(0, ["n"])


def overlap_table(a: DataFrame, b: DataFrame, genome: DataFrame) -> DataFrame:
    """The contingency table of an overlap test: pairs that overlap, rows of a alone, of b alone, and how many further
    intervals of the mean length of both the genome could hold."""
    a, b = (written(x.select("chrom", "start", "end", "ord"), "intervals") for x in (a, b))
    length = F.avg(F.col("end") - F.col("start"))
    rows = a.agg(F.count(F.lit(1)).alias("na"), length.alias("la")).join(b.agg(F.count(F.lit(1)).alias("nb"), length.alias("lb"))).join(genome.agg(F.sum("size").alias("bases")))
    of_a, of_b = (counted(x, {"y": y}) for x, y in ((a, b), (b, a)))
    found = of_a.agg(F.coalesce(F.sum("n_y"), F.lit(0)).alias("n_both"), F.count_if(F.col("n_y") > 0).alias("ha")).join(of_b.agg(F.count_if(F.col("n_y") > 0).alias("hb")))
    one = rows.join(found)  # one row each
    possible = F.floor(F.col("bases") / (F.col("la") + F.col("lb")))
    only_a, only_b = F.col("na") - F.col("ha"), F.col("nb") - F.col("hb")
    return one.select("n_both", only_a.alias("only_a"), only_b.alias("only_b"), F.greatest(F.lit(0), possible - F.col("n_both") - only_a - only_b).alias("neither"))


def _sized(df: DataFrame, genome: DataFrame) -> DataFrame:
    """df with the size of its chrom; a chrom that the genome lacks is an error."""
    known = df.join(genome, "chrom", "left")
    return required(known, F.col("size").isNotNull(), F.concat(F.lit("not in the genome: "), F.coalesce("chrom", F.lit("null"))))


def flank(df: DataFrame, genome: DataFrame, left: int, right: int, stranded: bool = False) -> DataFrame:
    """The stretches beside each row, clipped to the chrom; empty ones are left out. `side` is left or right."""
    minus = (F.col("strand") == "-") if stranded else F.lit(False)
    before, after = F.when(minus, right).otherwise(left), F.when(minus, left).otherwise(right)
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.greatest(F.lit(0), F.col("start") - before).alias("s"), F.col("start").alias("e")),
        F.struct(F.lit("right").alias("side"), F.col("end").alias("s"), F.least(F.col("size"), F.col("end") + after).alias("e")),
    )
    cut = _sized(df, genome).select("chrom", "ord", F.explode(sides).alias("f"))
    return cut.select("chrom", F.col("f.s").alias("start"), F.col("f.e").alias("end"), "ord", "f.side").where("start < end")


def union_graphs(files: dict[str, DataFrame], filler: float = 0) -> DataFrame:
    """Tables of scored intervals that don't overlap within a table: the stretches between all their ends, with each
    table's score there, or the filler. The score is that of the interval that began last, as it was given."""
    graphs = {n: df.select("chrom", "start", "end", "score") for n, df in files.items()}
    events = None
    for name, df in graphs.items():
        edges = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d"), F.col("score").alias("v")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"), F.lit(None).alias("v")))
        one = df.select("chrom", F.lit(name).alias("file"), F.explode(edges).alias("e")).select("chrom", "file", "e.*")
        events = one if events is None else events.unionByName(one)
    begun = F.max(F.when(F.col("d") == 1, F.struct("pos", "v")))
    by_pos = events.groupBy("chrom", "pos").pivot("file", list(graphs)).agg(F.sum("d").alias("d"), begun.alias("v")).na.fill(0)
    chunk = F.floor(F.col("pos") / CHUNK)
    deep = running(by_pos, ["chrom"], chunk, ["pos"], {f"_{n}_{x}": (how, F.col(f"{n}_{x}")) for n in graphs for x, how in (("d", "sum"), ("v", "max"))})
    ended = neighbour(deep, ["chrom"], chunk, ["pos"], "pos", "end", following=True)
    some = F.greatest(F.lit(0), *[F.col(f"_{n}_d") for n in graphs]) > 0
    scores = [F.when(F.col(f"_{n}_d") > 0, F.col(f"_{n}_v")["v"]).otherwise(filler).alias(n) for n in graphs]
    return ended.where(some & F.col("end").isNotNull()).select("chrom", F.col("pos").alias("start"), "end", *scores)


def islands(df: DataFrame, gap: int = 0, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """df with `island`: rows that overlap, touch or are at most gap apart have the same number within their chrom."""
    chunk = F.floor(F.col("start") / CHUNK)
    order = ["start", "end", "ord"]
    reach = F.when(F.col("start").isNotNull(), F.col("end"))
    seen = running(df, by, chunk, order, {"_reach": ("max", reach)}, exclusive=True)
    new = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0)
    return running(seen, by, chunk, order, {"island": ("sum", new)}).drop("_reach")


def merge(df: DataFrame, gap: int = 0, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """The union of the intervals: what overlaps or touches is one."""
    return islands(df, gap, by).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """What of each chrom of the genome (chrom, size) no interval covers."""
    merged = merge(df)
    ends = merged.select("chrom", "start", "end").unionAll(genome.select("chrom", F.col("size").alias("start"), F.col("size").alias("end")))
    gaps = neighbour(ends, ["chrom"], F.floor(F.col("start") / CHUNK), ["start", "end"], "end", "before")
    return gaps.select("chrom", F.coalesce("before", F.lit(0)).alias("start"), F.col("start").alias("end")).where("start < end")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What of each row of a no row of b covers, as fragments in order (chrom, start, end, ord)."""
    a, cut = written(a.select("ord", "chrom", "start", "end"), "intervals"), written(merge(b).select("chrom", "start", "end"), "merged")
    hits = overlaps(a, cut).select("a.ord", F.struct(F.greatest("a.start", "b.start").alias("s"), F.least("a.end", "b.end").alias("e")).alias("cut"))
    cuts = hits.groupBy("ord").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    rows = a.select("ord", "chrom", "start", "end").join(cuts, "ord", "left")
    inner = F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    starts = F.concat(F.array(F.col("start").cast("long")), F.transform(inner, lambda c: c["e"]))
    ends = F.concat(F.transform(inner, lambda c: c["s"]), F.array(F.col("end").cast("long")))
    pieces = rows.select("ord", "chrom", F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("p"))
    return pieces.select("chrom", "p.start", "p.end", "ord").where("start < end")


def window_pairs(a: DataFrame, b: DataFrame, left: int, right: int, stranded: bool = False) -> DataFrame:
    """Pairs of a row of a, widened by left and right (the other way on '-' if stranded), with what it overlaps in b."""
    minus = (F.col("strand") == "-") if stranded else F.lit(False)
    wide = a.select(
        "chrom", "ord", F.greatest(F.lit(0), F.col("start") - F.when(minus, right).otherwise(left)).alias("start"), (F.col("end") + F.when(minus, left).otherwise(right)).alias("end")
    )
    return overlaps(wide, b).select("a.chrom", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"))


def closest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of a its nearest rows of b, all ties: (a_ord, b_ord, distance). Overlap is distance 0; otherwise
    the gap and one; without any row on the chrom b_ord is null and the distance -1. Pairs that overlap are handed on as
    they are found; which rows have none is counted."""
    a, b = (written(x.select("chrom", "start", "end", "ord"), "intervals") for x in (a, b))
    hits = overlaps(a, b).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), F.lit(0).cast("long").alias("distance"))
    free = written(a.join(counted(a, {"b": b}).where("n_b > 0"), "ord", "left_anti"), "free")

    def nearest(b_pos: Column, a_pos: Column, sign: int) -> DataFrame:
        """The last of b's positions (times sign) up to each of a's."""
        marks = b.select("chrom", (b_pos * sign).alias("pos"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("ord")).distinct()
        probes = free.select("chrom", (a_pos * sign).alias("pos"), F.lit(1).alias("side"), F.col("ord").cast("long"))
        both = marks.unionByName(probes)
        found = running(both, ["chrom"], F.floor(F.col("pos") / CHUNK), ["pos", "side", "ord"], {"at": ("max", F.when(F.col("side") == 0, F.col("pos")))})
        return found.where("side = 1 AND at IS NOT NULL").select("ord", "chrom", (F.col("at") * sign).alias("b_pos"), (F.col("pos") - F.col("at") + 1).alias("distance"))

    before = nearest(F.col("end"), F.col("start"), 1).withColumn("way", F.lit("end"))
    after = nearest(F.col("start"), F.col("end"), -1).withColumn("way", F.lit("start"))
    sides = written(before.unionByName(after), "sides")
    least = sides.groupBy("ord").agg(F.min("distance").alias("least"))
    best = sides.join(least, "ord").where("distance = least")
    ends = b.select("chrom", F.col("ord").alias("b_ord"), F.explode(F.array(F.struct(F.lit("end").alias("way"), F.col("end").alias("b_pos")), F.struct(F.lit("start").alias("way"), F.col("start").alias("b_pos")))).alias("m"))
    ties = best.join(ends.select("chrom", "b_ord", "m.way", "m.b_pos"), ["chrom", "way", "b_pos"]).select(F.col("ord").alias("a_ord"), "b_ord", "distance").distinct()
    found = hits.unionByName(ties)
    none = free.join(least, "ord", "left_anti").select(F.col("ord").alias("a_ord"), F.lit(None).cast("long").alias("b_ord"), F.lit(-1).cast("long").alias("distance"))
    return found.unionByName(none)


def depth_runs(df: DataFrame) -> DataFrame:
    """Runs of equal depth above nothing: chrom, start, end and depth. Each interval is two events, however long."""
    edges = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    events = df.select("chrom", F.explode(edges).alias("e")).groupBy("chrom", "e.pos").agg(F.sum("e.d").alias("d")).where("d <> 0")
    chunk = F.floor(F.col("pos") / CHUNK)
    deep = running(events, ["chrom"], chunk, ["pos"], {"depth": ("sum", F.col("d"))})
    ended = neighbour(deep, ["chrom"], chunk, ["pos"], "pos", "end", following=True)
    return ended.where("depth > 0 AND end IS NOT NULL").select("chrom", F.col("pos").alias("start"), "end", "depth")


def genome_histogram(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Bases of each chrom at each depth, 0 included, and their fraction."""
    runs = written(depth_runs(df).groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases")), "depths")
    covered = runs.groupBy("chrom").agg(F.sum("bases").alias("covered"))
    bare = genome.join(covered, "chrom", "left").select("chrom", F.lit(0).cast("long").alias("depth"), (F.col("size") - F.coalesce("covered", F.lit(0))).alias("bases"))
    return runs.unionByName(bare).join(genome, "chrom").select("chrom", "depth", "bases", (F.col("bases") / F.col("size")).alias("fraction"))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of a: how many rows of b overlap it, its covered bases, length and covered fraction."""
    a, b = (written(x.select("chrom", "start", "end", "ord"), "intervals") for x in (a, b))
    found = counted(a, {"b": b}, covered=True).select("ord", F.col("n_b").alias("n"), F.col("bases_b").alias("bases"))
    rows = a.select("ord", (F.col("end") - F.col("start")).alias("length")).join(found, "ord", "left").na.fill(0, ["n", "bases"])
    return rows.withColumn("fraction", F.when(F.col("length") > 0, F.col("bases") / F.col("length")).otherwise(0.0))


def map_values(a: DataFrame, b: DataFrame, reducers: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """For each row of a the reducers (over columns of `b`) of the rows that overlap it, and for each name in `distinct`
    how many distinct values a column of b has among them; null without any.

    Distinct values are numbered, and the numbers met are bits of one row of a, so a row is all that leaves a task. Where
    a column has over 64 * WORDS values, its pairs are exchanged."""
    a, b = written(a, "intervals"), written(b, "intervals")
    found, many = dict(reducers), {}
    marked = b
    for name, c in (distinct or {}).items():
        values = written(b.where(F.col(c).isNotNull()).select(c).distinct(), "values")
        if values.count() > 64 * WORDS:
            many[name] = F.count_distinct(f"b.{c}")
            continue
        codes = values.select(c, (F.row_number().over(Window.orderBy(c)) - 1).alias(f"_code_{name}"))
        marked = marked.join(codes, c, "left")
        words = range(-(-values.count() // 64))
        code = F.col(f"b._code_{name}")
        bits = [F.bit_count(F.coalesce(F.bit_or(F.when(F.shiftright(code, 6) == w, F.expr(f"shiftleft(1L, b._code_{name} % 64)"))), F.lit(0).cast("long"))) for w in words]
        found[name] = sum(bits, F.lit(0)).cast("long")
    marked = marked if marked is b else written(marked, "marked")
    out = a.select("ord")
    for columns in (found, many):
        if columns:
            out = out.join(overlaps(a, marked).groupBy("a.ord").agg(*[c.alias(n) for n, c in columns.items()]), "ord", "left")
    return out


def annotate(a: DataFrame, files: dict[str, DataFrame]) -> DataFrame:
    """For each row of a and each table: how many rows overlap it and the fraction of it that they cover (0 of an empty
    row), one pass for all tables."""
    a = written(a.select("chrom", "start", "end", "ord"), "intervals")
    files = {n: written(df.select("chrom", "start", "end"), "tagged") for n, df in files.items()}
    rows = a.select("ord", (F.col("end") - F.col("start")).alias("_len")).join(counted(a, files, covered=True), "ord", "left")
    share = lambda n: F.round(F.coalesce(f"bases_{n}", F.lit(0)) / F.col("_len"), 6)
    cols = [F.coalesce(f"n_{n}", F.lit(0)).alias(f"{n}_n") for n in files] + [F.when(F.col("_len") > 0, share(n)).otherwise(0.0).alias(f"{n}_fraction") for n in files]
    return rows.select("ord", *cols)


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases in both, bases in either, their ratio (as 32-bit float) and the number of shared pieces."""
    ma, mb = (written(merge(x).select("chrom", "start", "end"), "merged") for x in (a, b))
    both = overlaps(ma, mb).agg(F.coalesce(F.sum(overlap_length()), F.lit(0)).alias("intersection"), F.count(F.lit(1)).alias("n"))
    length = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    sizes = ma.unionAll(mb).agg(length.alias("sum"))
    row = both.join(sizes)  # one row each
    union = F.col("sum") - F.col("intersection")
    return row.select("intersection", union.alias("union"), F.when(union > 0, (F.col("intersection") / union).cast("float").cast("double")).otherwise(float("nan")).alias("jaccard"), "n")


def spacing(df: DataFrame) -> DataFrame:
    """Distance of each row from the one before it on its chrom, by order of start: negative by how much they overlap,
    0 if they touch."""
    return neighbour(df, ["chrom"], F.floor(F.col("start") / CHUNK), ["start", "end", "ord"], "end", "before").select("ord", (F.col("start") - F.col("before")).alias("distance"))


def slop(df: DataFrame, genome: DataFrame, left: int, right: int, stranded: bool = False) -> DataFrame:
    """Rows widened to both sides and clipped to the chrom."""
    minus = (F.col("strand") == "-") if stranded else F.lit(False)
    start = F.col("start") - F.when(minus, right).otherwise(left)
    end = F.col("end") + F.when(minus, left).otherwise(right)
    return _sized(df, genome).withColumns({"start": F.least(F.greatest(start, F.lit(0)), F.col("size")), "end": F.greatest(F.least(end, F.col("size")), F.lit(0))}).drop("size")


def shift(df: DataFrame, genome: DataFrame, by: int) -> DataFrame:
    """Rows moved along the chrom and clipped to it, keeping at least one base."""
    start = F.greatest(F.lit(0), F.least(F.col("start") + by, F.col("size") - 1))
    end = F.greatest(F.lit(1), F.least(F.col("end") + by, F.col("size")))
    return _sized(df, genome).withColumns({"start": start, "end": end}).drop("size")


def make_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of a size and step over each row, the last ones clipped."""
    at = F.explode(F.when(F.col("start") < F.col("end"), F.sequence(F.col("start"), F.col("end") - 1, F.lit(step).cast("long"))))
    return df.select("chrom", "ord", at.alias("start"), F.col("end").alias("_end")).select("chrom", "ord", "start", F.least(F.col("start") + size, F.col("_end")).alias("end"))


def partitions(files: dict[str, DataFrame]) -> DataFrame:
    """The stretches between all ends of several tables' intervals, with how often each table covers them."""
    events = None
    for name, df in files.items():
        edges = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
        one = df.select("chrom", F.lit(name).alias("file"), F.explode(edges).alias("e")).select("chrom", "file", "e.pos", "e.d")
        events = one if events is None else events.unionByName(one)
    by_pos = events.groupBy("chrom", "pos").pivot("file", list(files)).agg(F.sum("d")).na.fill(0)
    chunk = F.floor(F.col("pos") / CHUNK)
    deep = running(by_pos, ["chrom"], chunk, ["pos"], {f"{n}_depth": ("sum", F.col(n)) for n in files})
    ended = neighbour(deep, ["chrom"], chunk, ["pos"], "pos", "end", following=True)
    some = F.greatest(F.lit(0), *[F.col(f"{n}_depth") for n in files]) > 0
    return ended.where(some & F.col("end").isNotNull()).select("chrom", F.col("pos").alias("start"), "end", *[f"{n}_depth" for n in files])


def relative_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """For midpoints of a between two of b: the distance to the nearer one over the distance of the two, counted in
    hundredths."""
    mid = lambda df: df.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("pos"))
    marks = mid(b).distinct().withColumn("ref", F.lit(True)).withColumn("n", F.lit(1).cast("long"))
    probes = mid(a).groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("ref", F.lit(False))
    both = marks.unionByName(probes)
    chunk = F.floor(F.col("pos") / CHUNK)
    seen = running(both, ["chrom"], chunk, ["pos", F.col("ref").desc()], {"prev": ("max", F.when(F.col("ref"), F.col("pos")))})
    back = seen.withColumn("neg", -F.col("pos"))
    seen = running(back, ["chrom"], F.floor(F.col("neg") / CHUNK), ["neg", F.col("ref").desc()], {"next": ("max", F.when(F.col("ref"), F.col("neg")))})
    inside = seen.where("NOT ref AND prev IS NOT NULL AND next IS NOT NULL").withColumn("next", -F.col("next"))
    near = F.least(F.col("pos") - F.col("prev"), F.col("next") - F.col("pos"))
    span = F.col("next") - F.col("prev")
    hundredth = F.when(span > 0, F.floor(near * 100 / span)).otherwise(0).cast("long")
    return inside.groupBy(hundredth.alias("hundredth")).agg(F.sum("n").alias("count"))


def binned_means(df: DataFrame, width: int) -> DataFrame:
    """Mean depth of each bin of a width that any interval touches."""
    runs = depth_runs(df)
    cut = runs.select("chrom", "start", "end", "depth", F.explode(_bins(F.col("start"), F.col("end"), width)).alias("bin"))
    inside = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    return cut.groupBy("chrom", "bin").agg((F.sum(inside * F.col("depth")) / width).alias("mean"))


def smoothed(df: DataFrame, bins: int) -> DataFrame:
    """(chrom, bin, mean) with the mean over as many bins to each side; bins that aren't there count as 0."""
    w = Window.partitionBy("chrom").orderBy("bin").rangeBetween(-bins, bins)
    return df.withColumn("smooth", F.sum("mean").over(w) / (2 * bins + 1))


def lifted(df: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """For each row where it lies in another assembly: to_chrom, to_start, to_end, way and a status.

    blocks are the stretches of chains without gaps: chrom, start, end, chain, to_chrom, to_start (of its first base
    there, on the plus strand) and way. A row is `lifted` if one chain alone maps at least the share `least` of its
    bases, from the first to the last mapped one; else it is `deleted` (nothing maps), `partly` (too little of it does),
    `split` (over several chains) or `several` (more than one chain maps enough) and has no place.
    """
    df = written(df.select("chrom", "start", "end", "ord"), "intervals")
    pairs = overlaps(df, blocks)
    start, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    back = F.col("b.way") == "-"
    first = F.when(back, F.col("b.end") - end).otherwise(start - F.col("b.start")) + F.col("b.to_start")
    pieces = pairs.select("a.ord", (F.col("a.end") - F.col("a.start")).alias("length"), "b.chain", "b.to_chrom", "b.way", first.alias("to_start"), (first + end - start).alias("to_end"))
    chains = pieces.groupBy("ord", "chain", "to_chrom", "way").agg(
        F.min("to_start").alias("to_start"), F.max("to_end").alias("to_end"), (F.sum(F.col("to_end") - F.col("to_start")) >= F.first("length") * least).alias("enough")
    )
    place = F.struct("to_chrom", "to_start", "to_end", "way")
    found = chains.groupBy("ord").agg(F.count(F.lit(1)).alias("chains"), F.count_if("enough").alias("good"), F.max(F.when(F.col("enough"), place)).alias("place"))
    status = F.when(F.col("chains").isNull(), "deleted").when(F.col("good") == 1, "lifted").when(F.col("good") > 1, "several").when(F.col("chains") > 1, "split").otherwise("partly")
    out = df.select("ord").join(found, "ord", "left").withColumn("status", status)
    return out.select("ord", *[F.when(F.col("status") == "lifted", F.col("place")[c]).alias(c) for c in ("to_chrom", "to_start", "to_end", "way")], "status")
