"""Reference sequences as tiles of one width, and the bases of places and ranges in them.

Pieces (chrom, at, piece) are stretches of a sequence as a file's lines have them, without gaps or overlaps; places count
from 0. Tiles (chrom, tile, lo, seq) hold `width` bases each and some bases before them, so that what looks to the left
seldom needs a second tile. Nothing holds a whole chromosome. Bases are upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HALO = 1 << 12, 64


def tiles(pieces: DataFrame, width: int = WIDTH, halo: int = HALO) -> DataFrame:
    """The tiles of pieces; lo is where a tile's seq begins, `halo` bases before it or at the start."""
    end = F.col("at") + F.length("piece")
    rows = pieces.where(F.length("piece") > 0).select("chrom", "at", "piece", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((end - 1 + halo) / width))).alias("tile"))
    lo = F.greatest(F.col("tile") * width - halo, F.lit(0))
    begin = F.greatest(lo, F.col("at"))
    n = F.least((F.col("tile") + 1) * width, end) - begin
    cut = rows.where(n > 0).select("chrom", "tile", lo.alias("lo"), begin.alias("at"), F.substr("piece", (begin - F.col("at") + 1).cast("int"), n.cast("int")).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])  # a tile is bounded
    whole = cut.groupBy("chrom", "tile", "lo").agg(F.upper(F.array_join(parts, "")).alias("seq"))
    return whole.where(F.length("seq") > F.col("tile") * width - F.col("lo"))  # not the halo of a tile past the end


def own_bases(of: DataFrame, width: int = WIDTH) -> DataFrame:
    """Tiles without the bases before them."""
    return of.select("chrom", "tile", F.substr("seq", (F.col("tile") * width - F.col("lo") + 1).cast("int")).alias("seq"))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """How many first letters a and b share, up to `most`: a search by halves of lengths. Both are worked out once, not in
    each step of the search."""
    steps = [1 << i for i in range(max(1, most).bit_length() - 1, -1, -1)]
    both = F.array(F.struct(F.left(a, F.lit(most)).alias("a"), F.left(b, F.lit(most)).alias("b")))
    longer = lambda p: lambda k, s: F.when((k + s <= F.length(p["a"])) & (k + s <= F.length(p["b"])) & (F.left(p["a"], k + s) == F.left(p["b"], k + s)), k + s).otherwise(k)
    return F.get(F.transform(both, lambda p: F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), longer(p))), F.lit(0))


def fetched(rows: DataFrame, of: DataFrame, keys: list[str], start: Column, end: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows (keys are unique, and so is chrom with them) with the bases of [start, end), which must fit in a row; bases
    beyond the sequence are left out, an unknown chrom or an empty range gives null. Other columns stay."""
    asked = rows.where(start < end).select(*keys, "chrom", start.alias("_s"), end.alias("_e"), F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))).alias("tile"))
    at = F.greatest(F.col("_s") - F.col("tile") * width, F.lit(0))
    part = F.substr("seq", (at + 1).cast("int"), (F.least(F.col("_e") - F.col("tile") * width, F.lit(width)) - at).cast("int"))
    parts = asked.join(own_bases(of, width), ["chrom", "tile"]).select(*keys, "tile", part.alias("part"))
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile", "part"))), lambda p: p["part"]), "").alias(name))
    return rows.join(whole, keys, "left")
