"""One form for equivalent variant records: left alignment against a reference, atoms, and alleles split and joined.

Records are those of operators.variants (chrom, pos from 1, ref, alt, ord); the reference is a table of tiles. A record
is joined to the tile left of its change. How far it may shift is one comparison: the bases before the change, read
backwards, against the changed bases repeated; the shift is what both share. Only records whose shift reaches the edge of
their tile are joined to the tile before, in another round, so rounds count the longest repeat in tiles, on ever fewer
rows.

Alleles that aren't plain letters (symbolic ones, breakends, `*`, null) stay as they are. Reference bases are compared
in upper case. A record on a chrom that the reference lacks, or beyond its end, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.checks import required
from loomspark.operators.reference import HALO, WIDTH, common_prefix, fetched
from loomspark.scratch import discard, written

LETTERS = "^[ACGTNacgtn]+$"


def _plain() -> Column:
    return F.coalesce(F.col("ref").rlike(LETTERS) & F.col("alt").rlike(LETTERS), F.lit(False))


def _bare(variants: DataFrame) -> DataFrame:
    """Records with plain alleles as `at` (from 0), `gone` and `new`: what they share at the end, then at the start, is
    cut off even if nothing is left of an allele."""
    rows = variants.withColumns({"_r": F.upper("ref"), "_a": F.upper("alt")})
    most = 1 << 20
    tail = common_prefix(F.reverse("_r"), F.reverse("_a"), most)
    rows = rows.withColumn("_tail", tail)
    rows = rows.withColumns({c: F.left(c, F.length(c) - F.col("_tail")) for c in ("_r", "_a")})
    rows = rows.withColumn("_head", common_prefix(F.col("_r"), F.col("_a"), most))
    return rows.select(*variants.columns, (F.col("pos") - 1 + F.col("_head")).alias("at"), F.substr("_r", F.col("_head") + 1).alias("gone"), F.substr("_a", F.col("_head") + 1).alias("new"))


def left_aligned(variants: DataFrame, reference: DataFrame, width: int = WIDTH, halo: int = HALO) -> DataFrame:
    """variants with insertions and deletions moved as far to the left as they go and all alleles trimmed. Other columns
    stay. A change at the very start of a sequence is anchored by the base after it."""
    rows = written(_bare(variants.where(_plain())), "align-bare")  # a filter on its columns would repeat all their work
    reference = written(reference, "align-tiles")  # read in every round
    shifting = ((F.col("gone") == "") != (F.col("new") == "")) & (F.col("at") > 0)
    kept = rows.columns
    now, done = written(rows.where(shifting), "align-open"), []
    changed = F.concat("gone", "new")  # one of them is empty
    while True:
        tile = F.floor((F.col("at") - 1) / width)
        near = now.withColumn("tile", tile).join(reference, ["chrom", "tile"], "left")
        near = required(near, F.length("seq") >= F.col("at") - F.col("lo"), F.concat(F.lit("no reference for "), "chrom", F.lit(":"), F.col("pos").cast("string")))
        there = (F.col("at") - F.col("lo")).cast("int")
        before = F.reverse(F.left("seq", there))
        again = F.repeat(F.reverse(changed), (F.floor(there / F.length(changed)) + 1).cast("int"))
        near = near.withColumn("shift", common_prefix(before, again, width + halo))
        turned = near.withColumn("_n", F.col("shift") % F.length(changed))
        turn = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.right(c, F.col("_n")), F.left(c, F.length(c) - F.col("_n"))))
        moved = turned.withColumns({"open": (F.col("shift") == there) & (F.col("lo") > 0), "at": F.col("at") - F.col("shift"), "gone": turn("gone"), "new": turn("new")})
        moved = written(moved.select(*kept, "open"), "align-moved")
        discard(now)
        done.append(moved.where("NOT open").select(*kept))
        now = moved.where("open").select(*kept)
        if now.isEmpty():
            break
    pure = reduce(DataFrame.unionByName, [*done, rows.where(~shifting)])
    indel = (F.col("gone") == "") | (F.col("new") == "")
    anchor = F.when(~indel | ((F.col("gone") == "") & (F.col("new") == "")), F.lit(-1)).when(F.col("at") > 0, F.col("at") - 1).otherwise(F.length("gone"))
    based = pure.withColumn("_place", anchor.cast("long"))
    bare = based.where("_place < 0")
    need = based.where("_place >= 0").withColumn("tile", F.floor(F.col("_place") / width)).join(reference, ["chrom", "tile"], "left")
    need = required(need, F.length("seq") > F.col("_place") - F.col("lo"), F.concat(F.lit("no reference for "), "chrom", F.lit(":"), F.col("pos").cast("string")))
    base = F.substr("seq", (F.col("_place") - F.col("lo") + 1).cast("int"), F.lit(1))
    first = F.col("at") == 0
    need = need.withColumns({"ref": F.when(first, F.concat("gone", base)).otherwise(F.concat(base, "gone")), "alt": F.when(first, F.concat("new", base)).otherwise(F.concat(base, "new")), "pos": F.when(first, F.lit(1)).otherwise(F.col("at")).cast("long")})
    same = (F.col("gone") == "") & (F.col("new") == "")  # no change at all: the record as it was
    bare = bare.withColumns({"ref": F.when(same, F.upper("ref")).otherwise(F.col("gone")), "alt": F.when(same, F.upper("alt")).otherwise(F.col("new")), "pos": F.when(same, F.col("pos")).otherwise(F.col("at") + 1).cast("long")})
    odd = variants.where(~_plain()).withColumn("pos", F.col("pos").cast("long"))
    return need.select(*variants.columns).unionByName(bare.select(*variants.columns)).unionByName(odd)


def with_reference(variants: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """variants with `reference`: the bases that the sequence has where each record's ref stands. Comparing it with ref
    finds records to exclude; putting it in ref's place mends them."""
    return fetched(variants, reference, ["ord"], F.col("pos") - 1, F.col("pos") - 1 + F.length("ref"), "reference", width)


def atoms(variants: DataFrame) -> DataFrame:
    """Records with several changed bases as a record for each: SNPs where bases of the shorter length differ, and what
    one allele has beyond that as an insertion or deletion after its last base. `atom` numbers them from 0."""
    n = F.least(F.length("ref"), F.length("alt"))
    one = lambda c, i: F.substr(c, i, F.lit(1))
    snps = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: one(F.col("ref"), i) != one(F.col("alt"), i)), lambda i: F.struct((F.col("pos") + i - 1).cast("long").alias("pos"), one(F.col("ref"), i).alias("ref"), one(F.col("alt"), i).alias("alt")))
    rest = F.struct((F.col("pos") + n - 1).cast("long").alias("pos"), F.substr("ref", n).alias("ref"), F.concat(one(F.col("ref"), n), F.substr("alt", n + 1)).alias("alt"))
    whole = F.struct(F.col("pos").cast("long").alias("pos"), F.col("ref").alias("ref"), F.col("alt").alias("alt"))
    parts = F.concat(snps, F.when(F.length("ref") != F.length("alt"), F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0)))
    parts = F.when(_plain() & (F.size(parts) > 0), parts).otherwise(F.array(whole))
    out = variants.select(*[c for c in variants.columns if c not in ("pos", "ref", "alt")], F.posexplode(parts).alias("atom", "_v"))
    return out.withColumns({c: F.col("_v")[c] for c in ("pos", "ref", "alt")}).drop("_v")


def _genotype(j: Column | int, k: Column | int) -> Column:
    """Where the genotype of alleles j <= k stands among the diploid ones."""
    k = F.lit(k) if isinstance(k, int) else k
    return (k * (k + 1) / 2).cast("int") + j


def split_alleles(records: DataFrame, per_alt: Sequence[str] = (), per_allele: Sequence[str] = (), per_genotype: Sequence[str] = (), calls: Sequence[str] = (), other: int | None = 0) -> DataFrame:
    """Records with `alts`, a list, as one record for each with `alt` and `nth` (from 0). Lists with a value for each
    alternative, each allele or each diploid genotype keep those of the reference and this one; calls (lists of allele
    numbers) say 1 for this one and `other` for another one. A list of another length is an error; null stays null."""
    n = F.size("alts")
    sizes = {c: n for c in per_alt} | {c: n + 1 for c in per_allele} | {c: ((n + 1) * (n + 2) / 2).cast("int") for c in per_genotype}
    for c, size in sizes.items():
        records = required(records, F.col(c).isNull() | (F.size(c) == size), f"{c} has not a value for each")
    rows = records.select("*", F.posexplode("alts").alias("nth", "alt")).drop("alts")
    i = F.col("nth") + 1
    new = {c: F.slice(c, i, 1) for c in per_alt} | {c: F.array(F.get(c, F.lit(0)), F.get(c, i)) for c in per_allele}
    new |= {c: F.array(F.get(c, F.lit(0)), F.get(c, _genotype(0, i)), F.get(c, _genotype(i, i))) for c in per_genotype}
    called = lambda a: F.when(a == i, F.lit(1)).when(a > 0, F.lit(other).cast("int")).otherwise(a)
    keep = {c: F.when(F.col(c).isNotNull(), v) for c, v in new.items()} | {c: F.transform(c, called) for c in calls}
    return rows.withColumns(keep)


def join_alleles(records: DataFrame, keys: Sequence[str] = ("chrom", "pos", "ref"), per_alt: Sequence[str] = (), per_allele: Sequence[str] = (), per_genotype: Sequence[str] = (), calls: Sequence[str] = ()) -> DataFrame:
    """Records with one `alt` of the same keys as one with `alts` in the order of `ord`: lists as split_alleles() would
    have split them. A genotype of two alternatives has no value in them and is null; of two records that give a call
    an alternative the first one counts."""
    lists = [*per_alt, *per_allele, *per_genotype, *calls]
    rows = F.sort_array(F.collect_list(F.struct("ord", "alt", *lists)))  # a site has few alternatives
    some = records.groupBy(*keys).agg(rows.alias("_r"))
    r, n = F.col("_r"), F.size("_r")
    each = lambda c, k: F.transform(r, lambda x: F.get(x[c], F.lit(k)))
    new = {c: each(c, 0) for c in per_alt} | {c: F.concat(F.array(F.get(F.get(r, F.lit(0))[c], F.lit(0))), each(c, 1)) for c in per_allele}

    def genotypes(c: str) -> Column:
        row = lambda k: F.get(r, k - 1)[c]
        one = lambda j, k: F.when(k == 0, F.get(F.get(r, F.lit(0))[c], F.lit(0))).when(j == 0, F.get(row(k), F.lit(1))).when(j == k, F.get(row(k), F.lit(2)))
        return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.transform(F.sequence(F.lit(0), k), lambda j: one(j, k))))

    def call(c: str) -> Column:
        places = F.sequence(F.lit(0), F.size(F.get(r, F.lit(0))[c]) - 1)
        which = lambda p: F.array_position(F.transform(r, lambda x: F.coalesce(F.get(x[c], p), F.lit(-1))), F.lit(1)).cast("int")
        return F.transform(places, lambda p: F.when(which(p) > 0, which(p)).otherwise(F.get(F.get(r, F.lit(0))[c], p)))

    new |= {c: genotypes(c) for c in per_genotype} | {c: call(c) for c in calls}
    return some.select(*keys, F.get(r, F.lit(0))["ord"].alias("ord"), F.transform(r, lambda x: x["alt"]).alias("alts"), *[v.alias(c) for c, v in new.items()])
