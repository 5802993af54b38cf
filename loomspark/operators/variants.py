"""Variant records in plain form (chrom, pos, ref, alt, qual, ord): one alternative allele a row, pos from 1, ord a number
that tells rows apart. Alleles are letters; other columns stay.

A null allele has the type `other` and stays as it is; a null quality ranks below all others; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.running import neighbour
from loomspark.operators import intervals as I

SITE = ("chrom", "pos", "ref", "alt")
PURINES, PYRIMIDINES = ("A", "G"), ("C", "T")
#: Positions to a chunk of the sweep for the nearest site.
CHUNK = 1 << 16


def _shared(a: Column, b: Column) -> Column:
    """How many first letters a and b share, at least one of each left over."""
    most = F.least(F.length(a), F.length(b)) - 1
    return F.when(most > 0, F.size(F.filter(F.sequence(F.lit(1), most), lambda i: F.left(a, i) == F.left(b, i)))).otherwise(0)


def trimmed(variants: DataFrame) -> DataFrame:
    """Alleles without the end and then the start that both share, each keeping a letter; pos moves with the start."""
    cut = variants.withColumn("_end", _shared(F.reverse("ref"), F.reverse("alt")))
    cut = cut.withColumns({c: F.left(c, F.length(c) - F.col("_end")) for c in ("ref", "alt")})
    cut = cut.withColumn("_begin", F.coalesce(_shared(F.col("ref"), F.col("alt")), F.lit(0)))
    moved = {c: F.substr(c, F.col("_begin") + 1) for c in ("ref", "alt")}
    return cut.withColumns({"pos": F.col("pos") + F.col("_begin"), **moved}).drop("_begin", "_end")


def kind() -> Column:
    """snp, mnp (several bases for as many), indel, ref (no change) or other; letters of either case."""
    n, m = F.length("ref"), F.length("alt")
    plain = F.col("ref").rlike("^[ACGTNacgtn]+$") & F.col("alt").rlike("^[ACGTNacgtn]+$")
    known = F.when(F.upper("ref") == F.upper("alt"), "ref").when(n != m, "indel").when(n == 1, "snp").otherwise("mnp")
    return F.when(plain, known).otherwise("other")


def transition() -> Column:
    """Whether a single-base change stays among purines or among pyrimidines."""
    ref, alt = F.upper("ref"), F.upper("alt")
    return (ref.isin(*PURINES) & alt.isin(*PURINES)) | (ref.isin(*PYRIMIDINES) & alt.isin(*PYRIMIDINES))


def report(variants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records of each kind, transitions, transversions and their ratio, of the whole table or of each group."""
    rows = variants.withColumns({"_kind": kind(), "_ts": transition()})
    kinds = [F.count_if(F.col("_kind") == k).alias(f"{k}s") for k in ("snp", "mnp", "indel", "other")]
    snp = F.col("_kind") == "snp"
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *kinds, F.count_if(snp & F.col("_ts")).alias("ts"), F.count_if(snp & ~F.col("_ts")).alias("tv"))
    return sums.withColumn("ts_tv", F.when(F.col("tv") > 0, F.round(F.col("ts") / F.col("tv"), 6)))


def ts_tv_by_quality(variants: DataFrame, width: float) -> DataFrame:
    """Transitions and transversions of each step of qualities of a width."""
    snps = variants.where(kind() == "snp")
    return snps.groupBy(F.floor(F.col("qual") / width).alias("step")).agg(F.count_if(transition()).alias("ts"), F.count_if(~transition()).alias("tv"))


def substitutions(variants: DataFrame) -> DataFrame:
    """How often each base, in upper case, stands for each other one."""
    return variants.where(kind() == "snp").groupBy(F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).agg(F.count(F.lit(1)).alias("n"))


def indel_lengths(variants: DataFrame) -> DataFrame:
    """How many indels gain (above zero) or lose each number of bases."""
    return variants.where(kind() == "indel").groupBy((F.length("alt") - F.length("ref")).alias("gain")).agg(F.count(F.lit(1)).alias("n"))


def density(variants: DataFrame, width: int) -> DataFrame:
    """Records of each window of a width that has any, and how many that is for a thousand bases."""
    n = variants.groupBy("chrom", F.floor((F.col("pos") - 1) / width).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("per_kb", F.round(F.col("n") * 1000 / width, 6))


def soft_filter(variants: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`filter`: the names of the rules that a record breaks, by `;` and in the rules' order, or PASS. A rule that is
    null of a record isn't broken. Keeping `filter = 'PASS'` makes it a hard filter."""
    broken = F.concat_ws(";", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return variants.withColumn("filter", F.when(broken == "", "PASS").otherwise(broken))


def spans(variants: DataFrame) -> DataFrame:
    """The bases of the reference that each record covers, from 0."""
    return variants.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), "ord")


def near_indels(variants: DataFrame, gap: int) -> DataFrame:
    """ord of the SNPs with at most gap bases between them and an indel."""
    wide = spans(variants.where(kind() == "indel")).withColumns({"start": F.col("start") - gap, "end": F.col("end") + gap})
    return I.overlapping(spans(variants.where(kind() == "snp")), wide).select("ord")


def crowded_indels(variants: DataFrame, gap: int) -> DataFrame:
    """ord of the indels that go where indels stand at most gap bases apart: of each such row of indels the one of the
    highest quality stays, of equal ones that of the smallest ord."""
    indels = variants.where(kind() == "indel")
    rows = I.islands(spans(indels), gap).join(indels.select("ord", "qual"), "ord")
    best = rows.groupBy("chrom", "island").agg(F.max(F.struct("qual", -F.col("ord")))["col2"].alias("best"))
    return rows.join(best, ["chrom", "island"]).where(F.col("ord") != -F.col("best")).select("ord")


def transferred(variants: DataFrame, notes: DataFrame, columns: Sequence[str], replace: bool = True) -> DataFrame:
    """Columns of notes (one row a site, else the least row by those columns) for the records of the same site and
    alleles. Without a note a record keeps its own value or null; replace=False keeps its own wherever it has one."""
    one = notes.groupBy(*SITE).agg(F.min(F.struct(*columns)).alias("_note"))
    own = {c: F.col(c) if c in variants.columns else F.lit(None) for c in columns}
    found = {c: F.coalesce(F.col("_note")[c], own[c]) if replace else F.coalesce(own[c], F.col("_note")[c]) for c in columns}
    return variants.join(one, list(SITE), "left").withColumns(found).drop("_note")


def concatenated(files: Sequence[DataFrame], once: bool = True) -> DataFrame:
    """The records of all files with `file`, their number from 0; once: of each site and alleles the first file's alone,
    and there the smallest ord."""
    all_rows = None
    for number, rows in enumerate(files):
        rows = rows.withColumn("file", F.lit(number))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    if not once:
        return all_rows
    rest = [c for c in all_rows.columns if c not in SITE]
    first = all_rows.groupBy(*SITE).agg(F.min_by(F.struct(*rest), F.struct("file", "ord")).alias("_row"))
    return first.select(*SITE, "_row.*").select(*all_rows.columns)


def joined_alleles(variants: DataFrame) -> DataFrame:
    """Records of one site and reference allele as one: its distinct alternatives in order and the highest quality."""
    one = variants.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"), F.max("qual").alias("qual"))
    return one.withColumn("alts", F.array_join("alts", ","))


def site_distances(variants: DataFrame) -> DataFrame:
    """Of each site (chrom, pos) the distance to the nearest other one on its chrom; null without any."""
    sites = variants.select("chrom", "pos").distinct()
    chunk = F.floor(F.col("pos") / CHUNK)
    before = neighbour(sites, ["chrom"], chunk, ["pos"], "pos", "before")
    both = neighbour(before, ["chrom"], chunk, ["pos"], "pos", "after", following=True)
    return both.select("chrom", "pos", F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos")).alias("distance"))


def set_genotypes(gt: DataFrame, which: Column, to: Column) -> DataFrame:
    """Genotypes (alts) for which `which` holds set to another value; where it is null they stay."""
    return gt.withColumn("alts", F.when(which, to).otherwise(F.col("alts")))
