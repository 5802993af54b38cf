"""Sequence operators: statistics, k-mers, dereplication, FracMinHash sketches, trimming and per-cycle quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import dna


def stats(seqs: DataFrame, by: str) -> DataFrame:
    """Number, length sum, least, mean, most and N50 of each group's sequences (column seq).

    The N50 is found over one row for each length, so a group of any number of sequences stays small.
    """
    lengths = seqs.groupBy(by, F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    longest = Window.partitionBy(by).orderBy(F.col("len").desc())
    total = F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(by))
    upto = lengths.withColumns({"half": total / 2, "upto": F.sum(F.col("len") * F.col("n")).over(longest)})
    return upto.groupBy(by).agg(
        F.sum("n").alias("num_seqs"), F.sum(F.col("len") * F.col("n")).alias("sum_len"), F.min("len").alias("min_len"),
        F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 4).alias("avg_len"), F.max("len").alias("max_len"),
        F.max(F.when(F.col("upto") >= F.col("half"), F.col("len"))).alias("n50"),
    )


def kmer_counts(seqs: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """How often each k-mer of only A, C, G and T occurs; canonical if both strands count as one."""
    one = dna.kmer_rows(seqs, k)
    key = dna.canonical(F.col("kmer")) if both_strands else F.col("kmer")
    return one.groupBy(key.alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def grep(seqs: DataFrame, pattern: str) -> DataFrame:
    """The sequences that hold a pattern on either strand, with the strands."""
    plus = F.instr(F.upper("seq"), pattern) > 0
    minus = F.contains(F.upper("seq"), dna.reverse_complement(F.lit(pattern)))
    return seqs.where(plus | minus).withColumns({"plus": plus, "minus": minus})


def gc_windows(seqs: DataFrame, width: int) -> DataFrame:
    """G and C of each window of a width, side by side, and their skew (G - C) / (G + C)."""
    parts = F.regexp_extract_all(F.upper("seq"), F.lit("(?s).{1,%d}" % width), F.lit(0))
    cut = seqs.select("id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))).alias("window", "part"))
    g, c = dna.count_of(F.col("part"), "G"), dna.count_of(F.col("part"), "C")
    return cut.select("id", "window", (g + c).alias("gc"), F.when(g + c > 0, F.round((g - c) / (g + c), 6)).alias("skew"))


def dereplicate(seqs: DataFrame) -> DataFrame:
    """Each distinct sequence (case and U/T alike) once, with its abundance and the label of its first record."""
    key = F.replace(F.upper("seq"), F.lit("U"), F.lit("T"))
    return seqs.groupBy(key.alias("seq")).agg(F.count(F.lit(1)).alias("size"), F.min_by("label", "ord").alias("label"))


def rereplicate(seqs: DataFrame) -> DataFrame:
    """Each sequence as often as its size says, numbered from 1."""
    return seqs.select("label", "seq", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(1).cast("long"), F.col("size")))).alias("copy"))


def sketch(seqs: DataFrame, k: int, scaled: int) -> DataFrame:
    """FracMinHash: of each id the distinct hashes of canonical k-mers in the lowest 1/scaled of all hashes, with how
    often they occur. The hash is the first 60 bits of the k-mer's MD5."""
    one = dna.kmer_rows(seqs, k, "id")
    number = F.conv(F.substring(F.md5(dna.canonical(F.col("kmer"))), 1, 15), 16, 10).cast("long")
    return one.select("id", number.alias("hash")).where(F.col("hash") < F.lit((1 << 60) // scaled)).groupBy("id", "hash").agg(F.count(F.lit(1)).alias("abundance"))


def compare_sketches(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Pairs with any common hash: common hashes, Jaccard, containment of each in the other and the average nucleotide
    identity of the containment."""
    sizes = lambda s, name: s.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    common = a.select(F.col("id").alias("a"), "hash").join(b.select(F.col("id").alias("b"), "hash"), "hash").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    full = common.join(sizes(a, "na"), common["a"] == F.col("id")).drop("id").join(sizes(b, "nb"), common["b"] == F.col("id")).drop("id")
    return full.select(
        "a", "b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"),
        F.round(F.col("common") / F.col("na"), 6).alias("a_in_b"), F.round(F.col("common") / F.col("nb"), 6).alias("b_in_a"),
        F.round(F.pow(F.col("common") / F.col("na"), F.lit(1.0 / k)), 6).alias("ani"),
    )


def minimizers(seq: Column, k: int, w: int) -> Column:
    """The distinct smallest k-mers of the windows of w k-mers, in order of first use."""
    each = dna.kmers(seq, k)
    windows = F.when(F.size(each) >= w, F.transform(F.sequence(F.lit(1), F.size(each) - w + 1), lambda i: F.array_min(F.slice(each, i, w))))
    return F.array_distinct(F.coalesce(windows, F.array().cast("array<string>")))


def trim_tail(reads: DataFrame, window: int, least: float) -> DataFrame:
    """Reads (seq, qual) cut before the first window of qualities whose mean is below least."""
    q = dna.qualities(F.col("qual"))
    rows = reads.withColumn("_q", q)
    bad = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_q") - window + 1, F.lit(1))), lambda i: F.aggregate(F.slice("_q", i, window), F.lit(0), lambda a, x: a + x) < least * window)
    cut = F.coalesce(F.try_element_at(bad, F.lit(1)) - 1, F.length("seq"))
    return rows.withColumns({"seq": F.substring("seq", F.lit(1), cut), "qual": F.substring("qual", F.lit(1), cut)}).drop("_q")


def cycle_quality(reads: DataFrame) -> DataFrame:
    """For each cycle: bases, mean quality and the share of each base."""
    per = reads.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.struct(i.alias("cycle"), F.substring("seq", i, F.lit(1)).alias("base"), (F.ascii(F.substring("qual", i, F.lit(1))) - 33).alias("q")))).alias("x")).select("x.*")
    share = [F.round(F.count_if(F.col("base") == b) / F.count(F.lit(1)), 6).alias(b) for b in "ACGT"]
    return per.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("mean_q"), *share)


def pairwise_distance(queries: DataFrame, seqs: DataFrame, blocks: int = 64) -> DataFrame:
    """Of each query and every other aligned sequence, which it meets in blocks: compared sites, differences and the Jukes-Cantor distance (null
    where it can't be estimated). Sites with anything but A, C, G or T in either are left out."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = queries.select(F.col("id").alias("a"), F.upper("seq").alias("sa"), every.alias("block"))
    b = seqs.select(F.col("id").alias("b"), F.upper("seq").alias("sb"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    pairs = a.join(b, "block").where("a <> b")
    n = F.least(F.length("sa"), F.length("sb"))
    sites = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring("sa", i, F.lit(1)).alias("x"), F.substring("sb", i, F.lit(1)).alias("y")))
    used = F.filter(sites, lambda s: s["x"].isin(*"ACGT") & s["y"].isin(*"ACGT"))
    out = pairs.select("a", "b", used.alias("u")).select("a", "b", F.size("u").alias("sites"), F.size(F.filter("u", lambda s: s["x"] != s["y"])).alias("differences"))
    p = F.col("differences") / F.col("sites")
    return out.withColumn("jc69", F.when((F.col("sites") > 0) & (p < 0.75), F.round(-0.75 * F.log(1 - p * 4 / 3), 6)))


def trim_poly(reads: DataFrame, base: str, least: int) -> DataFrame:
    """Reads (seq, qual) without a tail of at least so many copies of a base."""
    rows = reads.withColumn("_keep", F.length(F.regexp_replace("seq", "(?i)%s{%d,}$" % (base, least), "")))
    return rows.withColumns({c: F.left(c, F.col("_keep")) for c in ("seq", "qual")}).drop("_keep")


def complexity(seq: Column) -> Column:
    """The share of bases that differ from the next one; null below two bases."""
    runs = F.length(F.regexp_replace(F.upper(seq), r"(.)\1+", "$1"))
    return F.when(F.length(seq) > 1, (runs - 1) / (F.length(seq) - 1))


def judged(reads: DataFrame, shortest: int = 15, most_n: int = 5, mean: float = 0.0, low: int = 15, low_share: float = 0.4, complex_share: float = 0.0) -> DataFrame:
    """Reads with `verdict`: the first of these that holds. length (under shortest), quality (over low_share of the bases
    below low, or a mean below mean), n (more than most_n unknown bases), complexity (below complex_share); else pass.
    A null sequence or quality counts as empty."""
    seq, qual = F.coalesce("seq", F.lit("")), F.coalesce("qual", F.lit(""))
    rows = reads.withColumn("_q", dna.qualities(qual))
    n = F.size("_q")
    poor = F.size(F.filter("_q", lambda x: x < low)) > n * low_share
    weak = F.aggregate("_q", F.lit(0).cast("long"), lambda a, x: a + x) < n * mean
    verdict = (
        F.when(F.length(seq) < shortest, "length").when(poor | weak, "quality").when(dna.count_of(F.upper(seq), "N") > most_n, "n")
        .when(complexity(seq) < complex_share, "complexity").otherwise("pass")
    )
    return rows.withColumn("verdict", verdict).drop("_q")
