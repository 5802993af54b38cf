"""URL filter: a blocked Bloom filter before an exact hash join.

Listed entries are canonical URLs (host and path; scheme, query and fragment don't count) and prefix rules (a host
with its subdomains, and the start of a path). Every entry has a text key; a URL has as many candidate keys as there
are entries that could fit it: itself, and each of its host suffixes with each start of its path of a length that a
rule has. The filter is a table of blocks of eight 64-bit words. A key's hash picks one block and one bit in each
word. Candidates whose bits aren't all set are dropped by an equi-join on the block; the few that pass meet the
entries in an exact join, which removes the false positives. A rule that fits outdoes a listing; of the rules that
fit, the longest wins (host and path together, then the longer host).

The work is done once for each distinct (host, path), so that a URL that very many pages share costs no more than
another. Defined results: a null url, or one without `://`, has an empty host and path, which nothing fits. Rules are
a bounded list that the caller writes down (at most MAX_RULES); listed URLs are a table of any size. An entry listed
twice with both verdicts blocks. Ports and user names are part of the host, as the contract says. Empty tables and
lists are fine; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, UPPER, written

#: (host, path, verdict) of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 10_000
BITS_PER_KEY, WORDS = 16, 8
#: A filter of up to this many blocks (72 bytes each with its number) is broadcast; a larger one is dealt by block.
BROADCAST_BLOCKS = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _exact_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("="), host, F.lit(" "), path)


def _prefix_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit(" "), path)


def entries(spark: SparkSession, rules: Sequence[tuple[str, str, str]], listed: DataFrame | None) -> DataFrame:
    """(key, verdict, rule): the rules, and the listed URLs (a table with host and path), which block."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; list single URLs in the table")
    kind = "struct<host:string,path:string,verdict:string>"
    written_down = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]).cast(f"array<{kind}>")
    table = spark.range(1).select(F.explode(written_down).alias("r")).select("r.*")
    out = table.select(_prefix_key(F.col("host"), F.col("path")).alias("key"), "verdict", F.concat("host", "path").alias("rule"))
    if listed is not None:
        urls = listed.where("host != ''").select(_exact_key(F.col("host"), F.col("path")).alias("key"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"))
        out = out.unionAll(urls)
    return out.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("rule").alias("rule"))


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _bits(key: Column) -> list[Column]:
    """One bit for each of the block's words, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def blocked_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (key) -> (block, w0 .. w7): only the blocks with any bit."""
    bits = [b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))]
    return keys.select(_place(F.col("key"), blocks), *bits).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def passing(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose bits are all set."""
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        hit &= F.col(f"w{i}").bitwiseAND(b) == b
    return candidates.withColumn("block", _place(F.col("key"), blocks)).join(bloom, "block").where(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def _candidates(rules: Sequence[tuple[str, str, str]]) -> Column:
    """All keys of (host, path) that an entry could have, with their lengths."""
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    exact = F.struct(_exact_key(host, path).alias("key"), (F.length(host) + F.length(path)).alias("n"), F.length(host).alias("n_host"))
    out = [F.array(exact)]
    for n_labels, n_path in shapes:
        suffix = F.array_join(F.slice(labels, F.lit(-n_labels), F.lit(n_labels)), ".")
        start = F.substring(path, 1, n_path)
        one = F.struct(_prefix_key(suffix, start).alias("key"), (F.length(suffix) + n_path).alias("n"), F.length(suffix).alias("n_host"))
        out.append(F.when((F.size(labels) >= n_labels) & (F.length(path) >= n_path), F.array(one)).otherwise(F.array().cast("array<struct<key:string,n:int,n_host:int>>")))
    return F.concat(*out)


def judge_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of pages (all columns in `page`) with host, path, rule and verdict."""
    spark = pages.sparkSession
    known = written(entries(spark, rules, listed), "url-entries")
    blocks = max(1, math.ceil(known.count() * BITS_PER_KEY / (64 * WORDS)))
    bloom = blocked_filter(known, blocks)
    url = F.col(f"`{url_col}`")
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")
    rows = pages.select(page, host_of(url).alias("host"), path_of(url).alias("path"))
    urls = rows.select("host", "path").where("host != ''").distinct()
    keys = urls.select("host", "path", F.explode(_candidates(rules)).alias("c")).select("host", "path", "c.*")
    found = passing(keys, bloom, blocks).join(known, "key")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.col("rule").isNotNull(), "n", "n_host"))
    judged = found.groupBy("host", "path").agg(best.alias("best"))
    return rows.join(judged, ["host", "path"], "left").select(
        "page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
