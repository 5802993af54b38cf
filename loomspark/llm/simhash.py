"""Near-dedup by SimHash with pigeonring filtering.

Fingerprints: a text's words (ASCII lower case) give shingles of three words, repeats included; each shingle's XXH64
votes on 64 bits, and a bit is set if more than half of the hashes set it. Texts of fewer than three words are one
shingle; texts without words have the fingerprint zero.

Links: two fingerprints that differ in at most two bits. The 64 bits are a ring of five segments. If two fingerprints
differ in at most two bits, then from some segment on, every chain of l consecutive segments differs in at most
l * 2/5 bits: none in the first two segments, at most one in the first three or four, at most two in all. So only
fingerprints that agree in two neighbouring segments meet, in buckets, and pairs whose chain breaks its budget are
pruned before the whole fingerprints are compared.

Equal fingerprints are one row from the start. A bucket with up to DENSE fingerprints gives its pairs, so at most
DENSE / 2 for each fingerprint. In a larger bucket the chain goes on without pairs: each fingerprint is listed under
itself and under each of its neighbours at one bit outside the two segments that the bucket shares. Two fingerprints
differ in at most two bits exactly if they are listed under a common entry, and every entry links its fingerprints to
its smallest. Both ways are exact; neither drops or caps anything, and both grow in proportion to the bucket.

Defined results: null text counts as empty; rows that repeat are linked like any others; a null id takes part in its
component but is its smallest id only if there is no other; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomspark.llm.common import small_batches, text_or_empty, whole_row, written
from loomspark.llm.components import connected_components

SHINGLE, SEED, BITS, RADIUS, SEGMENTS = 3, 42, 64, 2, 5
DENSE = 64
#: Shingles whose votes are counted at once.
CHUNK = 1 << 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    votes, total, digest = np.zeros((8, 8), np.int64), max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        grams = zip(*[part[i:] for i in range(SHINGLE)]) if len(words) >= SHINGLE else [part]
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype=">u8")
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes[k] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(votes.ravel() * 2 > total).tobytes(), "big")


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint as a signed long; null counts as empty."""
    for texts in batches:
        yield pd.Series([fingerprint(t or "") for t in texts], dtype=np.uint64).astype(np.int64) if len(texts) else pd.Series([], dtype=np.int64)


def _bounds() -> list[tuple[int, int]]:
    at = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    return list(zip(at, at[1:]))


def _mask(start: int, length: int) -> int:
    """The bits of `length` segments from `start` on around the ring, as a signed long."""
    bits = 0
    for i in range(length):
        lo, hi = _bounds()[(start + i) % SEGMENTS]
        bits |= ((1 << (hi - lo)) - 1) << lo
    return bits - (1 << 64) if bits >> 63 else bits


def _chain_budget(length: int) -> int:
    return length * RADIUS // SEGMENTS


def _exact_length() -> int:
    """How many segments from a chain's start must agree."""
    return max(n for n in range(1, SEGMENTS + 1) if _chain_budget(n) == 0)


def _in_budget(start: Column, differing: Column) -> Column:
    """Whether the chain from segment `start` keeps its budget at every length."""
    out = F.bit_count(differing) <= RADIUS
    for length in range(_exact_length() + 1, SEGMENTS):
        masks = F.array(*[F.lit(_mask(i, length)) for i in range(SEGMENTS)])
        out &= F.bit_count(differing.bitwiseAND(F.element_at(masks, start + 1))) <= _chain_budget(length)
    return out


def links(prints: DataFrame) -> DataFrame:
    """prints (fp), distinct -> edges (a, b) between fingerprints at most RADIUS bits apart: all pairs of small
    buckets, and enough of those of large buckets to join the same fingerprints."""
    exact = _exact_length()
    starts = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(i, exact))).alias("shared")) for i in range(SEGMENTS)])
    keyed = prints.select("fp", F.explode(starts).alias("k")).select("k.start", "k.shared", "fp")
    sizes = keyed.groupBy("start", "shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["start", "shared"]), "simhash-buckets")
    small = shared.where(F.col("n") <= DENSE).groupBy("start", "shared").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    firsts = small.where(F.size("fps") > 1).select("start", "fps", F.posexplode("fps").alias("at", "a"))
    pairs = firsts.select("start", "a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    near = pairs.where(_in_budget(F.col("start"), F.col("a").bitwiseXOR(F.col("b")))).select("a", "b")
    own = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(b - (1 << 64) if (b := 1 << i) >> 63 else b) for i in range(BITS) if not (_mask(s, exact) >> i) & 1]) for s in range(SEGMENTS)])
    under = shared.where(F.col("n") > DENSE).select("start", "fp", F.explode(F.element_at(own, F.col("start") + 1)).alias("flip"))
    under = under.select("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"), "fp")
    least = under.groupBy("start", "entry").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = under.join(least.select("start", "entry", "a"), ["start", "entry"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return near.unionAll(stars).distinct()


def near_components(rows: DataFrame) -> DataFrame:
    """rows (id, mark, fp) -> (fp, best, n_rows): for each fingerprint the first of the rows that links reach from it,
    by id (null last) and then by the mark of its text."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    groups = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    found = connected_components(links(groups.select("fp")))
    labelled = groups.join(found, groups["fp"] == found["vertex"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    best = labelled.groupBy("component").agg(F.min("first").alias("best"), F.sum("n").alias("n_rows"))
    return labelled.join(best, "component").select("fp", "best", "n_rows")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp) of every row, written once; mark is a hash of the text."""
    text = text_or_empty(f"`{text_col}`")
    small_batches(docs.sparkSession)
    return written(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), simhash(text).alias("fp")), "simhash-rows")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs: its id, fingerprint (16 hex digits) and component_id."""
    rows = fingerprints(docs, id_col, text_col)
    classes = written(near_components(rows), "simhash-classes")  # so that both sides of the join are dealt
    joined = rows.join(classes, "fp")
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"))


def keep_best(docs: DataFrame, components: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that components (best: id and mark) name, of repeats one."""
    stay = written(components.select("best.id", "best.mark").distinct(), "near-kept")
    stay = stay.select(F.col("id").alias("at_id"), F.col("mark").alias("at_mark"))
    marked = docs.select(whole_row(docs)).select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text_or_empty(f"row.`{text_col}`")).alias("mark"))
    kept = marked.join(stay, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")), "left_semi")
    return kept.dropDuplicates(["id", "mark"]).select("row.*")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component: the one with the smallest id (of repeats of it, one)."""
    return keep_best(docs, near_components(fingerprints(docs, id_col, text_col)), id_col, text_col)
