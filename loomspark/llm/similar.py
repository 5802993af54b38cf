"""SimHash near-dedup by the similarity of word shingles, for pipelines: long fingerprints, pigeonring, verification.

Two documents are near copies if the sets of their shingles (words split by ASCII white space, ASCII lower case; a text
of fewer words is one shingle) have a Jaccard similarity of at least `similarity`. Their fingerprints then differ in
some 15 % of the bits at a similarity of 0.8, far more than the two of 64 that the module simhash looks for, so the
fingerprints are longer here. They are rings of `segments` segments of `width` bits each: the width grows with the
logarithm of the number of rows, so that few unlike documents agree in a segment, and there are as many segments as a
pair at the least similarity needs to agree in one and keep the chain's budget with the probability RECALL.

Documents meet in the segments in which they agree. The chain of segments that follows such a one, as far as 64 bits
reach, must keep its cumulative differences within l/segments of the radius at each length l; pairs whose chain breaks
its budget are pruned. The others go on to the whole Hamming distance and at last to the sets themselves, as sorted
64-bit hashes of the shingles, so nothing but near copies is linked.

Equal sets are one row from the start. A segment's bucket gives its pairs if these are no more than its documents. If
they are more, as in groups of near copies, each document meets one of them first, and in buckets of more than DENSE two
that all share. What then isn't in the bucket's largest component yet is compared with that component in blocks, by the
whole fingerprints and then by the sets of all within the radius. So nothing is dropped or capped, the pairs that leave
the tasks grow in proportion to a group, and only documents that meet a group and aren't linked to it by then are
compared with all of it.

Defined results: null text counts as empty, and texts without words are copies of each other; links are transitive; of
a component the row with the smallest id stays (null last; of repeats of it, one). Empty tables are fine, and other
columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import small_batches, text_or_empty, written
from loomspark.llm.components import connected_components
from loomspark.llm.simhash import keep_best

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
RECALL, DENSE, BLOCK, SLICE = 0.995, 64, 256, 1024
#: The share of differing bits that segments are planned for, and the radius, against what is expected of long texts.
#: Short texts, whose votes are often tied, differ in more bits.
MARGIN, RADIUS = 1.1, 1.45
#: From so many shingles on, the differing bits of a pair at the least similarity spread as the binomial distribution
#: says, and four standard deviations are radius enough.
LONG = 64
#: Shingles whose votes are counted at once: so many fit in a byte.
CHUNK = 255
#: Shingles that one set is compared with at once.
COMPARED = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


class Plan:
    """Width and number of the segments for a number of documents, the radius and the chain's budgets."""

    def __init__(self, rows: int, similarity: float):
        if not 0.5 <= similarity < 1:
            raise ValueError("similarity must be from 0.5 up to, but not including, 1")
        differing = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.similarity, self.width = similarity, min(30, max(12, math.ceil(math.log2(rows + 1)) - 2))
        self.follow = 64 // self.width
        agree = (1 - MARGIN * differing) ** self.width * 0.97  # of these, the chain keeps its budget in more than 97 %
        self.segments = max(self.follow + 1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))
        self.words = -(-self.segments * self.width // 64)
        bits = self.segments * self.width
        self.radius = int(RADIUS * differing * bits)
        self.long_radius = min(self.radius, math.ceil(1.03 * differing * bits + 4 * math.sqrt(differing * (1 - differing) * bits)))

    def radius_for(self, shingles: np.ndarray) -> np.ndarray:
        return np.where(shingles < LONG, self.radius, self.long_radius)

    def budget(self, length: int) -> int:
        return length * self.radius // self.segments

    def masks(self) -> list[tuple[int, int]]:
        """For every length of the chain the bits of its followers, as a signed long, and its budget."""
        out = []
        for n in range(1, self.follow + 1):
            bits = (1 << n * self.width) - 1
            out.append((bits - (1 << 64) if bits >> 63 else bits, self.budget(n + 1)))
        return out

    def in_budget(self, differing: Column) -> Column:
        out = F.lit(True)
        for mask, most in self.masks():
            out &= F.bit_count(differing.bitwiseAND(F.lit(mask))) <= most
        return out


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(max(1, len(words) - size + 1), np.uint64(n))
    for i in range(n):
        out = mixed(out * STEP ^ hashes[i : i + len(out)])
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """words * 64 bits, each set if more than half of the shingles vote for it."""
    votes, turn = np.zeros(words * 64, np.int64), np.arange(1, words + 1, dtype=np.uint64) * STEP
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(mixed(hashes[at : at + CHUNK, None] + turn).view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (small + large - common)


def similar_to(a: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """similar() of one set with each of several."""
    sizes = np.array([len(s) for s in sets])
    parts = np.split(np.arange(len(sets)), np.flatnonzero(np.diff(np.cumsum(sizes) // COMPARED)) + 1)
    common = []
    for part in parts:
        theirs = np.concatenate([sets[i] for i in part])
        held = a[np.minimum(np.searchsorted(a, theirs), len(a) - 1)] == theirs
        common.append(np.add.reduceat(held, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64))
    common = np.concatenate(common)
    return common >= similarity * (len(a) + sizes - common)


def ring(bits: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of bytes) -> the value of each segment and the up to 64 bits that follow it on the ring."""
    flat = np.unpackbits(bits, axis=1, bitorder="little")[:, : plan.segments * plan.width]
    weights = np.uint64(1) << np.arange(plan.width, dtype=np.uint64)
    values = (flat.reshape(len(bits), plan.segments, plan.width).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
    after = np.zeros_like(values)
    for k in range(plan.follow):
        after |= np.roll(values, -1 - k, axis=1) << np.uint64(k * plan.width)
    return values, after


def _keyed(prints: DataFrame, plan: Plan) -> DataFrame:
    """prints (fp, bits) -> (segment, value, after, fp) for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values, after = ring(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), plan)
                segment = np.tile(np.arange(plan.segments, dtype=np.int32), b.num_rows)
                fp = np.repeat(b.column(0).to_numpy(), plan.segments)
                yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(values.ravel().astype(np.int32)), pa.array(after.ravel().view(np.int64)), pa.array(fp)], names=["segment", "value", "after", "fp"])

    return prints.select("fp", "bits").mapInArrow(run, "segment int, value int, after long, fp long")


def _pairs(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (segment, value, after, fp) of small buckets -> the pairs (a, b) whose chain keeps its budget.

    A bucket with more such pairs than documents gives of each document the pair with the least fp, and besides its
    documents that have pairs, as (segment, value, a) without b, for _open_units.
    """

    def found(segment: np.ndarray, value: np.ndarray, after: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])])
        sizes = np.diff(np.r_[begins, len(fp)])
        bucket, ends = np.repeat(np.arange(len(begins)), sizes), np.repeat(begins + sizes, sizes)
        others = ends - np.arange(len(fp)) - 1  # every row meets those of its bucket that come after it
        one = np.repeat(np.arange(len(fp)), others)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(others) - others, others)
        differing = after[one] ^ after[two]
        ok = np.ones(len(one), bool)
        for mask, most in plan.masks():
            ok &= np.bitwise_count((differing & mask).view(np.uint64)) <= most
        one, two = one[ok], two[ok]
        many = (np.bincount(bucket[one], minlength=len(begins)) > sizes)[bucket[one]]
        me, other = np.r_[one[many], two[many]], np.r_[two[many], one[many]]
        order = np.lexsort((fp[other], me))
        opened, at = np.unique(me[order], return_index=True)
        a, b = fp[np.r_[one[~many], opened]], fp[np.r_[two[~many], other[order][at]]]
        pairs, none = np.zeros(len(a), np.int32), np.repeat([False, True], [len(a), len(opened)])
        columns = [
            pa.array(np.r_[pairs, segment[opened]], mask=~none),
            pa.array(np.r_[pairs, value[opened]], mask=~none),
            pa.array(np.r_[np.minimum(a, b), fp[opened]]),
            pa.array(np.r_[np.maximum(a, b), fp[opened]], mask=none),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "value", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the rest of it."""
        rest = [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield found(*[r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]
        if len(rest[0]):
            yield found(*rest)

    dealt = rows.select("segment", "value", "after", "fp").repartition("segment", "value").sortWithinPartitions("segment", "value")
    return dealt.mapInArrow(run, "segment int, value int, a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star_pairs(large: DataFrame, plan: Plan) -> DataFrame:
    """Of large buckets the pairs of every document with the first and the last one by a hash."""
    me, by = F.struct("fp", "after"), F.xxhash64("fp", F.lit(SEED))
    ends = large.groupBy("segment", "value").agg(F.array(F.min_by(me, by), F.max_by(me, by)).alias("ends"))
    ends = ends.select("segment", "value", F.explode("ends").alias("end"))
    met = large.join(ends, ["segment", "value"]).where((F.col("fp") != F.col("end.fp")) & plan.in_budget(F.col("after").bitwiseXOR(F.col("end.after"))))
    return met.select(*_ordered(F.col("fp"), F.col("end.fp")))


def _open_units(opened: DataFrame, labels: DataFrame, prints: DataFrame, sets_of) -> DataFrame:
    """What of the buckets (segment, value, fp) isn't in their largest component meets that component, as units (main, block, slice).

    A unit holds up to about BLOCK such documents (`asks`) and about SLICE of what they meet: the component, and all
    else that meets it. A document meets a component once, however many buckets they share.
    """
    rows = opened.join(labels, opened["fp"] == labels["vertex"], "left")
    rows = written(rows.select("segment", "value", "fp", F.coalesce("component", "fp").alias("label")), "similar-labels")
    of = rows.groupBy("segment", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("segment", "value").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    rest = written(rows.join(of, ["segment", "value"]).where("label != main").select("main", "fp", "label").distinct(), "similar-rest")
    mains = rest.select("main").distinct()
    inside = labels.join(mains, labels["component"] == mains["main"]).select("main", F.col("vertex").alias("fp"), F.col("main").alias("label"))
    met = written(inside.unionByName(mains.select("main", F.col("main").alias("fp"), F.col("main").alias("label"))).unionByName(rest), "similar-met")
    sizes = rest.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    sizes = written(sizes.join(met.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")), "main"), "similar-mains")

    def dealt(rows: DataFrame, own: str, number: str, other: str, others: str, asks: bool) -> DataFrame:
        place = F.pmod(F.xxhash64("fp"), number).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(other)
        return rows.join(sizes, "main").select("main", "fp", "label", place, every, F.lit(asks).alias("asks"))

    both = dealt(rest, "block", "blocks", "slice", "slices", True).unionByName(dealt(met, "slice", "slices", "block", "blocks", False))
    known = prints.select("fp", "n", "bits").join(written(sets_of(met.select("fp").distinct()), "similar-sets"), "fp")
    both = both.join(written(known, "similar-known"), "fp").select("main", "block", "slice", "asks", "fp", "label", "n", "bits", "hashes")
    return both.repartition("main", "block", "slice").sortWithinPartitions("main", "block", "slice", F.col("asks").desc())


def _unit_links(units: DataFrame, plan: Plan) -> DataFrame:
    """Of every unit links of other components: pairs within the radius are verified on the sets, and of each document
    that asks and each component one link is given."""

    def close(one: pd.DataFrame, two: pd.DataFrame) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(t["bits"]), np.uint64).reshape(len(t), -1) for t in (one, two))
        apart = np.zeros((len(one), len(two)), np.int32)
        for k in range(x.shape[1]):
            apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
        na, nb = one["n"].to_numpy()[:, None], two["n"].to_numpy()[None, :]
        ok = (apart <= plan.radius_for(np.minimum(na, nb))) & (np.minimum(na, nb) >= plan.similarity * np.maximum(na, nb))
        labels = two["label"].to_numpy()
        ok &= one["label"].to_numpy()[:, None] != labels[None, :]
        links, sets = [], [np.frombuffer(h, np.uint64) for h in two["hashes"]]
        for i in np.flatnonzero(ok.any(axis=1)):
            near = np.flatnonzero(ok[i])
            near = near[similar_to(np.frombuffer(one["hashes"].iat[i], np.uint64), [sets[j] for j in near], plan.similarity)]
            for j in near[np.unique(labels[near], return_index=True)[1]]:
                links.append(sorted((int(one["fp"].iat[i]), int(two["fp"].iat[j]))))
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A unit's documents that ask come first and are held; those that they meet are met as they come."""
        unit, held = None, []
        for batch in batches:
            rows = batch.to_pandas()
            for key, part in rows.groupby(["main", "block", "slice"], sort=False):
                if key != unit:
                    unit, held = key, []
                held.append(part[part["asks"]])
                held, others = [pd.concat(held, ignore_index=True)], part[~part["asks"]]
                if len(held[0]) and len(others):
                    yield close(held[0], others)

    return units.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, prints: DataFrame, sets_of, plan: Plan) -> DataFrame:
    """Of the pairs (a, b) those within the radius whose sets are similar."""

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), plan.similarity) for x, y in zip(a, b)], dtype=bool)

    def both(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("fp").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), side)
        return pairs

    pairs = both(written(pairs.distinct(), "similar-pairs"), prints, "bits", "n")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    radius = F.when(least < LONG, plan.radius).otherwise(plan.long_radius)
    near = written(pairs.where(least >= most * plan.similarity).where(apart("bits_a", "bits_b") <= radius).select("a", "b"), "similar-near")
    sets = written(sets_of(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "similar-sets")
    return written(both(near, sets, "hashes").where(alike("hashes_a", "hashes_b")).select("a", "b"), "similar-links")


def links(prints: DataFrame, sets_of, plan: Plan) -> DataFrame:
    """prints (fp, n, bits), distinct -> links (a, b) that join all near copies; sets_of gives the sets (fp, hashes)
    of a table of fps."""
    keyed = _keyed(prints, plan)
    sizes = keyed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE)
    sizes = written(sizes.select("segment", "value"), "similar-sizes")
    large = written(keyed.join(sizes, ["segment", "value"], "left_semi"), "similar-large")
    small = keyed.join(sizes, ["segment", "value"], "left_anti")
    met = written(_pairs(small, plan), "similar-met")
    pairs = met.where("b IS NOT NULL").select("a", "b").unionByName(_star_pairs(large, plan))
    first = _verified(pairs, prints, sets_of, plan)
    opened = large.select("segment", "value", "fp").unionByName(met.where("b IS NULL").select("segment", "value", F.col("a").alias("fp")))
    if opened.isEmpty():
        return first
    found = written(connected_components(first), "similar-found")
    more = written(_unit_links(_open_units(opened, found, prints, sets_of), plan), "similar-links")
    return found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each component of near copies."""
    plan = Plan(docs.count(), similarity)
    small_batches(docs.sparkSession)

    @F.pandas_udf("fp long, n int, bits binary")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, shingle) for t in texts]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).astype(np.int64)
            yield pd.DataFrame({"fp": fps, "n": np.array([len(s) for s in sets], np.int32), "bits": [fingerprint(s, plan.words).tobytes() for s in sets]})

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, shingle).tobytes() for t in texts], dtype=object)

    text = text_or_empty(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), printed(text).alias("p"))
    rows = written(rows.select("id", "mark", "p.*"), "similar-rows")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    groups = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "similar-prints")

    def sets_of(fps: DataFrame) -> DataFrame:
        wanted = written(groups.join(fps, "fp", "left_semi").select("fp", F.col("first.mark").alias("at_mark")), "similar-wanted")
        texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("t"))
        found = texts.join(wanted, F.col("mark") == F.col("at_mark")).select("fp", packed("t").alias("hashes"))
        return found.groupBy("fp").agg(F.any_value("hashes").alias("hashes"))

    found = written(connected_components(links(groups.select("fp", "n", "bits"), sets_of, plan)), "similar-found")
    labelled = groups.join(found, groups["fp"] == found["vertex"], "left").select("first", F.coalesce("component", "fp").alias("component"))
    best = labelled.groupBy("component").agg(F.min("first").alias("best"))
    return keep_best(docs, best, id_col, text_col)
