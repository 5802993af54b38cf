"""Hard negatives: for anchors and their nearest rows of the same label, the best other rows a little less alike.

Vectors become whole numbers, so scores (inner products) are exact. Rows are laid out along a Hilbert curve through a few
random projections, label by label, and cut into blocks: a Parquet table with one row for each block, its ids, its
vectors and its zone map, the least and greatest component of each dimension. Anchors are gathered in groups in the
same order. Interval arithmetic on an anchor and a zone map bounds every score in the block from both sides, and a
block is read for an anchor only if the bounds meet what it looks for:

1. Positives: blocks of the anchor's label that can beat the k-th best of the anchor's own block.
2. Negatives, first look: of each page of zone maps the most promising block of another label. What it holds raises
   the bottom of the windows [low % of the positive's score, high % of it].
3. Negatives: the other blocks of other labels whose bounds meet a window above what is found already.

Bounds never leave out a row that counts, so results are exact. How many blocks are read depends on the data: vectors
that lie in heaps need few, vectors without any structure nearly all. Zone maps are a five-hundredth of the vectors;
they and the blocks are dealt to tasks by joins. A task keeps the best few of each window, the rest is a window
function's top k. One frequent vector is blocks with tight bounds, one label of a third of all rows is many blocks.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part; nor does a
row whose inner product with itself doesn't fit in a long, as no score of it could be returned. Of vectors of different
lengths the shorter one counts as filled up with zeros. Equal rows count once; rows with one id and different vectors
or labels are rows of their own, but no anchor is compared with a row of its own id. Ties go to smaller ids. An anchor
without positives gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import small_batches, written

#: A block holds about so many bytes of vectors, a page so many zone maps, a group so many anchors at most.
BLOCK_BYTES, PAGE, GROUP = 1 << 18, 512, 128
#: Dimensions of the Hilbert curve and bits of each.
AXES, BITS = 8, 6
#: A task keeps the best rows of so many windows before it hands them on.
WINDOWS = 50_000
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rows with blocks go to a Python worker so many at a time.
BLOCK_ROWS = 16


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BLOCK_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of whole coordinates below 2 ** bits -> each one's place on the Hilbert curve (bits * dimensions up to 62).

    Gray-code construction: from the highest bit down, each axis whose bit is set flips the lower bits of the first
    axis, others swap them with it; then the axes' bits are Gray-decoded and interleaved.
    """
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def curve_keys(q: np.ndarray) -> np.ndarray:
    """Rows of numbers -> places on the curve, by signs of random sums: the direction alone counts."""
    signs = np.random.default_rng(13).integers(0, 2, (AXES, q.shape[1])).T * 2 - 1
    norm = np.sqrt((q**2).sum(axis=1, keepdims=True))
    z = np.divide(q @ signs, norm, out=np.zeros((len(q), AXES)), where=norm > 0)
    cells = np.clip(np.floor((z + 3) / 6 * (1 << BITS)), 0, (1 << BITS) - 1)
    return hilbert_index(cells.astype(np.int64), BITS)


def _of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, width) if width else np.zeros((len(data) // 4 or 1, 0), "<i4")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; the shorter rows end in zeros."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if not w or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.int64)).max()) * float(np.abs(b.astype(np.int64)).max()) * w
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows a and zone maps (rows of low and high): the least and the greatest inner product there can be."""
    w = min(a.shape[1], low.shape[1])
    a, low, high = (x[:, :w].astype(np.float64) for x in (a, low, high))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size >= 1 << 52, size * 1e-12 + 1, 0)  # beyond exact doubles
    return least - slack, most + slack


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of rows ordered by score, highest first, then id."""
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[some], ids[some]
    at = np.lexsort((ids, -scores))[:k]
    return scores[at], ids[at]


class Kept:
    """The best k rows of each window so far; handed on when there are too many windows."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, key: tuple[int, int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.rows:
            s, i = self.rows[key]
            scores, ids = np.r_[s, scores], np.r_[i, ids]
        self.rows[key] = best(scores, ids, self.k)

    def batch(self) -> pa.RecordBatch:
        flat = [(*key, s, i) for key, (ss, ii) in self.rows.items() for s, i in zip(ss.tolist(), ii.tolist())]
        self.rows = {}
        columns = list(zip(*flat)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["group", "nth", "slot", "score", "id"])


FOUND = "group long, nth int, slot int, score long, id long"


def _whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, place, width, q): the rows that take part, each vector as packed whole numbers."""
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("id", "label", "vector").where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            sizes = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for w in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == w)
                x = flat[starts[at][:, None] + np.arange(w)]
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(scale * x)
                    fits = (q**2).sum(axis=1) < 2.0**62
                at, q = at[fits], q[fits]
                data = q.astype("<i4")
                packed = pa.array([r.tobytes() for r in data], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(curve_keys(q)), pa.array(np.full(len(at), w, np.int32)), packed], names=["id", "label", "place", "width", "q"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, "id long, label long, place long, width int, q binary")


BLOCKS = "block long, label long, n int, width int, ids binary, q binary, low binary, high binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """rows in order -> the blocks, label by label, with their zone maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen, size, last = 0, 0, None

        def block(part: int) -> pa.RecordBatch:
            nonlocal seen, size
            width = max(r[3] for r in held)
            q = np.zeros((len(held), width), "<i4")
            for x, r in zip(q, held):
                x[: r[3]] = np.frombuffer(r[4], "<i4")
            row = [part << 32 | seen, held[0][1], len(held), width, np.array([r[0] for r in held], "<i8").tobytes(), q.tobytes(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes()]
            seen, size = seen + 1, 0
            held.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                part, row = r[0], (r[1], r[2], r[3], r[4], r[5])
                if last == row:
                    continue  # equal rows count once
                if held and (held[0][1] != row[1] or size + 4 * row[3] > BLOCK_BYTES):
                    yield block(part)
                held.append(row)
                size += 4 * row[3] + 8
                last = row
        if held:
            yield block(part)

    ordered = rows.orderBy("label", "place", "id", "width", "q").select(F.spark_partition_id().alias("part"), "id", "label", "place", "width", "q")
    return written(ordered.mapInArrow(run, BLOCKS), "negatives-blocks")


GROUPS = "group long, label long, n int, width int, ids binary, q binary, low binary, high binary, positive binary"


def _group_row(group: int, label: int, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, positive: np.ndarray) -> pa.RecordBatch:
    row = [group, label, len(ids), q.shape[1], ids.astype("<i8").tobytes(), q.astype("<i4").tobytes(), *[x.astype("<i8").tobytes() for x in (low, high, positive)]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in GROUPS.split(", ")])


def _anchors(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """Groups of anchors of one label. Their one window has no top, and as its bottom the k-th best of the own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen = 0

        def group(part: int, label: int) -> pa.RecordBatch:
            nonlocal seen
            seen += 1
            width = max(len(h[1]) for h in held)
            q = np.zeros((len(held), width), "<i4")
            for x, h in zip(q, held):
                x[: len(h[1])] = h[1]
            low = np.array([[h[2]] for h in held])
            ids = np.array([h[0] for h in held])
            held.clear()
            return _group_row(part << 32 | seen, label, ids, q, low, np.full_like(low, MOST), np.full_like(low, -1))

        label = part = None
        for batch in batches:
            for part, now, width, ids, q in zip(*[c.to_pylist() for c in batch.columns]):
                ids, q = np.frombuffer(ids, "<i8"), _of(q, width)
                at = np.flatnonzero(ids % every == 0)
                if held and now != label:
                    yield group(part, label)
                label = now
                for i, scores in zip(at.tolist(), products(q[at], q)):
                    others = scores[ids != ids[i]]
                    held.append((int(ids[i]), q[i], int(np.partition(others, -k)[-k]) if len(others) >= k else LEAST))
                    if len(held) == GROUP:
                        yield group(part, label)
        if held:
            yield group(part, label)

    rows = blocks.select(F.spark_partition_id().alias("part"), "label", "width", "ids", "q")
    return written(rows.mapInArrow(run, GROUPS), "negatives-anchors")


def _pages(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The zone maps (page, zones), about PAGE of them on a page, and the number of pages."""
    n = max(1, -(-blocks.count() // PAGE))
    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("page"), F.struct("block", "label", "width", "low", "high").alias("zone"))
    return written(zones.groupBy("page").agg(F.sort_array(F.collect_list("zone")).alias("zones")), "negatives-pages"), n


TO_READ = "block long, group long, nth binary, ids binary, width int, q binary, low binary, high binary"


def _choose(groups: DataFrame, pages: DataFrame, n_pages: int, same_label: bool, first_look: bool | None = None) -> DataFrame:
    """Which blocks to read for which anchors of a group, with all that is needed to score them.

    first_look: True for the most promising block of each page, False for all but these, None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                zones = [z for z in g["zones"] if (z["label"] == g["label"]) == same_label]
                if not zones:
                    continue
                q, ids = _of(g["q"], g["width"]), np.frombuffer(g["ids"], "<i8")
                low, high = (np.frombuffer(g[c], "<i8").reshape(len(ids), -1) for c in ("low", "high"))
                width = max(z["width"] for z in zones)
                zone_low, zone_high = np.zeros((2, len(zones), width), "<i4")
                for i, z in enumerate(zones):
                    zone_low[i, : z["width"]], zone_high[i, : z["width"]] = np.frombuffer(z["low"], "<i4"), np.frombuffer(z["high"], "<i4")
                least, most = bounds(q, zone_low, zone_high)
                meets = np.zeros(least.shape, bool)
                for s in range(low.shape[1]):
                    meets |= (most >= low[:, s : s + 1]) & (least <= high[:, s : s + 1]) & (low[:, s : s + 1] <= high[:, s : s + 1])
                if first_look is not None:
                    front = np.zeros(meets.shape, bool)
                    front[np.arange(len(ids)), most.argmax(axis=1)] = True
                    meets &= front if first_look else ~front
                for i in np.flatnonzero(meets.any(axis=0)).tolist():
                    who = np.flatnonzero(meets[:, i])
                    out.append((zones[i]["block"], g["group"], who.astype("<i4").tobytes(), ids[who].tobytes(), g["width"], q[who].tobytes(), low[who].tobytes(), high[who].tobytes()))
                    if len(out) == BLOCK_ROWS:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, types)], names=[c.split()[0] for c in TO_READ.split(", ")])

    dealt = groups.select("group", "label", "width", "ids", "q", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page"))
    with _few_rows(groups.sparkSession):
        return written(dealt.join(pages, "page").drop("page").mapInArrow(run, TO_READ), "negatives-to-read")


def _score(to_read: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best k rows of the chosen blocks in each window, as far as a task has seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(k)
        for batch in batches:
            for r in batch.to_pylist():
                mine, theirs = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["block_ids"], "<i8")
                a, b = _of(r["q"], r["width"]), _of(r["block_q"], r["block_width"])
                low, high = (np.frombuffer(r[c], "<i8").reshape(len(mine), -1) for c in ("low", "high"))
                scores, floor = products(a, b), np.where(low <= high, low, MOST).min(axis=1)
                near = (scores >= floor[:, None]) & (theirs[None, :] != mine[:, None])
                nth = np.frombuffer(r["nth"], "<i4").tolist()
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    s, ids = scores[i, near[i]], theirs[near[i]]
                    for slot in range(low.shape[1]):
                        some = (s >= low[i, slot]) & (s <= high[i, slot])
                        if some.any():
                            kept.add((r["group"], nth[i], slot), s[some], ids[some])
            if len(kept.rows) > WINDOWS:
                yield kept.batch()
        yield kept.batch()

    theirs = blocks.select("block", F.col("ids").alias("block_ids"), F.col("width").alias("block_width"), F.col("q").alias("block_q"))
    with _few_rows(blocks.sparkSession):
        return written(to_read.join(theirs, "block").drop("block").mapInArrow(run, FOUND), "negatives-found")


def _top(found: DataFrame, k: int) -> DataFrame:
    """found with `rank` (from 1) in its window, the first k."""
    order = Window.partitionBy("group", "nth", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(groups: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """The groups with the window of each positive in place of what they looked for before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                ids, found = np.frombuffer(g["ids"], "<i8"), defaultdict(dict)
                for p in g["found"]:
                    found[p["nth"]][p["rank"]] = p
                slots = max((p["rank"] for p in g["found"]), default=1)
                bottom, top, who = (np.full((len(ids), slots), v) for v in (1, 0, -1))
                for i, ps in found.items():
                    for rank, p in ps.items():
                        bottom[i, rank - 1], top[i, rank - 1], who[i, rank - 1] = -(-low * p["score"] // 100), high * p["score"] // 100, p["id"]
                yield _group_row(g["group"], g["label"], ids, _of(g["q"], g["width"]), bottom, top, who)

    gathered = positives.groupBy("group").agg(F.collect_list(F.struct("nth", "rank", "score", "id")).alias("found"))  # a group is GROUP anchors
    with _few_rows(groups.sparkSession):
        return written(groups.select("group", "label", "width", "ids", "q").join(gathered, "group").mapInArrow(run, GROUPS), "negatives-windows")


def _raised(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The groups with the bottom of each window raised to the k-th best that was found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                ids = np.frombuffer(g["ids"], "<i8")
                low, high, who = (np.frombuffer(g[c], "<i8").reshape(len(ids), -1) for c in ("low", "high", "positive"))
                low = low.copy()
                for f in g["found"] or []:
                    low[f["nth"], f["slot"]] = max(low[f["nth"], f["slot"]], f["score"])
                yield _group_row(g["group"], g["label"], ids, _of(g["q"], g["width"]), low, high, who)

    full = _top(found, k).where(F.col("rank") == k).groupBy("group").agg(F.collect_list(F.struct("nth", "slot", "score")).alias("found"))
    with _few_rows(groups.sparkSession):
        return written(groups.join(full, "group", "left").drop("n").mapInArrow(run, GROUPS), "negatives-raised")


def hard_negatives(rows: DataFrame, every: int = 100, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    `every`, and each of its n_positives nearest rows of its label, the n_negatives nearest rows of other labels with a
    score from low to high percent of the positive's. Vectors are multiplied by `scale` and rounded down."""
    if low > high or min(every, scale, n_positives, n_negatives) < 1:
        raise ValueError("low must not be above high, and the numbers positive")
    vectors = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    blocks = _blocks(_whole_numbers(vectors, scale))
    with _few_rows(rows.sparkSession):
        groups = _anchors(blocks, every, n_positives)
    pages, n_pages = _pages(blocks)
    found = _score(_choose(groups, pages, n_pages, same_label=True), blocks, n_positives)
    positives = written(_top(found, n_positives).drop("slot"), "negatives-positives")
    windows = _windows(groups, positives, low, high)
    first = _score(_choose(windows, pages, n_pages, False, first_look=True), blocks, n_negatives)
    raised = _raised(windows, first, n_negatives)
    rest = _score(_choose(raised, pages, n_pages, False, first_look=False), blocks, n_negatives)
    negatives = _top(first.unionByName(rest), n_negatives)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, ids in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["group", "nth", "anchor_id"])

    ids = groups.select("group", "ids").mapInArrow(anchors, "group long, nth int, anchor_id long")
    pairs = positives.join(ids, ["group", "nth"]).select("group", "nth", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("group", "nth", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["group", "nth", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
