"""Conversations as a prefix trie, with the totals of every subtree, by a rollup in bands of depth.

A node is a distinct sequence of the first d turns. Its key is a running hash: each turn at its depth gives two
64-bit hashes, and a prefix has the exclusive or of those of its turns, so that the keys along a conversation are running
aggregates by chunks of depth and one long conversation is many tasks. A node's members are counted by a partial
aggregation, so a first turn or a conversation that very many share is a row or so from each task.

Totals of subtrees (`roll_up`): depths are cut into bands of BAND. A node adds its own value to itself and to its
ancestors in its band only, at most BAND of them, whose keys its conversations carry. The sums at the bands' topmost
nodes are a trie of their own, BAND times less deep, which is rolled up in the same way; then each of these completed
totals goes to the ancestors in the band above. Rounds are the logarithm of the depth to the base BAND, and no row is
exploded to more than BAND rows, however deep the trie is.

Digests of the ids of those who end at a node (`end_digests`): ids are sorted by range, so a node's may be in many tasks,
joined there into pieces, and the pieces of a node hashed as a stream in the order of the ids.

Defined results: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; rows
that repeat are turns each. Rows without a conv_id belong to no conversation and are left out. Conversations without
turns end at the root. An empty table has no root and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import text_or_empty, written

#: Levels of a band, and of a chunk that running hashes are scanned by; a chunk is whole bands.
BAND, CHUNK = 8, 512
KEY = ["depth", "key_a", "key_b"]


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin, from 0, and the number of rows at the end."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, n]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, said_a, said_b, n_bytes): the place of each turn in its conversation, from 0, two hashes of what
    is said and the text's length. Turns are sorted by range, so a conversation may be spread over many tasks."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # so that equal rows can be parted too
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_row").select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.xxhash64("role", "text").alias("said_a"),
        F.xxhash64(F.lit("said"), "text", "role").alias("said_b"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                at = _runs([ids])
                begins = at[:-1].copy()
                begins[0] -= seen if ids[0] == last else 0
                nth = np.arange(len(ids)) - np.repeat(begins, np.diff(at))
                last, seen = ids[-1], int(nth[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=[*batch.schema.names, "nth"])

    at = written(ordered.mapInArrow(number, "conv_id long, part int, said_a long, said_b long, n_bytes long, nth long"), "trie-turns")
    counts = at.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    cut = before.where("before > 0")  # conversations that go on in another partition: at most one for each of these
    return at.join(cut, ["conv_id", "part"], "left").select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "said_a", "said_b", "n_bytes")


def rebuilt(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """(conv_id, depth, length, said_a, said_b, n_bytes): every conversation with its first `head` turns taken from the
    conversation `base` (both from conv_id; without them every conversation is as it is). Depth is from 1, and a row
    of depth 0 stands for each conversation's root. `head` must be small: a head is joined to all that take it."""
    placed = written(numbered_turns(turns), "trie-placed")
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"base": F.col("conv_id") if base is None else base, "head": F.lit(0).cast("long") if head is None else head})
    theirs = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.join(theirs, "base", "left").select("conv_id", "base", "head", given.alias("given"), (given + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")), "trie-convs")
    said = ["said_a", "said_b", "n_bytes"]
    top = convs.agg(F.max("head")).first()[0] or 0
    heads = placed.where(F.col("pos") < top).select(F.col("conv_id").alias("base"), "pos", *said)
    taken = convs.where("given > 0").join(heads, "base").where("pos < given").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", *said)
    own = placed.join(convs, "conv_id").where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("given") + 1).alias("depth"), "length", *said)
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), "length", *[none.alias(c) for c in said])
    return taken.unionByName(own).unionByName(roots)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows of rebuilt() with the key of the prefix that ends there, and without what is said."""
    own = {f"own_{k}": F.when(F.col("depth") == 0, F.lit(0)).otherwise(h).cast("long") for k, h in (("a", F.xxhash64("depth", "said_a")), ("b", F.xxhash64("said_b", "depth")))}
    rows = written(rows.withColumns(own).withColumn("chunk", F.floor(F.col("depth") / CHUNK)).drop("said_a", "said_b"), "trie-rows")
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(F.col("length") >= CHUNK).groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"own_{k}").alias(k) for k in "ab"])
    firsts = totals.select("conv_id", "chunk", *[F.bit_xor(k).over(before).alias(f"before_{k}") for k in "ab"])
    scanned = rows.withColumns({f"key_{k}": F.bit_xor(f"own_{k}").over(within) for k in "ab"}).join(firsts, ["conv_id", "chunk"], "left")
    keys = [F.col(f"key_{k}").bitwiseXOR(F.coalesce(f"before_{k}", F.lit(0))).alias(f"key_{k}") for k in "ab"]
    return scanned.select("conv_id", "depth", "length", "n_bytes", *keys)


def _with_ancestors(of: DataFrame, step: int) -> DataFrame:
    """The rows whose depth is a multiple of `step`, with the keys 1 to BAND steps above (up1_a, up1_b, ...): those in
    their band, and for a band's topmost node all of the band above. A topmost node is listed in both bands."""
    rows = of.where(F.col("depth") % step == 0).withColumn("k", F.expr(f"depth DIV {step}"))
    band = F.floor(F.col("k") / BAND)
    rows = rows.withColumn("band", F.explode(F.when(F.col("k") % BAND == 0, F.array(band - 1, band)).otherwise(F.array(band))))
    line = Window.partitionBy("conv_id", "band").orderBy("k")
    rows = rows.withColumns({f"up{i}_{k}": F.lag(f"key_{k}", i).over(line) for i in range(1, BAND + 1) for k in "ab"})
    return rows.where(F.col("band") == F.floor((F.col("k") - 1) / BAND)).drop("band")  # the root's is -1


_UPS = [f"up{i}_{k}" for i in range(1, BAND + 1) for k in "ab"]


def trie_nodes(of: DataFrame) -> DataFrame:
    """One row for each node: its key, its ancestors' keys in its band, smallest member, numbers of members and of those
    who end here, and the bytes of its last text."""
    ends = F.count_if(F.col("depth") == F.col("length"))
    return _with_ancestors(of, 1).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), ends.alias("n_ends"), F.min("n_bytes").alias("n_bytes"), *[F.min(c).alias(c) for c in _UPS])


def roll_up(of: DataFrame, nodes: DataFrame, values: list[str], deepest: int, step: int = 1) -> DataFrame:
    """(key, values): the sums of the values over each node's subtree. nodes has every node at a multiple of `step`
    with its ancestors' keys; `of` are the conversations' prefixes."""
    k = F.expr(f"depth DIV {step}")
    nodes = nodes.withColumn("nth", k % BAND)

    def above(i: int) -> list[Column]:
        return [(F.col("depth") - i * step).alias("depth"), F.col(f"up{i}_a").alias("key_a"), F.col(f"up{i}_b").alias("key_b")]

    def targets(first: int, nth: Column) -> Column:
        """The node itself (0) and its ancestors in the band, but for the topmost one."""
        up = [F.struct(*(above(i) if i else [F.col(c) for c in KEY])) for i in range(first, BAND)]
        return F.filter(F.array(*[F.when(nth > i, u) for i, u in zip(range(first, BAND), up)]), lambda x: x.isNotNull())

    sums = [F.sum(v).alias(v) for v in values]
    top = F.array(*[F.struct(*(above(i) if i else [F.col(c) for c in KEY])) for i in range(BAND)])
    to_top = nodes.select(F.get(top, F.col("nth").cast("int")).alias("to"), *values)
    tops = to_top.groupBy(*[F.col(f"to.{c}").alias(c) for c in KEY]).agg(*sums)
    if deepest >= step * BAND:
        above_all = _with_ancestors(of, step * BAND).groupBy(*KEY).agg(*[F.min(c).alias(c) for c in _UPS])
        tops = roll_up(of, written(above_all.join(tops, KEY), "trie-band"), values, deepest, step * BAND)
    tops = written(tops, "trie-tops")
    inner = nodes.where("nth > 0").select(F.explode(targets(0, F.col("nth"))).alias("to"), *values)
    below = nodes.where("nth = 0 AND depth > 0").drop(*values).join(tops, KEY)
    inner = inner.unionByName(below.select(F.explode(targets(1, F.lit(BAND))).alias("to"), *values))
    return tops.unionByName(inner.groupBy(*[F.col(f"to.{c}").alias(c) for c in KEY]).agg(*sums))


def end_digests(of: DataFrame) -> DataFrame:
    """(key, ends_sha256): for each node at which conversations end, the SHA-256 of their ids in ascending order."""
    schema = "depth long, key_a long, key_b long, first long, ids string"
    ends = of.where("depth = length").select(*KEY, "conv_id")
    ordered = written(ends, "trie-ends").orderBy(*KEY, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy() for c in batch.columns]
                at, ids = _runs(columns[:3]), columns[3].tolist()
                texts = [",".join(map(str, ids[i:j])) for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[at[:-1]]) for c in columns], pa.array(texts, pa.string())], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            for key, ids in zip(keys, batch.column(4).to_pylist()):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            yield _table(done)
        if now:
            yield _table([(*now, sha.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

    joined = ordered.mapInArrow(pieces, schema)
    by_node = joined.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return by_node.mapInArrow(hashed, "depth long, key_a long, key_b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of texts that sharing each prefix saves in its subtree), ends_sha256."""
    of = written(prefixes(rebuilt(turns, base, head)), "trie-prefixes")
    nodes = trie_nodes(of).withColumns({"n_leaves": (F.col("n_convs") == F.col("n_ends")).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = written(nodes, "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = roll_up(of, nodes.select(*KEY, *_UPS, "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], deepest)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1_a").alias("key_a"), F.col("up1_b").alias("key_b")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.select(*KEY, "conv_id", "n_convs", "up1_a", "up1_b")
    parts = [own, totals, children, end_digests(of)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    whole = merged.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in merged.columns if c not in KEY])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("up1_a"), F.col("key_b").alias("up1_b"), F.col("conv_id").alias("parent_conv_id"))
    nobody = F.sha2(F.lit(b""), 256)
    return (
        written(whole, "trie-whole")
        .join(parents, ["depth", "up1_a", "up1_b"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
    )
