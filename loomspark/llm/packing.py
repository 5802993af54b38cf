"""Token-ID output: documents packed into rows of a fixed number of tokens, as binary matrices.

A document longer than a row is split, without loss, into pieces of a whole row and one rest; a whole piece is a row of
its own. The rests of the whole table are packed best-fit decreasing: the longest first, each into the row with the
least room that still takes it. Rests of one length are alike to the packing, so it works on how many there are of each
length, at most `length` numbers, whatever the size of the table: runs of rows that are filled alike are one entry. The
room is searched by a segment tree over the amounts of room (0 to `length`), which finds the smallest amount that is
large enough and has a run in a number of steps that is the logarithm of the row length. The plan says for every rank
among the rests of a length which row and place it gets, and each rest goes to its row in one shuffle.

Ranks count the rests of a length by the task that wrote them and their order in it: running sums over one number for
each task and length. Other input splits give the same rows but for which of the rests of a length are where.

Each packed row holds the ids and the positions (which start again from 0 with each piece) as little-endian unsigned
integers of 16 bits, or of 32 where a vocabulary or a row needs them; unused places at the end hold `pad` and position
0. cu_seqlens has the cumulative lengths of the pieces, from 0; doc_ids, parts and n_parts say which piece of which
document each is.

Defined results: documents without tokens (null or empty text) take no place in a row and are not listed. A null id
stays null. Repeated rows are packed each. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.bpe import loaded, slices
from loomspark.llm.common import small_batches, text_or_empty, written

LENGTH = 2048
PIECES = "doc_id long, part int, n_parts int, size int, nth long, task int, ids binary"


class RoomTree:
    """How many open rows there are for each amount of room; finds the least amount from a given one on."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, room: int) -> int:
        """The least amount of room that is at least `room` and has a row, or -1."""
        i, count = self.size + room, self.count
        while not count[i]:
            while i & 1:  # up from right children, then to the next subtree on the right
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """How many pieces there are of each size -> the plan: (size, rank, row, offset, each).

    An entry holds for the pieces of a size from a rank on, up to the next entry: they fill the rows from `row` on,
    `each` of them in every row, one after the other from the place `offset` on.
    """
    plan, n_rows = [], 0
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # runs (first row, number of rows)
    tree = RoomTree(length)

    def put(room: int, row: int, n: int) -> None:
        if n:
            by_room[room].append((row, n))
            tree.add(room, 1)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.least(size)
            if room < 0:
                room, run = length, (n_rows, -(-left // (length // size)))
                n_rows += run[1]
            else:
                run = by_room[room].pop()
                tree.add(room, -1)
            row, n = run
            each = room // size
            full, some = min(n, left // each), 0
            if full:
                plan.append((size, rank, row, length - room, each))
                put(room - each * size, row, full)
            if full < n and left > full * each:  # one row that the last pieces don't fill
                some = left - full * each
                plan.append((size, rank + full * each, row + full, length - room, some))
                put(room - some * size, row + full, 1)
            put(room, row + full + (some > 0), n - full - (some > 0))
            rank += full * each + some
            left -= full * each + some
    return plan


def _pieces(docs: DataFrame, tokenizer: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """Every piece of every document, with its number among the pieces of its size that its task writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = loaded(tokenizer), np.zeros(length + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 2):
                texts = [bpe.encode_all([t])[0] for t in some.column(2).to_pylist()] if some.num_rows == 1 else bpe.encode_all(some.column(2).to_pylist())
                sizes = np.array([len(t) for t in texts])
                n_parts = -(-sizes // length)
                doc = np.repeat(np.arange(len(texts)), n_parts)
                part = np.arange(len(doc)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                size = np.minimum(length, sizes[doc] - part * length)
                nth = seen[size] + pd.Series(size).groupby(size).cumcount().to_numpy()
                seen += np.bincount(size, minlength=length + 1)
                ids = [texts[d][p * length : (p + 1) * length].tobytes() for d, p in zip(doc.tolist(), part.tolist())]
                columns = [some.column(1).take(pa.array(doc)), part.astype(np.int32), n_parts[doc].astype(np.int32), size.astype(np.int32), nth, some.column(0).take(pa.array(doc)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    rows = docs.select(F.spark_partition_id().alias("task"), F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(run, PIECES), "pack-pieces")


def _place(plan: list[tuple[int, int, int, int, int]]):
    """A function of size and rank that gives row and offset. The plan has a few entries for each size at most."""
    size, first, row, offset, each = (np.array(c, np.int64) for c in zip(*sorted(plan)))
    keys = size << 44 | first

    @F.pandas_udf("row long, offset int")
    def place(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, sizes.to_numpy(np.int64) << 44 | ranks.to_numpy(), side="right") - 1
        nth = ranks.to_numpy() - first[at]
        return pd.DataFrame({"row": row[at] + nth // each[at], "offset": (offset[at] + nth % each[at] * size[at]).astype(np.int32)})

    return place


def _numbers(n: int, width: int) -> Column:
    """0, 1, .. n - 1 as packed numbers."""
    return F.lit(bytearray(np.arange(n, dtype=f"<u{width}").tobytes()))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed rows of all documents: pack_id, n_used, doc_ids, parts, n_parts, cu_seqlens, ids, position_ids."""
    if length < 1:
        raise ValueError("length must be positive")
    width = int(loaded(tokenizer).width[-1])
    if max(length, pad) >> 8 * width:
        raise ValueError(f"length and pad must fit in {8 * width} bits, like the ids")
    pieces = _pieces(docs, tokenizer, length, id_col, text_col)
    counts = pieces.groupBy("task", "size").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("task")) - F.col("n")
    firsts = written(counts.select("task", "size", "n", before.alias("first")), "pack-counts")
    found = {r["size"]: r["n"] for r in firsts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    whole = found.pop(length, 0)
    plan = best_fit_decreasing(found, length) or [(length, 0, 0, 0, 1)]
    ranked = pieces.join(firsts.drop("n"), ["task", "size"]).withColumn("rank", F.col("first") + F.col("nth"))
    own = F.struct(F.lit(0).alias("offset"), "size", "doc_id", "part", "n_parts", "ids")
    full = ranked.where(F.col("size") == length).select(F.col("rank").alias("pack_id"), F.array(own).alias("pieces"))
    rests = ranked.where(F.col("size") < length).withColumn("at", _place(plan)("size", "rank"))
    rests = rests.select((F.col("at.row") + whole).alias("pack_id"), F.struct("at.offset", "size", "doc_id", "part", "n_parts", "ids").alias("piece"))
    both = full.unionByName(rests.groupBy("pack_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces")))

    def joined(f) -> Column:
        return F.aggregate("pieces", F.lit(bytearray()), lambda a, p: F.concat(a, f(p)))

    used = (F.element_at("pieces", -1)["offset"] + F.element_at("pieces", -1)["size"]).cast("int")
    rest = (length - F.col("n_used")) * width
    padding, zeros = (F.lit(bytearray(np.full(length, v, f"<u{width}").tobytes())) for v in (pad, 0))
    each = both.select("pack_id", used.alias("n_used"), "pieces")
    return each.select(
        "pack_id",
        "n_used",
        F.col("pieces.doc_id").alias("doc_ids"),
        F.col("pieces.part").alias("parts"),
        F.col("pieces.n_parts").alias("n_parts"),
        F.concat("pieces.offset", F.array("n_used")).alias("cu_seqlens"),
        F.concat(joined(lambda p: p["ids"]), F.substring(padding, F.lit(1), rest)).alias("ids"),
        F.concat(joined(lambda p: F.substring(_numbers(length, width), F.lit(1), p["size"] * width)), F.substring(zeros, F.lit(1), rest)).alias("position_ids"),
    )


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """packed -> (doc_id, part, n_parts, ids): every piece again, for reading a packed table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for docs, parts, n_parts, cu, ids in zip(b["doc_ids"], b["parts"], b["n_parts"], b["cu_seqlens"], b["ids"]):
                row = np.frombuffer(ids, "<u4" if wide else "<u2")
                out += [(d, p, n, row[i:j].astype(np.int32)) for d, p, n, i, j in zip(docs, parts, n_parts, cu, cu[1:])]
            yield pd.DataFrame(out, columns=["doc_id", "part", "n_parts", "ids"]).astype({"doc_id": "Int64"})

    return packed.mapInPandas(run, "doc_id long, part int, n_parts int, ids array<int>")
