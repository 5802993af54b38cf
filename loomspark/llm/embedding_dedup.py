"""Embedding near-dedup by spherical-cap filters.

Filters are directions on the sphere, structured as products: after a fixed random rotation, a direction is a pair of
code words, one of each half's code of random unit vectors, so CODE words a half give CODE^2 filters. A vector's
filters are all those whose direction it meets at the threshold or above. They are list-decoded: of each half only
the words are looked at that can reach the threshold with the other half's best word. The threshold is set, for each
dimension, so that a random vector has FILTERS filters on average. Several codes with rotations of their own make
vectors rare that have few filters in all. Vectors of one label that share a filter are candidates, and every candidate
pair is verified by its cosine in double precision.

In fewer than LOW dimensions such caps are narrower than the angle that is looked for, and directions made of two equal
halves leave parts of the sphere bare. There the cells of GRIDS rotated and shifted grids are the filters, four times as
wide as the distance of two unit vectors at the least cosine.

The work follows the candidates. Equal vectors of a label are one row with a weight from the start. Only (filter,
row) numbers are exchanged to find filters with more than one row; only rows with such a filter are dealt to them with
their vectors. A filter with more than BLOCK rows is split into blocks, and every pair of blocks is a task's unit of
its own, so no task holds a whole large filter. A pair is counted only in the first filter that both rows have; no
pairs leave the tasks, only counts and the edges of a spanning forest of each unit.

Filters are a search with a measured recall (see the tests: over 0.99 at cosines from 0.98 on, in every dimension from 1
to 16, in 64 and in 256); what is linked has a cosine of at least `least_cosine`, which may not be below 0.98, as the
caps are planned for that. Defined results: null labels, and vectors that are null, empty, zero or hold null
or non-finite components, link with nothing and are their own component. Vectors of different lengths link with
nothing of each other. A null vec_id counts as a link of others but is the smallest of its component only if there is
no other. Repeated rows are links of each other. Empty tables are fine; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import written
from loomspark.llm.components import connected_components

LEAST_COSINE = 0.98
#: So many codes of their own; CODE words a half in each; filters that a random vector has in each, on average.
CODES, CODE, FILTERS = 8, 512, 6.0
BLOCK, SEED = 512, 20
LOW, GRIDS = 12, 16


@lru_cache(maxsize=4 * CODES)
def product_code(dim: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A code's rotation, the two halves' words (as columns) and the threshold, for vectors of a dimension."""
    rng = np.random.default_rng([SEED, dim, code])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = max(1, dim // 2)
    words = [rng.standard_normal((n, CODE)) for n in (half, dim - half)]
    words = [w / np.maximum(np.linalg.norm(w, axis=0), 1e-300) / np.sqrt(2) for w in words]
    x = rng.standard_normal((400, dim))
    x = x @ turn / np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:, :half] @ words[0], x[:, half:] @ words[1]
    # the threshold by bisection on how many of all filters the random vectors have
    b.sort(axis=1)
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        n = sum(CODE * CODE - np.searchsorted(row_b, mid - row_a).sum() for row_a, row_b in zip(a, b)) / len(x)
        low, high = (mid, high) if n > FILTERS else (low, mid)
    return turn, words[0], words[1], high


def grid_cells(unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of a grid's cells that the unit vectors lie in."""
    dim = unit.shape[1]
    rng, side = np.random.default_rng([SEED, dim, code]), 4 * np.sqrt(2 - 2 * LEAST_COSINE)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cell = np.floor((unit @ turn + rng.random(dim) * side) / side).astype(np.int64)
    return np.arange(len(unit)), (cell + 16) @ (np.int64(32) ** np.arange(dim)) * GRIDS + code


def list_decode(unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all of a code's filters that each unit vector (a row) exceeds."""
    if unit.shape[1] < LOW:
        return grid_cells(unit, code)
    turn, w0, w1, least = product_code(unit.shape[1], code)
    x = unit @ turn
    a, b = x[:, : len(w0)] @ w0, x[:, len(w0) :] @ w1
    row_a, col_a = np.nonzero(a >= least - b.max(axis=1)[:, None])
    row_b, col_b = np.nonzero(b >= least - a.max(axis=1)[:, None])
    # every word of the first half against every word of the second half of the same row
    first, count = np.searchsorted(row_b, row_a), np.bincount(row_b, minlength=len(unit))[row_a]
    left = np.repeat(np.arange(len(row_a)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    ok = a[row_a[left], col_a[left]] + b[row_b[right], col_b[right]] >= least
    left, right = left[ok], right[ok]
    return row_a[left], (code * CODE + col_a[left]) * CODE + col_b[right]


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cls, vector) -> (cls, filters), the filters in order."""
    for b in batches:
        filters = [np.empty(0, np.int64)] * len(b)
        sizes = b["vector"].map(len).to_numpy()
        for dim in np.unique(sizes):
            at = np.nonzero(sizes == dim)[0]
            for part in np.array_split(at, max(1, len(at) // 256)):
                units = _units(b["vector"].iloc[part])
                row, found = (np.concatenate(x) for x in zip(*(list_decode(units, c) for c in range(GRIDS if dim < LOW else CODES))))
                order = np.lexsort((found, row))
                for i, fs in zip(part, np.split(found[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])):
                    filters[i] = fs
        yield pd.DataFrame({"cls": b["cls"], "filters": filters})


def _lower(filters: list[np.ndarray], this: int) -> np.ndarray:
    """For each row which of the filters below `this` it has, out of those that more than one row has."""
    sizes = [int(np.searchsorted(f, this)) for f in filters]
    below = np.concatenate([f[:n] for f, n in zip(filters, sizes)])
    _, at, n = np.unique(below, return_inverse=True, return_counts=True)
    several = n > 1
    number, row, mine = np.cumsum(several) - 1, np.repeat(np.arange(len(filters)), sizes), several[at]
    out = np.zeros((len(filters), int(several.sum())), np.float32)
    out[row[mine], number[at[mine]]] = 1
    return out


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        while (p := self.up.get(v, v)) != v:
            self.up[v] = v = self.up.get(p, p)
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def verify_unit(x: np.ndarray, cls: np.ndarray, weight: np.ndarray, filters: list, this: int, block: np.ndarray, one: int, two: int, least_cosine: float) -> tuple[np.ndarray, list]:
    """One filter's rows, or two blocks of them (x are unit vectors) -> each row's links and a spanning forest."""
    rows, cols = (np.arange(len(x)),) * 2 if one == two else (np.nonzero(block == one)[0], np.nonzero(block == two)[0])
    near = x[rows] @ x[cols].T >= least_cosine
    if one == two:
        near = np.triu(near, 1)
    if near.any():
        lower = _lower(filters, this)
        near &= lower[rows] @ lower[cols].T == 0  # counted elsewhere if they share an earlier filter
    a, b = np.nonzero(near)
    a, b = rows[a], cols[b]
    n = np.bincount(a, weight[b], minlength=len(x)) + np.bincount(b, weight[a], minlength=len(x)) if len(a) else np.zeros(len(x))
    forest = _Forest()
    return n, [e for e in zip(cls[a].tolist(), cls[b].tolist()) if forest.join(*e)]


def _verify(least_cosine: float):
    key = ["label", "dim", "filter", "one", "two"]

    def verified(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Counts of links (v, n) and edges (v, w) of the units that lie between the starts."""
        cls, weight, filters, vectors = b["cls"].to_numpy(), b["weight"].to_numpy(), b["filters"].tolist(), b["vector"].tolist()
        block, this, one, two = (b[c].to_numpy() for c in ("block", "filter", "one", "two"))
        counts, edges = np.zeros(len(b)), []
        for i, j in zip(starts, starts[1:]):
            counts[i:j], more = verify_unit(_units(vectors[i:j]), cls[i:j], weight[i:j], filters[i:j], this[i], block[i:j], one[i], two[i], least_cosine)
            edges += more
        some = counts > 0
        linked = pd.DataFrame({"v": cls[some], "w": None, "n": counts[some].astype(np.int64)})
        return pd.concat([linked, pd.DataFrame(edges, columns=["v", "w"]).assign(n=0)]).astype({"v": "Int64", "w": "Int64", "n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by unit; the last unit of a batch waits for the rest of it."""
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            keys = b[key].to_numpy()
            starts = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])[0]
            if len(starts) > 1:
                yield verified(b, starts)
            rest = b.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield verified(rest, np.array([0, len(rest)]))

    return run


def near_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """Every row of rows: its id, n_links, component_id and kept."""
    if least_cosine < LEAST_COSINE:
        raise ValueError(f"the filters are planned for cosines from {LEAST_COSINE} on")
    plain = rows.schema[vector_col].dataType.simpleString() == "array<float>"  # half of a double's bytes to deal
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    narrow = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>" if plain else "array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    mine = narrow.where(usable)
    least_id = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("least")
    classes = mine.groupBy("label", "vector").agg(least_id, F.count(F.lit(1)).alias("weight"))
    classes = written(classes.select("label", "vector", "weight", F.col("least.id").alias("least"), F.monotonically_increasing_id().alias("cls")), "near-classes")
    decoded = written(classes.select("cls", "vector").mapInPandas(_decode, "cls long, filters array<long>"), "near-filters")
    small = classes.select("cls", "label", F.size("vector").alias("dim"))
    listed = decoded.join(small, "cls").select("cls", "label", "dim", F.explode("filters").alias("filter"))
    sizes = listed.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(listed.join(sizes, ["label", "dim", "filter"]), "near-shared")
    several = shared.groupBy("cls").agg(F.sort_array(F.collect_list("filter")).alias("filters"))  # a row has some 50
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cls"), n_blocks).cast("int")
    shared = shared.withColumn("n_blocks", n_blocks).withColumn("block", block)
    units = shared.select("cls", "label", "dim", "filter", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    units = units.select("cls", "label", "dim", "filter", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    full = units.join(classes.select("cls", "vector", "weight").join(several, "cls"), "cls")
    dealt = full.repartition("label", "dim", "filter", "one", "two").sortWithinPartitions("label", "dim", "filter", "one", "two")
    found = written(dealt.mapInPandas(_verify(least_cosine), "v long, w long, n long"), "near-found")
    counts = found.where("w IS NULL").groupBy("v").agg(F.sum("n").alias("n"))
    counts = written(counts, "near-counts")
    linked = connected_components(found.where("w IS NOT NULL").select(F.col("v").alias("a"), F.col("w").alias("b")))
    linked = written(linked, "near-linked")
    labelled = classes.join(counts, classes["cls"] == counts["v"], "left").join(linked, classes["cls"] == linked["vertex"], "left")
    labelled = written(labelled.select("label", "vector", "least", F.coalesce("component", "cls").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "near-labelled")
    smallest = written(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "near-smallest")
    answers = written(labelled.join(smallest, "component").select("label", "vector", "n_links", "component_id"), "near-answers")
    linking = mine.join(answers, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = narrow.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linking.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
