"""Hard negatives against all scores in plain numpy, on heaps, frequent vectors, wide numbers and odd rows."""

import math

import numpy as np
import pytest
from helpers import SF, duck

from loomspark.llm import hard_negatives as H
from loomspark.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, score double, `group` string"


def brute(rows, every=100):
    own = []
    for i, vec, label in dict.fromkeys((i, tuple(v) if v is not None else None, la) for i, v, la in rows):
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [math.floor(256 * x) for x in vec]
        if sum(x * x for x in q) < 2**62:
            own.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a, la, qa in own:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lb) for i, lb, q in own if i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:5]:
            fit = [(s, i) for s, i, lb in scored if lb != la and -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def by_query(spark, tmp_path, rows, parts=3):
    spark.createDataFrame([(*r, 1.0, "g") for r in rows], SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return got(queries.op13_hard_negatives(spark, str(tmp_path)))


def test_hilbert_curve_visits_neighbours():
    """All places once, and each one beside the one before."""
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        at = H.hilbert_index(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, a = rng.integers(-300, 300, (50, 9)), rng.integers(-300, 300, (20, 9))
    least, most = H.bounds(a, q.min(axis=0)[None], q.max(axis=0)[None])
    s = H.products(a, q)
    assert (s >= least).all() and (s <= most).all()
    wide = rng.integers(-(2**29), 2**29, (30, 4))
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in wide] for u in wide]
    assert H.products(wide, wide).tolist() == exact


def test_query_on_its_table(spark):
    rows = duck().sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert got(queries.op13_hard_negatives(spark, SF)) == brute(rows) != []


@pytest.mark.parametrize("size", [512, 1 << 18])
def test_heaps_and_a_frequent_vector(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(H, "BLOCK_BYTES", size)
    monkeypatch.setattr(H, "PAGE", 16)
    monkeypatch.setattr(H, "GROUP", 3)
    rng = np.random.default_rng(4)
    heaps = rng.normal(size=(12, 6))
    rows = [(i, (heaps[i % 12] + rng.normal(size=6) * 0.05).tolist(), int(rng.integers(0, 10))) for i in range(900)]
    rows += [(1000 + i, heaps[0].tolist(), int(i % 2)) for i in range(500)]
    assert by_query(spark, tmp_path, rows) == brute(rows) != []


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Of heaps that are far apart only the own ones are read."""
    monkeypatch.setattr(H, "BLOCK_BYTES", 1024)
    rng = np.random.default_rng(5)
    heaps = rng.normal(size=(20, 8)) * 3
    rows = [(i, (heaps[i % 20] + rng.normal(size=8) * 0.01).tolist(), i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label long")
    blocks = H._blocks(H._whole_numbers(df, 256))
    groups = H._anchors(blocks, 100, 5)
    chosen = H._choose(groups, *H._pages(blocks), same_label=True)
    n_anchors = 40
    read = sum(len(r.nth) // 4 for r in chosen.select("nth").collect())
    assert read < 0.25 * n_anchors * blocks.where("label = 0").count()


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9], 2), (4, [0.9, 0.1, 5.0], 2), (5, [], 1), (6, None, 1), (7, [1.0, 0.0], 0), (8, [1.0, nan], 2),
        (9, [inf, 0.0], 2), (10, [None, 1.0], 2), (None, [1.0, 0.0], 2), (11, [1.0, 0.0], None), (12, [1e30, 0.0], 2), (13, [1.0, 0.0], 2), (13, [1.0, 0.0], 2), (15, [-1.0, 0.5], 1),
        (100, [0.0, 0.0], 3), (101, [1.0, 1.0], 3), (200, [-1.0, 0.0], 4), (201, [1.0, 0.0], 4), (300, [], 5), (301, [], 5), (-100, [2.0, 1.0], 1), (1, [1.0, 0.5], 1), (400, [9.0], 9),
    ]
    assert by_query(spark, tmp_path, rows) == brute(rows) != []


def test_empty_table(spark, tmp_path):
    assert by_query(spark, tmp_path, [], 1) == []
