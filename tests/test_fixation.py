"""Fixation indices and their errors against plain Python."""

import math
import random

import pytest

from loomspark.operators.fixation import fst

SCHEMA = "site long, pos long, sample long, pop string, alts long"


def site_parts(x, y):
    x, y = [g for g in x if g is not None], [g for g in y if g is not None]
    if not x or not y:
        return None
    n, p, h = [len(x), len(y)], [sum(x) / 2 / len(x), sum(y) / 2 / len(y)], [x.count(1) / len(x), y.count(1) / len(y)]
    num = (p[0] - p[1]) ** 2 - sum(f * (1 - f) / (2 * k - 1) for f, k in zip(p, n))
    den = p[0] * (1 - p[1]) + p[1] * (1 - p[0])
    bar = sum(n) / 2
    if bar == 1:
        return num, den, 0.0, 0.0
    c = 2 * bar - sum(k * k for k in n) / (2 * bar)
    f = sum(k * q for k, q in zip(n, p)) / (2 * bar)
    s2 = sum(k * (q - f) ** 2 for k, q in zip(n, p)) / bar
    het = sum(k * q for k, q in zip(n, h)) / (2 * bar)
    a = bar / c * (s2 - (f * (1 - f) - s2 / 2 - het / 4) / (bar - 1))
    b = bar / (bar - 1) * (f * (1 - f) - s2 / 2 - (2 * bar - 1) / (4 * bar) * het)
    return num, den, a, a + b + het / 2


@pytest.mark.parametrize("block", [5, 12, 40])
def test_fst(spark, block):
    rng = random.Random(block)
    pops = {s: "xyz"[s % 3] for s in range(14)}
    rate = {(site, p): rng.random() for site in range(63) for p in "xyz"}
    gt = [(i, 7 * (i % 50), s, p, None if rng.random() < 0.2 or (20 <= i < 32 and p == "z") else sum(rng.random() < rate[i, p] for _ in "ab")) for i in range(63) for s, p in pops.items()]
    got = {(r.a, r.b): r for r in fst(spark.createDataFrame(gt, SCHEMA), block).collect()}
    assert sorted(got) == [("x", "y"), ("x", "z"), ("y", "z")]
    order = sorted(range(63), key=lambda i: (7 * (i % 50), i))
    calls = {}
    for i, _, s, p, g in gt:
        calls.setdefault((i, p), []).append(g)
    for (a, b), r in got.items():
        each = [site_parts(calls[i, a], calls[i, b]) or (0.0,) * 4 for i in order]
        blocks = [[sum(e[c] for e in each[k : k + block]) for c in range(4)] for k in range(0, 63 - block + 1, block)]
        assert r.blocks == len(blocks)
        for c, value, error in ((0, r.hudson, r.hudson_se), (2, r.wc, r.wc_se)):
            assert value == pytest.approx(sum(e[c] for e in each) / sum(e[c + 1] for e in each))
            if len(blocks) < 2:
                assert error is None
                continue
            out = [sum(x[c] for x in blocks if x is not y) / sum(x[c + 1] for x in blocks if x is not y) for y in blocks]
            mean = sum(out) / len(out)
            assert error == pytest.approx(math.sqrt((len(out) - 1) / len(out) * sum((v - mean) ** 2 for v in out)), rel=1e-6)


def test_fst_of_nothing(spark):
    assert fst(spark.createDataFrame([], SCHEMA), 3).count() == 0
    same = fst(spark.createDataFrame([(1, 1, s, "xy"[s % 2], 0) for s in range(6)], SCHEMA), 1).collect()[0]
    assert (same.hudson, same.hudson_se, same.wc, same.blocks) == (None, None, None, 1)
    with pytest.raises(ValueError):
        fst(spark.createDataFrame([], SCHEMA), 0)
