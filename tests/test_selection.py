"""Clumps and pruning by linkage against the rules that go through the sites one by one."""

import random

import pytest

from loomspark.operators import selection as L


def made(rng, n, reach, even):
    sites = [(i, rng.randint(0, 3 * n) if not even else i, rng.choice([0.0001, 0.001, 0.005, 0.02, 0.3]) if rng.random() < 0.5 else rng.random() / 50, rng.choice([0.1, 0.2, 0.3, rng.random() / 2])) for i in range(n)]
    pairs = [(a[0], b[0], rng.random()) for a in sites for b in sites if a[0] < b[0] and abs(a[1] - b[1]) <= reach]
    return sites, pairs


def frames(spark, sites, pairs):
    return spark.createDataFrame(sites, "site long, pos long, p double, maf double"), spark.createDataFrame(pairs, "a long, b long, r2 double")


CASES = [(60, 12, False, 0.5), (40, 10, True, 0.0), (80, 30, False, 0.8), (25, 1000, False, 0.3)]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_clump(spark, case):
    n, reach, even, r2 = case
    sites, pairs = made(random.Random(n), n, reach, even)
    near = {frozenset(p[:2]) for p in pairs if p[2] >= r2}
    want = {}
    order = sorted(sites, key=lambda s: (s[2], s[1], s[0]))
    for s in order:
        if s[2] <= 0.006 and s[0] not in want:
            want[s[0]] = s[0]
            for t in order:
                if t[2] <= 0.02 and t[0] not in want and frozenset((s[0], t[0])) in near:
                    want[t[0]] = s[0]
    got = L.clump(*frames(spark, sites, pairs), 0.006, 0.02, r2).collect()
    assert sorted((r.site, r["index"]) for r in got) == sorted(want.items())


@pytest.mark.parametrize("case", CASES, ids=str)
def test_prune(spark, case):
    n, reach, even, r2 = case
    sites, pairs = made(random.Random(n + 1), n, reach, even)
    near = {frozenset(p[:2]) for p in pairs if p[2] > r2}
    there = {s[0] for s in sites}
    order = sorted(sites, key=lambda s: (s[1], s[0]))
    for j, t in enumerate(order):
        for s in order[:j]:
            if t[0] in there and s[0] in there and frozenset((s[0], t[0])) in near:
                there.discard(s[0] if s[3] < t[3] else t[0])
    got = L.pruned(*frames(spark, sites, pairs), r2).collect()
    assert len(got) == n and {r.site for r in got if r.kept} == there


def test_nothing(spark):
    sites, pairs = frames(spark, [(1, 5, None, 0.1)], [])
    assert L.clump(sites, pairs, 0.1, 0.1, 0.5).count() == 0
    assert [tuple(r) for r in L.pruned(sites, pairs, 0.5).collect()] == [(1, True)]
    assert L.pruned(sites.limit(0), pairs, 0.5).count() == 0 and L.clump(sites.limit(0), pairs, 0.1, 0.2, 0.5).count() == 0
    with pytest.raises(ValueError):
        L.clump(sites, pairs, 0.2, 0.1, 0.5)
