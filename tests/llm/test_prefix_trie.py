"""The prefix trie against plain Python, with long conversations, hot ones and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SF, duck

from loomspark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key_a string"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    new = {}
    for c, ts in said.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = abs(c) // 5 * 5 * (1 if c > 0 else -1)
        new[c] = said.get(base, [])[:h] + ts[h:] if rebuild else ts
    members = defaultdict(list)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, leaves, saved, ends = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for c, ts in new.items():
        ends[tuple(ts)].append(c)
    inner = {p[:-1] for p in members if p}
    for p in members:
        if p:
            kids[p[:-1]] += 1
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def by_query(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return got(queries.op12_prefix_trie(spark, str(tmp_path)))


def test_query_on_its_table(spark):
    rows = duck().sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got(queries.op12_prefix_trie(spark, SF)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (0, 0, "user", "a"), (0, None, None, "first"), (0, 1, "bot", None), (0, 1, "bot", "é"), (0, 1, "bot", "é"), (1, 5, "user", "x"), (2, 0, "user", "a"),
        (-3, 0, "user", "a"), (-3, 1, "bot", "b"), (-5, 0, "user", "neg"), (-9, 2, "u", "w" * 5000), (7, 0, "", ""), (12, 3, None, None), (None, 0, "user", "nobody"),
        (5, 0, "user", "a"), (6, 0, "user", "a"), (8, 0, "user", "a"), (9, 1, "user", "z"), (2**62, 0, "user", "a"),
    ]
    assert by_query(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert by_query(spark, tmp_path, []) == []


@pytest.mark.parametrize("band, chunk", [(8, 512), (3, 6), (2, 4)])
def test_deep_and_shared(spark, monkeypatch, band, chunk):
    """Depths over several bands of bands, a conversation that many share, and others that leave it on the way."""
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "_UPS", [f"up{i}_{k}" for i in range(1, band + 1) for k in "ab"])
    rng, rows = random.Random(1), []
    trunk = [("user", f"t{i}" * rng.randint(0, 3)) for i in range(150)]
    for c in range(60):
        said = trunk[: rng.choice([1, 2, 3, 40, 150])] + [("bot", rng.choice("xy")) for _ in range(rng.choice([0, 0, 3, 20]))]
        rows += [(c, i, *t) for i, t in enumerate(said)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert got(prefix_trie.prefix_trie(df)) == brute(rows, rebuild=False)
