import random

import numpy as np
import pytest
from helpers import duck

import corpus_pipeline
from loomspark.llm import similar

WORDS = [f"w{i}" for i in range(3000)]


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_brute_force(rows):
    """rows (id, text): the smallest id of each component."""
    sets, up, holders = [grams(t) for _, t in rows], list(range(len(rows))), {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders.get(g, ())}:
            common = len(s & sets[j])
            if common >= 0.8 * (len(s) + len(sets[j]) - common):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for g in s:
            holders.setdefault(g, []).append(i)
    return sorted({rows[root(i)][0] for i in range(len(rows))})


def test_stage_drops_what_five_words_make_near_copies(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = sorted(duck(f"/root/testdata/{sf}").sql("SELECT doc_id, text FROM documents").fetchall())
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").select("doc_id").collect())
        assert got == kept_by_brute_force(rows)


@pytest.mark.parametrize("block", [2, 8, 64])
def test_large_groups_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "SLICE", 3 * block)
    monkeypatch.setattr(similar, "DENSE", block)
    monkeypatch.setattr(similar, "RECALL", 0.99999)  # so that the random texts' result is that of brute force
    rnd, rows = random.Random(5), []
    for _ in range(4):
        text = rnd.choices(WORDS, k=150)
        for i in range(40):  # each a little further from the first
            if i % 3 == 0:
                text = [*text[: (k := rnd.randrange(150))], rnd.choice(WORDS), *text[k + 1 :]]
            rows.append((len(rows), " ".join([*text, str(i)])))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \n", "A b", "a  B", "a b c"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_similar(df).collect()) == kept_by_brute_force(rows)
    assert similar.drop_similar(df.limit(0)).isEmpty()


@pytest.mark.parametrize("size", [5, 20, 200, 2000])
def test_recall_at_the_least_similarity(size):
    rnd, n, plan = np.random.default_rng(3), 400, similar.Plan(200_000, 0.8)
    prints = []
    for _ in range(n):
        h = rnd.integers(1 << 63, size=size, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(h[: size - size // 10]), np.unique(h[size // 10 if size > 5 else 1 :])  # 4 of 5 shingles in both
        assert similar.similar(a, b, 0.8) or size == 5
        prints.append([similar.fingerprint(x, plan.words) for x in (a, b if size > 5 else h[1:])])
    (va, xa), (vb, xb) = (similar.ring(np.array([p[i] for p in prints]), plan) for i in (0, 1))
    chain = va == vb
    for mask, most in plan.masks():
        chain &= np.bitwise_count((xa ^ xb) & np.uint64(mask & (1 << 64) - 1)) <= most
    radius = plan.radius_for(np.array(size * 0.9))
    close = np.array([np.bitwise_count(a ^ b).sum() <= radius for a, b in prints])
    assert (chain.any(axis=1) & close).sum() >= (0.985 if size > 5 else 0.9) * n


def test_unlike_texts_hardly_meet():
    rnd, plan = np.random.default_rng(4), similar.Plan(200_000, 0.8)
    values, after = similar.ring(np.array([similar.fingerprint(rnd.integers(1 << 63, size=300, dtype=np.uint64), plan.words) for _ in range(1500)]), plan)
    met = pruned = 0
    for i in range(1, 1500):
        same = values[i] == values[:i]
        met += same.sum()
        for mask, most in plan.masks():
            same &= np.bitwise_count((after[i] ^ after[:i]) & np.uint64(mask & (1 << 64) - 1)) <= most
        pruned += same.sum()
    assert met < 3 * 1500**2 / 2 * plan.segments / 2**plan.width and pruned <= 3


def test_similarity_out_of_range():
    for s in (0.2, 1.0):
        with pytest.raises(ValueError):
            similar.Plan(10, s)


def test_pairs_grow_in_proportion_to_a_group(spark, monkeypatch):
    verified, counts, rnd = similar._verified, [], random.Random(6)
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: counts.append(pairs.distinct().count()) or verified(pairs, *rest))
    text = rnd.choices(WORDS, k=300)
    for size in (24, 60):  # buckets of at most DENSE
        rows = [(i, " ".join([*text[: (k := rnd.randrange(300))], f"x{i}", *text[k + 1 :]])) for i in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r.doc_id for r in similar.drop_similar(df).collect()) == kept_by_brute_force(rows) == [0]
    assert counts[1] < 15 * 60 and counts[1] < 4 * counts[0]  # all pairs are 1,770, 6.4 times as many as of 24


def test_what_a_group_leaves_open_is_compared_with_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(similar, "RECALL", 0.99999)
    rnd, rows = random.Random(7), []
    text = rnd.choices(WORDS, k=150)
    for i in range(60):  # many of them near to each other, but not enough for a link
        words = list(text)
        for k in rnd.sample(range(150), rnd.choice((1, 2, 4))):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = kept_by_brute_force(rows)
    assert sorted(r.doc_id for r in similar.drop_similar(df).collect()) == kept


def test_one_set_with_several(monkeypatch):
    monkeypatch.setattr(similar, "COMPARED", 50)
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(60, size=rnd.integers(1, 120), dtype=np.uint64)) for _ in range(200)]
    for a in sets[:20]:
        assert similar.similar_to(a, sets, 0.8).tolist() == [similar.similar(a, b, 0.8) for b in sets]
