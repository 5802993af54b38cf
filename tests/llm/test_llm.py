"""The operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import SF, assert_matches, duck
from test_similar import kept_by_brute_force
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import bpe, chat, components, embedding_dedup, exact_dedup, mixing, packing, queries, sharding, simhash, toxicity, url_filter
from loomspark.session import read_table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size int, shard int, `row` string"
LONG = "word " * 60_000
ODD = [
    (1, "a b c d", "x", 1, 1, "r"),
    (2, None, None, None, None, None),
    (3, "", "x", 2, 2, "r"),
    (3, "", "x", 2, 2, "r"),
    (None, "A  b\tc d", "x", 3, 3, "r"),
    (4, LONG, "y", 4, 4, "r"),
    (5, LONG + "end", "y", 5, 5, "r"),
    (6, "a b c d", "x", 1, 1, "r"),
    (7, " \n\t", None, 1, 1, "r"),
    (7, "other words here", None, 1, 1, "r"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_matches(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


# sharding


def jump(key, n):
    at, to = -1, 0
    while to < n:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_op1(spark):
    got = queries.op1_shard(spark, SF).collect()
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall())
    slots = defaultdict(list)
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        key = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), jump(key, 16), jump(key, 17))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 2)
    rows = odd.select("doc_id", "shard").unionAll(spark.range(7).select(F.lit(9).cast("long"), F.lit(1)))
    rows = rows.select("doc_id", F.col("shard").alias("n"))
    got = sharding.assign_shards(rows, "doc_id", shards=2, buckets=3).collect()
    assert Counter((r.doc_id, r.n) for r in got) == Counter((r.doc_id, r.n) for r in rows.collect())
    for s in (0, 1):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(none.select("doc_id"), "doc_id").isEmpty()


# byte-pair encoding


@pytest.fixture(scope="module")
def theirs():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())


def test_op2(spark, theirs):
    texts = dict(duck().sql("SELECT doc_id, text FROM documents").fetchall())
    got = queries.op2_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_bpe_on_odd_texts(theirs):
    mine, rnd = bpe.Bpe(queries.tokenizer_path()), random.Random(5)
    alphabet = list("abcdefgh   's'tre'll don't 0123 \n\t") + ["<|endoftext|>", "<|startoftext|>", "<|", "Σ", "ΑΣ ", "İ", "é", "e\u0301", "\x1c", "\x85", "中文", "😀"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice((1, 5, 60)))) for _ in range(1500)] + ["ab" * 3000, "é" * 999, LONG]
    for text in texts:
        ids = mine.encode(text).tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids, text[:50]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_both_ways_of_merging_agree():
    mine, rnd = bpe.Bpe(queries.tokenizer_path()), random.Random(3)
    words = ["".join(rnd.choice("theinaroé") for _ in range(rnd.randint(1, 40))).encode() for _ in range(300)]
    for word, got in zip(words, mine._by_scan(words)):
        ids = [*mine.first[list(word[:-1])].tolist(), int(mine.last[word[-1]])]
        assert np.frombuffer(got, mine.width).tolist() == mine._by_heap(ids)


def test_every_code_point_is_read_as_the_library_reads_it(theirs):
    mine = bpe.Bpe(queries.tokenizer_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        texts = [form % chr(c) for c in points[at : at + 40_000] for form in ("a%sb", "%s", "a%s\u0301\u0323 1")]
        want = theirs.encode_batch(texts, add_special_tokens=False)
        assert all(got.tolist() == w.ids for got, w in zip(mine.encode_all(texts), want))


def test_words_outlive_the_cache(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 7)
    monkeypatch.setattr(bpe, "PIECE", 20)
    mine, rnd = bpe.Bpe(queries.tokenizer_path()), random.Random(9)
    texts = [" ".join(rnd.choice(["der", "Bär", "x" * 70, "a'll", "\u0301e", "<|endoftext|>", "12 "]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    assert [x.tolist() for x in mine.encode_all(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_are_looked_up_among_the_older_ones_one_by_one():
    class Older(dict):
        def __iter__(self):
            raise AssertionError("all the older words are gone through")

    known = bpe.Bpe(queries.tokenizer_path()).known
    known.older = Older({b"some": b"as it was"})
    known.learn({b"some", b"words"})
    assert known == {b"some": b"as it was", b"words": known.bpe.encode("words").tobytes()}


def test_bpe_columns_on_odd_rows(spark, odd, none):
    path = queries.tokenizer_path()
    got = bpe.encode_table(odd, path, ids_col="size", decoded_col="row")
    assert sorted(got.columns) == sorted(odd.columns)
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert all(r["size"] == [] and r["row"] == "" for r in rows if not r.text)
    assert max(len(r["size"]) for r in rows) >= 60_000
    again = bpe.decode_table(got, path, "size", "shard").collect()
    assert all(r["shard"] == r["row"] for r in again)
    assert bpe.encode_table(none, path).isEmpty()


# embeddings


def cluster(n, dim, centre, cosine, rng):
    noise = rng.standard_normal((n, dim))
    noise -= noise @ centre[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * centre + np.sqrt(1 - cosine**2) * noise


def links_by_brute_force(vectors, labels):
    n, up = [0] * len(vectors), list(range(len(vectors)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def good(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if labels[i] is not None and labels[i] == labels[j] and good(a) and good(b) and len(a) == len(b):
                x, y = np.float64(a), np.float64(b)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    r = sorted((root(i), root(j)))
                    up[r[1]] = r[0]
    return [(n[i], root(i)) for i in range(len(vectors))]


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # so that the large cluster is split in blocks
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = [v.tolist() for k, c in enumerate(centres) for v in cluster(90 if k == 0 else 4, 64, c, 0.9935, rng)]
    labels = [1 + (i > 200) for i in range(len(x))]
    x += [x[0], x[0], None, [], [0.0] * 64, [float("nan")] * 64, [None] + x[0][1:], x[0][:32], [2 * c for c in x[1]], x[0]]
    labels += [1, 2, 1, 1, 1, 1, 1, 1, 1, None]
    rows = spark.createDataFrame([(i, v, l, "n") for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows).collect()}
    want = dict(enumerate(links_by_brute_force(x, labels)))
    assert got == want
    assert embedding_dedup.near_vectors(rows.limit(0)).isEmpty()


@pytest.mark.parametrize("dim", [*range(1, 17), 64, 256])
def test_recall_of_the_filters(dim):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([cluster(1, dim, v, 0.98, rng)[0] if dim > 1 else v for v in x])
    found = set()
    for code in range(embedding_dedup.GRIDS if dim < embedding_dedup.LOW else embedding_dedup.CODES):
        a, b = (set(zip(*map(np.ndarray.tolist, embedding_dedup.list_decode(v, code)))) for v in (x, y))
        found |= {i for i, _ in a & b}
    assert len(found) >= 0.99 * len(x)


@pytest.mark.parametrize("dim", [1, 2, 3, 7])
def test_near_vectors_in_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((120, dim)).tolist()
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    x = [r.embedding for r in rows.orderBy("vec_id").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(rows).collect()}
    assert got == dict(enumerate(links_by_brute_force(x, [1] * len(x))))
    with pytest.raises(ValueError):
        embedding_dedup.near_vectors(rows, least_cosine=0.9)


def test_op3(spark):
    rows = sorted(duck(SMALL).sql("SELECT vec_id, embedding, label FROM embeddings").fetchall())
    want = links_by_brute_force([r[1] for r in rows], [r[2] for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_embedding_dedup(spark, SMALL).collect()}
    assert got == {r[0]: (n, rows[c][0], rows[c][0] == r[0]) for r, (n, c) in zip(rows, want)}


# toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~held))
    graded = toxicity.grade_documents(docs, labels, model=model).select("row.doc_id", "rejected", "severity")
    rows = graded.join(labels.where(held & (F.col("quality") == 1)), "doc_id").collect()
    clean, toxic = [[r.rejected for r in rows if r.toxic == t] for t in (0, 1)]
    assert len(clean) > 300 and len(toxic) > 50
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.95 * len(toxic)
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in rows)


def test_known_features_score_as_all_features():
    text = "Bad badly badge baden " * 3 + "idiot good goodly"
    weights = {f: 0.1 * (i + 1) for i, f in enumerate(sorted(toxicity.features(text))) if i % 2}
    want = sum(weights.get(f, 0) for f in toxicity.features(text))
    assert toxicity.OrdinalModel(weights, [0, 1, 2]).raw(text) == pytest.approx(want)


def test_features_are_held_for_few_texts_at_a_time():
    texts = [f"some words {i}{i} and wordier" * (i % 3) for i in range(500)] + [None]
    batch = pd.DataFrame({"h": range(501), "toxic": 1, "text": texts})
    pieces = list(toxicity.feature_lists(iter([batch, batch[:0]])))
    assert max(map(len, pieces)) <= 64
    assert [(h, set(f)) for p in pieces for h, f in zip(p["h"], p["f"])] == [(i, toxicity.features(t)) for i, t in enumerate(texts)]


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (6, 1), (7, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.grade_documents(odd, labels).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert toxicity.grade_documents(none, labels).isEmpty()
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == len(ODD)


# url filter


def test_filter_and_join_agree_with_plain_rules(spark):
    rnd = random.Random(4)
    urls = [None, "", "no scheme", "a://", "http://Example.NET/en/x?y#z", "http://xexample.net/en/", "http://net/", "http://a.org/fr/b://c", "x://é.org/fr/", "http://a\nb.net/c", "http://" + "a." * 5000 + "net/" + "p" * 9000]
    urls += ["http://" + rnd.choice(["net", "b.net", "example.net", "c.example.com", "a.org", "q.de"]) + rnd.choice(["/", "/en/", "/de/x", "/fr/1", "", "?/en/"]) for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("q.de", "/"), ("b.net", "/"), (None, "/"), ("", "")], "host string, path string")
    for row in url_filter.judge_urls(pages, listed=listed).collect():
        rest = (row.page.url or "").partition("://")[2]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if (host, path) in {("q.de", "/"), ("b.net", "/")} else "allow")
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)
    assert url_filter.judge_urls(pages.limit(0)).isEmpty()


def test_blocked_filter_passes_all_keys_and_few_others(spark):
    keys, others = spark.range(2000).selectExpr("concat('k', id) AS key"), spark.range(20000).selectExpr("concat('o', id) AS key")
    bloom = url_filter.blocked_filter(keys, 63)
    assert url_filter.passing(keys, bloom, 63).count() == 2000
    assert url_filter.passing(others, bloom, 63).count() < 400


# exact dedup


def exact_by_brute_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")].append(r)
    out = {}
    for plain, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in members:
            out[(r[0], r[1])] = (keep, len(members), hashlib.sha256(plain.encode()).hexdigest())
    return out


def test_exact_groups_of_odd_rows(spark, odd, none):
    got = exact_dedup.exact_groups(odd.repartition(5).select("doc_id", "text", F.col("shard").alias("digest")))
    want = exact_by_brute_force(ODD)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == Counter((r[0], *want[r[0], r[1]]) for r in ODD)
    assert sum(r.kept for r in got.collect()) == len({w[2] for w in want.values()})
    assert exact_dedup.exact_groups(none).isEmpty()


def test_exact_filter_keeps_one_row_of_each_text(odd, none):
    got = exact_dedup.drop_exact_copies(odd)
    assert got.columns == odd.columns
    want = exact_by_brute_force(ODD)
    assert Counter(r.doc_id for r in got.collect()) == Counter(k for k, _, _ in {(v[0], v[1], v[2]) for v in want.values()})
    assert exact_dedup.drop_exact_copies(none).isEmpty()


# packing


def room_by_the_plain_rule(lengths, length):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in range(len(room)) if room[r] >= n]
        if fits:
            room[min(fits, key=lambda r: room[r])] -= n
        else:
            room.append(length - n)
    return sorted(room)


def test_best_fit_decreasing_is_the_plain_rule():
    rnd = random.Random(6)
    for _ in range(300):
        lengths = Counter(rnd.randint(1, rnd.choice((5, 50))) for _ in range(rnd.randint(0, 80)))
        plan = sorted(packing.best_fit_decreasing(lengths, 50))
        places = defaultdict(set)
        for (size, rank, row, offset, each), after in zip(plan, [*plan[1:], (0, 0)]):
            for k in range((after[1] if after[0] == size else lengths[size]) - rank):
                place = set(range(start := offset + k % each * size, start + size))
                assert not places[row + k // each] & place and max(place) < 50
                places[row + k // each] |= place
        assert sum(map(len, places.values())) == sum(k * n for k, n in lengths.items())
        assert sorted(50 - len(p) for p in places.values()) == room_by_the_plain_rule(lengths.elements(), 50)


def check_packed(rows, mine, texts, length):
    """rows are right, hold all of texts (id, text), and are as full as the plain rule makes them."""
    pieces, room = defaultdict(list), []
    for r in rows:
        cu, ids, positions = r.cu_seqlens, np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == length and cu[0] == 0 and cu[-1] == r.n_used
        assert positions[: r.n_used].tolist() == [k for i, j in zip(cu, cu[1:]) for k in range(j - i)]
        assert not positions[r.n_used :].any() and not ids[r.n_used :].any()
        room.append(length - r.n_used)
        for doc, part, n, i, j in zip(r.doc_ids, r.parts, r.n_parts, cu, cu[1:]):
            pieces[doc].append((part, n, ids[i:j].tolist()))
    want, sizes = defaultdict(list), []
    for doc, text in texts:
        ids = mine.encode(text or "").tolist()
        parts = [ids[at : at + length] for at in range(0, len(ids), length)]
        want[doc] += [(k, len(parts), p) for k, p in enumerate(parts)]
        sizes += map(len, parts)
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items() if p}
    assert len({r.pack_id for r in rows}) == len(rows)
    assert sorted(room) == room_by_the_plain_rule(sizes, length)


def test_packing_of_odd_rows(odd, none):
    path = queries.tokenizer_path()
    packed = packing.pack(odd.repartition(3), path, length=128)
    check_packed(packed.collect(), bpe.Bpe(path), [r[:2] for r in ODD], 128)
    assert sum(len(r.ids) for r in packing.unpack(packed).collect() if r.doc_id == 4) == len(bpe.Bpe(path).encode(LONG))
    assert packing.pack(none, path).isEmpty()
    with pytest.raises(ValueError):
        packing.pack(odd, path, length=1 << 16)


def test_op7(spark):
    rows = queries.op7_pack_tokens(spark, SF).collect()
    texts = duck().sql("SELECT doc_id, text FROM documents").fetchall()
    check_packed(rows, bpe.Bpe(queries.tokenizer_path()), texts, packing.LENGTH)
    assert sum(r.n_used for r in rows) >= 0.99 * (len(rows) - 1) * packing.LENGTH


# mixing


def filled(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        target |= {s: cap * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    return target


def test_op8(spark):
    got = queries.op8_mix_sources(spark, SF).collect()
    assert sorted(got) == sorted(queries.op8_mix_sources(spark, SF).collect())
    texts = {i: (t, s) for i, t, s in duck().sql("SELECT doc_id, text, source FROM documents").fetchall()}
    sizes, taken = Counter(), Counter()
    for r in got:
        text, source = texts[r.doc_id]
        assert r.size == len(words(text)) and 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
    target = filled(sizes)
    for r in got:
        source = texts[r.doc_id][1]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert abs(taken[source] - target[source]) <= max(x.size for x in got if texts[x.doc_id][1] == source)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 0, "b": 5}, {None: 7, "x": 1, "y": 300}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = filled(sizes)
    assert got == {s: pytest.approx(want[s]) for s in sizes}


def test_quotas_split_counts_exactly_and_evenly(spark):
    counts = spark.createDataFrame([(0, 64), (1, 3), (2, 130), (3, 0)], "ix int, n long")
    got = mixing.split_quotas(counts, shards=7, seed=3).collect()
    assert {i: sum(r.quota for r in got if r.ix == i) for i in range(4)} == {0: 64, 1: 3, 2: 130, 3: 0}
    shares = [sum(r.quota for r in got if r.shard == s) for s in range(7)]
    assert sum(shares) == 197 and max(shares) - min(shares) <= 3


def test_shards_hold_what_the_tree_gives_them(spark):
    mixture = mixing.Mixture(read_table(spark, SMALL, "documents"), blocks=8, shards=5)
    plan = mixture.plan.select("source", "block", F.explode("draws.shard").alias("shard")).collect()
    by_shard, by_source = Counter(r.shard for r in plan), Counter(r.source for r in plan)
    assert set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    assert len({tuple(sorted(Counter(r.shard for r in plan if r.source == s).items())) for s in by_source}) > 1
    mixed = mixture.mixed()
    assert {r.shard for r in mixed.select("shard").distinct().collect()} <= set(range(5))
    got = mixing.shuffled(mixture)
    assert got.columns == mixture.docs.columns and got.count() == mixed.count()


def test_shards_are_written_in_random_order(spark, tmp_path):
    mixture = mixing.Mixture(read_table(spark, SMALL, "documents"), shards=3)
    mixing.write_shards(mixture, str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix"))
    want = Counter((r.doc_id, r.shard) for r in mixture.mixed().select("row.doc_id", "shard").collect())
    assert Counter((r.doc_id, r.mix_shard) for r in got.collect()) == want


def test_hypergeometric_draws_have_the_right_mean(spark):
    draw = mixing._hypergeometric(F.lit(100).cast("long"), F.lit(30).cast("long"), F.lit(40).cast("long"), (F.col("id") + 0.5) / 2000)
    mean, sd = spark.range(2000).select(draw.alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert mean == pytest.approx(12, abs=0.05) and sd == pytest.approx(np.sqrt(40 * 0.3 * 0.7 * 60 / 99), abs=0.05)


def test_mix_of_odd_rows(odd, none):
    mixture = mixing.Mixture(odd, blocks=4, shards=3)
    mixed = mixture.mixed().collect()
    copies = {(r.id, r.source, r.size): len(r.draws) for r in mixture.sized().collect()}
    assert sum(n * k[2] for k, n in copies.items()) == sum(len(words(r.row.text)) for r in mixed)
    assert all(0 <= r.shard < 3 and 0 <= r.epoch < 3 for r in mixed)
    assert mixing.Mixture(none).mixed().isEmpty()


# chats


def test_snapshots_collapse(spark):
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}" if i < 2 else f"{c // 10}-{i}") for c in range(40) for i in range(c % 10)]
    turns += [(100, None, None, None), (101, 0, "user", "t0"), (101, 0, "user", "t0"), (None, 0, "user", "<|im_end|>"), (102, 0, "user", LONG)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(rows.withColumn("hash", F.lit(1))).collect()}
    assert set(got) == {9, 19, 29, 39, 100, None, 102}
    assert got[100].rendered == "<|im_start|>\n<|im_end|>\n" and "< |im_end| >" in got[None].rendered
    assert got[9].n_turns == 9 and got[102].rendered.count("word") == 60_000
    assert chat.format_chats(rows.limit(0)).isEmpty()


# SimHash and components


def fingerprint(text):
    w = words(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_brute_force(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                r = sorted((root(i), root(j)))
                up[r[1]] = r[0]
    return [root(i) for i in range(len(prints))]


def test_op10(spark):
    rows = sorted(duck(SMALL).sql("SELECT doc_id, text FROM documents").fetchall())
    prints = [fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[r][0]) for i, r in enumerate(near_by_brute_force(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SMALL).collect()} == want


@pytest.mark.parametrize("dense", [2, 10, 64])
def test_links_join_what_two_bits_join(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd, prints = random.Random(8), []
    for _ in range(12):
        centre = rnd.getrandbits(64)
        prints += [centre] + [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(25)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    up = {p: p for p in signed}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in edges:
        up[root(e.a)] = root(e.b)
    want = near_by_brute_force(prints)
    for i in range(len(prints)):
        for j in range(i):
            assert (root(signed[i]) == root(signed[j])) == (want[i] == want[j])


def test_near_copies_of_odd_rows(odd, none):
    got = simhash.near_groups(odd.select("doc_id", "text", F.col("shard").alias("fp"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in got})
    assert simhash.near_groups(none).isEmpty() and simhash.drop_near_copies(none).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 1000 + i) for i in range(50)] + [(5, 5), (200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    got = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 100 for i in range(50)}, 201: 200, 202: 200}


# the pipeline


def test_pipeline_stages(spark, theirs):
    docs = read_table(spark, SMALL, "documents")
    labels = dict(duck(SMALL).sql("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        if name != "bpe":
            assert seen[-1].columns == docs.columns, name
    _, clean, exact, near, mixed, tokens = [d.collect() for d in seen]
    assert {r.doc_id for r in clean} >= {i for i, t in labels.items() if not t}
    want = exact_by_brute_force([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id for r in exact} == {v[0] for v in want.values()} and len(exact) == len({v[0] for v in want.values()})
    assert sorted(r.doc_id for r in near) == kept_by_brute_force(sorted((r.doc_id, r.text) for r in exact))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)
    texts = {r.doc_id: r.text for r in near}
    assert all(r.ids == theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in tokens)


def test_pipeline_on_odd_rows(spark, tmp_path, none):
    at = str(tmp_path)
    read_table(spark, SMALL, "labels").write.parquet(at + "/labels.parquet")
    rows = [(*r, r[0], "x", ["r"]) for r in ODD] + [(100 + i, f"one two three four five {i // 2}", "z", 0, 0, "r", i, "x", None) for i in range(8)]
    odd = spark.createDataFrame(rows, DOCS + ", n_tokens long, lang string, ids array<string>")
    odd.write.parquet(at + "/documents.parquet")
    got = corpus_pipeline.run(spark, at)
    assert {"size", "shard", "row", "lang", "ids", "n_tokens", "decoded"} <= set(got.columns) and "text" not in got.columns
    assert {r.doc_id for r in got.collect()} <= {None, *range(1, 8), *range(100, 108)} - {101, 103, 105, 107}
    none.write.parquet(at + "/empty/documents.parquet")
    read_table(spark, SMALL, "labels").write.parquet(at + "/empty/labels.parquet")
    assert corpus_pipeline.run(spark, at + "/empty").isEmpty()
