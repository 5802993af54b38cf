"""Order-preserving packing: cuts against the plain quadratic rule, whole documents, little padding, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, duck
from tokenizers import Tokenizer

from loomspark.llm import ordered_packing as P
from loomspark.llm import queries

SCHEMA = "doc_id long, text string, start string, ids int, source string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def cost_of(cuts, ends, cost, length):
    at = dict(zip(ends, cost))
    return sum(P.padding(b - a, length) + at[b] + P.SEQUENCE for a, b in zip([0, *cuts], cuts))


@pytest.mark.parametrize("length", [1, 7, 16, 64])
def test_cuts_cost_as_little_as_by_the_plain_rule(length):
    rng = random.Random(length)
    for _ in range(60):
        ends = np.cumsum([rng.randint(1, length) for _ in range(rng.randint(1, 40))])
        cost = np.array([rng.choice([0, 4, 32]) for _ in ends])
        best = {0: 0}
        for j, (e, c) in enumerate(zip(ends.tolist(), cost.tolist())):
            best[e] = min(best[a] + P.padding(e - a, length) + P.SEQUENCE + c for a in best if e - length <= a < e)
        cuts = P.best_cuts(ends, cost, length)
        assert cuts[-1] == ends[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
        assert cost_of(cuts, ends.tolist(), cost.tolist(), length) == best[ends[-1]]


def check(rows, texts, library, length=2048):
    """rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset) hold the documents; gives used and padding."""
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append((r[6], r[2]))
    assert set(by_doc) == set(want)
    for doc, of in want.items():
        if len(of) == 1:
            ids, at = of[0], 0
            for r in sorted(by_doc[doc], key=lambda r: r[1]):
                assert r[1] == at and r[2] > 0 and r[4] == len(ids)
                assert r[3] == zlib.crc32(np.array(ids[at : at + r[2]], "<u4").tobytes())
                at += r[2]
            assert at == len(ids)
        else:
            assert sum(r[2] for r in by_doc[doc]) == sum(map(len, of))
    used = pad = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert 0 < at <= length
        used, pad = used + at, pad + P.padding(at, length)
    return used, pad


def rows_of(df):
    return [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in df.collect()]


def test_query_on_its_table(spark, library):
    texts = duck().sql("SELECT doc_id, text FROM documents").fetchall()
    used, pad = check(rows_of(queries.op11_pack_in_order(spark, SF)), texts, library)
    assert pad < 0.01 * used


@pytest.mark.parametrize("stretch", [1 << 18, 5000])
def test_odd_rows_and_stretches(spark, tmp_path, library, monkeypatch, stretch):
    monkeypatch.setattr(P, "STRETCH", stretch)
    monkeypatch.setattr(P, "LOOK_AHEAD", 2500)
    texts = [(1, "A b. C d!"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "word " * 30_000), (5, "One. Two, three. " * 4000), (6, "é" * 3000), (7, " \n"), (8, "<|endoftext|> x")]
    texts += [(10 + i, "Some words here, and more. " * (i % 40)) for i in range(200)]
    spark.createDataFrame([(*t, "s", 1, "x") for t in texts], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    used, pad = check(rows_of(queries.op11_pack_in_order(spark, str(tmp_path))), texts, library)
    assert pad < 0.01 * used


def test_sequences_hold_the_pieces(spark, library):
    df = spark.createDataFrame([(1, "One two. Three four five."), (2, None), (3, "six " * 50)], "doc_id long, text string").coalesce(1)
    pieces = P.pack_in_order(df, queries.tokenizer_path(), length=16)
    whole = {r.sequence_id: r for r in P.sequences(pieces, 16, pad=7).collect()}
    for r in pieces.collect():
        row = np.frombuffer(whole[r.sequence_id].ids, "<u4")
        n = whole[r.sequence_id].n_used
        assert row[r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u4").tolist()
        assert len(row) == n + P.padding(n, 16) and (row[n:] == 7).all()
        assert whole[r.sequence_id].cu_seqlens[0] == 0 and whole[r.sequence_id].cu_seqlens[-1] == n


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_pack_in_order(spark, str(tmp_path)).collect() == []
