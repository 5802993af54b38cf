"""Piles against a walk along each CIGAR, in plain Python; duplicates against a plain grouping."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import duplicates as D
from loomspark.operators import pileup as P
from loomspark.operators import reference as R

READS = "qname string, flag int, chrom string, start long, mapq int, c string, seq string, qual string, ord long"
CIGARS = ["20M", "8M2I10M", "8M3D12M", "5S10M4N5M", "3H2I8M1D6M2I2S", "4M1I2D15M", "10M2P10M", "20S", "6=4X10M"]


def some_reads(n, seed, start=40):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        flag = rng.choice([1, 1, 1, 0, 1025, 257, 513, 5]) | rng.choice([0, 16])
        qual = "".join(chr(33 + rng.randint(2, 40)) for _ in range(20)) if k % 11 else "*"
        rows.append((f"t{k // 2}", flag, rng.choice("xy") if k % 7 == 0 else "x", rng.randint(0, start), rng.randint(0, 60), rng.choice(CIGARS), "".join(rng.choice("ACGTN") for _ in range(20)) if k % 13 else "*", qual, k))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, READS).withColumn("cigar", P.parsed_cigar(F.col("c"))).drop("c")
    return df.withColumn("end", F.col("start") + P.reference_length(F.col("cigar")))


def walk(row):
    """(pos, base, quality, deletion, skip, inserted, deleted, head, tail) of a read."""
    qname, flag, chrom, pos, mapq, cigar, seq, qual, k = row
    ops = [(o, int(n)) for n, o in re.findall(r"(\d+)(.)", cigar)]
    at, out = 0, []
    for i, (o, n) in enumerate(ops):
        for j in range(n if o in "MDN=X" else 0):
            base = ("N" if seq == "*" else seq[at + j]) if o in "M=X" else None
            q = None if base is None or qual == "*" else ord(qual[at + j]) - 33
            out.append([pos + j, base, q, o == "D", o == "N", None, 0, False, False])
        if o in "MDN=X":
            pos += n
            a, d, ins = at + (n if o in "M=X" else 0), 0, ""
            for o2, n2 in ops[i + 1 :]:
                if o2 not in "IDP":
                    break
                if o2 == "I":
                    ins += "N" * n2 if seq == "*" else seq[a : a + n2]
                    a += n2
                d += n2 if o2 == "D" else 0
            out[-1][5:7] = [ins or None, d]
        at += n if o in "MIS=X" else 0
    if out:
        out[0][7] = out[-1][8] = True
    return [tuple(x) for x in out]


def test_expanded(spark, monkeypatch):
    monkeypatch.setattr(P, "PLACES", 100)
    rows = some_reads(300, 1)
    got = defaultdict(list)
    for r in P.expanded(frame(spark, rows)).collect():
        got[r.ord].append((r.pos, r.base, r.quality, r.deletion, r["skip"], r.inserted, r.deleted, r["head"], r["tail"]))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {row[-1]: w for row in rows if (w := walk(row))}


def kept(rows, min_quality=13, mates=True):
    """What pileup() keeps: {(chrom, pos): [(ord, base, quality, ...)]}."""
    used = [r for r in rows if not r[1] & 1796]
    walks = {r[-1]: {w[0]: list(w) for w in walk(r)} for r in used}
    names = defaultdict(list)
    for r in used:
        names[r[0]].append(r)
    for two in names.values():
        if mates and len(two) == 2 and two[0][2] == two[1][2]:
            a, b = (walks[r[-1]] for r in two)
            for pos in set(a) & set(b):
                x, y = a[pos], b[pos]
                if x[1] and y[1] and x[2] is not None and y[2] is not None:
                    if y[2] > x[2]:
                        x, y = y, x
                    x[2], y[2] = (min(200, x[2] + y[2]) if x[1] == y[1] else x[2] * 4 // 5), 0
    out = defaultdict(list)
    for r in used:
        for pos, w in walks[r[-1]].items():
            if w[1] is None or w[2] is None or w[2] >= min_quality:
                out[r[2], pos].append((r, w))
    return out


@pytest.mark.parametrize("mates", [True, False])
def test_places(spark, mates):
    rows = some_reads(400, 2)
    got = {(r.chrom, r.pos): (r.depth, r.a, r.c, r.g, r.t, r.deletions, r.skips, r.insertions, r.qualities) for r in P.places(P.pileup(frame(spark, rows), mates_once=mates)).collect()}
    want = {}
    for at, of in kept(rows, mates=mates).items():
        ws = [w for _, w in of]
        want[at] = (sum(w[1] is not None for w in ws), *[sum(w[1] == b for w in ws) for b in "ACGT"], sum(w[3] for w in ws), sum(w[4] for w in ws), sum(w[5] is not None for w in ws), sum(w[2] or 0 for w in ws))
    assert got == want


def test_text_and_consensus(spark):
    genome = "".join(random.Random(5).choice("ACGT") for _ in range(90))
    tiles = R.tiles(spark.createDataFrame([(c, 0, genome) for c in "xy"], "chrom string, at long, piece string"), 16, 0)
    rows = some_reads(120, 3)
    bases = P.pileup(frame(spark, rows), mates_once=False)
    got = defaultdict(dict)
    for r in P.pile_text(bases, tiles, 16, piece=50).collect():
        got[r.chrom, r.pos][r.piece] = (r.ref, r.depth, r.bases, r.qualities)
    want = defaultdict(dict)
    for (c, pos), of in kept(rows, mates=False).items():
        for piece in {r[-1] // 50 for r, _ in of}:
            text = quals = ""
            some = [(r, w) for r, w in of if r[-1] // 50 == piece]
            for r, w in some:
                case = str.lower if r[1] & 16 else str.upper
                text += "^" + chr(min(r[4], 93) + 33) if w[7] else ""
                text += "*" if w[3] else ("<" if r[1] & 16 else ">") if w[4] else ("," if r[1] & 16 else ".") if w[1] == genome[pos] else case(w[1])
                text += f"+{len(w[5])}{case(w[5])}" if w[5] else ""
                text += f"-{w[6]}{case(genome[pos + 1 : pos + 1 + w[6]].ljust(w[6], 'N'))}" if w[6] else ""
                text += "$" if w[8] else ""
                quals += chr(min(w[2] or 0, 93) + 33)
            want[c, pos][piece] = (genome[pos], len(some), text, quals)
    assert got == want
    called = {(r.chrom, r.pos): (r.base, r.depth) for r in P.consensus(bases, min_depth=2).collect()}
    for at, of in kept(rows, mates=False).items():
        sums, n, gone = defaultdict(int), 0, 0
        for _, w in of:
            if w[1] is not None:
                sums[w[1]] += 1 if w[2] is None else w[2]
                n += 1
            elif not w[4]:
                gone += 1
        if n and n >= gone:
            best = min(sums, key=lambda b: (-sums[b], b))
            assert called.pop(at) == (best if n >= 2 else "N", n)
    assert not called


def test_pile_of_nothing(spark):
    assert P.places(P.pileup(frame(spark, []))).count() == 0
    with pytest.raises(Exception, match="fit its sequence"):
        P.places(P.pileup(frame(spark, [("a", 0, "x", 0, 9, "5M", "ACG", "III", 1)]))).count()


def marked(rows, with_failed):
    """Duplicates by plain grouping."""

    def end(r):
        ops = re.findall(r"(\d+)(.)", r[5])
        clip = lambda o: sum(int(n) for n, _ in o[: next((i for i, x in enumerate(o) if x[1] not in "SH"), len(o))])
        span = sum(int(n) for n, o in ops if o in "MDN=X")
        return (r[2], r[3] + span + clip(ops[::-1]), True) if r[1] & 16 else (r[2], r[3] - clip(ops), False)

    used = [r for r in rows if not r[1] & (4 | 256 | 2048) and (with_failed or not r[1] & 512)]
    score = lambda r: sum(q for c in r[7] if (q := ord(c) - 33) >= 15) if r[7] != "*" else 0
    names, groups, dup = defaultdict(list), defaultdict(list), set()
    for r in used:
        if r[1] & 1:
            names[r[0]].append(r)
    pairs = {n: rs for n, rs in names.items() if len(rs) == 2}
    taken, ends = {r[-1] for rs in pairs.values() for r in rs}, set()
    for n, rs in pairs.items():
        groups[tuple(sorted(map(end, rs)))].append((any(r[1] & 512 for r in rs), -sum(map(score, rs)), n))
        ends |= set(map(end, rs))
    for of in groups.values():
        dup |= {r[-1] for _, _, n in sorted(of)[1:] for r in pairs[n]}
    alone = defaultdict(list)
    for r in used:
        if r[-1] not in taken:
            alone[end(r)].append((bool(r[1] & 512), -score(r), r[0], r[-1]))
    for e, of in alone.items():
        dup |= {x[-1] for x in sorted(of)[0 if e in ends else 1 :]}
    return dup


@pytest.mark.parametrize("with_failed", [False, True])
def test_duplicate_templates(spark, with_failed):
    rows = some_reads(600, 6, start=3)
    got = {r.ord for r in D.mark_templates(frame(spark, rows), with_failed).where("duplicate").collect()}
    assert got == marked(rows, with_failed) and len(got) > 100
    assert D.mark_templates(frame(spark, []), with_failed).count() == 0
