"""Piles of bases over the places of a reference: which base of which read lies where.

Reads have qname, flag, chrom, start, mapq, cigar (a list of op and len), seq, qual and ord. Where a read's bases lie is a
running sum over its CIGAR operations; batches of reads are expanded at once, by arrays, with no exchange. What
follows is grouped by place: counts are partial aggregations, so a very deep place is a few rows by then, and the pile
itself, as text, comes in pieces of a bounded number of reads.

Both mates of a pair may cover a place. There they count once: the better base stays, with the sum of both qualities (200
at most) if they agree, else with four fifths of its own, and the other's quality is 0. Only bases in the overlap of two
mates are exchanged for that.

A missing sequence (`*`) gives N and no quality, and a base without a quality passes any bound. Empty tables give none.
A CIGAR that doesn't fit its sequence is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.reference import WIDTH, own_bases
from loomspark.sources.text import DUPLICATE, QC_FAIL, REVERSE, SECONDARY, UNMAPPED

OPS = "MIDNSHP=X"
#: Operations that move along the reference, along the read, or along both.
ON_REFERENCE, ON_READ, ON_BOTH = "MDN=X", "MIS=X", "M=X"
#: Places that are expanded at a time.
PLACES = 1 << 20
#: Reads of a piece of a pile's text have orders in one step of this width.
PIECE = 4096
BASES = "ord long, chrom string, pos long, base string, quality int, deletion boolean, skip boolean, inserted string, deleted int, head boolean, tail boolean"


def parsed_cigar(text: Column) -> Column:
    """A CIGAR string as a list of (op, len)."""
    lens, ops = F.regexp_extract_all(text, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def reference_length(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*ON_REFERENCE), o["len"]).otherwise(0))


def _letters(x: np.ndarray, there: np.ndarray) -> pa.Array:
    """Bytes as an array of one-letter strings, null where `there` is false."""
    data = x[there].astype(np.uint8)
    offsets = np.r_[0, np.cumsum(there)].astype(np.int32)
    return pa.StringArray.from_buffers(len(x), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()), pa.array(there).buffers()[1])


def _expanded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(ord, chrom, start, cigar, seq, qual) -> BASES, every place of every read."""
    n = batch.num_rows
    cigar = batch.column(3)
    per_read = np.diff(cigar.offsets.to_numpy())
    flat = cigar.flatten()
    code = np.array(pc.fill_null(pc.index_in(flat.field("op"), pa.array(list(OPS))), -1))
    size = np.array(flat.field("len"), np.int64)
    read = np.repeat(np.arange(n), per_read)
    along = {k: size * np.isin(code, [OPS.index(c) for c in ops]) for k, ops in (("ref", ON_REFERENCE), ("read", ON_READ))}
    first = np.cumsum(per_read) - per_read

    def before(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(x) - x
        return run - run[np.minimum(first, len(run) - 1)][read] if len(run) else run

    ref_at, read_at = before(along["ref"]), before(along["read"])
    seqs, quals = batch.column(4).to_pylist(), batch.column(5).to_pylist()
    long = np.bincount(read, along["read"], minlength=n).astype(np.int64)
    whole = [s if s and s != "*" else "N" * k for s, k in zip(seqs, long.tolist())]
    scored = [q if q and q != "*" else "\0" * k for q, k in zip(quals, long.tolist())]
    if any(len(s) != k or len(q) != k for s, q, k in zip(whole, scored, long.tolist())):
        raise ValueError("a CIGAR doesn't fit its sequence or qualities")
    letters = np.frombuffer("".join(whole).upper().encode("latin-1", "replace"), np.uint8)
    marks = np.frombuffer("".join(scored).encode("latin-1", "replace"), np.uint8)
    begin = np.cumsum(long) - long
    placed = np.flatnonzero(along["ref"] > 0)
    k = along["ref"][placed]
    op = np.repeat(placed, k)
    within = np.arange(len(op)) - np.repeat(np.cumsum(k) - k, k)
    of = read[op]
    pos = batch.column(2).to_numpy()[of] + ref_at[op] + within
    is_base = np.isin(code[op], [OPS.index(c) for c in ON_BOTH])
    at = np.where(is_base, begin[of] + read_at[op] + within, 0)
    base, mark = (x[at] if len(x) else np.zeros(len(at), np.uint8) for x in (letters, marks))
    has_quality = is_base & (mark > 0)
    last = within == along["ref"][op] - 1
    head, tail = np.zeros((2, len(op)), bool)
    if len(op):
        new = np.r_[True, of[1:] != of[:-1]]
        head, tail = new, np.r_[new[1:], True]
    inserted, deleted = {}, np.zeros(len(op), np.int32)
    following = np.minimum(op + 1, len(code) - 1) if len(code) else op
    indel = last & (op + 1 < len(code)) & (read[following] == of) & np.isin(code[following], [OPS.index(c) for c in "IDP"])
    for i in np.flatnonzero(indel).tolist():
        j, r = int(op[i]) + 1, int(of[i])
        while j < len(code) and read[j] == r and OPS[code[j]] in "IDP":
            if OPS[code[j]] == "I":
                a = int(read_at[j])
                inserted[i] = inserted.get(i, "") + whole[r][a : a + int(size[j])].upper()
            elif OPS[code[j]] == "D":
                deleted[i] += size[j]
            j += 1
    text = [None] * len(op)
    for i, s in inserted.items():
        text[i] = s
    columns = [
        batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(pos, pa.int64()), _letters(base, is_base),
        pa.array(mark.astype(np.int32) - 33, pa.int32(), mask=~has_quality), pa.array(code[op] == OPS.index("D")), pa.array(code[op] == OPS.index("N")),
        pa.array(text, pa.string()), pa.array(deleted), pa.array(head), pa.array(tail),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BASES.split(", ")])


def expanded(reads: DataFrame) -> DataFrame:
    """(BASES): a row for each place of the reference that each read lies on, by its alignment. `inserted` and
    `deleted` stand at the place before; what is inserted before a read's first place is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = np.array(pc.fill_null(batch.column(6), 0), np.int64) + 1
            cut, start = np.cumsum(spans), 0
            while start < batch.num_rows:
                done = cut[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(cut, done + PLACES)))
                yield _expanded(pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in batch.columns[:6]], names=batch.schema.names[:6]))
                start = end

    cigar = F.transform("cigar", lambda o: F.struct(o["op"].alias("op"), o["len"].cast("int").alias("len")))
    rows = reads.select(F.col("ord").cast("long").alias("ord"), "chrom", F.col("start").cast("long").alias("start"), cigar.alias("cigar"), "seq", "qual", reference_length(F.col("cigar")).alias("span"))
    return rows.where("start IS NOT NULL AND cigar IS NOT NULL").mapInArrow(run, BASES)


def pileup(reads: DataFrame, min_quality: int = 13, min_mapq: int = 0, excluded: int = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE, mates_once: bool = True) -> DataFrame:
    """The bases of reads that are good enough, with `mapq` and `reverse`."""
    used = reads.where((F.col("flag").bitwiseAND(excluded) == 0) & (F.col("mapq") >= min_mapq))
    all_bases = expanded(used)
    own = used.select("ord", "qname", "mapq", (F.col("flag").bitwiseAND(REVERSE) != 0).alias("reverse"))
    good = F.col("base").isNull() | F.col("quality").isNull() | (F.col("quality") >= min_quality)
    if not mates_once:
        return all_bases.join(own.drop("qname"), "ord").where(good)
    spans = used.select("qname", "chrom", "ord", "start", (F.col("start") + reference_length(F.col("cigar"))).alias("end"))
    two = spans.groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("chrom").alias("c"), F.max("chrom").alias("d"), F.max("start").alias("from"), F.min("end").alias("to"))
    both = two.where("n = 2 AND c = d AND from < to").select("qname", "from", "to")
    known = all_bases.join(own.join(both, "qname", "left"), "ord")
    shared = F.coalesce((F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("to")) & F.col("base").isNotNull() & F.col("quality").isNotNull(), F.lit(False))
    pair = Window.partitionBy("qname", "pos").orderBy(F.desc("quality"), "ord")
    mine, theirs = F.col("quality"), F.coalesce(F.lead(F.struct("base", "quality")).over(pair), F.lag(F.struct("base", "quality")).over(pair))
    within = known.where(shared).withColumns({"_mate": theirs, "_nth": F.row_number().over(pair)})
    better = F.when(F.col("_mate.base") == F.col("base"), F.least(mine + F.col("_mate.quality"), F.lit(200))).otherwise(F.floor(mine * 4 / 5).cast("int"))
    within = within.withColumn("quality", F.when(F.col("_mate").isNull(), mine).when(F.col("_nth") == 1, better).otherwise(0)).drop("_mate", "_nth")
    return known.where(~shared).unionByName(within).drop("qname", "from", "to").where(good)


def places(bases: DataFrame) -> DataFrame:
    """For each place with reads: depth (of bases), how many of each base, deletions, skips and insertions, and the sum of
    qualities."""
    each = [F.count_if(F.col("base") == b).alias(b.lower()) for b in "ACGT"]
    return bases.groupBy("chrom", "pos").agg(
        F.count("base").alias("depth"), *each, F.count_if("deletion").alias("deletions"), F.count_if("skip").alias("skips"), F.count("inserted").alias("insertions"), F.coalesce(F.sum("quality"), F.lit(0)).alias("qualities")
    )


def consensus(bases: DataFrame, min_depth: int = 1, least_share: float = 0.0) -> DataFrame:
    """For each place the base with the greatest sum of qualities (of equals the first letter), or N where fewer than
    min_depth reads or less than the share of the qualities are for it. A place where more reads lack it is left out."""
    by_base = bases.where("NOT skip").groupBy("chrom", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("quality", F.lit(1))).alias("q"))
    best = F.min_by(F.struct("base", "q"), F.struct(-F.col("q"), "base"))
    of = by_base.groupBy("chrom", "pos").agg(F.sum(F.when(F.col("base").isNotNull(), F.col("n"))).alias("depth"), F.sum(F.when(F.col("base").isNull(), F.col("n"))).alias("gone"), F.sum("q").alias("all"), best.alias("best"))
    present = by_base.where("base IS NOT NULL").groupBy("chrom", "pos").agg(best.alias("best"), F.sum("q").alias("all"), F.sum("n").alias("depth"))
    kept = of.where(F.coalesce("depth", F.lit(0)) >= F.coalesce("gone", F.lit(0))).select("chrom", "pos")
    sure = (F.col("depth") >= min_depth) & (F.col("best.q") >= F.lit(least_share) * F.col("all"))
    return present.join(kept, ["chrom", "pos"]).select("chrom", "pos", F.when(sure, F.col("best.base")).otherwise("N").alias("base"), "depth")


def pile_text(bases: DataFrame, reference: DataFrame | None = None, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """Piles as text: chrom, pos, ref, piece, depth, bases and qualities. A place's reads, in their order, come in
    pieces of those whose ord lies in one step of width `piece`; a place's text is its pieces' one after the other.

    `.` and `,` are the reference's base on the forward and the reverse strand, letters (small on the reverse strand)
    other bases, `*` a deletion, `>` and `<` a skip; `^` and the mapping quality begin a read, `$` ends it, and `+` or `-`
    with a length and the bases say what is inserted or deleted next."""
    if reference is None:
        known = bases.withColumns({"ref": F.lit("N"), "_gone": F.lit("")})
    else:
        at = (F.col("pos") - F.col("tile") * width + 1).cast("int")
        pair = own_bases(reference, width)
        beyond = pair.select("chrom", (F.col("tile") - 1).alias("tile"), F.col("seq").alias("more"))
        tiles = pair.join(beyond, ["chrom", "tile"], "left")
        known = bases.withColumn("tile", F.floor(F.col("pos") / width)).join(tiles, ["chrom", "tile"], "left")
        known = known.withColumns({"ref": F.coalesce(F.substr("seq", at, F.lit(1)), F.lit("N")), "_gone": F.substr(F.concat("seq", F.coalesce("more", F.lit(""))), at + 1, F.col("deleted"))}).drop("seq", "more", "tile")
    cased = lambda c: F.when(F.col("reverse"), F.lower(c)).otherwise(F.upper(c))
    same = F.when(F.col("reverse"), ",").otherwise(".")
    symbol = F.when(F.col("deletion"), "*").when(F.col("skip"), F.when(F.col("reverse"), "<").otherwise(">")).when(F.col("base") == F.col("ref"), same).otherwise(cased(F.col("base")))
    more = F.when(F.col("inserted").isNotNull(), F.concat(F.lit("+"), F.length("inserted").cast("string"), cased(F.col("inserted")))).otherwise("")
    less = F.when(F.col("deleted") > 0, F.concat(F.lit("-"), F.col("deleted").cast("string"), cased(F.rpad(F.coalesce("_gone", F.lit("")), F.col("deleted"), F.lit("N"))))).otherwise("")
    begin = F.when(F.col("head"), F.concat(F.lit("^"), F.char(F.least("mapq", F.lit(93)) + 33))).otherwise("")
    item = F.struct("ord", F.concat(begin, symbol, more, less, F.when(F.col("tail"), "$").otherwise("")).alias("s"), F.char(F.least(F.coalesce("quality", F.lit(0)), F.lit(93)) + 33).alias("q"))
    rows = known.groupBy("chrom", "pos", "ref", F.floor(F.col("ord") / piece).alias("piece")).agg(F.sort_array(F.collect_list(item)).alias("r"))
    text = lambda c: F.array_join(F.transform("r", lambda x: x[c]), "")
    return rows.select("chrom", "pos", "ref", "piece", F.size("r").alias("depth"), text("s").alias("bases"), text("q").alias("qualities"))
