"""Queries of reference tiles, normalized variants, piles and duplicate pairs.

The reference comes from part: 24 bases a part on three chroms, eight neighbouring parts with one repeated unit. Reads
come from orders (two neighbouring keys are mates, 20 bases each, one of five CIGARs), variants from part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import duplicates as D
from loomspark.operators import normalize as N
from loomspark.operators import pileup as P
from loomspark.operators import reference as R
from loomspark.session import read_table

#: Tiles this small have repeats over several of them.
WIDTH, HALO = 64, 8
#: Both Spark and DuckDB read these.
_PIECE = [
    "concat('c', cast(p_partkey % 3 AS STRING)) AS chrom", "cast(floor(p_partkey / 3) AS BIGINT) AS k",
    "substr(repeat(substr('ACGTTGCATC', 1 + cast(floor(floor(p_partkey / 3) / 8) AS INT) * 7 % 8, 1 + cast(floor(floor(p_partkey / 3) / 8) AS INT) % 3), 24), 1, 24) AS piece",
    "p_partkey", "p_size",
]
_VARIANT = [
    "chrom", "k * 24 + o + 1 AS pos", "CASE WHEN kind = 1 THEN substr(s, o + 1, 1) ELSE substr(s, o + 1, d + 1) END AS ref",
    "CASE kind WHEN 0 THEN substr(s, o + 1, 1) WHEN 1 THEN substr(s, o + 1, d + 1) ELSE translate(substr(s, o + 1, d + 1), 'ACGT', 'CGTA') END AS alt", "ord",
]
_READ = [
    "concat('t', cast(cast(floor(o_orderkey / 2) AS BIGINT) AS STRING)) AS qname",
    "cast(1 + CASE WHEN o_orderkey % 29 = 0 THEN 1024 ELSE 0 END + CASE WHEN o_orderkey % 31 = 0 THEN 512 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN o_custkey % 13 = 0 THEN 4 ELSE 0 END AS INT) AS flag",
    "concat('c', cast(cast(floor(o_orderkey / 2) AS BIGINT) % 3 AS STRING)) AS chrom", "cast(floor(o_orderkey / 2) AS BIGINT) * 37 % 700 + (o_orderkey % 2) * 7 AS start",
    "cast(o_custkey % 61 AS INT) AS mapq", "cast(o_orderkey % 5 AS INT) AS pattern",
    "substr('ACGTTGCATCGGATTACAAGCTTGCCATGACCTA', cast(1 + o_custkey % 14 AS INT), 20) AS seq", "substr('5I?+#<AF!78DG2>H0E:B3C94=16;@5I?+#', cast(1 + o_orderkey % 14 AS INT), 20) AS qual", "o_orderkey AS ord",
]
CIGARS = ("20M", "8M2I10M", "8M3D12M", "5S10M4N5M", "3H2I8M1D6M2I2S")


def parts(spark, sf_dir):
    return read_table(spark, sf_dir, "part").selectExpr(*_PIECE)


def pieces(spark, sf_dir):
    return parts(spark, sf_dir).select("chrom", (F.col("k") * 24).alias("at"), "piece")


def tiles(spark, sf_dir):
    return R.tiles(pieces(spark, sf_dir), WIDTH, HALO)


def variants(spark, sf_dir):
    p = parts(spark, sf_dir)
    after = p.select("chrom", (F.col("k") - 1).alias("k"), F.col("piece").alias("more"))
    both = p.join(after, ["chrom", "k"]).selectExpr("chrom", "k", "concat(piece, more) AS s", "cast(p_size % 24 AS INT) AS o", "cast(p_partkey % 4 AS INT) AS kind", "cast(1 + p_partkey % 5 AS INT) AS d", "p_partkey AS ord")
    return both.selectExpr(*_VARIANT)


def reads(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").selectExpr(*_READ)
    cigar = P.parsed_cigar(F.get(F.array(*[F.lit(c) for c in CIGARS]), F.col("pattern")))
    rows = rows.withColumn("cigar", cigar).drop("pattern")
    return rows.withColumn("end", F.col("start") + P.reference_length(F.col("cigar")))


def alleles(spark, sf_dir):
    """Records with several alternatives and lists for them."""
    v = variants(spark, sf_dir).where(F.length("ref") == 1)
    n = F.col("ord") % 3 + 1
    alts = F.slice(F.array(F.col("alt"), F.concat("alt", F.lit("A")), F.concat("alt", F.lit("TT"))), 1, n.cast("int"))
    count = lambda m: F.transform(F.sequence(F.lit(1), m.cast("int")), lambda i: (F.col("ord") + i).cast("int"))
    return v.select("chrom", "pos", "ref", alts.alias("alts"), "ord", count(n).alias("af"), count(n + 1).alias("ad"), count((n + 1) * (n + 2) / 2).alias("pl"), F.array((F.col("ord") % (n + 1)).cast("int"), n.cast("int")).alias("gt"))


_LISTS = {"per_alt": ["af"], "per_allele": ["ad"], "per_genotype": ["pl"], "calls": ["gt"]}
_TEXT = ("af", "ad", "pl", "gt")


def _joined(*names):
    return [F.array_join(F.transform(n, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias(n) for n in names]


def split(s, d):
    return N.split_alleles(alleles(s, d), **_LISTS).select("ord", "nth", "alt", *_joined(*_TEXT))


def rejoined(s, d):
    """One call a side: of the alleles split, those put together again."""
    one = N.split_alleles(alleles(s, d), **_LISTS).withColumn("ord", F.col("ord") * 4 + F.col("nth"))
    return N.join_alleles(one, **_LISTS).select(F.floor(F.col("ord") / 4).alias("ord"), *_joined("alts", *_TEXT))


def windows(s, d):
    """Ranges of several lengths around the variants, over the tiles' edges too."""
    v = variants(s, d)
    asked = v.select("chrom", F.greatest(F.col("pos") - 30, F.lit(0)).alias("start"), (F.col("pos") + F.col("ord") % 90).alias("end"), "ord")
    return R.fetched(asked, tiles(s, d), ["ord"], F.col("start"), F.col("end"), "bases", WIDTH)


QUERIES = {
    "vcf_left_align": lambda s, d: N.left_aligned(variants(s, d), tiles(s, d), WIDTH, HALO).select("ord", "pos", "ref", "alt"),
    "vcf_atoms": lambda s, d: N.atoms(variants(s, d)).select("ord", "atom", "pos", "ref", "alt"),
    "vcf_split_alleles": split,
    "vcf_join_lists": rejoined,
    "bed_getfasta": lambda s, d: windows(s, d).select("ord", "start", "end", "bases"),
    "bam_mpileup": lambda s, d: P.places(P.pileup(reads(s, d))),
    "bam_pile_text": lambda s, d: P.pile_text(P.pileup(reads(s, d), mates_once=False), tiles(s, d), WIDTH),
    "bam_consensus": lambda s, d: P.consensus(P.pileup(reads(s, d), mates_once=False), min_depth=3, least_share=0.4),
    "bam_markdup_pairs": lambda s, d: D.mark_templates(reads(s, d)).select("ord", "duplicate"),
}

_SQL_PARTS = "p AS (SELECT {} FROM part), genome AS (SELECT chrom, string_agg(piece, '' ORDER BY k) AS g FROM p GROUP BY 1)".format(", ".join(_PIECE))
_SQL_VARIANTS = """, both_p AS (SELECT p.chrom, p.k, p.piece || q.piece AS s, (p.p_size % 24)::INT AS o, (p.p_partkey % 4)::INT AS kind, (1 + p.p_partkey % 5)::INT AS d, p.p_partkey AS ord
        FROM p JOIN p q ON q.chrom = p.chrom AND q.k = p.k + 1), v AS (SELECT {} FROM both_p)""".format(", ".join(_VARIANT))
_SQL_READS = """r AS (SELECT {} FROM orders),
    ops(pattern, i, op, ref_at, read_at, n, ins, del) AS (VALUES (0, 0, 'M', 0, 0, 20, 0, 0), (1, 0, 'M', 0, 0, 8, 2, 0), (1, 2, 'M', 8, 10, 10, 0, 0), (2, 0, 'M', 0, 0, 8, 0, 3), (2, 1, 'D', 8, 8, 3, 0, 0), (2, 2, 'M', 11, 8, 12, 0, 0),
        (3, 1, 'M', 0, 5, 10, 0, 0), (3, 2, 'N', 10, 15, 4, 0, 0), (3, 3, 'M', 14, 15, 5, 0, 0), (4, 2, 'M', 0, 2, 8, 0, 1), (4, 3, 'D', 8, 10, 1, 0, 0), (4, 4, 'M', 9, 10, 6, 2, 0)),
    spans(pattern, lead, len, trail) AS (VALUES (0, 0, 20, 0), (1, 0, 18, 0), (2, 0, 23, 0), (3, 5, 19, 0), (4, 3, 15, 2)),
    used AS (SELECT r.*, len, lead, trail FROM r JOIN spans USING (pattern) WHERE flag & 1796 = 0),
    e AS (SELECT *, unnest(range(n)) AS j FROM used JOIN ops USING (pattern)),
    b AS (SELECT chrom, qname, ord, mapq, flag & 16 <> 0 AS rev, start + ref_at + j AS pos, op, CASE WHEN op = 'M' THEN substr(seq, (read_at + j + 1)::INT, 1) END AS base,
             CASE WHEN op = 'M' THEN ascii(substr(qual, (read_at + j + 1)::INT, 1)) - 33 END AS q, CASE WHEN ins > 0 AND j = n - 1 THEN substr(seq, (read_at + n + 1)::INT, ins) END AS inserted,
             CASE WHEN j = n - 1 THEN del ELSE 0 END AS deleted, ref_at + j = 0 AS head, ref_at + j = len - 1 AS tail FROM e)""".format(", ".join(_READ))  # fmt: skip
_SQL_LISTS = """, w AS (SELECT chrom, pos, ref, ord, (ord % 3 + 1)::INT AS n, [alt, alt || 'A', alt || 'TT'][1:(ord % 3 + 1)::INT] AS alts FROM v WHERE length(ref) = 1),
    x AS (SELECT *, list_transform(range(1, n + 1), lambda i: (ord + i)::INT) AS af, list_transform(range(1, n + 2), lambda i: (ord + i)::INT) AS ad,
             list_transform(range(1, ((n + 1) * (n + 2)) // 2 + 1), lambda i: (ord + i)::INT) AS pl, [(ord % (n + 1))::INT, n] AS gt FROM w)"""

ORACLE_SQL = {
    "vcf_left_align": f"""WITH RECURSIVE {_SQL_PARTS}{_SQL_VARIANTS},
        moves AS (SELECT ord, g, pos AS x, substr(CASE WHEN length(ref) > 1 THEN ref ELSE alt END, 2) AS s, length(ref) > 1 AS gone FROM v JOIN genome USING (chrom) WHERE length(ref) <> length(alt)
            UNION ALL SELECT ord, g, x - 1, right(s, 1) || left(s, length(s) - 1), gone FROM moves WHERE x > 0 AND substr(g, x::INT, 1) = right(s, 1)),
        least_at AS (SELECT ord, min(x) AS x, arg_min(s, x) AS s, any_value(gone) AS gone, any_value(g) AS g FROM moves GROUP BY 1),
        based AS (SELECT *, CASE WHEN x > 0 THEN substr(g, x::INT, 1) WHEN gone THEN substr(g, length(s) + 1, 1) ELSE substr(g, 1, 1) END AS base FROM least_at)
        SELECT ord, greatest(x, 1) AS pos, CASE WHEN NOT gone THEN base WHEN x > 0 THEN base || s ELSE s || base END AS ref, CASE WHEN gone THEN base WHEN x > 0 THEN base || s ELSE s || base END AS alt FROM based
        UNION ALL SELECT ord, pos, ref, alt FROM v WHERE length(ref) = length(alt)""",
    "vcf_atoms": f"""WITH {_SQL_PARTS}{_SQL_VARIANTS},
        i AS (SELECT *, unnest(range(1, least(length(ref), length(alt)) + 1)) AS i FROM v),
        a AS (SELECT ord, i, pos + i - 1 AS pos, substr(ref, i::INT, 1) AS ref, substr(alt, i::INT, 1) AS alt FROM i WHERE substr(ref, i::INT, 1) <> substr(alt, i::INT, 1)
            UNION ALL SELECT ord, 99, pos, ref, alt FROM v WHERE length(ref) <> length(alt) AND least(length(ref), length(alt)) = 1)
        SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY i) - 1)::INT AS atom, pos, ref, alt FROM a""",
    "vcf_split_alleles": f"""WITH {_SQL_PARTS}{_SQL_VARIANTS}{_SQL_LISTS}, u AS (SELECT *, unnest(range(1, n + 1))::INT AS i FROM x)
        SELECT ord, i - 1 AS nth, alts[i] AS alt, af[i]::VARCHAR AS af, ad[1] || ',' || ad[i + 1] AS ad, pl[1] || ',' || pl[(i * (i + 1)) // 2 + 1] || ',' || pl[(i * (i + 1)) // 2 + i + 1] AS pl,
               (gt[1] = i)::INT || ',' || (gt[2] = i)::INT AS gt FROM u""",
    "vcf_join_lists": f"""WITH {_SQL_PARTS}{_SQL_VARIANTS}{_SQL_LISTS}, one AS (SELECT x.*, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY ord) AS k FROM x)
        SELECT ord, array_to_string(alts, ',') AS alts, array_to_string(af, ',') AS af, array_to_string(ad, ',') AS ad,
               array_to_string(flatten(list_transform(range(0, n + 1), lambda k: list_transform(range(0, k + 1), lambda j: CASE WHEN j = 0 OR j = k THEN pl[((k * (k + 1)) // 2 + j + 1)::INT]::VARCHAR ELSE '.' END))), ',') AS pl,
               array_to_string(gt, ',') AS gt FROM one WHERE k = 1""",
    "bed_getfasta": f"""WITH {_SQL_PARTS}{_SQL_VARIANTS}, z AS (SELECT ord, g, greatest(pos - 30, 0) AS start, pos + ord % 90 AS "end" FROM v JOIN genome USING (chrom))
        SELECT ord, start, "end", substr(g, (start + 1)::INT, ("end" - start)::INT) AS bases FROM z""",
    "bam_mpileup": f"""WITH {_SQL_READS},
        pair AS (SELECT qname, max(start) AS f, min(start + len) AS t FROM used GROUP BY 1 HAVING count(*) = 2 AND min(chrom) = max(chrom)),
        m AS (SELECT b.*, count(*) OVER w AS n, row_number() OVER (w ORDER BY q DESC, ord) AS k, min(base) OVER w = max(base) OVER w AS same, sum(q) OVER w AS both_q
              FROM b JOIN pair USING (qname) WHERE op = 'M' AND pos >= f AND pos < t WINDOW w AS (PARTITION BY qname, pos)),
        c AS (SELECT chrom, pos, op, base, (CASE WHEN n = 1 THEN q WHEN k = 2 THEN 0 WHEN same THEN least(both_q, 200) ELSE q * 4 // 5 END)::INT AS q, inserted FROM m
              UNION ALL SELECT b.chrom, b.pos, op, base, q, inserted FROM b LEFT JOIN pair USING (qname) WHERE NOT coalesce(op = 'M' AND b.pos >= f AND b.pos < t, false))
        SELECT chrom, pos, count(base) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t,
               count(*) FILTER (op = 'D') AS deletions, count(*) FILTER (op = 'N') AS skips, count(inserted) AS insertions, coalesce(sum(q), 0)::BIGINT AS qualities FROM c WHERE base IS NULL OR q >= 13 GROUP BY 1, 2""",
    "bam_pile_text": f"""WITH {_SQL_PARTS}, {_SQL_READS},
        y AS (SELECT b.*, CASE WHEN pos < length(g) THEN substr(g, (pos + 1)::INT, 1) ELSE 'N' END AS ref, rpad(substr(g, (pos + 2)::INT, deleted), deleted, 'N') AS gone FROM b LEFT JOIN genome USING (chrom) WHERE base IS NULL OR q >= 13),
        s AS (SELECT *, CASE WHEN head THEN '^' || chr(least(mapq, 93) + 33) ELSE '' END || CASE WHEN op = 'D' THEN '*' WHEN op = 'N' THEN CASE WHEN rev THEN '<' ELSE '>' END WHEN base = ref THEN CASE WHEN rev THEN ',' ELSE '.' END WHEN rev THEN lower(base) ELSE base END
                 || CASE WHEN inserted IS NULL THEN '' ELSE '+' || length(inserted) || CASE WHEN rev THEN lower(inserted) ELSE inserted END END || CASE WHEN deleted = 0 THEN '' ELSE '-' || deleted || CASE WHEN rev THEN lower(gone) ELSE gone END END
                 || CASE WHEN tail THEN '$' ELSE '' END AS sym FROM y)
        SELECT chrom, pos, ref, ord // 4096 AS piece, count(*)::INT AS depth, string_agg(sym, '' ORDER BY ord) AS bases, string_agg(chr((least(coalesce(q, 0), 93) + 33)::INT), '' ORDER BY ord) AS qualities FROM s GROUP BY ALL""",
    "bam_consensus": f"""WITH {_SQL_READS}, k AS (SELECT chrom, pos, base, count(*) AS n, sum(q) AS q FROM b WHERE op = 'M' AND q >= 13 GROUP BY 1, 2, 3),
        gone AS (SELECT chrom, pos, count(*) AS n FROM b WHERE op = 'D' GROUP BY 1, 2),
        f AS (SELECT *, row_number() OVER (w ORDER BY q DESC, base) AS i, sum(n) OVER w AS depth, sum(q) OVER w AS total FROM k WINDOW w AS (PARTITION BY chrom, pos))
        SELECT f.chrom, f.pos, CASE WHEN depth >= 3 AND q >= 0.4 * total THEN base ELSE 'N' END AS base, depth::BIGINT AS depth FROM f LEFT JOIN gone d ON d.chrom = f.chrom AND d.pos = f.pos WHERE i = 1 AND depth >= coalesce(d.n, 0)""",
    "bam_markdup_pairs": f"""WITH {_SQL_READS},
        scored AS (SELECT r.ord, r.qname, {{'c': chrom, 'at': CASE WHEN flag & 16 <> 0 THEN start + len + trail ELSE start - lead END, 'rev': flag & 16 <> 0}} AS place,
                    list_sum(list_transform(range(1, 21), lambda i: CASE WHEN ascii(substr(qual, i::INT, 1)) - 33 >= 15 THEN ascii(substr(qual, i::INT, 1)) - 33 ELSE 0 END))::BIGINT AS score
                   FROM r JOIN spans USING (pattern) WHERE flag & 2820 = 0),
        two AS (SELECT qname, min(place) AS one, max(place) AS two, sum(score) AS score FROM scored GROUP BY 1 HAVING count(*) = 2),
        worse AS (SELECT qname FROM (SELECT qname, row_number() OVER (PARTITION BY one, two ORDER BY score DESC, qname) AS k FROM two) WHERE k > 1),
        alone AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, qname, ord) AS k FROM scored WHERE qname NOT IN (SELECT qname FROM two)),
        dup AS (SELECT ord FROM scored WHERE qname IN (SELECT qname FROM worse) UNION ALL SELECT ord FROM alone WHERE k > 1 OR place IN (SELECT one FROM two UNION SELECT two FROM two))
        SELECT ord, ord IN (SELECT ord FROM dup) AS duplicate FROM r""",
}
