"""Queries of the variant records, which Spark derives from lineitem, and of lifted intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import intervals as I
from loomspark.operators import variants as V
from loomspark.plans.intervals import VIEWS, left
from loomspark.session import read_table

#: Both Spark and DuckDB read these: alleles are pieces of a fixed string.
_COLUMNS = [
    "concat('c', cast(l_suppkey % 7 AS STRING)) AS chrom", "l_orderkey * 3 + l_linenumber % 3 + 1 AS pos",
    "substr('ACGTTACGGTCATTGCA', cast(1 + l_partkey % 11 AS INT), cast(1 + greatest(l_linenumber % 5 - 2, 0) AS INT)) AS ref",
    "substr('ACGTTACGGTCATTGCA', cast(1 + l_suppkey % 13 AS INT), cast(1 + greatest(l_partkey % 7 - 4, 0) AS INT)) AS alt",
    "l_quantity AS qual", "l_tax AS depth", "l_orderkey * 8 + l_linenumber AS ord",
]


def records(spark, sf_dir):
    """A record for each order line; of lines of one number the greatest."""
    rows = read_table(spark, sf_dir, "lineitem").selectExpr(*_COLUMNS)
    return rows.groupBy("ord").agg(F.max(F.struct("chrom", "pos", "ref", "alt", "qual", "depth")).alias("v")).select("v.*", "ord")


def _v(f):
    return lambda spark, sf_dir: f(records(spark, sf_dir))


def gaps(variants):
    near = V.near_indels(variants, 3).withColumn("why", F.lit("SnpGap"))
    return near.unionByName(V.crowded_indels(variants, 5).withColumn("why", F.lit("IndelGap")))


def transfer(variants):
    notes = variants.where("ord % 3 = 0").select(*V.SITE, (F.col("qual") * 2).alias("qual"), F.col("depth").alias("note"))
    return V.transferred(variants, notes, ["qual", "note"]).select("ord", "qual", "note")


def soft(variants):
    rules = {"q10": F.col("qual") < 10, "tax": F.col("depth") > 0.05, "indel": V.kind() == "indel"}
    return V.soft_filter(variants, rules).select("ord", "filter")


QUERIES = {
    "vcf_trim": _v(lambda v: V.trimmed(v).select("ord", "pos", "ref", "alt")),
    "vcf_stats": _v(lambda v: V.report(v, ["chrom"])),
    "vcf_ts_tv": _v(lambda v: V.ts_tv_by_quality(v, 10)),
    "vcf_substitutions": _v(V.substitutions),
    "vcf_indel_lengths": _v(V.indel_lengths),
    "vcf_density": _v(lambda v: V.density(v, 1000)),
    "vcf_filter": _v(soft),
    "vcf_gaps": _v(gaps),
    "vcf_annotate": _v(transfer),
    "vcf_concat": _v(lambda v: V.concatenated([v.where("ord % 2 = 0"), v.where("ord % 3 <> 1")]).select("ord", "file", *V.SITE)),
    "vcf_join_alleles": _v(V.joined_alleles),
    "vcf_distance": _v(V.site_distances),
    "bed_lift": lambda s, d: I.lifted(left(s, d), chain(s, d), 0.9),
}


def chain(spark, sf_dir):
    """A chain for each chrom: blocks of 700 bases with 40 left out between them, back to front on every other chrom."""
    ends = left(spark, sf_dir).groupBy("chrom").agg(F.max("end").alias("end"))
    blocks = I.make_windows(ends.select("chrom", F.lit(0).cast("long").alias("start"), "end", F.lit(0).cast("long").alias("ord")), 700, 740)
    back = F.substring("chrom", 4, 1).cast("int") % 2 == 1
    to = F.when(back, 10_000_000 - F.col("end")).otherwise(F.col("start") + 5000)
    return blocks.select("chrom", "start", "end", F.col("chrom").alias("chain"), F.concat(F.lit("n"), F.col("chrom")).alias("to_chrom"), to.alias("to_start"), F.when(back, "-").otherwise("+").alias("way"))


_BASE = """v AS (SELECT ord, unnest(max(struct_pack(chrom := chrom, pos := pos, ref := ref, alt := alt, qual := qual, depth := depth)))
    FROM (SELECT %s FROM lineitem) GROUP BY ord),
k AS (SELECT *, CASE WHEN ref = alt THEN 'ref' WHEN length(ref) <> length(alt) THEN 'indel' WHEN length(ref) = 1 THEN 'snp' ELSE 'mnp' END AS kind, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS ts FROM v)""" % ", ".join(_COLUMNS)
_BODY = {
    "vcf_trim": """, e AS (SELECT *, len(list_filter(range(1, least(length(ref), length(alt))), lambda i: right(ref, i) = right(alt, i))) AS n FROM v),
        c AS (SELECT ord, pos, left(ref, length(ref) - n) AS ref, left(alt, length(alt) - n) AS alt FROM e),
        b AS (SELECT *, len(list_filter(range(1, least(length(ref), length(alt))), lambda i: left(ref, i) = left(alt, i))) AS m FROM c)
        SELECT ord, pos + m AS pos, substr(ref, m + 1) AS ref, substr(alt, m + 1) AS alt FROM b""",
    "vcf_stats": """SELECT chrom, count(*) AS records, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind = 'mnp') AS mnps, count(*) FILTER (kind = 'indel') AS indels, 0::BIGINT AS others,
        count(*) FILTER (kind = 'snp' AND ts) AS ts, count(*) FILTER (kind = 'snp' AND NOT ts) AS tv, round(count(*) FILTER (kind = 'snp' AND ts) / nullif(count(*) FILTER (kind = 'snp' AND NOT ts), 0), 6) AS ts_tv FROM k GROUP BY 1""",
    "vcf_ts_tv": "SELECT floor(qual / 10)::BIGINT AS step, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv FROM k WHERE kind = 'snp' GROUP BY 1",
    "vcf_substitutions": "SELECT ref, alt, count(*) AS n FROM k WHERE kind = 'snp' GROUP BY ALL",
    "vcf_indel_lengths": "SELECT (length(alt) - length(ref))::INT AS gain, count(*) AS n FROM k WHERE kind = 'indel' GROUP BY 1",
    "vcf_density": 'SELECT chrom, (pos - 1) // 1000 AS "window", count(*) AS n, round(count(*) * 1000 / 1000, 6) AS per_kb FROM v GROUP BY ALL',
    "vcf_filter": "SELECT ord, coalesce(nullif(concat_ws(';', CASE WHEN qual < 10 THEN 'q10' END, CASE WHEN depth > 0.05 THEN 'tax' END, CASE WHEN kind = 'indel' THEN 'indel' END), ''), 'PASS') AS filter FROM k",
    "vcf_gaps": """, s AS (SELECT ord, chrom, kind, qual, pos - 1 AS a, pos - 1 + length(ref) AS b FROM k), i AS (SELECT * FROM s WHERE kind = 'indel'),
        m AS (SELECT *, max(b) OVER (PARTITION BY chrom ORDER BY a, b, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
        g AS (SELECT *, sum((reach IS NULL OR a > reach + 5)::INT) OVER (PARTITION BY chrom ORDER BY a, b, ord ROWS UNBOUNDED PRECEDING) AS island FROM m),
        o AS (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY qual DESC, ord) AS place FROM g)
        SELECT ord, 'SnpGap' AS why FROM s WHERE kind = 'snp' AND EXISTS (SELECT 1 FROM i WHERE i.chrom = s.chrom AND i.a - 3 < s.b AND i.b + 3 > s.a)
        UNION ALL SELECT ord, 'IndelGap' FROM o WHERE place > 1""",
    "vcf_annotate": """, n AS (SELECT chrom, pos, ref, alt, min(struct_pack(q := qual * 2, d := depth)) AS x FROM v WHERE ord % 3 = 0 GROUP BY ALL)
        SELECT ord, coalesce(x.q, qual) AS qual, x.d AS note FROM v LEFT JOIN n USING (chrom, pos, ref, alt)""",
    "vcf_concat": """SELECT ord, file, chrom, pos, ref, alt FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY file, ord) AS place
        FROM (SELECT *, 0 AS file FROM v WHERE ord % 2 = 0 UNION ALL SELECT *, 1 FROM v WHERE ord % 3 <> 1)) WHERE place = 1""",
    "vcf_join_alleles": "SELECT chrom, pos, ref, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alts, max(qual) AS qual FROM v GROUP BY ALL",
    "vcf_distance": """SELECT chrom, pos, least(pos - lag(pos) OVER w, lead(pos) OVER w - pos) AS distance FROM (SELECT DISTINCT chrom, pos FROM v) WINDOW w AS (PARTITION BY chrom ORDER BY pos)""",
}
ORACLE_SQL = {k: f"WITH {_BASE} {v}" for k, v in _BODY.items()}
ORACLE_SQL["bed_lift"] = f"""WITH {VIEWS}, lift_g AS (SELECT chrom, max("end") AS top FROM a GROUP BY 1),
    lift_w AS (SELECT chrom, top, unnest(range(0, top, 740)) AS s FROM lift_g), lift_c AS (SELECT chrom, s, least(s + 700, top) AS e, substr(chrom, 4, 1)::INT % 2 = 1 AS back FROM lift_w),
    lift_p AS (SELECT ord, a.chrom, a."end" - a.start AS length, back, greatest(start, s) AS x, least("end", e) AS y, s, e FROM a JOIN lift_c c ON a.chrom = c.chrom AND start < e AND s < "end"),
    lift_m AS (SELECT *, CASE WHEN back THEN 10000000 - e + e - y ELSE s + 5000 + x - s END AS t FROM lift_p),
    lift_f AS (SELECT ord, 'n' || any_value(chrom) AS to_chrom, min(t) AS to_start, max(t + y - x) AS to_end, CASE WHEN any_value(back) THEN '-' ELSE '+' END AS way, sum(y - x) >= any_value(length) * 0.9 AS ok FROM lift_m GROUP BY ord)
    SELECT ord, CASE WHEN ok THEN to_chrom END AS to_chrom, CASE WHEN ok THEN to_start END AS to_start, CASE WHEN ok THEN to_end END AS to_end, CASE WHEN ok THEN way END AS way,
        CASE WHEN ok THEN 'lifted' WHEN ok IS NULL THEN 'deleted' ELSE 'partly' END AS status FROM a LEFT JOIN lift_f USING (ord)"""
