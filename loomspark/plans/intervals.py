"""Queries of the interval family, over intervals that Spark derives from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import intervals as I
from loomspark.operators.nearest import nearest
from loomspark.session import read_table

CHROMS = 8
DAY0 = "1992-01-01"


def left(spark, sf_dir):
    """Intervals A: a chrom for each eighth of the suppliers, by ship date, as long as the quantity."""
    li = read_table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY0).cast("date")).cast("long")
    start = day * 100 + F.col("l_partkey") % 97
    return li.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % CHROMS).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"),
        F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"), F.col("l_quantity").cast("long").alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    ).groupBy("ord").agg(*[F.max(F.struct("start", "chrom", "end", "strand", "score"))[c].alias(c) for c in ("chrom", "start", "end", "strand", "score")])


def right(spark, sf_dir):
    """Intervals B: orders by date, as long as their price is high."""
    o = read_table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit(DAY0).cast("date")).cast("long")
    start = day * 100 + F.col("o_orderkey") % 83
    size = F.floor(F.col("o_totalprice") / 10000).cast("long") + 1
    return o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % CHROMS).cast("string")).alias("chrom"), start.alias("start"), (start + size).alias("end"), size.alias("score"), F.col("o_orderkey").alias("ord"))


def genome(spark, sf_dir):
    return left(spark, sf_dir).select("chrom", "end").unionAll(right(spark, sf_dir).select("chrom", "end")).groupBy("chrom").agg((F.max("end") + 100).alias("size"))


def _ab(f):
    return lambda spark, sf_dir: f(left(spark, sf_dir), right(spark, sf_dir))


def _a(f):
    return lambda spark, sf_dir: f(left(spark, sf_dir))


def _ag(f):
    return lambda spark, sf_dir: f(left(spark, sf_dir), genome(spark, sf_dir))


def _scored(df):
    """Merged intervals with how many there were as score."""
    return I.merge(df).withColumnRenamed("n", "score")


QUERIES = {
    "bed_sort": _a(lambda a: a.orderBy("chrom", "start", "ord").select("chrom", "start", "end", "ord")),
    "bed_intersect": _ab(I.intersect),
    "bed_overlapping": _ab(lambda a, b: I.overlapping(a, b).select("ord")),
    "bed_not_overlapping": _ab(lambda a, b: I.overlapping(a, b, False).select("ord")),
    "bed_intersect_fraction": _ab(lambda a, b: I.reported(a, b, 0.5).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "shared")),
    "bed_intersect_reciprocal": _ab(lambda a, b: I.reported(a, b, 0.4, 0.4).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "shared")),
    "bed_intersect_either": _ab(lambda a, b: I.reported(a, b, 0.6, 0.6, True).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "shared")),
    "bed_intersect_strand": _ab(lambda a, b: I.reported(a, b.withColumn("strand", F.when(F.col("ord") % 2 == 0, "-").otherwise("+")), strand="same").select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), "shared")),
    "bed_intersect_all": _ab(I.all_overlaps),
    "bed_intersect_count": _ab(I.overlap_counts),
    "bed_fisher": lambda s, d: I.overlap_table(left(s, d), right(s, d), genome(s, d)),
    "bed_flank": _ag(lambda a, g: I.flank(a, g, 40, 7, True)),
    "bed_union_graphs": _ab(lambda a, b: I.union_graphs({"one": _scored(b.where("ord % 2 = 1")), "two": _scored(b.where("ord % 2 = 0"))}, -1)),
    "bed_merge": _ab(lambda a, b: I.merge(b)),
    "bed_cluster": _ab(lambda a, b: I.islands(b, 20).select("chrom", "ord", "island")),
    "bed_cluster_strand": _a(lambda a: I.islands(a, 5, ("chrom", "strand")).select("chrom", "strand", "ord", "island")),
    "bed_complement": lambda s, d: I.complement(right(s, d), genome(s, d)),
    "bed_subtract": _ab(I.subtract),
    "bed_window": _ab(lambda a, b: I.window_pairs(a, b, 30, 10, True)),
    "bed_closest": _ab(I.closest),
    "bed_closest_k": _ab(lambda a, b: nearest(a, b, 3)),
    "bed_closest_upstream": _ab(lambda a, b: nearest(a, b, 2, "first", False, oriented="a", downstream=False)),
    "bed_coverage": _ab(lambda a, b: I.coverage(a, b).withColumn("fraction", F.round("fraction", 6))),
    "bed_genomecov": lambda s, d: I.genome_histogram(left(s, d), genome(s, d)).withColumn("fraction", F.round("fraction", 9)),
    "bed_depth_runs": _ab(lambda a, b: I.depth_runs(b)),
    "bed_map": _ab(lambda a, b: I.map_values(a, b, {"sum": F.sum("b.score"), "mean": F.round(F.avg("b.score"), 6), "least": F.min("b.score"), "most": F.max("b.score"), "n": F.count(F.lit(1))}, {"distinct": "score"})),
    "bed_annotate": _ab(lambda a, b: I.annotate(a, {"odd": b.where("ord % 2 = 1"), "even": b.where("ord % 2 = 0")})),
    "bed_jaccard": _ab(lambda a, b: I.jaccard(a, b).withColumn("jaccard", F.round("jaccard", 6))),
    "bed_spacing": _ab(lambda a, b: I.spacing(b)),
    "bed_slop": _ag(lambda a, g: I.slop(a, g, 40, 7, True).select("chrom", "start", "end", "ord")),
    "bed_shift": _ag(lambda a, g: I.shift(a, g, -60).select("chrom", "start", "end", "ord")),
    "bed_windows": _ab(lambda a, b: I.make_windows(b, 10, 5)),
    "bed_multiinter": _ab(lambda a, b: I.partitions({"one": b.where("ord % 2 = 1"), "two": b.where("ord % 2 = 0")})),
    "bed_reldist": _ab(I.relative_distance),
    "signal_bins": _ab(lambda a, b: I.binned_means(b, 1000).withColumn("mean", F.round("mean", 9))),
    "signal_smooth": _ab(lambda a, b: I.smoothed(I.binned_means(b, 1000), 2).select("chrom", "bin", F.round("smooth", 9).alias("smooth"))),
}

VIEWS = f"""
a AS (SELECT ord, unnest(max(struct_pack(start := start, chrom := chrom, "end" := "end", strand := strand, score := score))) FROM (
    SELECT l_orderkey * 8 + l_linenumber AS ord, 'chr' || (l_suppkey % {CHROMS}) AS chrom, s AS start, s + l_quantity::BIGINT AS "end",
           CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, l_quantity::BIGINT AS score
    FROM (SELECT *, datediff('day', DATE '{DAY0}', l_shipdate::DATE) * 100 + l_partkey % 97 AS s FROM lineitem)) GROUP BY ord),
b AS (SELECT o_orderkey AS ord, 'chr' || (o_custkey % {CHROMS}) AS chrom, s AS start, s + floor(o_totalprice / 10000)::BIGINT + 1 AS "end", floor(o_totalprice / 10000)::BIGINT + 1 AS score
    FROM (SELECT *, datediff('day', DATE '{DAY0}', o_orderdate::DATE) * 100 + o_orderkey % 83 AS s FROM orders)),
g AS (SELECT chrom, max("end") + 100 AS size FROM (SELECT chrom, "end" FROM a UNION ALL SELECT chrom, "end" FROM b) GROUP BY 1),
hits AS (SELECT a.chrom, a.ord AS a_ord, b.ord AS b_ord, a.start AS a_start, a."end" AS a_end, b.start AS b_start, b."end" AS b_end, b.score
    FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end", ord) AS island
    FROM (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)),
mb AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM isl GROUP BY chrom, island),
isl_a AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end", ord) AS island
    FROM (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)),
ma AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM isl_a GROUP BY chrom, island),
ev AS (SELECT chrom, start AS pos, 1 AS d FROM b UNION ALL SELECT chrom, "end", -1 FROM b),
dp AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth
    FROM (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0))"""


def _cluster(table: str, gap: int, by: str) -> str:
    return f"""SELECT {by}, ord, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start, "end", ord)::BIGINT AS island
        FROM (SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {table})"""


_BINS = """(SELECT chrom, bin, sum((least("end", (bin + 1) * 1000) - greatest(start, bin * 1000)) * depth) / 1000.0 AS mean
    FROM (SELECT *, unnest(range(start // 1000, ("end" - 1) // 1000 + 1)) AS bin FROM dp WHERE depth > 0 AND "end" IS NOT NULL) GROUP BY 1, 2)"""

_MERGED_HALF = """SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS score FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end", ord) AS i FROM (
        SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE ord % 2 = {})) GROUP BY chrom, i"""
_SHARED = "least(a_end, b_end) - greatest(a_start, b_start)"

_BODY = {
    "bed_intersect_fraction": f"SELECT a_ord, b_ord, {_SHARED} AS shared FROM hits WHERE {_SHARED} >= 0.5 * (a_end - a_start)",
    "bed_intersect_reciprocal": f"SELECT a_ord, b_ord, {_SHARED} AS shared FROM hits WHERE {_SHARED} >= 0.4::DOUBLE * (a_end - a_start) AND {_SHARED} >= 0.4::DOUBLE * (b_end - b_start)",
    "bed_intersect_either": f"SELECT a_ord, b_ord, {_SHARED} AS shared FROM hits WHERE {_SHARED} >= 0.6::DOUBLE * (a_end - a_start) OR {_SHARED} >= 0.6::DOUBLE * (b_end - b_start)",
    "bed_intersect_strand": f"SELECT a_ord, b_ord, {_SHARED} AS shared FROM hits JOIN a ON a.ord = a_ord WHERE a.strand = CASE WHEN b_ord % 2 = 0 THEN '-' ELSE '+' END",
    "bed_intersect_all": f"SELECT a.ord AS a_ord, b_ord, coalesce({_SHARED}, 0) AS shared FROM a LEFT JOIN hits ON a_ord = a.ord",
    "bed_intersect_count": "SELECT a.ord, count(b_ord) AS n FROM a LEFT JOIN hits ON a_ord = a.ord GROUP BY 1",
    "bed_fisher": """, f AS (SELECT (SELECT count(*) FROM hits) AS n_both, (SELECT count(*) FROM a) - (SELECT count(DISTINCT a_ord) FROM hits) AS only_a,
        (SELECT count(*) FROM b) - (SELECT count(DISTINCT b_ord) FROM hits) AS only_b,
        floor((SELECT sum(size) FROM g) / ((SELECT avg("end" - start) FROM a) + (SELECT avg("end" - start) FROM b)))::BIGINT AS possible)
        SELECT n_both, only_a, only_b, greatest(0, possible - n_both - only_a - only_b) AS neither FROM f""",
    "bed_flank": """SELECT * FROM (SELECT a.chrom, greatest(0, start - CASE WHEN strand = '-' THEN 7 ELSE 40 END) AS start, start AS "end", ord, 'left' AS side FROM a
        UNION ALL SELECT a.chrom, "end", least(size, "end" + CASE WHEN strand = '-' THEN 40 ELSE 7 END), ord, 'right' FROM a JOIN g ON g.chrom = a.chrom) WHERE start < "end\"""",
    "bed_union_graphs": f""", m1 AS ({_MERGED_HALF.format(1)}), m0 AS ({_MERGED_HALF.format(0)}),
        e AS (SELECT DISTINCT chrom, unnest([start, "end"]) AS pos FROM (SELECT chrom, start, "end" FROM m1 UNION ALL SELECT chrom, start, "end" FROM m0)),
        s AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end" FROM e)
        SELECT s.chrom, s.start, s."end", coalesce(m1.score, -1) AS one, coalesce(m0.score, -1) AS two FROM s
        LEFT JOIN m1 ON m1.chrom = s.chrom AND m1.start <= s.start AND s."end" <= m1."end"
        LEFT JOIN m0 ON m0.chrom = s.chrom AND m0.start <= s.start AND s."end" <= m0."end"
        WHERE s."end" IS NOT NULL AND (m1.score IS NOT NULL OR m0.score IS NOT NULL)""",
    "bed_sort": 'SELECT chrom, start, "end", ord FROM a ORDER BY chrom, start, ord',
    "bed_intersect": 'SELECT chrom, greatest(a_start, b_start) AS start, least(a_end, b_end) AS "end", a_ord, b_ord FROM hits',
    "bed_overlapping": "SELECT DISTINCT a_ord AS ord FROM hits",
    "bed_not_overlapping": "SELECT ord FROM a WHERE ord NOT IN (SELECT a_ord FROM hits)",
    "bed_merge": 'SELECT chrom, start, "end", n FROM mb',
    "bed_cluster": _cluster("b", 20, "chrom"),
    "bed_cluster_strand": _cluster("a", 5, "chrom, strand"),
    "bed_complement": """SELECT chrom, before AS start, start AS "end" FROM (SELECT chrom, start, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start), 0) AS before
        FROM (SELECT chrom, start, "end" FROM mb UNION ALL SELECT chrom, size, size FROM g)) WHERE before < start""",
    "bed_subtract": """SELECT chrom, s AS start, e AS "end", ord FROM (SELECT ord, chrom, unnest([start] || coalesce(ce, [])) AS s, unnest(coalesce(cs, []) || ["end"]) AS e
        FROM a LEFT JOIN (SELECT a.ord AS o, list(greatest(a.start, mb.start) ORDER BY mb.start) AS cs, list(least(a."end", mb."end") ORDER BY mb.start) AS ce
        FROM a JOIN mb ON a.chrom = mb.chrom AND a.start < mb."end" AND mb.start < a."end" GROUP BY 1) ON o = ord) WHERE s < e""",
    "bed_window": """SELECT w.chrom, w.ord AS a_ord, b.ord AS b_ord FROM (SELECT chrom, ord, greatest(0, start - CASE WHEN strand = '-' THEN 10 ELSE 30 END) AS s,
        "end" + CASE WHEN strand = '-' THEN 30 ELSE 10 END AS e FROM a) w JOIN b ON w.chrom = b.chrom AND w.s < b."end" AND b.start < w.e""",
    "bed_closest": """, free AS (SELECT * FROM a WHERE ord NOT IN (SELECT a_ord FROM hits)),
        near AS (SELECT f.ord, f.chrom, f.start - p."end" + 1 AS before, n.start - f."end" + 1 AS after, p."end" AS pe, n.start AS ns
            FROM free f ASOF LEFT JOIN (SELECT DISTINCT chrom, "end" FROM b) p ON f.chrom = p.chrom AND f.start >= p."end"
            ASOF LEFT JOIN (SELECT DISTINCT chrom, start FROM b) n ON f.chrom = n.chrom AND f."end" <= n.start)
        SELECT a_ord, b_ord, 0::BIGINT AS distance FROM hits
        UNION ALL SELECT DISTINCT near.ord, b.ord, least(before, after) FROM near JOIN b ON b.chrom = near.chrom AND ((b."end" = pe AND before <= coalesce(after, before)) OR (b.start = ns AND after <= coalesce(before, after)))
        UNION ALL SELECT ord, NULL, -1 FROM near WHERE before IS NULL AND after IS NULL""",
    "bed_closest_k": """, st AS (SELECT chrom, start AS pos, row_number() OVER (PARTITION BY chrom ORDER BY start) AS r FROM (SELECT DISTINCT chrom, start FROM b)),
        en AS (SELECT chrom, "end" AS pos, row_number() OVER (PARTITION BY chrom ORDER BY "end") AS r FROM (SELECT DISTINCT chrom, "end" FROM b)),
        sides AS (SELECT a.ord, a.chrom, s.pos - a."end" + 1 AS d, s.pos AS s_pos, NULL AS e_pos FROM a ASOF JOIN st ON a.chrom = st.chrom AND a."end" <= st.pos JOIN st s ON s.chrom = st.chrom AND s.r >= st.r AND s.r < st.r + 3
            UNION ALL SELECT a.ord, a.chrom, a.start - e.pos + 1, NULL, e.pos FROM a ASOF JOIN en ON a.chrom = en.chrom AND a.start >= en.pos JOIN en e ON e.chrom = en.chrom AND e.r <= en.r AND e.r > en.r - 3),
        cand AS (SELECT a_ord, b_ord, 0::BIGINT AS distance FROM hits UNION ALL SELECT x.ord, b.ord, d FROM sides x JOIN b ON b.chrom = x.chrom AND b.start = s_pos UNION ALL SELECT x.ord, b.ord, d FROM sides x JOIN b ON b.chrom = x.chrom AND b."end" = e_pos),
        best AS (SELECT * FROM cand QUALIFY rank() OVER (PARTITION BY a_ord ORDER BY distance) <= 3)
        SELECT a_ord, b_ord, distance FROM best UNION ALL SELECT ord, NULL, -1 FROM a WHERE ord NOT IN (SELECT a_ord FROM best)""",
    "bed_closest_upstream": """, st AS (SELECT chrom, start AS pos, row_number() OVER (PARTITION BY chrom ORDER BY start) AS r FROM (SELECT DISTINCT chrom, start FROM b)),
        en AS (SELECT chrom, "end" AS pos, row_number() OVER (PARTITION BY chrom ORDER BY "end") AS r FROM (SELECT DISTINCT chrom, "end" FROM b)),
        sides AS (SELECT a.ord, a.chrom, s.pos - a."end" + 1 AS d, s.pos AS s_pos, NULL AS e_pos FROM a ASOF JOIN st ON a.chrom = st.chrom AND a."end" <= st.pos JOIN st s ON s.chrom = st.chrom AND s.r >= st.r AND s.r < st.r + 2 WHERE strand = '-'
            UNION ALL SELECT a.ord, a.chrom, a.start - e.pos + 1, NULL, e.pos FROM a ASOF JOIN en ON a.chrom = en.chrom AND a.start >= en.pos JOIN en e ON e.chrom = en.chrom AND e.r <= en.r AND e.r > en.r - 2 WHERE strand <> '-'),
        cand AS (SELECT x.ord AS a_ord, b.ord AS b_ord, d FROM sides x JOIN b ON b.chrom = x.chrom AND b.start = s_pos UNION ALL SELECT x.ord, b.ord, d FROM sides x JOIN b ON b.chrom = x.chrom AND b."end" = e_pos),
        best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY a_ord ORDER BY d, b_ord) <= 2)
        SELECT a_ord, b_ord, -d AS distance FROM best UNION ALL SELECT ord, NULL, -1 FROM a WHERE ord NOT IN (SELECT a_ord FROM best)""",
    "bed_coverage": """SELECT a.ord, "end" - start AS length, coalesce(n, 0) AS n, coalesce(bases, 0)::BIGINT AS bases, round(coalesce(bases, 0) / ("end" - start), 6) AS fraction FROM a
        LEFT JOIN (SELECT a_ord, count(*) AS n FROM hits GROUP BY 1) ON a_ord = a.ord
        LEFT JOIN (SELECT a.ord AS o, sum(least(a."end", mb."end") - greatest(a.start, mb.start)) AS bases FROM a JOIN mb ON a.chrom = mb.chrom AND a.start < mb."end" AND mb.start < a."end" GROUP BY 1) ON o = a.ord""",
    "bed_genomecov": """, ev_a AS (SELECT chrom, start AS pos, 1 AS d FROM a UNION ALL SELECT chrom, "end", -1 FROM a),
        r AS (SELECT chrom, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - pos AS len, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM (SELECT chrom, pos, sum(d) AS d FROM ev_a GROUP BY ALL)),
        h AS (SELECT chrom, depth, sum(len) AS bases FROM r WHERE depth > 0 GROUP BY ALL),
        z AS (SELECT chrom, depth::BIGINT AS depth, bases::BIGINT AS bases FROM h UNION ALL SELECT g.chrom, 0, size - coalesce(s, 0) FROM g LEFT JOIN (SELECT chrom, sum(bases) AS s FROM h GROUP BY 1) x ON x.chrom = g.chrom)
        SELECT z.chrom, depth, bases, round(bases / size, 9) AS fraction FROM z JOIN g ON g.chrom = z.chrom""",
    "bed_depth_runs": 'SELECT chrom, start, "end", depth::BIGINT AS depth FROM dp WHERE depth > 0',
    "bed_map": """SELECT a.ord, sum(h.score)::BIGINT AS sum, round(avg(h.score), 6) AS mean, min(h.score) AS least, max(h.score) AS most,
        nullif(count(h.score), 0) AS n, nullif(count(DISTINCT h.score), 0) AS "distinct" FROM a LEFT JOIN hits h ON h.a_ord = a.ord GROUP BY 1""",
    "bed_annotate": """, h2 AS (SELECT a_ord, count(*) FILTER (b_ord % 2 = 1) AS odd, count(*) FILTER (b_ord % 2 = 0) AS even FROM hits GROUP BY 1),
        i2 AS (SELECT *, b.ord % 2 AS f, max("end") OVER (PARTITION BY chrom, b.ord % 2 ORDER BY start, "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
        j2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, f ORDER BY start, "end", ord) AS island FROM i2),
        m2 AS (SELECT chrom, f, min(start) AS start, max("end") AS "end" FROM j2 GROUP BY chrom, f, island),
        c2 AS (SELECT a.ord, f, sum(least(a."end", m2."end") - greatest(a.start, m2.start)) AS bases FROM a JOIN m2 ON a.chrom = m2.chrom AND a.start < m2."end" AND m2.start < a."end" GROUP BY 1, 2)
        SELECT a.ord, coalesce(odd, 0) AS odd_n, coalesce(even, 0) AS even_n, round(coalesce(o.bases, 0) / (a."end" - a.start), 6) AS odd_fraction, round(coalesce(e.bases, 0) / (a."end" - a.start), 6) AS even_fraction
        FROM a LEFT JOIN h2 ON h2.a_ord = a.ord LEFT JOIN c2 o ON o.ord = a.ord AND o.f = 1 LEFT JOIN c2 e ON e.ord = a.ord AND e.f = 0""",
    "bed_jaccard": """, x AS (SELECT coalesce(sum(least(ma."end", mb."end") - greatest(ma.start, mb.start)), 0)::BIGINT AS i, count(*) AS n FROM ma JOIN mb ON ma.chrom = mb.chrom AND ma.start < mb."end" AND mb.start < ma."end"),
        y AS (SELECT sum("end" - start)::BIGINT AS s FROM (SELECT start, "end" FROM ma UNION ALL SELECT start, "end" FROM mb))
        SELECT i AS intersection, s - i AS "union", round((i / (s - i))::FLOAT::DOUBLE, 6) AS jaccard, n FROM x, y""",
    "bed_spacing": 'SELECT ord, start - lag("end") OVER (PARTITION BY chrom ORDER BY start, "end", ord) AS distance FROM b',
    "bed_slop": """SELECT a.chrom, least(greatest(start - CASE WHEN strand = '-' THEN 7 ELSE 40 END, 0), size) AS start,
        greatest(least("end" + CASE WHEN strand = '-' THEN 40 ELSE 7 END, size), 0) AS "end", ord FROM a JOIN g ON g.chrom = a.chrom""",
    "bed_shift": 'SELECT a.chrom, greatest(0, least(start - 60, size - 1)) AS start, greatest(1, least("end" - 60, size)) AS "end", ord FROM a JOIN g ON g.chrom = a.chrom',
    "bed_windows": 'SELECT chrom, ord, s AS start, least(s + 10, "end") AS "end" FROM (SELECT *, unnest(range(start, "end", 5)) AS s FROM b)',
    "bed_multiinter": """, e2 AS (SELECT chrom, start AS pos, ord % 2 AS f, 1 AS d FROM b UNION ALL SELECT chrom, "end", ord % 2, -1 FROM b),
        p2 AS (SELECT chrom, pos, sum(d) FILTER (f = 1) AS one, sum(d) FILTER (f = 0) AS two FROM e2 GROUP BY 1, 2),
        q2 AS (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", sum(coalesce(one, 0)) OVER w AS one_depth, sum(coalesce(two, 0)) OVER w AS two_depth FROM p2 WINDOW w AS (PARTITION BY chrom ORDER BY pos))
        SELECT chrom, start, "end", one_depth::BIGINT AS one_depth, two_depth::BIGINT AS two_depth FROM q2 WHERE greatest(one_depth, two_depth) > 0""",
    "bed_reldist": """, pa AS (SELECT chrom, (start + "end") // 2 AS pos, count(*) AS n FROM a GROUP BY 1, 2), pb AS (SELECT DISTINCT chrom, (start + "end") // 2 AS pos FROM b),
        m AS (SELECT pa.pos, pa.n, p.pos AS prev, x.pos AS next FROM pa ASOF JOIN pb p ON pa.chrom = p.chrom AND pa.pos >= p.pos ASOF JOIN pb x ON pa.chrom = x.chrom AND pa.pos <= x.pos)
        SELECT CASE WHEN next > prev THEN floor(least(pos - prev, next - pos) * 100 / (next - prev)) ELSE 0 END::BIGINT AS hundredth, sum(n)::BIGINT AS count FROM m GROUP BY 1""",
    "signal_bins": f"SELECT chrom, bin, round(mean, 9) AS mean FROM {_BINS}",
    "signal_smooth": f"SELECT chrom, bin, round(sum(mean) OVER (PARTITION BY chrom ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS smooth FROM {_BINS}",
}

ORACLE_SQL = {k: f"WITH {VIEWS} {v}" for k, v in _BODY.items()}
