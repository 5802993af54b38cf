"""Queries of the variant, population and matrix families, over tables that Spark derives from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import genotypes as G
from loomspark.operators import matrix as M
from loomspark.operators import variants as V
from loomspark.session import read_table

R = lambda df, *cols, d=6: df.withColumns({c: F.round(c, d) for c in cols})


def genotypes(spark, sf_dir):
    """A site for each part, a sample for each supplier of its order lines; alts from the line's keys; 1 in 17 missing."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % 60).alias("sample")).distinct()
    mix = F.col("l_partkey") * 31 + F.col("sample") * 17 + F.col("l_partkey") % 7 * F.col("sample")
    alts = F.when(mix % 17 != 0, F.least(F.lit(2), F.greatest(F.lit(0), mix % (3 + F.col("l_partkey") % 4) - F.col("l_partkey") % 2)).cast("long"))
    return li.select(F.col("l_partkey").alias("site"), (F.col("l_partkey") * 37).alias("pos"), "sample", F.concat(F.lit("p"), (F.col("sample") % 3).cast("string")).alias("pop"), alts.alias("alts"))


def counts(spark, sf_dir):
    """Lines sold of each brand (feature) in each nation of the supplier (sample)."""
    li, part, supp = (read_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).join(supp, li["l_suppkey"] == supp["s_suppkey"])
    return rows.groupBy(F.col("p_brand").alias("feature"), F.col("s_nationkey").alias("sample")).agg(F.count(F.lit(1)).alias("x"))


def lengths(spark, sf_dir):
    return read_table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.sum("p_size") + 1).alias("length"))


def measured(spark, sf_dir):
    c = counts(spark, sf_dir)
    return c.select("feature", "sample", F.log(F.col("x") + 1.0).alias("x"), (F.col("sample") % 3).alias("grp"), F.col("sample").cast("double").alias("t"))


def _g(f):
    return lambda spark, sf_dir: f(genotypes(spark, sf_dir))


def _c(f):
    return lambda spark, sf_dir: f(counts(spark, sf_dir))


def variant_presence(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("pos"), F.col("o_orderstatus").alias("ref"), F.col("o_orderkey").alias("ord"))
    return G.presence({str(k): o.where(F.col("ord") % 3 == k) for k in range(3)}, ["pos", "ref"]).groupBy("files").agg(F.count(F.lit(1)).alias("n"))


def adjusted_tests(spark, sf_dir):
    """p-values stand in for the F statistics: 1 / (1 + F)."""
    f = M.anova(measured(spark, sf_dir)).select("feature", F.round(1 / (1 + F.col("f")), 9).alias("p"))
    return R(M.adjusted(f), "bh", "holm", d=8)


def nearest_vectors(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = e.where(norm > 0).select(F.col("vec_id").alias("id"), "label", F.transform(v, lambda x: x / norm).alias("v"))
    return M.nearest(unit.where("id % 20 = 0").select(F.col("id").alias("q"), "label", F.col("v").alias("qv")), unit, 5)


QUERIES = {
    "vcf_fill_tags": _g(lambda g: R(G.site_tags(g), "af", "f_missing", "maf", "hwe_chi2")),
    "vcf_isec": variant_presence,
    "plink_samples": _g(lambda g: R(G.sample_counts(g), "f")),
    "plink_filters": _g(lambda g: G.filtered(g, 0.2, 0.15, 0.05)),
    "plink_ld": _g(lambda g: R(G.linkage(g, 111), "r2", d=8)),
    "popgen_diversity": _g(lambda g: R(G.diversity(G.population_counts(g), 2000), "pi", "theta", "tajima_d")),
    "popgen_between": _g(lambda g: R(G.between(G.population_counts(g)), "dxy", "fst")),
    "popgen_sfs": _g(lambda g: G.spectrum(G.population_counts(g))),
    "ecology_alpha": _c(lambda c: R(M.alpha(c), "shannon", "simpson", "dominance", "pielou_e", "chao1", "goods")),
    "ecology_beta": _c(lambda c: R(M.beta(c), "braycurtis", "jaccard", "euclidean")),
    "composition_alr": _c(lambda c: R(M.alr(c, "Brand#11"), "x")),
    "composition_rclr": _c(lambda c: R(M.robust_clr(c.withColumn("x", F.col("x") - 3)), "x")),
    "composition_perturb": _c(lambda c: R(M.perturbed(c, c.groupBy("feature").agg(F.max("x").alias("y"))), "x")),
    "composition_power": _c(lambda c: R(M.powered(c, 0.5), "x")),
    "ecology_evenness": _c(lambda c: R(M.evenness(c), "inv_simpson", "simpson_e", "berger_parker")),
    "ecology_canberra": _c(lambda c: R(M.canberra(c), "canberra")),
    "popgen_joint_sfs": _g(lambda g: G.joint_spectrum(G.population_counts(g))),
    "popgen_sfs_unfolded": _g(lambda g: G.spectrum(G.population_counts(g), False)),
    "vcf_setgt": _g(lambda g: V.set_genotypes(g, F.col("alts").isNull() | (F.col("sample") % 7 == 0), F.lit(0)).groupBy("site").agg(F.sum("alts").alias("ac"), F.count("alts").alias("ns"))),
    "composition_clr": _c(lambda c: R(M.clr(c), "x")),
    "composition_replace": _c(lambda c: R(M.multi_replace(c.withColumn("x", F.greatest(F.lit(0), F.col("x") - 5)), 0.001), "x", d=9)),
    "composition_vlr": _c(lambda c: R(M.log_ratio_variance(c), "vlr")),
    "composition_anova": lambda s, d: R(M.anova(measured(s, d)), "f"),
    "count_normalize": lambda s, d: R(M.normalized(counts(s, d), lengths(s, d)), "cpm", "fpkm", "tpm", d=4),
    "deseq_size_factors": _c(lambda c: R(M.size_factors(c, 25), "size_factor")),
    "limma_fit": lambda s, d: R(M.linear_fit(measured(s, d)), "slope", "intercept", "s2", "t_stat"),
    "adjust_p": adjusted_tests,
    "sc_neighbors": nearest_vectors,
}

_V = """g0 AS (SELECT DISTINCT l_partkey AS site, l_orderkey % 60 AS sample FROM lineitem),
g1 AS (SELECT *, site * 31 + sample * 17 + site % 7 * sample AS mix FROM g0),
g AS (SELECT site, site * 37 AS pos, sample, 'p' || (sample % 3) AS pop, CASE WHEN mix % 17 <> 0 THEN least(2, greatest(0, mix % (3 + site % 4) - site % 2)) END AS alts FROM g1),
pc AS (SELECT site, pos, pop, sum(alts)::BIGINT AS ac, 2 * count(alts) AS an FROM g GROUP BY ALL HAVING count(alts) > 0),
c AS (SELECT p_brand AS feature, s_nationkey AS sample, count(*) AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m AS (SELECT feature, sample, ln(x + 1.0) AS x, sample % 3 AS grp, sample::DOUBLE AS t FROM c),
tg AS (SELECT site, count(*) FILTER (alts = 0) AS n0, count(*) FILTER (alts = 1) AS n1, count(*) FILTER (alts = 2) AS n2, count(alts) AS ns, count(*) AS "all" FROM g GROUP BY 1),
t2 AS (SELECT *, n1 + 2 * n2 AS ac, 2 * ns AS an, CASE WHEN ns > 0 THEN (n1 + 2 * n2) / (2 * ns) END AS af, 1 - ns / "all" AS f_missing FROM tg),
av AS (SELECT feature, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM (SELECT feature, grp, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM m GROUP BY ALL) GROUP BY 1),
fs AS (SELECT feature, CASE WHEN q - b > 0 THEN (b - s * s / n) / (k - 1) / ((q - b) / (n - k)) END AS f FROM av)"""

_BODY = {
    "vcf_fill_tags": """SELECT site, n0, n1, n2, ns, "all", ac, an, round(af, 6) AS af, round(f_missing, 6) AS f_missing, round(least(af, 1 - af), 6) AS maf,
        CASE WHEN af > 0 AND af < 1 THEN round(pow(n0 - ns * pow(1 - af, 2), 2) / (ns * pow(1 - af, 2)) + pow(n1 - 2 * ns * af * (1 - af), 2) / (2 * ns * af * (1 - af)) + pow(n2 - ns * pow(af, 2), 2) / (ns * pow(af, 2)), 6) END AS hwe_chi2 FROM t2""",
    "vcf_isec": """, o AS (SELECT o_custkey % 500 AS pos, o_orderstatus AS ref, o_orderkey % 3 AS f, row_number() OVER (PARTITION BY o_custkey % 500, o_orderstatus, o_orderkey % 3 ORDER BY o_orderkey) AS nth FROM orders),
        b AS (SELECT pos, ref, nth, (max((f = 0)::INT))::VARCHAR || max((f = 1)::INT) || max((f = 2)::INT) AS files FROM o GROUP BY ALL) SELECT files, count(*) AS n FROM b GROUP BY 1""",
    "plink_samples": """, e AS (SELECT site, 2 * af * (1 - af) * an / (an - 1) AS e_het FROM t2 WHERE an > 1), r AS (SELECT sample, count(alts) AS called, count(*) FILTER (alts = 1) AS het, count(*) FILTER (alts IS NULL) AS missing, sum(e_het) FILTER (alts IS NOT NULL) AS e FROM g JOIN e USING (site) GROUP BY 1)
        SELECT sample, called, het, missing, CASE WHEN e > 0 THEN round(1 - het / e, 6) END AS f FROM r""",
    "plink_filters": """, k AS (SELECT sample FROM g GROUP BY 1 HAVING count(*) FILTER (alts IS NULL) / count(*) <= 0.2), h AS (SELECT site, coalesce(sum(alts), 0)::BIGINT AS ac, 2 * count(alts) AS an, 1 - count(alts) / count(*) AS fm FROM g WHERE sample IN (SELECT sample FROM k) GROUP BY 1)
        SELECT site, ac, an FROM h WHERE fm <= 0.15 AND an > 0 AND least(ac / an, 1 - ac / an) >= 0.05""",
    "plink_ld": """, x AS (SELECT a.site AS a, b.site AS b, count(*) AS n, var_pop(a.alts) AS va, var_pop(b.alts) AS vb, covar_pop(a.alts, b.alts) AS cv FROM g a JOIN g b ON a.sample = b.sample AND b.pos > a.pos AND b.pos <= a.pos + 111 WHERE a.alts IS NOT NULL AND b.alts IS NOT NULL GROUP BY 1, 2)
        SELECT a, b, n, round(cv * cv / (va * vb), 8) AS r2 FROM x WHERE va > 0 AND vb > 0""",
    "popgen_diversity": """, w AS (SELECT pop, pos // 2000 AS win, count(*) FILTER (ac > 0 AND ac < an) AS s, sum(CASE WHEN an > 1 THEN 2 * ac * (an - ac) / (an * (an - 1)) ELSE 0 END) AS pi, max(an) AS n FROM pc GROUP BY 1, 2),
        h AS (SELECT *, list_sum(list_transform(range(1, greatest(n, 2)), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, greatest(n, 2)), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM w)
        SELECT pop, win AS "window", s, round(pi, 6) AS pi, round(s / a1, 6) AS theta, CASE WHEN s >= 3 AND n > 2 THEN round((pi - s / a1) / sqrt(((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 * s + (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * s * (s - 1)), 6) END AS tajima_d FROM h""",
    "popgen_between": """, p AS (SELECT a.pop AS a, b.pop AS b, a.ac / a.an AS p, b.ac / b.an AS q, a.an AS na, b.an AS nb FROM pc a JOIN pc b ON a.site = b.site AND a.pop < b.pop WHERE a.an > 1 AND b.an > 1),
        s AS (SELECT a, b, count(*) AS sites, sum(p * (1 - q) + q * (1 - p)) AS dxy, count(*) FILTER ((p = 0 AND q = 1) OR (p = 1 AND q = 0)) AS fixed, sum((p - q) * (p - q) - p * (1 - p) / (na - 1) - q * (1 - q) / (nb - 1)) AS num FROM p GROUP BY 1, 2)
        SELECT a, b, sites, round(dxy, 6) AS dxy, fixed, CASE WHEN dxy > 0 THEN round(num / dxy, 6) END AS fst FROM s""",
    "popgen_joint_sfs": """, k AS (SELECT site, pop, ac FROM pc JOIN (SELECT pop, max(an) AS most FROM pc GROUP BY 1) USING (pop) WHERE an = most)
        SELECT a.pop AS a, b.pop AS b, a.ac AS count_a, b.ac AS count_b, count(*) AS sites FROM k a JOIN k b ON a.site = b.site AND a.pop < b.pop GROUP BY 1, 2, 3, 4""",
    "popgen_sfs_unfolded": "SELECT pop, ac AS count, count(*) AS sites FROM pc JOIN (SELECT pop, max(an) AS most FROM pc GROUP BY 1) USING (pop) WHERE an = most GROUP BY 1, 2",
    "vcf_setgt": "SELECT site, sum(CASE WHEN alts IS NULL OR sample % 7 = 0 THEN 0 ELSE alts END)::BIGINT AS ac, count(*) AS ns FROM g GROUP BY 1",
    "popgen_sfs": "SELECT pop, least(ac, an - ac) AS count, count(*) AS sites FROM pc JOIN (SELECT pop, max(an) AS most FROM pc GROUP BY 1) USING (pop) WHERE an = most GROUP BY 1, 2",
    "ecology_alpha": """, n AS (SELECT *, x / sum(x) OVER (PARTITION BY sample) AS p, sum(x) OVER (PARTITION BY sample) AS n FROM c),
        s AS (SELECT sample, count(*) AS o, max(n) AS n, sum(-p * log2(p)) AS h, sum(p * p) AS d, count(*) FILTER (x = 1) AS f1, count(*) FILTER (x = 2) AS f2 FROM n GROUP BY 1)
        SELECT sample, o AS observed, round(h, 6) AS shannon, round(1 - d, 6) AS simpson, round(d, 6) AS dominance, CASE WHEN o > 1 THEN round(h / log2(o), 6) END AS pielou_e, round(o + f1 * (f1 - 1) / (2 * (f2 + 1)), 6) AS chao1, round(1 - f1 / n, 6) AS goods FROM s""",
    "ecology_beta": """, f AS (SELECT DISTINCT feature FROM c), s AS (SELECT DISTINCT sample FROM c), d AS (SELECT feature, sample, coalesce(x, 0) AS x FROM f CROSS JOIN s LEFT JOIN c USING (feature, sample))
        SELECT a.sample AS a, b.sample AS b, round(sum(abs(a.x - b.x)) / sum(a.x + b.x), 6) AS braycurtis, round(1 - count(*) FILTER (a.x > 0 AND b.x > 0) / count(*) FILTER (a.x > 0 OR b.x > 0), 6) AS jaccard,
               round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS euclidean, sum(abs(a.x - b.x))::BIGINT AS cityblock FROM d a JOIN d b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2""",
    "composition_alr": "SELECT c.feature, sample, round(ln(c.x / r.x), 6) AS x FROM c JOIN (SELECT sample, x FROM c WHERE feature = 'Brand#11') r USING (sample) WHERE feature <> 'Brand#11'",
    "composition_rclr": "SELECT feature, sample, round(ln(x - 3) - avg(ln(x - 3)) OVER (PARTITION BY sample), 6) AS x FROM c WHERE x > 3",
    "composition_perturb": "SELECT feature, sample, round(x * y / sum(x * y) OVER (PARTITION BY sample), 6) AS x FROM c JOIN (SELECT feature, max(x) AS y FROM c GROUP BY 1) USING (feature)",
    "composition_power": "SELECT feature, sample, round(sqrt(x) / sum(sqrt(x)) OVER (PARTITION BY sample), 6) AS x FROM c",
    "ecology_evenness": "SELECT sample, round(sum(x) ** 2 / sum(x * x), 6) AS inv_simpson, round(sum(x) ** 2 / sum(x * x) / count(*), 6) AS simpson_e, round(max(x) / sum(x), 6) AS berger_parker FROM c GROUP BY 1",
    "ecology_canberra": """, s AS (SELECT DISTINCT sample FROM c), f AS (SELECT DISTINCT feature FROM c), w AS (SELECT sample, feature, coalesce(x, 0) AS x FROM s CROSS JOIN f LEFT JOIN c USING (sample, feature))
        SELECT p.sample AS a, q.sample AS b, round(sum(CASE WHEN p.x + q.x > 0 THEN abs(p.x - q.x) / (p.x + q.x) ELSE 0 END), 6) AS canberra FROM w p JOIN w q USING (feature) WHERE p.sample < q.sample GROUP BY 1, 2""",
    "composition_clr": "SELECT feature, sample, round(ln(x) - avg(ln(x)) OVER (PARTITION BY sample), 6) AS x FROM c",
    "composition_replace": """, y AS (SELECT feature, sample, greatest(0, x - 5) AS x FROM c), z AS (SELECT *, x / sum(x) OVER (PARTITION BY sample) AS p, count(*) FILTER (x = 0) OVER (PARTITION BY sample) AS z FROM y)
        SELECT feature, sample, round(CASE WHEN p = 0 THEN 0.001 ELSE p * (1 - z * 0.001) END, 9) AS x FROM z""",
    "composition_vlr": "SELECT a.feature AS a, b.feature AS b, round(var_samp(ln(a.x) - ln(b.x)), 6) AS vlr FROM c a JOIN c b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2",
    "composition_anova": "SELECT feature, round(f, 6) AS f FROM fs",
    "count_normalize": """, l AS (SELECT p_brand AS feature, sum(p_size) + 1 AS len FROM part GROUP BY 1)
        SELECT feature, sample, round(x * 1e6 / sum(x) OVER w, 4) AS cpm, round(x / len * 1e9 / sum(x) OVER w, 4) AS fpkm, round(x / len * 1e6 / sum(x / len) OVER w, 4) AS tpm FROM c JOIN l USING (feature) WINDOW w AS (PARTITION BY sample)""",
    "deseq_size_factors": ", g2 AS (SELECT feature, avg(ln(x)) AS m FROM c GROUP BY 1 HAVING count(*) = 25) SELECT sample, round(exp(quantile_cont(ln(x) - m, 0.5)), 6) AS size_factor FROM c JOIN g2 USING (feature) GROUP BY 1",
    "limma_fit": """, s AS (SELECT feature, count(*) AS n, avg(t) AS mt, avg(x) AS mx, var_pop(t) AS vt, covar_pop(t, x) AS cv, var_pop(x) AS vx FROM m GROUP BY 1),
        f AS (SELECT feature, n, vt, cv / vt AS b, mx - cv / vt * mt AS a, (vx - cv / vt * cv) * n / (n - 2) AS s2 FROM s WHERE vt > 0 AND n > 2)
        SELECT feature, round(b, 6) AS slope, round(a, 6) AS intercept, round(s2, 6) AS s2, CASE WHEN s2 > 0 THEN round(b / sqrt(s2 / (n * vt)), 6) END AS t_stat FROM f""",
    "adjust_p": """, p AS (SELECT feature, round(1 / (1 + f), 9) AS p FROM fs), r AS (SELECT *, count(p) OVER () AS n, row_number() OVER (ORDER BY p, feature) AS r FROM p)
        SELECT feature, p, round(min(least(1.0, p * n / r)) OVER (ORDER BY r DESC), 8) AS bh, round(max(least(1.0, p * (n - r + 1))) OVER (ORDER BY r), 8) AS holm FROM r""",
    "sc_neighbors": """, u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)
        SELECT q, id, cosine, rank::INT AS rank FROM (SELECT a.id AS q, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS rank
        FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE a.id % 20 = 0) WHERE rank <= 5""",
}
ORACLE_SQL = {k: f"WITH {_V} {v}" for k, v in _BODY.items()}
