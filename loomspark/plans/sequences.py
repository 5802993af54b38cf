"""Queries of the sequence family, over sequences that Spark derives from documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import dna
from loomspark.operators import sequences as S
from loomspark.session import read_table, spread

#: Letters of texts stand for bases; everything else is left out.
FROM, TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
K, SCALED = 21, 50


def seqs(spark, sf_dir):
    letters = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), FROM, TO)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select(F.col("doc_id").alias("id"), "lang", letters.alias("seq"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("ord"))


def queries_of(spark, sf_dir):
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), FROM, TO)
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), letters.alias("seq"))


def reads(spark, sf_dir):
    """Benchmark texts as reads with a quality for each base."""
    return queries_of(spark, sf_dir).select("id", "seq", F.translate("seq", "ACGT", "I?5+").alias("qual")).where("seq <> ''")


def long_reads(spark, sf_dir):
    """Documents as reads with a quality for each base."""
    return seqs(spark, sf_dir).select("id", "seq", F.translate("seq", "ACGT", "I?5+").alias("qual"))


def _s(f):
    return lambda spark, sf_dir: f(seqs(spark, sf_dir))


def seq_compare(spark, sf_dir):
    return S.compare_sketches(S.sketch(queries_of(spark, sf_dir), K, 4), S.sketch(seqs(spark, sf_dir), K, 4), K)


def seq_distance(spark, sf_dir):
    """Every sequence whose id is divisible by 20 against all others."""
    q = queries_of(spark, sf_dir)
    return S.pairwise_distance(q.where("id % 20 = 0"), q)


QUERIES = {
    "seq_stats": _s(lambda s: S.stats(s, "lang")),
    "seq_kmers": _s(lambda s: S.kmer_counts(s, 6)),
    "seq_kmers_one_strand": _s(lambda s: S.kmer_counts(s, 4, False)),
    "seq_grep": _s(lambda s: S.grep(s, "ACGTTGCA").select("id", "plus", "minus")),
    "seq_revcomp": _s(lambda s: s.select("id", F.md5(dna.reverse_complement(F.col("seq"))).alias("md5"))),
    "seq_subseq": _s(lambda s: s.select("id", dna.subsequence(F.col("seq"), 11, -11).alias("part"), dna.subsequence(F.col("seq"), -20, -1).alias("tail")).select("id", F.length("part").alias("n"), "tail")),
    "seq_translate": lambda s, d: queries_of(s, d).select("id", dna.translate(F.col("seq"), 2).alias("frame2")),
    "seq_gc_windows": _s(lambda s: S.gc_windows(s, 500)),
    "seq_dereplicate": _s(lambda s: S.dereplicate(s).select(F.md5("seq").alias("md5"), "size", "label")),
    "seq_rereplicate": _s(lambda s: S.rereplicate(S.dereplicate(s)).select("label", "copy")),
    "seq_sketch": _s(lambda s: S.sketch(s, K, SCALED)),
    "seq_sketch_compare": seq_compare,
    "seq_dict": _s(lambda s: s.select("id", F.length("seq").alias("length"), F.md5(F.upper("seq")).alias("md5"))),
    "fastq_trim": lambda s, d: S.trim_tail(reads(s, d), 4, 20.0).select("id", F.length("seq").alias("n"), F.md5("qual").alias("md5")),
    "fastq_judge": lambda s, d: S.judged(long_reads(s, d), 60, 0, 25.6, 11, 0.27, 0.7).select("id", "verdict"),
    "fastq_poly": lambda s, d: S.trim_poly(S.trim_poly(long_reads(s, d), "G", 2), "A", 2).select("id", F.length("seq").alias("n"), F.length("qual").alias("n_qual")),
    "fastq_cycles": lambda s, d: S.cycle_quality(reads(s, d)),
    "phylo_distance": seq_distance,
}

_TR = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{FROM}', '{TO}')"
_V = f"s AS (SELECT doc_id AS id, lang, {_TR} AS seq, 's' || doc_id AS label, doc_id AS ord FROM documents), q AS (SELECT item_id AS id, {_TR} AS seq FROM benchmark), r AS (SELECT id, seq, translate(seq, 'ACGT', 'I?5+') AS qual FROM q WHERE seq <> '')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _kmers(table: str, k: int) -> str:
    return f"(SELECT id, substr(seq, i::INT, {k}) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {table}))"


def _sketch(table: str, scaled: int) -> str:
    return f"(SELECT id, ('0x' || md5(least(kmer, {_RC.format('kmer')}))[1:15])::BIGINT AS hash, count(*) AS abundance FROM {_kmers(table, K)} GROUP BY 1, 2 HAVING hash < {(1 << 60) // scaled})"


_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_BODY = {
    "seq_stats": """, l AS (SELECT lang, length(seq) AS len, count(*) AS n FROM s GROUP BY ALL), u AS (SELECT *, sum(len * n) OVER (PARTITION BY lang) / 2 AS half, sum(len * n) OVER (PARTITION BY lang ORDER BY len DESC) AS upto FROM l)
        SELECT lang, sum(n)::BIGINT AS num_seqs, sum(len * n)::BIGINT AS sum_len, min(len)::INT AS min_len, round(sum(len * n) / sum(n), 4) AS avg_len, max(len)::INT AS max_len, (max(len) FILTER (upto >= half))::INT AS n50 FROM u GROUP BY 1""",
    "seq_kmers": f"SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS n FROM {_kmers('s', 6)} GROUP BY 1",
    "seq_kmers_one_strand": f"SELECT kmer, count(*) AS n FROM {_kmers('s', 4)} GROUP BY 1",
    "seq_grep": "SELECT id, contains(seq, 'ACGTTGCA') AS plus, contains(seq, 'TGCAACGT') AS minus FROM s WHERE contains(seq, 'ACGTTGCA') OR contains(seq, 'TGCAACGT')",
    "seq_revcomp": f"SELECT id, md5({_RC.format('seq')}) AS md5 FROM s",
    "seq_subseq": "SELECT id, greatest(length(seq) - 20, 0)::INT AS n, substr(seq, greatest(length(seq) - 19, 1)::INT) AS tail FROM s",
    "seq_translate": f"""SELECT id, coalesce(string_agg('{_CODE}'[(strpos('TCAG', substr(seq, i::INT, 1)) - 1) * 16 + (strpos('TCAG', substr(seq, (i + 1)::INT, 1)) - 1) * 4 + strpos('TCAG', substr(seq, (i + 2)::INT, 1))], '' ORDER BY i), '') AS frame2
        FROM (SELECT id, seq, unnest(range(2, length(seq) - 1, 3)) AS i FROM q) GROUP BY id UNION ALL SELECT id, '' FROM q WHERE length(seq) < 4""",
    "seq_gc_windows": """SELECT id, w::INT AS "window", (g + c)::INT AS gc, CASE WHEN g + c > 0 THEN round((g - c) / (g + c), 6) END AS skew FROM (SELECT id, w, length(p) - length(replace(p, 'G', '')) AS g, length(p) - length(replace(p, 'C', '')) AS c
        FROM (SELECT id, w, substr(seq, (w * 500 + 1)::INT, 500) AS p FROM (SELECT id, seq, unnest(range(0, (greatest(length(seq), 1) - 1) // 500 + 1)) AS w FROM s)))""",
    "seq_dereplicate": "SELECT md5(seq) AS md5, count(*) AS size, arg_min(label, ord) AS label FROM s GROUP BY seq",
    "seq_rereplicate": "SELECT label, unnest(range(1, size + 1)) AS copy FROM (SELECT count(*) AS size, arg_min(label, ord) AS label FROM s GROUP BY seq)",
    "seq_sketch": f"SELECT id, hash, abundance FROM {_sketch('s', SCALED)}",
    "seq_sketch_compare": f""", x AS {_sketch('q', 4)}, y AS {_sketch('s', 4)}, nx AS (SELECT id, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT id, count(*) AS n FROM y GROUP BY 1),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM x JOIN y USING (hash) GROUP BY 1, 2)
        SELECT a, b, common, round(common / (nx.n + ny.n - common), 6) AS jaccard, round(common / nx.n, 6) AS a_in_b, round(common / ny.n, 6) AS b_in_a, round(pow(common / nx.n, 1.0 / {K}), 6) AS ani
        FROM c JOIN nx ON nx.id = a JOIN ny ON ny.id = b""",
    "seq_dict": "SELECT id, length(seq)::INT AS length, md5(seq) AS md5 FROM s",
    "fastq_trim": """, b AS (SELECT id, list_transform(range(1, length(qual) + 1), lambda i: ascii(substr(qual, i::INT, 1)) - 33) AS qs, seq, qual FROM r),
        w AS (SELECT id, seq, qual, list_filter(range(1, greatest(length(qual) - 3, 1) + 1), lambda i: list_sum(qs[i:i + 3]) < 80) AS bad FROM b)
        SELECT id, coalesce(bad[1] - 1, length(seq))::INT AS n, md5(substr(qual, 1, coalesce(bad[1] - 1, length(seq))::INT)) AS md5 FROM w""",
    "fastq_judge": """, n AS (SELECT id, length(seq) AS n, length(replace(seq, 'A', '')) AS a, length(replace(seq, 'C', '')) AS c, length(replace(seq, 'G', '')) AS g, length(replace(seq, 'T', '')) AS t,
        length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) AS runs FROM s)
        SELECT id, CASE WHEN n < 60 THEN 'length' WHEN n - t > n * 0.27::DOUBLE OR (n - a) * 40 + (n - c) * 30 + (n - g) * 20 + (n - t) * 10 < n * 25.6::DOUBLE THEN 'quality'
            WHEN (runs - 1) / (n - 1) < 0.7::DOUBLE THEN 'complexity' ELSE 'pass' END AS verdict FROM n""",
    "fastq_poly": "SELECT id, length(regexp_replace(regexp_replace(seq, 'G{2,}$', ''), 'A{2,}$', ''))::INT AS n, length(regexp_replace(regexp_replace(seq, 'G{2,}$', ''), 'A{2,}$', ''))::INT AS n_qual FROM s",
    "fastq_cycles": """, c AS (SELECT i::INT AS cycle, substr(seq, i::INT, 1) AS base, ascii(substr(qual, i::INT, 1)) - 33 AS x FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM r))
        SELECT cycle, count(*) AS n, round(avg(x), 6) AS mean_q, round(count(*) FILTER (base = 'A') / count(*), 6) AS A, round(count(*) FILTER (base = 'C') / count(*), 6) AS C,
               round(count(*) FILTER (base = 'G') / count(*), 6) AS G, round(count(*) FILTER (base = 'T') / count(*), 6) AS T FROM c GROUP BY 1""",
    "phylo_distance": """, p AS (SELECT a.id AS a, b.id AS b, least(length(a.seq), length(b.seq)) AS sites,
        len(list_filter(range(1, least(length(a.seq), length(b.seq)) + 1), lambda i: substr(a.seq, i::INT, 1) <> substr(b.seq, i::INT, 1))) AS d FROM q a JOIN q b ON a.id % 20 = 0 AND a.id <> b.id)
        SELECT a, b, sites::INT AS sites, d::INT AS differences, CASE WHEN sites > 0 AND d / sites < 0.75 THEN round(-0.75 * ln(1 - d / sites * 4 / 3), 6) END AS jc69 FROM p""",
}
ORACLE_SQL = {k: f"WITH {_V} {v}" for k, v in _BODY.items()}
