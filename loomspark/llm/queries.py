"""The registered queries of the operators, each over its whole table, with the SQL that can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm.common import text_or_empty
from loomspark.llm.bpe import encode_table
from loomspark.llm.chat import format_chats
from loomspark.llm.embedding_dedup import near_vectors
from loomspark.llm.exact_dedup import exact_groups
from loomspark.llm.hard_negatives import hard_negatives
from loomspark.llm.mixing import Mixture
from loomspark.llm.ordered_packing import pack_in_order
from loomspark.llm.packing import pack
from loomspark.llm.prefix_trie import prefix_trie
from loomspark.llm.sharding import assign_shards
from loomspark.llm.simhash import near_groups
from loomspark.llm.toxicity import grade_documents
from loomspark.llm.url_filter import host_of, judge_urls, path_of
from loomspark.session import read_table


def op7_pack_tokens(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_mix_sources(spark, sf_dir):
    mixture = Mixture(read_table(spark, sf_dir, "documents"))
    rows, sources = mixture.sized(), mixture.sources.select("source", "source_size", "target")
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))


def tokenizer_path() -> str:
    """The file of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_shard(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = assign_shards(rows, "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_bpe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    both = encode_table(docs.select("doc_id", "text"), tokenizer_path(), decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_embedding_dedup(spark, sf_dir):
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    graded = grade_documents(docs.select("doc_id", "text"), labels)
    return graded.select("row.doc_id", F.round("severity", 9).alias("severity"), F.round("p_toxic", 9).alias("p_toxic"), "grade", "rejected")


#: Pages whose html holds this mark are listed, by their canonical URL, as URLs to block.
LISTED_MARK = "casino"


def op5_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.where(F.contains(F.lower("html"), F.lit(LISTED_MARK))).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return judge_urls(pages.select("page_id", "url"), listed=listed).select("page.page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat_format(spark, sf_dir):
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op10_simhash(spark, sf_dir):
    return near_groups(read_table(spark, sf_dir, "documents"))


def op11_pack_in_order(spark, sf_dir):
    pieces = pack_in_order(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Heads of rebuilt conversations have less than so many turns.
HEADS = 9


def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    return prefix_trie(read_table(spark, sf_dir, "conversations"), base=conv - conv % 5, head=F.crc32(conv.cast("string")) % HEADS)


def op13_hard_negatives(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


QUERIES = {
    "op1_shard": op1_shard,
    "op2_bpe": op2_bpe,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pack_tokens": op7_pack_tokens,
    "op8_mix_sources": op8_mix_sources,
    "op9_chat_format": op9_chat_format,
    "op10_simhash": op10_simhash,
    "op11_pack_in_order": op11_pack_in_order,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op5_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS h, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
        q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
        r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
                 FROM q JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
        listed AS (SELECT DISTINCT q.host, q.path FROM q JOIN pages p ON p.page_id = q.page_id WHERE contains(lower(p.html), 'casino') AND q.host <> '')
        SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.v, CASE WHEN l.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM q LEFT JOIN fits f ON f.page_id = q.page_id AND f.k = 1 LEFT JOIN listed l ON l.host = q.host AND l.path = q.path""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
        g AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g""",
    "op9_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS ts FROM t GROUP BY conv_id),
        u AS (SELECT min(conv_id) AS conv_id, n_turns, ts, count(*) AS n_copies FROM c GROUP BY n_turns, ts),
        pre AS (SELECT DISTINCT k AS n_turns, ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, n_turns)) AS k FROM c))
        SELECT u.conv_id, u.n_turns, u.n_copies,
               list_aggregate(list_transform(u.ts, lambda x: '<|im_start|>' || replace(replace(x.r, '<|', '< |'), '|>', '| >') || chr(10) || replace(replace(x.t, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
        FROM u WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.n_turns = u.n_turns AND pre.ts = u.ts)""",
    "op12_prefix_trie": r"""
        WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS of_byte),
        t AS (SELECT conv_id, conv_id::VARCHAR AS s, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
                                                              lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1]))) % 9 AS h FROM t, crc),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 5),
        m AS (SELECT conv_id, len(ts) AS n, ts, unnest(range(0, len(ts) + 1)) AS depth FROM r),
        nodes AS (SELECT depth, ts[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (depth = n) AS n_ends,
                         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '') AS ids FROM m GROUP BY ALL),
        kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        up AS (SELECT p, (n_convs = n_ends)::BIGINT AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[depth].t) END AS saved, unnest(range(0, depth + 1)) AS d FROM nodes),
        sums AS (SELECT p[1:d] AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1)
        SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ids) AS ends_sha256
        FROM nodes n JOIN sums s ON s.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN nodes q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]""",
    "op13_hard_negatives": r"""
        WITH v AS (SELECT DISTINCT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS "rank", n.id AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY "rank" <= 5""",
}
