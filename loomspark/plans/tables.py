"""Queries of the table family over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.cells import arithmetic, as_number, compared, is_in
from loomspark.operators import table as T
from loomspark.session import read_table


def table_groupby_lineitem(spark, sf_dir):
    """Grouped aggregation with composite keys."""
    li = read_table(spark, sf_dir, "lineitem")
    specs = [("l_quantity", "sum", "sum_qty"), ("l_extendedprice", "mean", "mean_price"), ("l_quantity", "count", "n")]
    out = T.group_by(li, ["l_returnflag", "l_linestatus"], specs)
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "mean_price": F.round("mean_price", 4)}).orderBy("l_returnflag", "l_linestatus")


def table_select(spark, sf_dir):
    """Selectors: a range, a name, a pattern and an exclusion."""
    return T.select(read_table(spark, sf_dir, "orders"), "1-2", "*priority", "-o_orderdate")


def table_filter(spark, sf_dir):
    """Typed comparison of text cells: `9` is less than `10`, a number never less than a string."""
    parts = read_table(spark, sf_dir, "part").withColumns({"cell": F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))})
    cell = F.col("cell")
    keep = compared(cell, "<", F.lit("10")) | (compared(cell, ">=", F.lit("Brand#3")) & F.col("p_name").rlike("^[a-m]"))
    return parts.where(keep).select("p_partkey", "cell", F.octet_length("p_name").alias("len"), F.char_length("p_name").alias("ulen"))


def table_sort(spark, sf_dir):
    """The place of every row in a numeric sort with ties by order."""
    parts = read_table(spark, sf_dir, "part").withColumn("cell", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise((F.col("p_retailprice") % 50).cast("int").cast("string")))
    return T.numbered(parts.select("p_partkey", "cell", "p_brand"), T.sort_keys([("cell", "number", True), ("p_brand", "nocase", False)], "p_partkey"))


def table_natural_sort(spark, sf_dir):
    """The place of every label in natural order."""
    labels = read_table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_size").cast("string"), F.lit("x"), (F.col("p_partkey") % 12).cast("string")).alias("label")).distinct()
    return T.numbered(labels, T.sort_keys([("label", "natural", False)], "label"))


def table_join_inner(spark, sf_dir):
    orders, cust = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    right = cust.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return T.join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), right, ["o_custkey"])


def table_join_left(spark, sf_dir):
    cust, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    big = orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return T.join(cust.select("c_custkey", "c_name"), big, ["c_custkey"], "left").withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


def table_join_full(spark, sf_dir):
    """A right-only row's key stands in the left's key column."""
    part, li = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    cheap = part.where("p_size < 20").select(F.col("p_partkey").alias("k"), "p_brand")
    sold = li.where("l_discount > 0.05").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return T.join(cheap, sold, ["k"], "full")


NUMERIC = ["count", "sum", "min", "max", "mean", "absmin", "absmax", "range", "harmmean", "pvar", "svar", "pstdev", "sstdev", "sskew", "median", "q1", "q3", "iqr", "rms"]


def table_reducers(spark, sf_dir):
    """The numeric reducers in one aggregation."""
    cust = read_table(spark, sf_dir, "customer")
    out = T.group_by(cust, ["c_mktsegment"], [("c_acctbal", op, op) for op in NUMERIC])
    return out.select("c_mktsegment", F.col("count").cast("long").alias("count"), *[F.round(op, 4).alias(op) for op in NUMERIC[1:]])


def table_text_reducers(spark, sf_dir):
    """first, last, collapse, unique, countunique and perc."""
    nation = read_table(spark, sf_dir, "nation").withColumn("letter", F.substring("n_name", 1, 1))
    specs = [("n_name", "first", "first"), ("n_name", "last", "last"), ("n_nationkey", "collapse", "keys"), ("letter", "unique", "letters"), ("letter", "countunique", "n_letters"), ("n_nationkey", "perc:90", "p90")]
    return T.group_by(nation, ["n_regionkey"], specs, "n_nationkey").withColumn("p90", F.round("p90", 6))


def table_mad(spark, sf_dir):
    return T.median_deviation(read_table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").withColumn("mad", F.round("mad", 4))


def table_consecutive(spark, sf_dir):
    """Runs of orders of the same status, in key order."""
    orders = read_table(spark, sf_dir, "orders")
    out = T.group_runs(orders, ["o_orderstatus"], "o_orderkey", [("o_orderkey", "count", "n"), ("o_orderkey", "min", "first_key"), ("o_orderkey", "max", "last_key")], chunk_rows=5000)
    return out.select("run", "o_orderstatus", "n", "first_key", "last_key")


STATUSES = ["F", "O", "P"]


def table_crosstab(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return T.crosstab(orders, "o_orderpriority", "o_orderstatus", STATUSES, F.count(F.lit(1)))


def table_concat(spark, sf_dir):
    cust, supp = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    return T.concat(cust.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), supp.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


def table_grep(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)license|password")).select("doc_id", "lang")


def table_intersect(spark, sf_dir):
    cust, supp = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    return cust.select(F.col("c_nationkey").alias("nation")).intersect(supp.select(F.col("s_nationkey").alias("nation")))


def table_uniq(spark, sf_dir):
    """The first order of each customer."""
    return T.uniq(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderkey")


def table_uniq_three(spark, sf_dir):
    return T.uniq(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", 3)


def table_freq(spark, sf_dir):
    return T.freq(read_table(spark, sf_dir, "events"), "event_type")


def table_sample(spark, sf_dir):
    return T.sample(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 0.1, 7, "o_orderkey")


def table_shuffle(spark, sf_dir):
    """The place of every row in a seeded random order."""
    return T.numbered(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [T.hash_order(3, "o_orderkey"), F.col("o_orderkey")])


def table_head(spark, sf_dir):
    return T.head(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 25, "o_orderkey")


def table_sample_rows(spark, sf_dir):
    return T.sample_rows(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 50, 11, "o_orderkey")


def table_reverse(spark, sf_dir):
    """The places of all rows from the last to the first."""
    return T.numbered(T.reverse(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), [F.col("o_orderkey").desc()])


def table_validate(spark, sf_dir):
    return T.validate(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_linestatus", "l_quantity"])


def table_filter_in(spark, sf_dir):
    """Membership by typed equality, and arithmetic of cells."""
    parts = read_table(spark, sf_dir, "part").withColumn("cell", F.col("p_size").cast("string"))
    half = arithmetic(arithmetic(F.col("cell"), "*", F.lit("3")), "%", F.lit("7"))
    return parts.where(is_in(F.col("cell"), [F.lit("7"), F.lit("1e1"), F.lit("x")]) | (half > 5)).select("p_partkey", "cell", half.alias("rest"))


def table_modes(spark, sf_dir):
    return T.modes(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def table_frequencies(spark, sf_dir):
    return T.by_frequency(read_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")


def table_frequencies_ascending(spark, sf_dir):
    return T.by_frequency(read_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", True)


def table_distinct_numbers(spark, sf_dir):
    return T.distinct_numbers(read_table(spark, sf_dir, "part"), ["p_brand"], "p_size", True)


def table_moments(spark, sf_dir):
    """Higher moments and means of all lines of a ship mode."""
    ops = ("geomean", "pskew", "pkurt", "skurt", "jarque", "ms")
    out = T.group_by(read_table(spark, sf_dir, "lineitem"), ["l_linestatus"], [("l_quantity", op, op) for op in ops])
    return out.select("l_linestatus", *[F.round(op, 4).alias(op) for op in ops])


def table_gather(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return T.gather(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


def table_spread(spark, sf_dir):
    sums = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return T.spread(sums, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"])


def table_fold(spark, sf_dir):
    return T.fold(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_partkey", "l_linenumber")


def table_unfold(spark, sf_dir):
    return T.unfold(table_fold(spark, sf_dir), "l_partkey")


def table_expand(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supp"))
    folded = T.fold(li, ["l_orderkey"], "part", "l_linenumber").join(T.fold(li, ["l_orderkey"], "supp", "l_linenumber"), "l_orderkey")
    return T.expand(folded, ["part", "supp"])


def table_separate(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return T.separate(part, "p_type", ["one", "two"], " ").select("p_partkey", "one", "two")


def table_mutate(spark, sf_dir):
    """Combine, replace, round and format dates."""
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat_ws("-", "o_orderstatus", F.regexp_replace("o_orderpriority", "[0-9]", "")).alias("tag"), F.round("o_totalprice", 1).alias("price"), F.date_format("o_orderdate", "yyyy/MM").alias("month"))


def table_transpose(spark, sf_dir):
    """Status counts by priority, turned: a row for each status."""
    counts = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", PRIORITIES).count()
    long = T.gather(counts, ["o_orderstatus"], PRIORITIES, "priority", "n")
    return T.spread(long, ["priority"], "o_orderstatus", "n", STATUSES)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table_correlate(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"),
        F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("pcov"),
        F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("scov"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 2).alias("dotprod"),
    )


def table_inspect(spark, sf_dir):
    """Rows, distinct values, nulls and numeric cells of columns of text."""
    o = read_table(spark, sf_dir, "orders")
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("cell")) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cell").alias("distinct"), F.count_if(F.col("cell").isNull()).alias("nulls"), F.count(as_number(F.col("cell"))).alias("numbers"))


def table_to_json(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("record"))


def table_semi_anti(spark, sf_dir):
    """Customers with and without orders, by semi- and anti-join."""
    cust, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    on = cust["c_custkey"] == orders["o_custkey"]
    with_, without = cust.join(orders, on, "left_semi"), cust.join(orders, on, "left_anti")
    count = lambda df, name: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("has_orders", F.lit(name))
    return count(with_, True).unionByName(count(without, False))


QUERIES = {f.__name__: f for f in (
    table_head, table_sample_rows, table_reverse, table_validate, table_filter_in, table_modes, table_frequencies, table_frequencies_ascending,
    table_distinct_numbers, table_moments,
    table_groupby_lineitem, table_select, table_filter, table_sort, table_natural_sort, table_join_inner, table_join_left,
    table_join_full, table_reducers, table_text_reducers, table_mad, table_consecutive, table_crosstab, table_concat,
    table_grep, table_intersect, table_uniq, table_uniq_three, table_freq, table_sample, table_shuffle, table_gather,
    table_spread, table_fold, table_unfold, table_expand, table_separate, table_mutate, table_transpose,
    table_correlate, table_inspect, table_to_json, table_semi_anti,
)}

_FOLD = "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey::VARCHAR) AS l_partkey FROM lineitem GROUP BY 1"

ORACLE_SQL = {
    "table_groupby_lineitem": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
               round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n
        FROM lineitem GROUP BY ALL ORDER BY ALL""",
    "table_select": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "table_filter": """
        WITH c AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS cell FROM part)
        SELECT p_partkey, cell, strlen(p_name)::INT AS len, length(p_name)::INT AS ulen FROM c
        WHERE (p_size % 3 <> 0 AND p_size < 10) OR (p_size % 3 = 0 AND cell >= 'Brand#3' AND regexp_matches(p_name, '^[a-m]'))""",
    "table_sort": """
        WITH c AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE trunc(p_retailprice % 50)::INT::VARCHAR END AS cell FROM part)
        SELECT p_partkey, cell, p_brand, row_number() OVER (ORDER BY try_cast(cell AS DOUBLE) DESC NULLS LAST, lower(p_brand), p_partkey) - 1 AS place FROM c""",
    "table_natural_sort": """
        WITH l AS (SELECT DISTINCT p_size AS a, p_partkey % 12 AS b FROM part)
        SELECT 'b' || a || 'x' || b AS label, row_number() OVER (ORDER BY a, b) - 1 AS place FROM l""",
    "table_join_inner": "SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "table_join_left": "SELECT c_custkey, c_name, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000",
    "table_join_full": """
        WITH a AS (SELECT p_partkey AS k, p_brand FROM part WHERE p_size < 20),
        b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
        SELECT k, p_brand, n FROM a FULL JOIN b USING (k)""",
    "table_reducers": """
        SELECT c_mktsegment, count(c_acctbal) AS count, round(sum(c_acctbal), 4) AS sum, round(min(c_acctbal), 4) AS min,
               round(max(c_acctbal), 4) AS max, round(avg(c_acctbal), 4) AS mean, round(min(abs(c_acctbal)), 4) AS absmin,
               round(max(abs(c_acctbal)), 4) AS absmax, round(max(c_acctbal) - min(c_acctbal), 4) AS range,
               round(count(c_acctbal) / sum(1 / c_acctbal), 4) AS harmmean, round(var_pop(c_acctbal), 4) AS pvar,
               round(var_samp(c_acctbal), 4) AS svar, round(stddev_pop(c_acctbal), 4) AS pstdev,
               round(stddev_samp(c_acctbal), 4) AS sstdev, round(skewness(c_acctbal), 4) AS sskew,
               round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.25), 4) AS q1,
               round(quantile_cont(c_acctbal, 0.75), 4) AS q3,
               round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 4) AS iqr,
               round(sqrt(avg(c_acctbal * c_acctbal)), 4) AS rms
        FROM customer GROUP BY 1""",
    "table_text_reducers": """
        SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first, arg_max(n_name, n_nationkey) AS last,
               string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys,
               list_aggregate(list_sort(list_distinct(list(n_name[1:1]))), 'string_agg', ',') AS letters,
               count(DISTINCT n_name[1:1]) AS n_letters, round(quantile_cont(n_nationkey, 0.9), 6) AS p90
        FROM nation GROUP BY 1""",
    "table_mad": """
        WITH m AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS mid FROM part GROUP BY 1)
        SELECT p_brand, round(quantile_cont(abs(p_retailprice - mid), 0.5), 4) AS mad FROM part JOIN m USING (p_brand) GROUP BY 1""",
    "table_consecutive": """
        WITH c AS (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (ORDER BY o_orderkey) THEN 0 ELSE 1 END AS c FROM orders),
        r AS (SELECT *, sum(c) OVER (ORDER BY o_orderkey) - 1 AS run FROM c)
        SELECT run::BIGINT AS run, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM r GROUP BY 1, 2""",
    "table_crosstab": """
        SELECT o_orderpriority, coalesce(nullif(count(*) FILTER (o_orderstatus = 'F'), 0)::VARCHAR, 'N/A') AS F,
               coalesce(nullif(count(*) FILTER (o_orderstatus = 'O'), 0)::VARCHAR, 'N/A') AS O,
               coalesce(nullif(count(*) FILTER (o_orderstatus = 'P'), 0)::VARCHAR, 'N/A') AS P FROM orders GROUP BY 1""",
    "table_concat": "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
    "table_grep": "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)license|password')",
    "table_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "table_uniq": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "table_uniq_three": "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
    "table_freq": "SELECT event_type, count(*) AS frequency FROM events GROUP BY 1",
    "table_sample": "SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || md5('7|' || o_orderkey)[1:8])::BIGINT < 429496729",
    "table_shuffle": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('3|' || o_orderkey), o_orderkey) - 1 AS place FROM orders",
    "table_head": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "table_sample_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('11|' || o_orderkey), o_orderkey LIMIT 50",
    "table_reverse": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders",
    "table_validate": """
        SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_repeated, sum(k)::BIGINT AS n_lacking
        FROM (SELECT count(*) AS n, count(*) FILTER (l_linestatus IS NULL OR l_linestatus = '' OR l_quantity IS NULL) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "table_filter_in": "SELECT p_partkey, p_size::VARCHAR AS cell, (p_size * 3 % 7)::DOUBLE AS rest FROM part WHERE p_size IN (7, 10) OR p_size * 3 % 7 > 5",
    "table_modes": """
        SELECT l_returnflag, l_linestatus, arg_min(l_quantity, (-n, l_quantity)) AS mode, arg_min(l_quantity, (n, l_quantity)) AS antimode
        FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL) GROUP BY 1, 2""",
    "table_frequencies": "SELECT o_orderstatus, string_agg(v || ':' || n, ',' ORDER BY n DESC, v) AS frequencies FROM (SELECT o_orderstatus, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "table_frequencies_ascending": "SELECT o_orderstatus, string_agg(v || ':' || n, ',' ORDER BY n, v) AS frequencies FROM (SELECT o_orderstatus, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "table_distinct_numbers": "SELECT p_brand, string_agg(p_size::VARCHAR, ',' ORDER BY p_size DESC) AS numbers FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1",
    "table_moments": """
        WITH m AS (SELECT l_linestatus, count(*) AS n, exp(avg(ln(l_quantity))) AS g, avg(l_quantity * l_quantity) AS ms, avg(l_quantity) AS u FROM lineitem GROUP BY 1),
        c AS (SELECT l_linestatus, n, g, ms, avg((l_quantity - u) ** 2) AS m2, avg((l_quantity - u) ** 3) AS m3, avg((l_quantity - u) ** 4) AS m4 FROM lineitem JOIN m USING (l_linestatus) GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) - 3 AS e FROM c)
        SELECT l_linestatus, round(g, 4) AS geomean, round(s, 4) AS pskew, round(e, 4) AS pkurt, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * e + 6), 4) AS skurt,
               round(n / 6 * (s * s + e * e / 4), 4) AS jarque, round(ms, 4) AS ms FROM k""",
    "table_gather": """
        SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS amount
        FROM lineitem""",
    "table_spread": """
        SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS N,
               round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY 1""",
    "table_fold": _FOLD,
    "table_unfold": f"SELECT l_orderkey, unnest(string_split(l_partkey, ';')) AS l_partkey FROM ({_FOLD})",
    "table_expand": """
        WITH f AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey::VARCHAR) AS p, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey::VARCHAR) AS s FROM lineitem GROUP BY 1)
        SELECT l_orderkey, unnest(p) AS part, unnest(s) AS supp FROM f""",
    "table_separate": """
        SELECT p_partkey, CASE WHEN strpos(p_type, ' ') > 0 THEN p_type[1:strpos(p_type, ' ') - 1] ELSE p_type END AS one,
               CASE WHEN strpos(p_type, ' ') > 0 THEN p_type[strpos(p_type, ' ') + 1:] END AS two FROM part""",
    "table_mutate": """
        SELECT o_orderkey, o_orderstatus || '-' || regexp_replace(o_orderpriority, '[0-9]', '', 'g') AS tag, round(o_totalprice, 1) AS price,
               strftime(o_orderdate, '%Y/%m') AS month FROM orders""",
    "table_transpose": """
        SELECT o_orderpriority AS priority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O,
               nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1""",
    "table_correlate": """
        SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(covar_pop(l_quantity, l_discount), 6) AS pcov,
               round(covar_samp(l_quantity, l_tax), 6) AS scov, round(sum(l_quantity * l_discount), 2) AS dotprod FROM lineitem GROUP BY 1""",
    "table_inspect": """
        SELECT field, count(*) AS rows, count(DISTINCT cell) AS distinct, count(*) FILTER (cell IS NULL) AS nulls, count(try_cast(cell AS DOUBLE)) AS numbers
        FROM (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderpriority']) AS field, unnest([o_orderkey::VARCHAR, o_orderstatus, o_orderpriority]) AS cell FROM orders) GROUP BY 1""",
    "table_to_json": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS record FROM nation""",
    "table_semi_anti": "SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, count(*) AS n FROM customer GROUP BY 1, 2",
}
