"""Queries of the relational core: filters, joins, aggregates, windows, sets, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators import relational as rel
from lakeloom.registry import Registry
from lakeloom.sources.tables import table

R = Registry()
S = R.spark_sql

# Scan, project, filter ------------------------------------------------------------
S("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
S("project_expressions", "SELECT o_orderkey, o_totalprice * 2 AS twice, -o_totalprice AS neg, o_orderkey % 7 AS rest FROM orders")
S("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_type = 'PROMO') AND NOT p_brand = 'Brand#4'")
S("filter_in_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 950 AND 1050 AND p_name LIKE '%ring%'")
S("filter_ilike_regex", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING' AND p_name RLIKE '^(red|blue)'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING' AND regexp_matches(p_name, '^(red|blue)')")
S("filter_null_tests", "SELECT id, file_size IS NULL AS n, first_row_id IS NOT NULL AS f, (file_size > 1000) IS TRUE AS big, (file_size > 1000) IS NOT FALSE AS maybe FROM lake_files")
S("filter_unknown", "SELECT id FROM lake_files WHERE (first_row_id > 100) IS UNKNOWN", "SELECT id FROM lake_files WHERE (first_row_id > 100) IS NULL")
S("distinct_from", "SELECT id FROM lake_files WHERE first_row_id IS DISTINCT FROM file_size AND file_size IS NOT DISTINCT FROM file_size")
S("case_searched_simple", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
S("coalesce_nullif_greatest", "SELECT id, coalesce(file_size, -1) AS size, nullif(row_count, -1) AS known, greatest(file_size, row_count) AS hi, least(file_size, row_count) AS lo FROM lake_files")
S("row_compare", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) < ('O', '3')")
S("any_all_array", "SELECT p_partkey FROM part WHERE array_contains(array(3, 7, 11), p_size) OR forall(array(48, 49), x -> p_size > x)", "SELECT p_partkey FROM part WHERE p_size = ANY([3, 7, 11]) OR (p_size > 48 AND p_size > 49)")
S("struct_field_access", "SELECT s.a AS a, s.b.c AS c FROM (SELECT named_struct('a', c_custkey, 'b', named_struct('c', c_name)) AS s FROM customer) t", "SELECT s.a AS a, s.b.c AS c FROM (SELECT {'a': c_custkey, 'b': {'c': c_name}} AS s FROM customer) t")
S("array_subscript_slice", "SELECT vec_id, try_element_at(embedding, 1) AS first, try_element_at(embedding, 999) AS beyond, slice(embedding, 2, 3) AS part FROM embeddings", "SELECT vec_id, embedding[1] AS first, embedding[999] AS beyond, embedding[2:4] AS part FROM embeddings")
S("values_list", "SELECT t.k, t.v, count(*) AS n FROM (VALUES ('F', 1), ('O', 2)) AS t(k, v) JOIN orders ON o_orderstatus = t.k GROUP BY t.k, t.v")
S("collate_binary", "SELECT p_name, count(*) AS n FROM part WHERE p_name < 'm' GROUP BY p_name")


@R.add("parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A statement with named parameters."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 400000, "status": "F"})


S("current_time_functions", "SELECT count(*) AS n FROM nation WHERE current_date() >= DATE '2020-01-01' AND current_timestamp() > TIMESTAMP '2020-01-01 00:00:00'", "SELECT count(*) AS n FROM nation WHERE current_date >= DATE '2020-01-01' AND current_timestamp > TIMESTAMP '2020-01-01 00:00:00'")
S("json_constructors", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j, try_parse_json(n_name) IS NOT NULL AS ok FROM nation", "SELECT n_nationkey, json_object('k', n_nationkey, 'n', n_name)::VARCHAR AS j, json_valid(n_name) AS ok FROM nation")

# Joins -----------------------------------------------------------------------------
S("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
S("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
S("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
S("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_suppkey = c_custkey")
S("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
S("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
S("join_not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
S("join_not_in_nulls", "SELECT id FROM lake_files WHERE id NOT IN (SELECT first_row_id FROM lake_files)")
S("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
S("join_theta_range", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
S("join_using", "SELECT k, a.n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
S("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
S("join_lateral_topn", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
S("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
S("join_multi_condition", "SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 10")


@R.add("join_range_bins", "SELECT event_id, lo FROM events JOIN (SELECT DISTINCT floor(p_retailprice / 10) - 90 AS lo, floor(p_retailprice / 10) - 85 AS hi FROM part) b ON value >= lo AND value < hi")
def join_range_bins(spark: SparkSession, sf: str) -> DataFrame:
    """A range join by bins: events whose value lies in an interval."""
    b = table(spark, sf, "part").select((F.floor(F.col("p_retailprice") / 10) - 90).cast("double").alias("lo"), (F.floor(F.col("p_retailprice") / 10) - 85).cast("double").alias("hi")).distinct()
    return rel.range_join(table(spark, sf, "events"), b, "value", "lo", "hi", 5.0).select("event_id", "lo")


# Aggregates ------------------------------------------------------------------------
S("agg_basic", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus")
S("agg_ordinals_expressions", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(length(o_orderpriority) AS BIGINT) AS l, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 10")
S("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_quantity) AS DOUBLE) AS quantities FROM lineitem GROUP BY l_returnflag")
S("agg_filter", "SELECT l_shipmode_year AS y, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS l_shipmode_year FROM lineitem) t GROUP BY l_shipmode_year")
S("agg_stats", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(stddev_samp(l_quantity), 6) AS sds, round(variance(l_quantity), 5) AS v, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY l_returnflag")
S("agg_corr_covar", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag")
S("agg_regr", "SELECT l_returnflag, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e6, 1) AS syy FROM lineitem GROUP BY l_returnflag")
S("agg_percentile", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS med, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY o_orderstatus")


@R.add("agg_percentile_array", "SELECT o_orderstatus, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY o_orderstatus")
def agg_percentile_array(spark: SparkSession, sf: str) -> DataFrame:
    """Several percentiles of each group at once."""
    return rel.percentiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", [0.25, 0.5, 0.75])


S("agg_mode", "SELECT c_nationkey, mode(c_mktsegment, true) AS m FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS m FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
S("agg_bool", "SELECT l_returnflag, bool_and(l_quantity > 0) AS every, bool_or(l_discount > 0.09) AS some FROM lineitem GROUP BY l_returnflag")
S("agg_any_value", "SELECT n_regionkey, any_value(n_regionkey) AS a, max(n_name) AS m, min(n_name) AS l FROM nation GROUP BY n_regionkey")
S("agg_string_ordered", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@R.add("agg_array_ordered", "SELECT table_name, array_agg(first_row_id ORDER BY id) AS ids FROM (SELECT DISTINCT * FROM lake_files) GROUP BY table_name HAVING count(*) < 50")
def agg_array_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """array_agg keeps nulls and takes an order, which collect_list does not."""
    from lakeloom.functions.arrays import array_agg

    f = table(spark, sf, "lake_files").distinct()
    return f.groupBy("table_name").agg(array_agg(F.col("first_row_id"), F.col("id")).alias("ids"), F.count("*").alias("n")).filter("n < 50").drop("n")


S("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
S("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
S("agg_grouping_sets_nested", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())")


@R.add("agg_grouping_mask", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INT AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_grouping_mask(spark: SparkSession, sf: str) -> DataFrame:
    """GROUPING over several columns."""
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(rel.grouping_mask("l_returnflag", "l_linestatus").cast("int").alias("g"), F.count("*").alias("n"))


S("agg_having_subquery", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / count(DISTINCT o_custkey) FROM orders)")
S("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
S("agg_distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# Windows ---------------------------------------------------------------------------
_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
S("win_rank_family", f"SELECT o_orderkey, CAST(row_number() OVER {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr FROM orders")
S("win_ntile_cume", f"SELECT o_orderkey, CAST(ntile(3) OVER {_W} AS BIGINT) AS nt, round(cume_dist() OVER {_W}, 9) AS cd, round(percent_rank() OVER {_W}, 9) AS pr FROM orders")
S("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER {_W} AS prev, lead(o_totalprice, 2) OVER {_W} AS next2, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER {_W} AS prev_or FROM orders")
S("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
S("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM events")
S("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, min(p_retailprice) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS lo FROM part")
S("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day FROM events")


@R.add("win_named_inherited", "SELECT o_orderkey, max(o_totalprice) OVER w AS m, row_number() OVER (w ORDER BY o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def win_named_inherited(spark: SparkSession, sf: str) -> DataFrame:
    """A window that refines a named one."""
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("m"), F.row_number().over(w.orderBy("o_orderkey")).cast("bigint").alias("rn"))


S("win_over_agg", "SELECT o_custkey, n, CAST(sum(n) OVER (ORDER BY o_custkey) AS BIGINT) AS running, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t")


def _excluded(name: str, exclude: str, how: str, start: int, end: int, frame: str) -> None:
    agg = {"sum": "round(sum(p_retailprice) OVER w, 4)", "count": "count(p_retailprice) OVER w", "avg": "round(avg(p_retailprice) OVER w, 8)", "max": "max(p_retailprice) OVER w"}[how]
    sql = f"SELECT p_partkey, {agg} AS x FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size, p_brand ROWS BETWEEN {frame} EXCLUDE {exclude})"

    @R.add(name, sql if "UNBOUNDED" in frame else sql.replace("p_size, p_brand", "p_partkey"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        order = ["p_size", "p_brand"] if "UNBOUNDED" in frame else ["p_partkey"]
        x = rel.window_exclude(F.col("p_retailprice"), how, exclude, ["p_type"], order, start, end)
        return table(spark, sf, "part").select("p_partkey", (x if how in ("count", "max") else F.round(x, 4 if how == "sum" else 8)).alias("x"))


_ALL = (Window.unboundedPreceding, Window.unboundedFollowing, "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
_excluded("win_exclude_current", "CURRENT ROW", "sum", *_ALL)
_excluded("win_exclude_group", "GROUP", "avg", *_ALL)
_excluded("win_exclude_ties", "TIES", "count", *_ALL)
_excluded("win_exclude_no_others", "NO OTHERS", "sum", *_ALL)
_excluded("win_exclude_bounded", "CURRENT ROW", "max", -3, 3, "3 PRECEDING AND 3 FOLLOWING")


@R.add("win_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def win_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """DISTINCT ON: each customer's dearest order."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.distinct_on(o, ["o_custkey"], [*rel.pg_order("o_totalprice", desc=True), *rel.pg_order("o_orderkey")])


# Sort, limit, sets, subqueries, CTEs --------------------------------------------------
S("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
S("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")


@R.add("nulls_order", "SELECT id, file_size FROM (SELECT DISTINCT id, file_size FROM lake_files) ORDER BY file_size DESC NULLS FIRST, id LIMIT 30")
def nulls_order(spark: SparkSession, sf: str) -> DataFrame:
    """PostgreSQL's default place of nulls."""
    f = table(spark, sf, "lake_files").select("id", "file_size").distinct()
    return f.orderBy(*rel.pg_order("file_size", desc=True), *rel.pg_order("id")).limit(30)


@R.add("with_ties", "SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 1 OFFSET 9)")
def with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """FETCH FIRST 10 ROWS WITH TIES."""
    return rel.fetch_with_ties(table(spark, sf, "part").select("p_partkey", "p_size"), [("p_size", True)], 10)


@R.add("limit_subquery", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) FROM nation)")
def limit_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """LIMIT by a subquery."""
    n = table(spark, sf, "nation").agg(F.count("*"))
    return rel.limit_by_query(table(spark, sf, "customer").select("c_custkey"), rel.pg_order("c_custkey"), n)


S("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
S("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
S("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
S("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
S("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
S("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
S("sub_scalar_corr", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
S("sub_scalar_in_select", "SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
S("sub_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
S("sub_in_case", "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS side FROM customer")
S("sub_from", "SELECT y, n FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)) t WHERE n > 10")
S("cte_chain", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b WHERE customers > 3")
S("cte_nested", "WITH a AS (WITH x AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT r_name, n FROM x JOIN region ON r_regionkey = n_regionkey) SELECT * FROM a")
S("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")


@R.add("cte_recursive_union", "WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT (n * 3) % 101 FROM t) SELECT n FROM t")
def cte_recursive_union(spark: SparkSession, sf: str) -> DataFrame:
    """The recursion that ends because only new rows go on."""
    return rel.recursive_union(spark.createDataFrame([(1,)], "n int"), lambda d: d.select(((F.col("n") * 3) % 101).cast("int").alias("n")))


@R.add("views_stacked", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def views_stacked(spark: SparkSession, sf: str) -> DataFrame:
    """A view on a view."""
    table(spark, sf, "customer").filter("c_acctbal > 0").createOrReplaceTempView("v_good")
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    spark.sql("SELECT n_name FROM v_good JOIN nation ON c_nationkey = n_nationkey").createOrReplaceTempView("v_named")
    return spark.sql("SELECT n_name, count(*) AS n FROM v_named GROUP BY n_name")


S("with_ordinality", "SELECT vec_id, CAST(pos + 1 AS BIGINT) AS nth, x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 4)) t AS pos, x", "SELECT vec_id, unnest(range(1, 5)) AS nth, unnest(embedding[1:4]) AS x FROM embeddings")
S("rows_from", "SELECT n_nationkey, z.a AS a, z.b AS b FROM nation LATERAL VIEW inline(arrays_zip(array(1, 2, 3), array('x', 'y'))) z AS a, b", "SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest(['x', 'y', NULL]) AS b FROM nation")
S("unnest_composite", "SELECT n_nationkey, x, y FROM nation LATERAL VIEW inline(array(named_struct('x', n_nationkey, 'y', n_name), named_struct('x', -1, 'y', 'none'))) t AS x, y", "SELECT n_nationkey, unnest([n_nationkey, -1]) AS x, unnest([n_name, 'none']) AS y FROM nation")

# Suites on the star schema ----------------------------------------------------------
_REV = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"
S("tpch_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-08-01 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus".replace("TIMESTAMP_NTZ '", "TIMESTAMP '"))
S("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
S("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority")
S("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
S("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
S("tpch_q7", "SELECT supp, cust, y, round(sum(v), 2) AS revenue FROM (SELECT n1.n_name AS supp, n2.n_name AS cust, CAST(year(l_shipdate) AS BIGINT) AS y, l_extendedprice * (1 - l_discount) AS v FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey IN (6, 7) AND n2.n_nationkey IN (6, 7) AND n1.n_nationkey <> n2.n_nationkey) t GROUP BY supp, cust, y")
S("tpch_q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
S("tpch_q12", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_linestatus")
S("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) t GROUP BY c_count")
S("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'")
S("tpch_q15", "WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)")
S("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
S("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
S("tpch_q19", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size <= 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size <= 20) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 40)")
S("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name")
S("tpch_q22", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey")
S("clickbench_count", "SELECT count(*) AS n FROM events WHERE event_type <> 'view'")
S("clickbench_distinct_users", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
S("clickbench_group_top", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
S("clickbench_avg_having", "SELECT user_id, round(avg(length(props)), 6) AS l, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 20")
S("clickbench_regex_group", "SELECT regexp_replace(s3_key, '/.*$', '') AS ns, count(*) AS n, min(s3_key) AS k FROM access_log WHERE s3_key <> '-' GROUP BY regexp_replace(s3_key, '/.*$', '')", "SELECT regexp_replace(s3_key, '/.*$', '') AS ns, count(*) AS n, min(s3_key) AS k FROM access_log WHERE s3_key <> '-' GROUP BY 1")
S("clickbench_minute", "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM events GROUP BY CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ)", "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1")
S("clickbench_like_count", "SELECT count(*) AS n FROM access_log WHERE request_uri LIKE '%device_pings%'")
S("clickbench_wide_sums", "SELECT " + ", ".join(f"CAST(sum(user_id + {i}) AS BIGINT) AS s{i}" for i in range(20)) + " FROM events")

# The suite's queries on part suppliers, with those pairs taken from the line items.
_PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
S("tpch_q2", f"WITH {_PS} SELECT s_acctbal, s_name, n_name, p_partkey FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size = 15 AND r_name = 'EUROPE' AND ps_supplycost = (SELECT min(q.ps_supplycost) FROM ps q JOIN supplier ON s_suppkey = q.ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE q.ps_partkey = p_partkey AND r_name = 'EUROPE')")
S("tpch_q8", "SELECT y, round(sum(CASE WHEN nation = 'NATION_3' THEN v ELSE 0 END) / sum(v), 8) AS share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, l_extendedprice * (1 - l_discount) AS v, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') t GROUP BY y")
S("tpch_q9", f"WITH {_PS} SELECT n_name, y, round(sum(amount), 1) AS profit FROM (SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS y, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%green%' OR p_name LIKE '%red%') t GROUP BY n_name, y")
S("tpch_q11", f"WITH {_PS}, v AS (SELECT ps_partkey, sum(CAST(ps_availqty AS DOUBLE)) AS q FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY ps_partkey) SELECT ps_partkey, q FROM v WHERE q > (SELECT sum(q) * 0.001 FROM v)")
S("tpch_q16", f"WITH {_PS} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS suppliers FROM ps JOIN part ON p_partkey = ps_partkey WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY p_brand, p_type, p_size")
S("tpch_q20", f"WITH {_PS} SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3 AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'b%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'))")
S("clickbench_min_max", "SELECT min(ts) AS first, max(ts) AS last FROM events")
S("clickbench_kinds_by_day", "SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CAST(ts AS DATE), event_type")
S("clickbench_top_values", "SELECT user_id, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY top DESC, user_id LIMIT 10")
S("clickbench_search_like", "SELECT operation, count(*) AS n, count(DISTINCT remote_ip) AS ips FROM access_log WHERE user_agent LIKE '%lake%' AND http_status = '200' GROUP BY operation")
S("clickbench_hour_of_day", "SELECT CAST(hour(request_time) AS BIGINT) AS h, count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes FROM access_log GROUP BY hour(request_time)")
S("clickbench_case_group", "SELECT CASE WHEN http_status LIKE '2%' THEN 'ok' WHEN http_status LIKE '4%' THEN 'client' ELSE 'server' END AS kind, count(*) AS n FROM access_log GROUP BY CASE WHEN http_status LIKE '2%' THEN 'ok' WHEN http_status LIKE '4%' THEN 'client' ELSE 'server' END")
S("clickbench_offset", "SELECT s3_key, count(*) AS n FROM access_log GROUP BY s3_key ORDER BY n DESC, s3_key LIMIT 10 OFFSET 20")
S("lake_deleted_files", "SELECT f.table_name, count(DISTINCT f.id) AS files, count(DISTINCT d.path) AS deletes FROM lake_files f JOIN deletion_file_map d ON f.table_name = d.table_name AND f.path = d.deleted_from GROUP BY f.table_name")
S("lake_bytes_by_table", "SELECT table_name, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN row_count >= 0 THEN row_count END) AS BIGINT) AS rows_known FROM (SELECT DISTINCT * FROM lake_files) f WHERE content = 0 GROUP BY table_name")
