"""The registered queries of the dialect, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import queries_sources
from tessera.session import Engine

#: name -> (dialect, SQL or None); {x} stands for the table x.
QUERIES: dict[str, tuple[str, str | None]] = {}


def q(name: str, dialect: str, sql: str | None = None) -> None:
    QUERIES[name] = (dialect, sql)


# scans, projection, filter
q("groupby_count_avg", "SELECT l_returnflag, COUNT(*), AVG(l_extendedprice) FROM {lineitem} GROUP BY l_returnflag",
  'SELECT l_returnflag, count(*) AS "count", avg(l_extendedprice) AS avg_l_extendedprice FROM lineitem GROUP BY 1')
q("filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) AS net, l_quantity + 1.0 AS more FROM {lineitem} WHERE l_quantity > 30.0 AND l_discount < 0.05",
  "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, l_quantity + 1.0::DOUBLE AS more FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05::DOUBLE")
q("star_qualified", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey",
  "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
q("distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
q("count_only", "SELECT COUNT(*) AS n FROM {lineitem}", "SELECT count(*) AS n FROM lineitem")
q("dual", "SELECT 1 + 2 AS three, 'a' + 'b' AS ab", "SELECT 3::BIGINT AS three, 'ab' AS ab")
# sort, limit
q("order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
q("order_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 5 OFFSET 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 7")
q("nested_order_limit", "SELECT AVG(o_totalprice) AS mean, COUNT(*) AS n FROM (SELECT * FROM {orders} o ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) t",
  "SELECT avg(o_totalprice) AS mean, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
# joins
q("inner_join", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000.0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
q("stream_join", "SELECT COUNT(*) AS n FROM {orders} o STREAM JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
q("comma_join", "SELECT r_name, n_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey", "SELECT r_name, n_name FROM nation, region WHERE n_regionkey = r_regionkey")
q("using_join", "SELECT l.i AS a FROM range(start=>0, end=>5) l JOIN range(start=>3, end=>9) r USING (i)", "SELECT l.i AS a FROM range(0, 5) l(i) JOIN range(3, 9) r(i) USING (i)")
q("cross_join", "SELECT r1.r_name AS a, r2.r_name AS b FROM {region} r1 CROSS JOIN {region} r2", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
q("theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
  "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("left_join", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
q("right_join", "SELECT c.c_custkey, o.o_orderkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
q("full_join", "SELECT l.i AS a, r.i AS b FROM range(start=>-10, end=>3) l OUTER JOIN range(start=>-2, end=>6) r ON l.i = r.i", "SELECT l.i AS a, r.i AS b FROM range(-10, 3) l(i) FULL JOIN range(-2, 6) r(i) ON l.i = r.i")
q("full_join_chain", "SELECT l.i AS a, r.i AS b, rr.i AS c FROM range(start=>-10, end=>3) l OUTER JOIN range(start=>-2, end=>6) r ON l.i = r.i OUTER JOIN range(start=>-20, end=>20) rr ON l.i + r.i = rr.i",
  "SELECT l.i AS a, r.i AS b, rr.i AS c FROM range(-10, 3) l(i) FULL JOIN range(-2, 6) r(i) ON l.i = r.i FULL JOIN range(-20, 20) rr(i) ON l.i + r.i = rr.i")
q("lookup_join", "SELECT n.n_name, COUNT(*) AS customers FROM {nation} n LOOKUP JOIN {customer} c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
q("lateral_lookup", "SELECT n.n_name, r.i FROM {nation} n LOOKUP JOIN range(start=>0, end=>n.n_regionkey) r", "SELECT n_name, r.i FROM nation, LATERAL (SELECT unnest(range(n_regionkey)) AS i) r")
q("correlated_lookup", "SELECT n.n_name, t.r_name FROM {nation} n LOOKUP JOIN (SELECT r_name FROM {region} r WHERE r.r_regionkey = n.n_regionkey) t", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
# aggregates
q("agg_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS c, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a FROM {lineitem} GROUP BY l_returnflag",
  "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, sum(DISTINCT l_linenumber)::BIGINT AS s, (sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber))::BIGINT AS a FROM lineitem GROUP BY 1")
q("agg_int_avg", "SELECT l_linestatus, AVG(l_linenumber) AS a FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, (sum(l_linenumber) // count(l_linenumber))::BIGINT AS a FROM lineitem GROUP BY 1")
q("agg_min_max", "SELECT o_orderpriority, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, MAX(o_orderdate) AS last, MIN(o_custkey) AS first FROM {orders} GROUP BY o_orderpriority",
  "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, max(o_orderdate)::TIMESTAMP AS last, min(o_custkey) AS first FROM orders GROUP BY 1")
q("agg_sum_interval", "SELECT COUNT(*) AS n, SUM(INTERVAL 2 SECONDS * n_regionkey) / INTERVAL 1 SECOND AS s FROM {nation}", "SELECT count(*) AS n, sum(2 * n_regionkey)::DOUBLE AS s FROM nation")
q("agg_array", "SELECT n_regionkey, array_agg(n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT AS n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
q("agg_array_distinct", "SELECT c_mktsegment, array_agg(DISTINCT c_nationkey) AS nations FROM {customer} GROUP BY c_mktsegment", "SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey::BIGINT)) AS nations FROM customer GROUP BY 1")
q("agg_null_count", "SELECT c.c_mktsegment, COUNT(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", "SELECT c_mktsegment, nullif(count(o_orderkey), 0) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
q("agg_empty", "SELECT COUNT(*) AS n, SUM(n_nationkey) AS s FROM {nation} WHERE n_name = 'none'", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS s FROM nation WHERE n_name = 'none' HAVING count(*) > 0")
q("group_only", "SELECT n_regionkey FROM {nation} GROUP BY n_regionkey", "SELECT DISTINCT n_regionkey::BIGINT AS n_regionkey FROM nation")
q("group_expression", "SELECT l_orderkey % 7 AS k, COUNT(*) + 1 AS n FROM {lineitem} GROUP BY l_orderkey % 7 HAVING COUNT(*) > 10", "SELECT l_orderkey % 7 AS k, count(*) + 1 AS n FROM lineitem GROUP BY 1 HAVING count(*) > 10")
# nesting
q("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), best AS (SELECT * FROM big WHERE total > 500000.0) SELECT c.c_name, b.total FROM best b JOIN {customer} c ON b.o_custkey = c.c_custkey",
  "WITH big AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT c_name, total FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 500000")
q("subquery_from", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey) t WHERE t.n > 10", "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 10")
q("query_expression", "SELECT r.r_name, len((SELECT n_name FROM {nation} n WHERE n.n_regionkey = r.r_regionkey)) AS nations FROM {region} r", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
q("in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000.0)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("not_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
q("exists", "SELECT n_name FROM {nation} n WHERE EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000.0)", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
q("set_operations", "SELECT n_nationkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region} EXCEPT SELECT i FROM range(start=>0, end=>3) r", "SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT r_regionkey FROM region EXCEPT SELECT i FROM range(0, 3) r(i)")
q("union_all", "SELECT r_name AS x FROM {region} UNION ALL SELECT n_name FROM {nation}", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation")
q("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", "SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
# functions
q("arithmetic", "SELECT l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS b, l_orderkey * 3 AS c, (l_orderkey - l_partkey) / 7 AS d, l_extendedprice / l_quantity AS e, -l_linenumber AS f FROM {lineitem}",
  "SELECT l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS b, l_orderkey * 3 AS c, trunc((l_orderkey - l_partkey) / 7)::BIGINT AS d, l_extendedprice / l_quantity AS e, -(l_linenumber::BIGINT) AS f FROM lineitem")
q("str_functions", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, reverse(p_type) AS c, substr(p_name, 2) AS d, substr(p_name, 1, 4) AS e, replace(p_name, 'e', '3') AS f, position(p_name, 'an') AS g, len(p_name) AS h, p_brand * 2 AS i, p_name + '!' AS j FROM {part}",
  "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, reverse(p_type) AS c, substr(p_name, 3) AS d, substr(p_name, 2, 4) AS e, replace(p_name, 'e', '3') AS f, nullif(instr(p_name, 'an'), 0) - 1 AS g, strlen(p_name) AS h, repeat(p_brand, 2) AS i, p_name || '!' AS j FROM part")
q("like_regex", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name NOT LIKE '_e%' AS b, p_name ~ '^[a-m]' AS c, p_brand ~* 'BRAND' AS d, p_name !~ 'z' AS e FROM {part}",
  "SELECT p_partkey, p_name LIKE '%a%' AS a, p_name NOT LIKE '_e%' AS b, regexp_matches(p_name, '^[a-m]') AS c, regexp_matches(lower(p_brand), 'brand') AS d, NOT regexp_matches(p_name, 'z') AS e FROM part")
q("math_functions", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, sqrt(abs(c_acctbal)) AS d FROM {customer}", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, sqrt(abs(c_acctbal)) AS d FROM customer")
q("math_logs", "SELECT i, floor(log2(float(i)) * 1000.0) AS a, floor(log(float(i)) * 1000.0) AS b, floor(log10(float(i)) * 1000.0 + 0.0001) AS c, pow(float(i), 2.0) AS d FROM range(start=>1, end=>100) r",
  "SELECT i, floor(log2(i) * 1000) AS a, floor(ln(i) * 1000) AS b, floor(log10(i) * 1000 + 0.0001) AS c, pow(i, 2)::DOUBLE AS d FROM range(1, 100) r(i)")
q("comparisons", "SELECT n_nationkey, n_nationkey < n_regionkey AS a, n_nationkey <= 3 AS b, n_nationkey = n_regionkey AS c, n_nationkey != 3 AS d, n_name >= 'I' AS e, n_name > 'I' AS f, NULL < 1 AS g FROM {nation}",
  "SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey < n_regionkey AS a, n_nationkey <= 3 AS b, n_nationkey = n_regionkey AS c, n_nationkey != 3 AS d, n_name >= 'I' AS e, n_name > 'I' AS f, NULL::BOOLEAN AS g FROM nation")
q("logic", "SELECT i, i > 2 AND i < 5 AS a, i < 2 OR i > 4 AS b, NOT (i = 3) AS c, i = 1 OR NULL AS d, i = 1 AND NULL AS e, i IS NULL AS f, i IS NOT NULL AS g FROM range(start=>0, end=>7) r",
  "SELECT i, i > 2 AND i < 5 AS a, i < 2 OR i > 4 AS b, NOT (i = 3) AS c, i = 1 OR NULL AS d, i = 1 AND NULL AS e, i IS NULL AS f, i IS NOT NULL AS g FROM range(0, 7) r(i)")
q("conversions", "SELECT o_orderkey, int(o_totalprice) AS a, float(o_custkey) AS b, int('12') AS c, int('1x') AS d, float('1.5') AS e, int(o_totalprice > 1000.0) AS f, string(o_orderkey) AS g FROM {orders}",
  "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS a, o_custkey::DOUBLE AS b, 12::BIGINT AS c, NULL::BIGINT AS d, 1.5::DOUBLE AS e, (o_totalprice > 1000)::BIGINT AS f, o_orderkey::VARCHAR AS g FROM orders")
q("time_functions", "SELECT o_orderkey, time_to_unix(o_orderdate) AS a, time_to_unix(o_orderdate + INTERVAL 1 DAY) AS b, time_to_unix(o_orderdate - INTERVAL 90 MINUTES) AS c, time_to_unix(time_from_unix(o_orderkey)) AS d, time_to_unix(parse_time('2006-01-02 15:04', '2024-03-05 06:07')) AS e FROM {orders}",
  "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate + INTERVAL 1 DAY)::BIGINT AS b, epoch(o_orderdate - INTERVAL 90 MINUTE)::BIGINT AS c, o_orderkey AS d, epoch(TIMESTAMP '2024-03-05 06:07:00')::BIGINT AS e FROM orders")
q("interval_functions", "SELECT i, INTERVAL 7 SECONDS * i / INTERVAL 2 SECONDS AS a, int(INTERVAL 3 MILLISECONDS * i) AS b, float(INTERVAL 90 SECONDS / 2) AS c FROM range(start=>1, end=>9) r", "SELECT i, 7.0::DOUBLE * i / 2 AS a, 3000000::BIGINT * i AS b, 45.0::DOUBLE AS c FROM range(1, 9) r(i)")
q("case_between", "SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey BETWEEN 1 AND 2 THEN 'few' ELSE 'many' END AS a, CASE n_regionkey WHEN 3 THEN 1 END AS b, (n_regionkey = 1) IS TRUE AS c FROM {nation}",
  "SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey BETWEEN 1 AND 2 THEN 'few' ELSE 'many' END AS a, CASE n_regionkey WHEN 3 THEN 1::BIGINT END AS b, (n_regionkey = 1) AS c FROM nation")
q("tuple_in_null", "SELECT i, i IN (1, 3, 5) AS a, i NOT IN (1, NULL) AS b, i IN (SELECT r_regionkey FROM {region}) AS c FROM range(start=>0, end=>8) r", "SELECT i, i IN (1, 3, 5) AS a, NOT coalesce(i IN (1, NULL), false) AS b, i IN (SELECT r_regionkey FROM region) AS c FROM range(0, 8) r(i)")
q("coalesce", "SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS k FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, coalesce(o_orderkey, -1) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
q("bits", "SELECT i, i % 3 AS a, i & 6 AS b, i | 8 AS c, i << 2 AS d FROM range(start=>0, end=>20) r", "SELECT i, i % 3 AS a, i & 6 AS b, i | 8 AS c, i << 2 AS d FROM range(0, 20) r(i)")
# lists and objects
q("list_index", "SELECT vec_id, embedding[0] AS a, embedding[3] AS b, embedding[100000] AS c, len(embedding) AS n FROM {embeddings}", "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[4]::DOUBLE AS b, NULL::DOUBLE AS c, len(embedding)::BIGINT AS n FROM embeddings")
q("unnest", "SELECT vec_id, unnest(embedding) AS x FROM {embeddings}", "SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
q("unnest_grouped", "SELECT t.k, unnest(t.names) AS name FROM (SELECT n_regionkey AS k, array_agg(n_name) AS names FROM {nation} GROUP BY n_regionkey) t", "SELECT n_regionkey::BIGINT AS k, n_name AS name FROM nation")
# table-valued functions and triggers
q("range_tvf", "SELECT i FROM range(start=>-3, end=>12) r", "SELECT i FROM range(-3, 12) r(i)")
q("tumble", "SELECT window_start, window_end, COUNT(*) AS n FROM tumble(source=>TABLE({events}), window_length=>INTERVAL 1 HOUR, time_field=>DESCRIPTOR(ts)) t GROUP BY window_start, window_end",
  "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, (time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR)::TIMESTAMP AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
q("tumble_offset", "SELECT window_end, COUNT(*) AS n FROM tumble(source=>TABLE({events}), window_length=>INTERVAL 1 DAY, time_field=>DESCRIPTOR(ts), offset=>INTERVAL 6 HOURS) t GROUP BY window_end",
  "SELECT (time_bucket(INTERVAL 1 DAY, ts - INTERVAL 6 HOUR) + INTERVAL 30 HOUR)::TIMESTAMP AS window_end, count(*) AS n FROM events GROUP BY 1")
q("tumble_week", "SELECT window_start, COUNT(*) AS n FROM tumble(source=>TABLE({events}), window_length=>INTERVAL 7 DAYS, time_field=>DESCRIPTOR(ts)) t GROUP BY window_start",
  "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05')::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1")
q("watermark_drop", "SELECT t.event_id FROM max_diff_watermark(source=>TABLE({events_shuffled}), max_diff=>INTERVAL 5 SECONDS, time_field=>DESCRIPTOR(ts), resolution=>INTERVAL 10 SECONDS) t",
  "SELECT event_id FROM (SELECT event_id, ts, max(epoch_us(ts) - epoch_us(ts) % 10000000) OVER (ORDER BY (event_id + (event_id * 7919) % 97) * 1000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000000 AS wm FROM events) WHERE wm IS NULL OR epoch_us(ts) > wm")
q("trigger_watermark", "WITH w AS (SELECT * FROM max_diff_watermark(source=>TABLE({events}), max_diff=>INTERVAL 5 SECONDS, time_field=>DESCRIPTOR(ts)) c), t AS (SELECT * FROM tumble(source=>TABLE(w), window_length=>INTERVAL 1 DAY, offset=>INTERVAL 0 SECONDS) c) SELECT window_end, user_id, COUNT(*) AS clicks FROM t GROUP BY window_end, user_id TRIGGER ON WATERMARK, COUNTING 500",
  "SELECT (time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, user_id, count(*) AS clicks FROM (SELECT *, max(epoch_us(ts) // 1000000 * 1000000) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000000 AS wm FROM events) WHERE wm IS NULL OR epoch_us(ts) > wm GROUP BY 1, 2")
q("poll_snapshot", "SELECT p.r_name FROM poll(source=>TABLE({region}), poll_interval=>INTERVAL 1 SECOND) p", "SELECT r_name FROM region")
q("docs_functions", "SELECT name, description FROM docs.functions")
q("docs_function_signatures", "SELECT name, output_type FROM docs.function_signatures")
q("docs_aggregates", "SELECT name, description FROM docs.aggregates")
q("docs_aggregate_signatures", "SELECT name, argument_type, output_type FROM docs.aggregate_signatures")
q("plugins_installed", "SELECT name, kind FROM plugins.installed_plugins")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text_of(name: str, sf_dir: str) -> str:
    places = {t: f"{sf_dir}/{t}.parquet" for t in TABLES} | {"events": f"{sf_dir}/events.parquet?seq=event_id", "events_shuffled": "events_shuffled?seq=seq"}
    return QUERIES[name][0].format_map(places)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        if name == "watermark_drop":
            events = spark.read.parquet(f"{sf_dir}/events.parquet")
            # an arrival that is not the order of time
            engine.register("events_shuffled", events.withColumn("seq", (F.col("event_id") + (F.col("event_id") * 7919) % 97) * 1000000 + F.col("event_id")))
        out = engine.sql(text_of(name, sf_dir))
        if name == "cte":
            out = out.withColumn("total", F.round("total", 2))
        return out

    run.__name__ = name
    return run


def trigger_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change stream of TRIGGER COUNTING 3: emissions and their retractions."""
    text = f"SELECT user_id, COUNT(*) AS n, SUM(value) AS total, MAX(value) AS most FROM {sf_dir}/events.parquet?seq=event_id e GROUP BY user_id TRIGGER COUNTING 3"
    log = Engine(spark).query(text).changelog()
    return log.select("user_id", "n", F.round("total", 4).alias("total"), "most", F.col("__retraction").alias("retraction"), F.col("__at").alias("at"))


TRIGGER_SQL = """
WITH r AS (SELECT user_id, event_id, row_number() OVER w AS n, sum(value) OVER w AS total, max(value) OVER w AS most, count(*) OVER (PARTITION BY user_id) AS every
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS turn, lag(n) OVER p AS n0, lag(total) OVER p AS t0, lag(most) OVER p AS m0
  FROM r WHERE n % 3 = 0 OR n = every WINDOW p AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, n, round(total, 4) AS total, most, false AS retraction, event_id AS at FROM e
UNION ALL SELECT user_id, n0, round(t0, 4), m0, true, event_id FROM e WHERE turn > 1
"""


def union_frame(engine: Engine, sf_dir: str) -> None:
    """A column that is Int, Float or String by row, from stored columns."""
    sql = f"SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN n_name ELSE NULL END AS u, n_nationkey AS k FROM {sf_dir}/nation.parquet n"
    engine.register("mixed", engine.sql(sql))


def union_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions, conversions and coalesce over a union."""
    engine = Engine(spark)
    union_frame(engine, sf_dir)
    return engine.sql("SELECT k, u::int AS i, u::string AS s, coalesce(u::int, int(u::string), -1) AS c, u = 3 AS three, u IS NULL AS missing FROM mixed m")


UNION_SQL = """SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::BIGINT END AS i, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS s,
CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::BIGINT ELSE -1 END AS c, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey = 3 WHEN n_nationkey % 3 = 1 THEN false END AS three, n_nationkey % 3 = 2 AS missing FROM nation"""


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: runner(n) for n in QUERIES} | {"trigger_counting": trigger_counting, "union_types": union_types} | queries_sources.QUERIES


def all_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in QUERIES.items() if s} | {"trigger_counting": TRIGGER_SQL, "union_types": UNION_SQL} | queries_sources.SQL
