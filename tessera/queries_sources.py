"""Registered queries over files that they write from the tables first, and over what the engine prints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera import sinks
from tessera.session import Engine
from tessera.sources.shared import new_path
from tessera.types import INT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_rows(spark: SparkSession, lines: Iterator[str]) -> DataFrame:
    """Printed lines with their place."""
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total, max(o_orderdate)::TIMESTAMP AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are inferred: Int, Float, String, Time."""
    path = new_path(spark, "orders.csv")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    orders.write.option("header", True).csv(path)
    out = Engine(spark).sql(f"SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS keys, SUM(o_totalprice) AS total, MAX(o_orderdate) AS last FROM {path} o WHERE o_totalprice > 1000.0 GROUP BY o_orderstatus")
    return out.withColumn("total", F.round("total", 2))


@query("SELECT c_custkey AS column_0, c_name AS column_1, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS column_2 FROM customer WHERE c_nationkey < 5")
def csv_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by number; an empty value is NULL."""
    path = new_path(spark, "customer.csv")
    some = table(spark, sf_dir, "customer").filter("c_nationkey < 5")
    some.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))).write.csv(path)
    return Engine(spark).sql(f"SELECT column_0, column_1, column_2 FROM {path}?header=false c")


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY 1")
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "part.tsv")
    table(spark, sf_dir, "part").write.options(header=True, sep="\t").csv(path)
    return Engine(spark).sql(f"SELECT p_brand, COUNT(*) AS n, SUM(p_size) AS sizes FROM {path} p GROUP BY p_brand")


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE + 1 AS next FROM nation")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are Float."""
    path = new_path(spark, "nation.json")
    table(spark, sf_dir, "nation").write.json(path)
    return Engine(spark).sql(f"SELECT n_nationkey, n_name, n_regionkey + 1.0 AS next FROM {path} n")


def objects(spark: SparkSession, sf_dir: str) -> str:
    """Objects whose fields differ from row to row: all have a, some b, and c is a number or a text."""
    path = new_path(spark, "objects.json")
    nation = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    text = F.concat(
        F.lit('{"k":'), F.col("n_nationkey"), F.lit(',"o":{"a":"'), F.col("n_name"), F.lit('"'), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',"b":'), F.col("n_regionkey"))).otherwise(F.lit("")),
        F.lit(',"c":'), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).otherwise(F.concat(F.lit('"t'), F.col("n_nationkey"), F.lit('"'))), F.lit("}}"),
    )
    nation.select(text).write.text(path)
    return path


@query("SELECT n_nationkey::DOUBLE AS k, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::DOUBLE END AS b, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::DOUBLE END AS number, CASE WHEN n_nationkey % 3 > 0 THEN 't' || n_nationkey END AS text FROM nation")
def object_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by ->, and a field of several types by assertion."""
    return Engine(spark).sql(f"SELECT k, o->a AS a, o->b AS b, o->c::float AS number, o->c::string AS text FROM {objects(spark, sf_dir)} t")


@query("SELECT n_nationkey::DOUBLE AS k, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::DOUBLE END AS b FROM nation")
def object_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields by ->*."""
    return Engine(spark).sql(f"SELECT t.k, t.a, t.b FROM (SELECT k, o->* FROM {objects(spark, sf_dir)} t) t")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS number, upper(n_name) AS text FROM nation")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "names.lines")
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return Engine(spark).sql(f"SELECT number, upper(text) AS text FROM {path} l")


@query("SELECT sum(c_custkey)::BIGINT AS s, count(*) AS n, max(c_custkey)::BIGINT AS last FROM customer")
def stdin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    import io

    engine = Engine(spark)
    keys = sorted(r[0] for r in table(spark, sf_dir, "customer").select("c_custkey").collect())
    engine.catalog.stdin = io.BytesIO("".join(f"{k}\n" for k in keys).encode())
    return engine.sql("SELECT SUM(int(text)) AS s, COUNT(*) AS n, MAX(int(text)) AS last FROM lines.stdin l")


@query("SELECT c_custkey, last FROM (SELECT c_custkey, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) ORDER BY last NULLS FIRST, c_custkey LIMIT 400")
def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL is least: first in ascending order."""
    return Engine(spark).sql(f"SELECT c.c_custkey, MAX(o.o_orderkey) AS last FROM {sf_dir}/customer.parquet c LEFT JOIN {sf_dir}/orders.parquet o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey ORDER BY last, c_custkey LIMIT 400")


@query("SELECT k, x FROM (SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::BIGINT END AS x FROM nation) ORDER BY x DESC NULLS LAST, k DESC LIMIT 20")
def null_order_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS x FROM {sf_dir}/nation.parquet n ORDER BY x DESC, k DESC LIMIT 20")


@query("SELECT -(o_totalprice) AS minus, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def order_by_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a computed output column and by a column that is not selected from elsewhere."""
    return Engine(spark).sql(f"SELECT -o_totalprice AS minus, o_orderkey FROM {sf_dir}/orders.parquet o ORDER BY minus, o_orderkey LIMIT 7")


@query("SELECT 10::BIGINT AS n, 10::BIGINT AS different")
def limit_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS different FROM (SELECT o_orderkey FROM {sf_dir}/orders.parquet o LIMIT 10) t")


@query("SELECT n_name, r_name FROM nation, region WHERE n_nationkey > r_regionkey * 5")
def theta_join_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT n.n_name, r.r_name FROM {sf_dir}/nation.parquet n JOIN {sf_dir}/region.parquet r ON n.n_nationkey > r.r_regionkey * 5")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def not_in_with_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT c_custkey FROM {sf_dir}/customer.parquet c WHERE c_custkey NOT IN (SELECT o_custkey FROM {sf_dir}/orders.parquet o WHERE o_totalprice > 150000.0)")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def query_expression_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of a subquery, opened."""
    return Engine(spark).sql(f"SELECT t.r_name, unnest(t.names) AS n_name FROM (SELECT r.r_name, (SELECT n_name FROM {sf_dir}/nation.parquet n WHERE n.n_regionkey = r.r_regionkey) AS names FROM {sf_dir}/region.parquet r) t")


@query("SELECT true AS later, true AS recent, count(*) AS n FROM region")
def now_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT t.later, t.recent, COUNT(*) AS n FROM (SELECT now() > parse_time('2006-01-02', '2024-01-01') AS later, now() < parse_time('2006-01-02', '2124-01-01') AS recent FROM {sf_dir}/region.parquet r) t GROUP BY t.later, t.recent")


@query("SELECT p_partkey, p_partkey % 5 AS a, 'part ' || p_partkey AS s, len('part ' || p_partkey)::BIGINT AS n, epoch(TIMESTAMP '2024-01-01' + to_days((p_partkey % 300)::INTEGER))::BIGINT AS t FROM part")
def parse_time_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each row in one layout, and texts that functions make."""
    engine = Engine(spark)
    days = table(spark, sf_dir, "part").select("p_partkey", F.date_format(F.expr("DATE'2024-01-01' + CAST(p_partkey % 300 AS INT)"), "dd.MM.yyyy HH:mm").alias("day"))
    engine.register("days", days)
    return engine.sql("SELECT p_partkey, p_partkey % 5 AS a, 'part ' + string(p_partkey) AS s, len('part ' + string(p_partkey)) AS n, time_to_unix(parse_time('02.01.2006 15:04', day)) AS t FROM days d")


@query("SELECT name FROM (VALUES ('abs'), ('ceil'), ('coalesce'), ('float'), ('floor'), ('int'), ('len'), ('like'), ('log'), ('log10'), ('log2'), ('lower'), ('now'), ('panic'), ('parse_time'), ('position'), ('pow'), ('replace'), ('reverse'), ('sqrt'), ('string'), ('substr'), ('time_from_unix'), ('time_to_unix'), ('upper')) v(name)")
def docs_function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented functions with a name of letters, less what this engine adds to the dialect."""
    return Engine(spark).sql("SELECT name FROM docs.functions f WHERE name ~ '^[a-z0-9_]+$' AND name NOT IN ('in', 'not', 'div', 'mod', 'bitnot')")


@query("SELECT name FROM (VALUES ('array_agg'), ('array_agg_distinct'), ('avg'), ('avg_distinct'), ('count'), ('count_distinct'), ('max'), ('min'), ('sum'), ('sum_distinct')) v(name)")
def docs_aggregate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql("SELECT name FROM docs.aggregates a")


@query("SELECT name, output_type FROM (VALUES ('upper', 'String'), ('len', 'Int'), ('sqrt', 'Float'), ('now', 'Time'), ('time_to_unix', 'Int')) v(name, output_type)")
def docs_some_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql("SELECT DISTINCT name, output_type FROM docs.function_signatures f WHERE name IN ('upper', 'len', 'sqrt', 'now', 'time_to_unix')")


@query("SELECT name, argument_type, output_type FROM (VALUES ('sum', 'Int', 'Int'), ('sum', 'Float', 'Float'), ('sum', 'Duration', 'Duration'), ('avg', 'Int', 'Int'), ('avg', 'Float', 'Float'), ('avg', 'Duration', 'Duration')) v(name, argument_type, output_type)")
def docs_sum_and_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql("SELECT name, argument_type, output_type FROM docs.aggregate_signatures a WHERE name IN ('sum', 'avg')")


class Squares(DataSource):
    """A data source of this module, to be registered: i and its square, filtered as Spark hands the filters down."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "i long, square long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SquaresReader(int(self.options["table"]))


class SquaresReader(DataSourceReader):
    def __init__(self, n: int) -> None:
        self.n = n

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(4)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int]]:
        return ((i, i * i) for i in range(partition.value, self.n, 4))


@query("SELECT i, i * i AS square, n_name FROM range(0, 60) t(i) JOIN nation ON n_nationkey = i WHERE i * i > 50")
def registered_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of a registered Python data source, joined with a file."""
    engine = Engine(spark, databases={"math": {"type": "squares"}})
    engine.register_source(Squares)
    return engine.sql(f"SELECT s.i, s.square, n.n_name FROM math.60 s JOIN {sf_dir}/nation.parquet n ON n.n_nationkey = s.i WHERE s.square > 50")


@query("SELECT r_regionkey::BIGINT AS k, r_name FROM region WHERE r_regionkey > 1")
def registered_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an extension of their own."""
    engine = Engine(spark)
    engine.register_reader("pq", lambda s, path, options: s.read.parquet(path.removesuffix(".pq") + ".parquet"))
    return engine.sql(f"SELECT r_regionkey AS k, r_name FROM {sf_dir}/region.pq r WHERE r_regionkey > 1")


@query("SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT * 3 + 1 AS x FROM nation")
def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register_function("triple_and_one", "Int", INT, lambda x: x * 3 + 1)
    return engine.sql(f"SELECT n_nationkey AS k, triple_and_one(n_nationkey) AS x FROM {sf_dir}/nation.parquet n")


@query("SELECT place, line FROM (SELECT 0 AS place, 'k,name,half' AS line UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), r_regionkey || ',' || r_name || ',' || CASE r_regionkey WHEN 0 THEN '0' WHEN 1 THEN '0.5' WHEN 2 THEN '1' WHEN 3 THEN '1.5' ELSE '' END FROM region)")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Engine(spark).query(f"SELECT r_regionkey AS k, r_name AS name, CASE WHEN r_regionkey < 4 THEN float(r_regionkey) / 2.0 END AS half FROM {sf_dir}/region.parquet r ORDER BY k")
    return of_rows(spark, (x.rstrip("\n") for x in sinks.csv_lines(q)))


@query("""SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS place, '{"k":' || r_regionkey || ',"name":"' || r_name || '","none":null,"ok":' || (r_regionkey > 2) || '}' AS line FROM region""")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Engine(spark).query(f"SELECT r_regionkey AS k, r_name AS name, NULL AS none, r_regionkey > 2 AS ok FROM {sf_dir}/region.parquet r ORDER BY k")
    return of_rows(spark, (x.rstrip("\n") for x in sinks.json_lines(q)))


@query("""SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS place, '{+0001-01-01T00:00:00Z| ' || r_regionkey || ', ''' || r_name || ''' |}' AS line FROM region""")
def sink_stream_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Engine(spark).query(f"SELECT r_regionkey AS k, r_name AS name FROM {sf_dir}/region.parquet r ORDER BY k")
    return of_rows(spark, (x.rstrip("\n") for x in sinks.stream_lines(q)))


@query("SELECT place, line FROM (VALUES (0, '+---+--------+'), (1, '| i |   s    |'), (2, '+---+--------+'), (3, '| 2 | ''no 2'' |'), (4, '| 1 | ''no 1'' |'), (5, '+---+--------+')) v(place, line)")
def sink_batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Engine(spark).query("SELECT i, 'no ' + string(i) AS s FROM range(start=>1, end=>3) r ORDER BY i DESC")
    return of_rows(spark, sinks.batch_table(q).splitlines())


@query("SELECT name, type, time_field FROM (VALUES ('window_end', 'Time', true), ('user_id', 'Int', false), ('n', 'Int', false), ('mean', 'Float', false)) v(name, type, time_field)")
def describe_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"SELECT window_end, user_id, COUNT(*) AS n, AVG(value) AS mean FROM tumble(source=>TABLE({sf_dir}/events.parquet), window_length=>INTERVAL 1 HOUR, time_field=>DESCRIPTOR(ts)) t GROUP BY window_end, user_id"
    # whether a column may be NULL follows the file's schema
    return spark.createDataFrame(Engine(spark).describe(text), "name string, type string, time_field boolean").withColumn("type", F.regexp_replace("type", r"^NULL \| ", ""))


@query("SELECT count(*) AS scans FROM (SELECT 1)")
def explain_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan has one scan, with the filter and two columns pushed into it."""
    plan = sinks.explain(Engine(spark).query(f"SELECT l_orderkey FROM {sf_dir}/lineitem.parquet l WHERE l_quantity > 49.0"))
    hits = plan.count("GreaterThan(l_quantity,49.0)") and plan.count("ReadSchema: struct<l_orderkey:bigint,l_quantity:double>")
    return spark.createDataFrame([(hits,)], "scans long")


TWO_TRIGGERS = """
WITH r AS (SELECT user_id, event_id, row_number() OVER w AS n, sum(value) OVER w AS total, count(*) OVER (PARTITION BY user_id) AS every
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, row_number() OVER p AS turn, lag(n) OVER p AS n0, lag(total) OVER p AS t0 FROM r WHERE n % 20 = 0 OR n % 30 = 0 OR n = every WINDOW p AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, n, round(total, 4) AS total, false AS retraction, event_id AS at FROM e
UNION ALL SELECT user_id, n0, round(t0, 4), true, event_id FROM e WHERE turn > 1
"""


@query(TWO_TRIGGERS)
def two_counting_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"SELECT user_id, COUNT(*) AS n, SUM(value) AS total FROM {sf_dir}/events.parquet?seq=event_id e GROUP BY user_id TRIGGER COUNTING 20, COUNTING 30"
    return Engine(spark).query(text).changelog().select("user_id", "n", F.round("total", 4).alias("total"), F.col("__retraction").alias("retraction"), F.col("__at").alias("at"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def end_of_stream_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT user_id, COUNT(*) AS n FROM {sf_dir}/events.parquet e GROUP BY user_id TRIGGER ON END OF STREAM")


@query("SELECT a.event_id AS a, b.event_id AS b, a.ts::TIMESTAMP AS at FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id + 1 = b.event_id")
def join_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time field of both sides goes through a join."""
    e = f"{sf_dir}/events.parquet"
    return Engine(spark).sql(f"SELECT a.event_id AS a, b.event_id AS b, a.ts AS at FROM {e}?time=ts a JOIN {e}?time=ts b ON a.user_id = b.user_id AND a.event_id + 1 = b.event_id")


@query("SELECT i, (i > 2)::BIGINT AS a FROM range(0, 5) t(i)")
def computed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql("SELECT i, int(i > 2) AS a FROM range(start=>3 - 3, end=>int('5')) r")


@query("SELECT r_name, i FROM region, LATERAL (SELECT unnest(range(r_regionkey * 1000)) AS i) t WHERE i % 400 = 0")
def computed_lookup_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT r.r_name, t.i FROM {sf_dir}/region.parquet r LOOKUP JOIN range(start=>0, end=>r.r_regionkey * 1000) t WHERE t.i % 400 = 0")


@query("SELECT r_name, true AS timed FROM region")
def poll_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"SELECT p.r_name, p.time > parse_time('2006-01-02', '2024-01-01') AS timed FROM poll(source=>TABLE({sf_dir}/region.parquet)) p")
