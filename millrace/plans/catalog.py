"""Every registered query of the library, and the SQL that tells its result."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.model import Context, JobExecution, Parameters, Status, StepExecution
from millrace.operators import policies as P
from millrace.operators.deadletter import dead_letters
from millrace.operators.processing import Checked, Chain, Composite, Identity, Project, PythonMap, Transform
from millrace.operators.ranges import bounds_frame, folded_status, range_of
from millrace.operators.sequence import chunk_sizes, chunked, numbered, size_histogram
from millrace.plans import repository as R
from millrace.plans.jobs import Action, FlowBuilder, JobBuilder, exit_status
from millrace.plans.steps import ChunkListener, Repeat, Step, StepBuilder, Stop, TaskletStep
from millrace.plans.workspace import folder
from millrace.sinks.files import JsonArraySink, ParquetSink
from millrace.sinks.others import CompositeSink
from millrace.sources.files import JsonArraySource, LineSource, XmlSource
from millrace.sources.http import HttpSource
from millrace.sources.memory import FrameSource
from millrace.sources.relational import KeysetSource, OffsetSource, bound_query, page, range_read, strictly_rising

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MONEY = "decimal(18,2)"

# chunks


@query("""SELECT o_orderkey AS order_key, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)) * 0.08, 2) AS DECIMAL(18,2)) AS tax,
  CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS chunk
  FROM orders WHERE o_totalprice > 50000""")
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("o_totalprice").cast(MONEY)
    step = Project(F.col("o_totalprice") > 50000, order_key=F.col("o_orderkey"), amount=amount, tax=S.round_half_even(amount * F.lit("0.08").cast("decimal(3,2)")).cast(MONEY))
    return chunked(step.apply(table(spark, sf_dir, "orders")), ["order_key"], 100, "chunk")


@query("""WITH k AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders WHERE o_totalprice > 50000)
  SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n FROM k GROUP BY chunk""")
def chunk_sizes_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_sizes(table(spark, sf_dir, "orders").where("o_totalprice > 50000"), 1000)


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS p FROM lineitem)
  SELECT CAST(p // 5000 AS BIGINT) AS chunk, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM s GROUP BY 1""")
def chunk_composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return chunked(rows, rows.columns, 5000, "chunk").groupBy("chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


def ran(*steps: Step, wanted: Status = Status.COMPLETED) -> JobExecution:
    """A job of these steps, run; the queries rest on its end."""
    builder = JobBuilder("query", steps[0].repository)
    for s in steps:
        builder.step(s)
    execution = builder.build().execute()
    if execution.status != wanted:
        raise RuntimeError(f"{execution.status}: {execution.failure_message}")
    return execution


@query("SELECT n, count(*) AS chunks FROM (SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 300 AS c FROM events WHERE event_type <> 'click') GROUP BY c) GROUP BY n")
def concurrent_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the chunks that a step of four parallel tasks has written."""
    path = folder(spark, "concurrent")
    source = FrameSource(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])
    ran(StepBuilder().source(source).processor(Project(F.col("event_type") != "click")).sink(ParquetSink(path)).chunk_size(300).chunks_per_commit(16).parallelism(4).build("copy"))
    return spark.read.parquet(path).groupBy("_chunk").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("chunks"))


@query("SELECT n, count(*) AS chunks FROM (SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS c FROM orders) GROUP BY c) GROUP BY n")
def chunk_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_histogram(table(spark, sf_dir, "orders"), 700)


# processors


@query("SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer WHERE c_acctbal > 0")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = Project(c_custkey=F.col("c_custkey"), c_name=F.col("c_name"), balance=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast(MONEY)))
    return Composite([mapped, Project(F.col("balance").isNotNull())]).apply(table(spark, sf_dir, "customer"))


@query("""SELECT c_custkey, upper(c_mktsegment) || '-p1-p2-p3' AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer
  WHERE c_acctbal > 0 AND c_nationkey % 2 = 0""")
def composite_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def suffix(s: str) -> Transform:
        return Transform(lambda df: df.withColumn("segment", F.concat("segment", F.lit(s))))

    steps = Composite([Project(F.col("c_acctbal") > 0, c_custkey=F.col("c_custkey"), segment=F.upper("c_mktsegment"), balance=F.col("c_acctbal").cast(MONEY), nation=F.col("c_nationkey")), suffix("-p1"), Project(F.col("nation") % 2 == 0), suffix("-p2"), suffix("-p3"), Identity()])
    return steps.apply(table(spark, sf_dir, "customer")).drop("nation")


@query("""SELECT event_id, 'Value:' || CAST(json_extract(props, '$.k') AS INTEGER) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) IS NOT NULL""")
def processor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = Project(event_id=F.col("event_id"), k=S.parse_int(F.get_json_object("props", "$.k")))
    show = Project(F.col("k").isNotNull(), event_id=F.col("event_id"), value=F.concat(F.lit("Value:"), F.col("k").cast("string")))
    return Chain(parse, show).apply(table(spark, sf_dir, "events"))


@query("""SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '!' AS shown FROM events WHERE event_id % 3 <> 0""")
def python_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(row: dict) -> dict | None:
        return None if row["event_id"] % 3 == 0 else {"event_id": row["event_id"], "shown": row["amount"] + "!"}

    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").cast(MONEY).cast("string").alias("amount"))
    return PythonMap(step, "event_id long, shown string").apply(rows).select("event_id", "shown")


# errors; the bad texts are derived, the tables hold none

_BAD = "CASE WHEN event_id % 50 = 7 THEN 'N/A' WHEN event_id % 50 = 31 THEN '' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END"
_PARSED = f"(SELECT event_id, {_BAD} AS raw, TRY_CAST({_BAD} AS DECIMAL(18,2)) AS amount FROM events)"


def events_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed().apply(raw_events(spark, sf_dir).withColumn("_seq", F.col("event_id")))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 50
    raw = F.when(at == 7, "N/A").when(at == 31, "").otherwise(F.col("value").cast(MONEY).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def parsed() -> Composite:
    amount = Transform(lambda df: df.withColumn("amount", S.parse_decimal(F.col("raw"))))
    return Composite([amount, Checked((F.col("amount").isNull()) & (F.col("raw") == ""), "EmptyValue", F.lit("empty"), ("ValueError", "Exception")), Checked(F.col("amount").isNull(), "BadFormat", F.concat(F.lit("not a number: "), F.col("raw")), ("ValueError", "Exception"))])


@query(f"SELECT event_id, amount FROM {_PARSED} WHERE amount IS NOT NULL")
def skip_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = P.classified(P.Classifier().skip(ValueError))  # both errors derive from it
    return P.apply_policy(events_with_errors(spark, sf_dir), policy).survivors.select("event_id", "amount")


@query(f"""WITH r AS {_PARSED}, b AS (SELECT event_id FROM r WHERE amount IS NULL ORDER BY event_id LIMIT 1 OFFSET 20),
  s AS (SELECT event_id, amount, (row_number() OVER (ORDER BY event_id) - 1) // 25 AS chunk, count(*) OVER () // 25 AS full_chunks FROM r
        WHERE amount IS NOT NULL AND event_id < coalesce((SELECT event_id FROM b), 1000000000000))
  SELECT event_id, amount, CAST(chunk AS BIGINT) AS chunk FROM s WHERE chunk < full_chunks OR (SELECT count(*) FROM b) = 0""")
def skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_policy(events_with_errors(spark, sf_dir), P.limited(20)).committed(25, "chunk").select("event_id", "amount", "chunk")


@query(f"""SELECT event_id, CASE WHEN raw = '' THEN 'EmptyValue' ELSE 'BadFormat' END AS exception_type,
  CASE WHEN raw = '' THEN 'empty' ELSE 'not a number: ' || raw END AS exception_message,
  row_number() OVER (ORDER BY event_id) - 1 AS skip_count_at_time FROM {_PARSED} WHERE amount IS NULL""")
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = P.apply_policy(events_with_errors(spark, sf_dir), P.ALWAYS).skipped
    return dead_letters(skipped, "load", "parse", ["event_id", "raw"]).select(F.col("_seq").alias("event_id"), "exception_type", "exception_message", "skip_count_at_time")


@query("""SELECT event_id, CAST(least(event_id % 5 + 1, 3) AS INTEGER) AS attempts, CASE WHEN event_id % 5 + 1 <= 3 THEN 'written' ELSE 'skipped' END AS outcome FROM events""")
def retry_then_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step whose function answers at the first to fifth call, with three calls at most; who fails is skipped."""
    calls: dict[int, int] = {}

    def flaky(row: dict) -> dict:
        n = calls[row["event_id"]] = calls.get(row["event_id"], 0) + 1
        if n <= row["event_id"] % 5:
            raise ConnectionResetError("no answer")
        return {"event_id": row["event_id"], "attempts": n}

    class Skipped(ChunkListener):
        def on_skip(self, step: StepExecution, skipped: DataFrame, before: int) -> None:
            skipped.select(F.get_json_object("_item", "$.event_id").cast("long").alias("event_id"), F.col("_err.attempts").alias("attempts")).write.mode("append").parquet(lost)

    kept, lost = folder(spark, "retried"), folder(spark, "lost")
    source = FrameSource(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    policy = P.RetryPolicy(3, P.Classifier().retry(ConnectionError))
    ran(StepBuilder().source(source).processor(PythonMap(flaky, "event_id long, attempts int")).retry_policy(policy).skip_policy(P.ALWAYS).listener(Skipped()).sink(ParquetSink(kept)).chunk_size(100).chunks_per_commit(1 << 30).build("call"))
    outcome = lambda path, name: spark.read.parquet(path).select("event_id", "attempts", F.lit(name).alias("outcome"))
    return outcome(kept, "written").union(outcome(lost, "skipped"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'TimeoutError' END AS error, CAST(CASE WHEN event_id % 4 = 3 THEN 2 END AS INTEGER) AS attempts FROM events WHERE event_id % 4 <> 1")
def python_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(row: dict) -> dict | None:
        if row["event_id"] % 4 == 3:
            raise TimeoutError("no answer")
        return None if row["event_id"] % 4 == 1 else {"event_id": row["event_id"]}

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), "event_id")
    done = PythonMap(step, "event_id long", attempts=2).apply(rows)
    return done.select(F.col("_seq").alias("event_id"), F.get("_err.types", F.lit(0)).alias("error"), F.col("_err.attempts").alias("attempts"))


@query(f"""WITH r AS (SELECT *, event_id % 10 = 0 AS filtered FROM {_PARSED})
  SELECT count(*) AS read_count, CAST(sum(CASE WHEN filtered THEN 1 ELSE 0 END) AS BIGINT) AS filtered_count,
  CAST(sum(CASE WHEN NOT filtered AND amount IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS write_count,
  CAST(sum(CASE WHEN NOT filtered AND amount IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skip_count,
  CAST(ceil(sum(CASE WHEN NOT filtered AND amount IS NOT NULL THEN 1 ELSE 0 END) / 100.0) AS BIGINT) AS chunks FROM r""")
def step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a step leaves in the repository."""
    path, repository = folder(spark, "counted"), R.Repository()
    step = StepBuilder(repository).source(FrameSource(raw_events(spark, sf_dir), ["event_id"])).processor(Project(F.col("event_id") % 10 != 0), parsed())
    done = ran(step.skip_policy(P.ALWAYS).sink(ParquetSink(path)).chunk_size(100).chunks_per_commit(50).build("parse"))
    s = repository.last_step_execution(done.id, "parse")
    chunks = spark.read.parquet(path).select("_chunk").distinct().count()
    return spark.createDataFrame([(s.read_count, s.read_count - s.write_count - s.skip_count, s.write_count, s.skip_count, chunks)], "read_count long, filtered_count long, write_count long, skip_count long, chunks long")


# file sources: the tables are written as files first


def customer_lines(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "lines")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast(MONEY).cast("string"), "c_mktsegment").alias("v"))
    lines = rows.select("k", F.when(F.col("k") % 10 == 9, F.concat("v", F.lit("\n   "))).otherwise(F.col("v")).alias("v"))  # a blank line after every tenth
    head = spark.createDataFrame([(-1, "Id,Name,Balance,Segment")], "k long, v string")
    head.union(lines).orderBy("k").coalesce(1).select("v").write.text(path)
    return path


def customer_line(line) -> list:
    parts = S.fields(line)
    return [S.field_or_empty(parts, 0).cast("long").alias("id"), S.field_or_empty(parts, 1).alias("name"), S.parse_decimal(S.field_or_empty(parts, 2)).alias("balance"), S.field_or_empty(parts, 3).alias("segment"), S.field_or_empty(parts, 4).alias("missing")]


_LINES = """SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_mktsegment AS segment, '' AS missing, CAST(c_custkey + c_custkey // 10 + 2 AS BIGINT) AS line_no FROM customer"""


@query(_LINES)
def flat_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineSource(spark, customer_lines(spark, sf_dir), customer_line).open(Context()).withColumnRenamed("_seq", "line_no")


@query(f"SELECT * FROM ({_LINES}) WHERE line_no > 113")
def flat_file_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, context = LineSource(spark, customer_lines(spark, sf_dir), customer_line), Context()
    source.save(context, 113)
    return source.open(context).withColumnRenamed("_seq", "line_no")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 + n_nationkey // 5 AS BIGINT) AS pos FROM nation")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "json")
    item = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    items = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 5 == 4, F.concat(item, F.lit(",null"))).otherwise(item).alias("v"))
    whole = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), ",\n").alias("v"))
    whole.select(F.concat(F.lit("["), "v", F.lit("]"))).write.text(path)
    return JsonArraySource(spark, path, "id int, name string, region int").open().withColumnRenamed("_seq", "pos")


def nation_xml(spark: SparkSession, sf_dir: str) -> str:
    """Regions with their nations inside: elements at two depths of one document."""
    path = folder(spark, "xml")
    nation = F.concat(F.lit('<nation id="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), "n_name", F.lit("</name></nation>"))
    inner = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", nation.alias("x")))), lambda s: s["x"]), "").alias("x"))
    outer = table(spark, sf_dir, "region").join(inner, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.concat(F.lit("<region>"), "x", F.lit("</region>")).alias("x"))
    doc = outer.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "x"))), lambda s: s["x"]), "").alias("x"))
    doc.select(F.concat(F.lit("<world>"), "x", F.lit("</world>"))).write.text(path)
    return path


_XML = "SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS pos, n_nationkey AS id, n_name AS name FROM nation"


@query(_XML)
def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XmlSource(spark, nation_xml(spark, sf_dir), "nation", "id int, name string").open(Context()).withColumnRenamed("_seq", "pos")


@query(f"SELECT * FROM ({_XML}) WHERE pos > 7")
def xml_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, context = XmlSource(spark, nation_xml(spark, sf_dir), "nation", "id int, name string"), Context()
    source.save(context, 7)
    return source.open(context).withColumnRenamed("_seq", "pos")


_XML_FILES = "SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS pos, n_nationkey AS id, n_name AS name FROM nation"


@query(f"SELECT * FROM ({_XML_FILES}) WHERE pos > 7")
def xml_files_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, read as one source; it goes on inside the second file."""
    path = folder(spark, "xml-files")
    nation = F.concat(F.lit('<nation id="'), F.col("n_nationkey").cast("string"), F.lit('"><name>'), "n_name", F.lit("</name></nation>"))
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", nation.alias("x")))), lambda s: s["x"]), "").alias("x"))
    for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect():  # five regions
        files.where(F.col("n_regionkey") == r[0]).select(F.concat(F.lit("<world>"), "x", F.lit("</world>"))).coalesce(1).write.text(f"{path}/{r[0]}")
    source, context = XmlSource(spark, f"{path}/*/part-*", "nation", "id int, name string"), Context()
    source.save(context, 7)
    return source.open(context).withColumnRenamed("_seq", "pos")


# relational and HTTP sources


@query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders")
def keyset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KeysetSource(table(spark, sf_dir, "orders"), "o_orderkey").open(Context()).select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(MONEY).alias("amount"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700")
def keyset_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, context = KeysetSource(table(spark, sf_dir, "orders"), "o_orderkey"), Context()
    source.save(context, 700)
    return source.open(context).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def keyset_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return strictly_rising(rows, "l_orderkey", rows.columns).drop("l_extendedprice")


@query("""WITH x AS (SELECT event_id, user_id, max(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
  SELECT event_id, user_id FROM x WHERE high IS NULL OR user_id > high""")
def keyset_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strictly_rising(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", ["event_id"])


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 300, 100)


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS pos FROM orders QUALIFY pos > 1000")
def offset_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, context = OffsetSource(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]), Context()
    source.save(context, 1000)
    return source.open(context).withColumnRenamed("_seq", "pos")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 20")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    sql = "select o_orderkey, o_orderpriority from millrace_orders where o_orderstatus = :status order by o_orderkey limit :page_size offset :offset"
    return bound_query(spark, sql, {"status": "F", "offset": 0}, offset=20, page_size=50)


@query("SELECT r_regionkey AS id, r_name AS name, CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS pos FROM region")
def http_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.asDict() for r in table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).orderBy("id").collect()]  # five regions

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            n = int(parse_qs(urlparse(self.path).query)["page"][0])
            body = json.dumps(rows[2 * n - 2 : 2 * n]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return HttpSource(spark, f"http://127.0.0.1:{server.server_port}/regions?lang=en", "id int, name string").open().withColumnRenamed("_seq", "pos")


# sinks


@query("SELECT s AS sink, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation, (VALUES ('first'), ('second')) AS t(s) GROUP BY s")
def fanout_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {name: folder(spark, name) for name in ("first", "second")}
    rows = FrameSource(table(spark, sf_dir, "nation"), ["n_nationkey"]).open(Context()).withColumn("_chunk", F.expr("(_seq - 1) div 10"))
    CompositeSink([ParquetSink(p) for p in paths.values()]).write(rows, "copy", 0)
    parts = [spark.read.parquet(p).select(F.lit(name).alias("sink"), "n_nationkey") for name, p in paths.items()]
    return parts[0].union(parts[1]).groupBy("sink").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "json-out")
    step = StepBuilder().source(FrameSource(table(spark, sf_dir, "nation"), ["n_nationkey"])).sink(JsonArraySink(path.removeprefix("file://"))).chunk_size(4)
    ran(step.build("copy"))
    return JsonArraySource(spark, path, "n_nationkey int, n_name string, n_regionkey int").open().drop("_seq")


@query("SELECT vec_id, embedding, label FROM embeddings")
def array_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "arrays")
    rows = FrameSource(table(spark, sf_dir, "embeddings"), ["vec_id"]).open(Context()).withColumn("_chunk", F.expr("(_seq - 1) div 100"))
    ParquetSink(path).write(rows, "copy", 0)
    return spark.read.parquet(path).select("vec_id", "embedding", "label")


# ranges

_BOUNDS = """SELECT 'partition' || i AS "partition", CAST(lo + i * base AS BIGINT) AS min_value,
  CAST(lo + i * base + base - 1 + CASE WHEN i = {g} - 1 THEN total % {g} ELSE 0 END AS BIGINT) AS max_value
  FROM (SELECT {lo} AS lo, {total} AS total, ({total}) // {g} AS base), range({g}) AS r(i)"""


@query("WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS total FROM orders)" + _BOUNDS.format(g=7, lo="(SELECT lo FROM b)", total="(SELECT total FROM b)"))
def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds_frame(spark, range_of(table(spark, sf_dir, "orders"), "o_orderkey"), 7)


@query("WITH b AS (SELECT min(r_regionkey) AS lo, max(r_regionkey) - min(r_regionkey) + 1 AS total FROM region)" + _BOUNDS.format(g=8, lo="(SELECT lo FROM b)", total="(SELECT total FROM b)"))
def range_bounds_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds_frame(spark, range_of(table(spark, sf_dir, "region"), "r_regionkey"), 8)


@query("""WITH b AS (SELECT min(o_orderkey) AS lo, (max(o_orderkey) - min(o_orderkey) + 1) // 7 AS base FROM orders)
  SELECT 'partition' || least((o_orderkey - lo) // base, 6) AS "partition", count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount FROM orders, b GROUP BY 1""")
def range_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    part = F.concat(F.lit("partition"), range_of(orders, "o_orderkey").number_of(F.col("o_orderkey"), 7).cast("string"))
    return orders.groupBy(part.alias("partition")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("amount"))


@query("SELECT o_orderkey, sqrt(o_orderkey) AS root FROM orders")
def range_read_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = range_of(table(spark, sf_dir, "orders"), "o_orderkey").bounds(3)
    frames = [range_read(table(spark, sf_dir, "orders"), "o_orderkey", low, high).select("o_orderkey", F.sqrt("o_orderkey").alias("root")) for _, low, high in parts]
    return frames[0].union(frames[1]).union(frames[2])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'Failed' WHEN bool_or(o_orderstatus = 'P') THEN 'Stopped' ELSE 'Completed' END AS status FROM orders GROUP BY o_custkey""")
def partition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(folded_status(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P").alias("status"))


# stop and restart


@query("""WITH s AS (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS chunk FROM orders WHERE o_totalprice > 50000),
  n AS (SELECT (count(*) + 99) // 100 AS chunks FROM s) SELECT o_orderkey, chunk FROM s, n WHERE chunk < greatest((chunks // 3 + 4) // 5, 1) * 5""")
def graceful_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a step has written that is asked to stop when a third of its chunks are: whole groups of five chunks."""
    rows, path, stop = table(spark, sf_dir, "orders").where("o_totalprice > 50000").select("o_orderkey"), folder(spark, "stopped"), Stop()
    third = -(-rows.count() // 100) // 3

    class Asks(ChunkListener):
        def after_chunk(self, step: StepExecution, chunk: int) -> None:
            if chunk + 5 >= third:
                stop.request()

    step = StepBuilder().source(FrameSource(rows, ["o_orderkey"])).sink(ParquetSink(path)).chunk_size(100).chunks_per_commit(5).listener(Asks()).graceful_stop(stop).build("copy")
    ran(step, wanted=Status.STOPPED)
    return spark.read.parquet(path).select("o_orderkey", F.col("_chunk").alias("chunk"))


@query("""WITH s AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders WHERE o_totalprice > 50000)
  SELECT CASE WHEN chunk < 6 THEN 1 ELSE 2 END AS run, o_orderkey FROM s""")
def restart_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose sink fails at the seventh chunk, and its restart, which goes on behind the last commit."""
    rows, paths, repository = table(spark, sf_dir, "orders").where("o_totalprice > 50000").select("o_orderkey"), [folder(spark, f"run{i}") for i in (1, 2)], R.Repository()

    class Fails(ParquetSink):
        def prepare(self, rows: DataFrame, step: str) -> Callable[[int | None], None]:
            commit = super().prepare(rows, step)

            def checked(first_chunk: int | None) -> None:
                if first_chunk == 6:
                    raise OSError("disk full")
                commit(first_chunk)

            return checked

    source = KeysetSource(rows, "o_orderkey")
    ran(StepBuilder(repository).source(source).sink(Fails(paths[0])).chunk_size(100).chunks_per_commit(6).build("copy"), wanted=Status.FAILED)
    ran(StepBuilder(repository).source(source).sink(ParquetSink(paths[1])).chunk_size(100).chunks_per_commit(1 << 30).build("copy"))
    return spark.read.parquet(paths[0]).select(F.lit(1).alias("run"), "o_orderkey").union(spark.read.parquet(paths[1]).select(F.lit(2), "o_orderkey"))


# flows

RULES = [("load", "COMPLETED", "to", "check"), ("load", "*", "to", "repair"), ("repair", "COMPLETED", "to", "load"), ("repair", "FAILED", "fail", None), ("check", "COMPLETED", "to", "publish"), ("check", "*", "stop", None), ("publish", "*", "end", None), ("orphan", "*", "end", None)]
_RULES = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', {'NULL' if d is None else repr(d)})" for i, (a, b, c, d) in enumerate(RULES)) + ") AS t(ord, step, on_status, action, next)"


def flow() -> tuple[FlowBuilder, dict[str, TaskletStep]]:
    """A builder that has got the rules, and its steps."""
    repository = R.Repository()
    steps = {name: TaskletStep(repository, name, lambda _: Repeat.FINISHED) for name in dict.fromkeys(r[0] for r in RULES)}
    builder = FlowBuilder("flow", repository).start(steps["load"])
    for step, on, action, to in RULES:
        at = builder.from_(steps[step]).on(on)
        at.to(steps[to]) if action == "to" else {"end": at.end, "fail": at.fail, "stop": at.stop}[action]()
    return builder, steps


@query(f"WITH RECURSIVE rules AS (SELECT * FROM {_RULES}), r(step) AS (SELECT 'load' UNION SELECT rules.next FROM r JOIN rules USING (step) WHERE rules.next IS NOT NULL) SELECT step FROM r")
def flow_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s.name,) for s in flow()[0].reachable()], "step string")


@query(f"""WITH rules AS (SELECT * FROM {_RULES}), s AS (SELECT * FROM (SELECT DISTINCT step FROM rules), (VALUES ('COMPLETED'), ('FAILED'), ('STOPPED')) AS v(status))
  SELECT s.step, s.status, rules.action, rules.next FROM s JOIN rules ON rules.step = s.step AND rules.on_status IN (s.status, '*')
  QUALIFY row_number() OVER (PARTITION BY s.step, s.status ORDER BY CASE WHEN on_status = '*' THEN 1 ELSE 0 END, ord) = 1""")
def flow_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder, steps = flow()
    named = {Action.CONTINUE: "to", Action.END: "end", Action.FAIL: "fail", Action.STOP: "stop"}
    found = [(name, on, builder.transitions(step).match(on)) for name, step in steps.items() for on in (exit_status(s) for s in (Status.COMPLETED, Status.FAILED, Status.STOPPED))]
    return spark.createDataFrame([(name, on, named[r.action], r.to.name if r.to is not None else None) for name, on, r in found if r is not None], "step string, status string, action string, next string")


# the repository's lookups, with orders as executions of customers' jobs

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'P' THEN 'Started' ELSE 'Completed' END"


def executions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "P", "Started").otherwise("Completed")
    start = F.col("o_orderdate").cast("timestamp")
    took = F.expr("make_dt_interval(0, 0, 0, cast(o_orderkey * 37 as decimal(18,6)))")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_instance_id"), status.alias("status"), start.alias("start_time"), F.when(F.col("o_orderstatus") != "P", start + took).alias("end_time"), F.when(F.col("o_orderstatus") == "F", "late").alias("failure_message"))


def instances_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("job-"), F.lower("c_mktsegment")).alias("job_name"), F.lit("{}").alias("parameters_json"))


_EXEC = f"(SELECT o_orderkey AS id, o_custkey AS job_instance_id, {_STATUS} AS status, o_orderdate AS start_time, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey * 37) END AS end_time, CASE WHEN o_orderstatus = 'F' THEN 'late' END AS failure_message FROM orders)"
_DURATION = "CASE WHEN end_time IS NULL THEN '-' ELSE printf('%02d:%02d:%02d', epoch(end_time - start_time)::BIGINT // 3600, epoch(end_time - start_time)::BIGINT % 3600 // 60, epoch(end_time - start_time)::BIGINT % 60) END"


@query(f"SELECT job_instance_id, arg_max(id, id) AS id, arg_max(status, id) AS status FROM {_EXEC} GROUP BY 1")
def latest_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_by(executions_of(spark, sf_dir), "job_instance_id", "id").select("job_instance_id", "id", "status")


@query(f"SELECT job_instance_id, max(id) AS id FROM {_EXEC} WHERE status = 'Started' GROUP BY 1")
def running_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_by(executions_of(spark, sf_dir).where("status = 'Started'"), "job_instance_id", "id").select("job_instance_id", "id")


@query(f"""WITH e AS (SELECT * FROM {_EXEC} QUALIFY row_number() OVER (PARTITION BY job_instance_id ORDER BY id DESC) = 1)
  SELECT c_custkey AS id, 'job-' || lower(c_mktsegment) AS job_name, '{{}}' AS parameters_json, coalesce(e.status, '-') AS last_status,
  coalesce(strftime(e.start_time, '%Y-%m-%d %H:%M:%S'), '-') AS started, coalesce(strftime(e.end_time, '%Y-%m-%d %H:%M:%S'), '-') AS ended
  FROM customer LEFT JOIN e ON e.job_instance_id = c_custkey""")
def jobs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.jobs_view(instances_of(spark, sf_dir), executions_of(spark, sf_dir))


@query(f"""SELECT e.id, e.status, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started, coalesce(strftime(end_time, '%Y-%m-%d %H:%M:%S'), '-') AS ended, {_DURATION} AS duration, failure_message
  FROM {_EXEC} AS e JOIN customer ON c_custkey = job_instance_id WHERE lower(c_mktsegment) = 'building'""")
def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.executions_view(instances_of(spark, sf_dir), executions_of(spark, sf_dir), "job-building")


@query("""SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS id, 'step' || l_linenumber AS step_name,
  CASE l_linestatus WHEN 'F' THEN 'Failed' ELSE 'Completed' END AS status, CAST(l_quantity AS BIGINT) AS read_count, CAST(l_quantity AS BIGINT) - 1 AS write_count, CAST(1 AS BIGINT) AS skip_count, CAST(0 AS BIGINT) AS rollback_count, '-' AS duration
  FROM lineitem QUALIFY l_orderkey = 5""")
def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    lines = numbered(table(spark, sf_dir, "lineitem"), order, "at")
    quantity = F.col("l_quantity").cast("long")
    steps = lines.select((F.col("at") + 1).alias("id"), F.concat(F.lit("step"), F.col("l_linenumber").cast("string")).alias("step_name"), F.when(F.col("l_linestatus") == "F", "Failed").otherwise("Completed").alias("status"), quantity.alias("read_count"), (quantity - 1).alias("write_count"), F.lit(1).cast("long").alias("skip_count"), F.lit(0).cast("long").alias("rollback_count"), F.col("l_shipdate").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.col("l_orderkey").alias("job_execution_id"))
    return R.steps_view(steps, 5)


@query(f"SELECT id, CASE WHEN status = 'Failed' AND id = (SELECT max(id) FROM {_EXEC} WHERE status = 'Failed') THEN 'Abandoned' ELSE status END AS status FROM {_EXEC}")
def rerun_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = executions_of(spark, sf_dir).select("id", "status")
    last = rows.where("status = 'Failed'").agg(F.max("id")).first()[0]
    return R.abandoned(rows, F.lit(last))


@query("SELECT * FROM (VALUES (1, '{\"a\":\"1\",\"b\":\"2\"}', 'a=1, b=2'), (2, '{\"a\":\"1\",\"b\":\"2\"}', 'a=1, b=2'), (3, '{}', '(none)'), (4, '{}', '(none)')) AS t(id, canonical, shown)")
def param_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "2", "a": "1"}), (3, {}), (4, None)], "id int, p map<string,string>")
    return rows.select("id", S.canonical_parameters(F.col("p")).alias("canonical"), S.format_parameters(F.col("p")).alias("shown"))


@query(f"SELECT id, {_DURATION} AS duration FROM {_EXEC}")
def duration_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions_of(spark, sf_dir).select("id", S.format_duration(F.col("start_time"), F.col("end_time")).alias("duration"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  w(user_id, n, event_id, acquired, until) AS (SELECT user_id, n, event_id, true, ts + INTERVAL 30 MINUTE FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, e.event_id, e.ts >= w.until, CASE WHEN e.ts >= w.until THEN e.ts + INTERVAL 30 MINUTE ELSE w.until END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
  SELECT event_id, user_id, acquired FROM w""")
def lock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock attempts in order of time: one that meets a lock not yet expired is refused and changes nothing."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # a lock outlives no attempt that comes 30 minutes after its predecessor: those start afresh, so groups between them are short
    gap = F.when(F.coalesce(at - F.lag(at).over(order) >= 1_800_000_000, F.lit(True)), 1).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", at.alias("at"), gap.alias("gap")).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    tries = rows.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("at", "event_id"))).alias("tries"))
    start = F.struct(F.lit(-(1 << 62)).alias("until"), F.array().cast("array<struct<event_id:bigint,acquired:boolean>>").alias("out"))
    walk = F.aggregate("tries", start, lambda s, t: F.struct(F.when(t["at"] >= s["until"], t["at"] + 1_800_000_000).otherwise(s["until"]).alias("until"), F.concat(s["out"], F.array(F.struct(t["event_id"].alias("event_id"), (t["at"] >= s["until"]).alias("acquired")))).alias("out")), lambda s: s["out"])
    return tries.select("user_id", F.explode(walk).alias("x")).select("x.event_id", "user_id", "x.acquired")


@query("""WITH l AS (SELECT user_id, max(ts) AS last_beat FROM events GROUP BY user_id) SELECT user_id, last_beat FROM l WHERE last_beat < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE""")
def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stale(table(spark, sf_dir, "events"), "user_id", "ts", timedelta(minutes=60))


@query("SELECT r_regionkey AS turn, CASE WHEN r_regionkey < 4 THEN 'Continuable' ELSE 'Finished' END AS status FROM region")
def tasklet_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    repository = R.Repository()
    instance = repository.instance("tasklet", Parameters())
    job = repository.create_job_execution(instance, Parameters())
    turns: list[tuple[int, str]] = []
    last = table(spark, sf_dir, "region").count() - 1

    def work(_) -> Repeat:
        out = Repeat.CONTINUABLE if len(turns) < last else Repeat.FINISHED
        turns.append((len(turns), out.value))
        return out

    TaskletStep(repository, "count", work).execute(job)
    return spark.createDataFrame(turns, "turn int, status string")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'http://h/x?a=1&page=' ELSE 'http://h/x?page=' END || (event_id % 7 + 1) AS url FROM events")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("event_id") % 2 == 0, "http://h/x?a=1").otherwise("http://h/x")
    return table(spark, sf_dir, "events").select("event_id", S.page_url(base, F.col("event_id") % 7 + 1).alias("url"))


@query("""SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 50 AS BIGINT) AS chunk FROM conversations""")
def chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 50, "chunk")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pipeline(spark, sf_dir)
