"""Source and sink queries: what is written to the shared folder in a format is read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, shared_path
from ..sources import readers as R
from ..sources.ingestion import Step
from ..sources.ingestion import ingest as ingest_table


@query("csv_coerced", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_acctbal > 5000 AS rich FROM customer")
def csv_coerced(t):
    path = shared_path(t.spark, "csv")
    t.customer.withColumn("rich", F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no")).write.option("header", True).csv(path)
    kinds = {"c_custkey": "long", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "rich": "boolean"}
    return R.read_delimited(t.spark, path, kinds).select(*kinds)


@query("tsv_as_text", "SELECT cast(n_nationkey AS VARCHAR) AS n_nationkey, n_name, cast(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def tsv_as_text(t):
    path = shared_path(t.spark, "tsv")
    t.nation.write.option("header", True).option("sep", "\t").csv(path)
    return R.read_delimited(t.spark, path, sep="\t")


@query("fixed_width", "SELECT p_partkey, p_size, p_brand FROM part")
def fixed_width(t):
    path = shared_path(t.spark, "fixed")
    t.part.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, " "), F.lpad(F.col("p_size").cast("string"), 4, " "), F.rpad("p_brand", 12, " ")).alias("value")).write.text(path)
    return R.read_fixed_width(t.spark, path, [("p_partkey", 0, 10, "long"), ("p_size", 10, 4, "int"), ("p_brand", 14, 12, "string")])


@query("json_lines", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_lines(t):
    path = shared_path(t.spark, "json")
    t.orders.select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("o")).write.json(path)
    return R.read_json(t.spark, path, "o_orderkey long, o struct<o_orderstatus:string,o_totalprice:double>").select("o_orderkey", "o.*")


@query("variant_paths", "SELECT o_orderkey, o_orderstatus FROM orders")
def variant_paths(t):
    path = shared_path(t.spark, "variant")
    t.orders.select("o_orderkey", F.struct("o_orderstatus").alias("o")).write.json(path)
    v = R.read_json(t.spark, path)
    return v.select(F.variant_get("value", "$.o_orderkey", "long").alias("o_orderkey"), F.variant_get("value", "$.o.o_orderstatus", "string").alias("o_orderstatus"))


@query("xml_rows", "SELECT n_nationkey, n_name FROM nation")
def xml_rows(t):
    path = shared_path(t.spark, "xml")
    t.nation.select("n_nationkey", "n_name").write.option("rowTag", "nation").option("rootTag", "nations").xml(path)
    return R.read_xml(t.spark, path, "nation", "n_nationkey int, n_name string")


@query("orc_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def orc_round_trip(t):
    path = shared_path(t.spark, "orc")
    t.supplier.write.orc(path)
    return t.spark.read.orc(path).select("s_suppkey", "s_name", "s_acctbal")


@query("series_range", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'")
def series_range(t):
    """Written by day, read by range: other days' folders are pruned."""
    path = shared_path(t.spark, "series")
    R.write_series(t.events, path, "ts")
    rows = t.spark.read.parquet(path).where("day BETWEEN date'2024-01-05' AND date'2024-01-09'")
    return R.range_read(rows, "ts", "2024-01-05 06:00:00", "2024-01-09 00:00:00").select("event_id", "value")


@query("keyed_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def keyed_latest(t):
    return R.latest(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("keyed_upsert", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def keyed_upsert(t):
    changes = t.customer.where("c_nationkey = 3").select("c_custkey", F.lit("moved").alias("c_mktsegment"))
    return R.upsert(t.customer.select("c_custkey", "c_mktsegment"), changes, ["c_custkey"])


@query("syslog_lines", "SELECT 'host' || (user_id % 3) AS host, count(*) AS n, max(event_id) AS last_pid FROM events GROUP BY 1")
def syslog_lines(t):
    line = F.concat(F.lit("<34>"), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), F.col("user_id") % 3, F.lit(" app["), F.col("event_id"), F.lit("]: "), F.col("event_type"))
    parsed = R.parse_syslog(t.events.select(line.alias("value")))
    return parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("pid").cast("long").alias("last_pid"))


@query("cef_lines", "SELECT event_type AS name, count(*) AS n, max(user_id) AS most FROM events GROUP BY 1")
def cef_lines(t):
    line = F.concat(F.lit("CEF:0|acme|probe|1.0|100|"), F.col("event_type"), F.lit("|5|src=10.0.0.1 user="), F.col("user_id"))
    parsed = R.parse_cef(t.events.select(line.alias("value")))
    return parsed.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("extension")["user"].cast("long")).alias("most"))


@query("bulk_lines", "SELECT CASE WHEN event_id % 3 = 0 THEN 'delete' WHEN event_id % 3 = 1 THEN 'update' ELSE 'index' END AS action, count(*) AS n, sum(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END)::BIGINT AS users FROM events GROUP BY 1")
def bulk_lines(t):
    m = F.col("event_id") % 3
    name = F.when(m == 0, "delete").when(m == 1, "update").otherwise("index")
    head = F.concat(F.lit('{"'), name, F.lit('":{"_index":"e","_id":"'), F.col("event_id"), F.lit('"}}'))
    doc = F.concat(F.when(m == 1, F.lit('{"doc":')).otherwise(F.lit("")), F.lit('{"user":'), F.col("user_id"), F.lit("}"), F.when(m == 1, F.lit("}")).otherwise(F.lit("")))
    lines = t.events.select("user_id", F.posexplode(F.when(m == 0, F.array(head)).otherwise(F.array(head, doc))).alias("i", "value"), "event_id")
    numbered = lines.select(F.col("user_id").alias("source"), (F.col("event_id") * 2 + F.col("i")).alias("line_no"), "value")
    out = R.parse_bulk(numbered)
    return out.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("document", "$.user").cast("long")).alias("users"))


def _steps() -> tuple[list[str], dict]:
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)")
    return ["parse", "check", "chunk", "store"], {
        "parse": Step({"k": k}, F.when(F.col("k").isNull(), "no number")),
        "check": Step(error=F.when(F.col("value") > 150, F.lit("value over 150")).when(F.col("event_type") == "error", F.lit("is an error"))),
        "chunk": Step(explode=("part", F.expr("CASE WHEN k % 4 > 0 THEN sequence(1, k % 4) ELSE array() END"))),
        "store": Step({"stored_as": F.concat_ws(":", "event_id", "part")}),
    }


_FAILED = "CASE WHEN k IS NULL THEN 'parse' WHEN value > 150 OR event_type = 'error' THEN 'check' WHEN k % 4 <= 0 THEN 'chunk' END"
_PARSED = "(SELECT *, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query("ingest_events", f"SELECT event_id, cast(part AS INTEGER) AS part, event_id || ':' || part AS stored_as FROM (SELECT event_id, unnest(range(1, k % 4 + 1)) AS part FROM {_PARSED} WHERE {_FAILED} IS NULL)")
def ingest_events(t):
    """Events in four named steps; what a step can't take is in ingest_event_errors."""
    return ingest_table(t.events, *_steps()).rows.select("event_id", "part", "stored_as")


@query("ingest_event_errors", f"SELECT event_id, {_FAILED} AS failed_step, CASE WHEN k IS NULL THEN 'no number' WHEN value > 150 THEN 'value over 150' WHEN event_type = 'error' THEN 'is an error' ELSE 'nothing to store' END AS error FROM {_PARSED} WHERE {_FAILED} IS NOT NULL")
def ingest_event_errors(t):
    return ingest_table(t.events, *_steps()).errors.select("event_id", "failed_step", "error")
