"""Readers and writers: delimited and fixed-width text, JSON, XML, logs, key-value and time-series tables."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalog import small


def coerced(text: Column, kind: str, default=None) -> Column:
    """Text as a type: blank is the default, what can't be read is null."""
    c = F.when(F.trim(text) != "", F.trim(text))
    if kind == "boolean":
        out = F.when(c.isNotNull(), F.lower(c).isin("true", "1", "yes"))
    elif kind == "binary":
        out = F.try_to_binary(c, F.lit("base64"))
    elif kind == "uuid":
        out = F.when(c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c))
    elif kind == "string":
        out = c
    else:
        out = c.try_cast({"float": "float", "long": "bigint"}.get(kind, kind))
    return out if default is None else F.coalesce(out, F.lit(default).cast(out_type(kind)))


def out_type(kind: str) -> str:
    return {"uuid": "string", "long": "bigint"}.get(kind, kind)


def read_delimited(spark: SparkSession, path: str, columns: dict[str, str] | None = None, sep: str = ",", encoding: str = "UTF-8", defaults: dict | None = None, skip_rows: int = 0, header_row: int | None = 0) -> DataFrame:
    """A table with a header row. With ``columns`` (name -> type) values are coerced and <name>_raw keeps what could not be read; without, all are strings.

    ``skip_rows`` lines at the top of each file are passed over; of those after, line ``header_row`` names the columns and
    what stands before it goes too. None: no header, columns are c0, c1 and so on. Quoted fields don't go over lines.
    """
    if not skip_rows and header_row == 0:
        raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    else:
        raw = _below_header(spark, path, sep, encoding, skip_rows, header_row)
    if not columns:
        return raw
    out = []
    for name, kind in columns.items():
        value = coerced(F.col(f"`{name}`"), kind, (defaults or {}).get(name))
        out.append(value.alias(name))
        if kind not in ("string", "boolean"):
            out.append(F.when(value.isNull() & (F.trim(f"`{name}`") != ""), F.col(f"`{name}`")).alias(f"{name}_raw"))
    return raw.select(*out)


def _below_header(spark: SparkSession, path: str, sep: str, encoding: str, skip_rows: int, header_row: int | None) -> DataFrame:
    """Lines are counted from the start of each file's first block, so only what lies there can be passed over."""
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("top"), F.monotonically_increasing_id().alias("at"))
    tops = lines.where("top").groupBy(F.col("file").alias("of")).agg(F.min("at").alias("begin"))
    line = F.when(F.col("top"), F.col("at") - F.col("begin"))
    numbered = lines.join(small(tops), F.col("file") == F.col("of")).withColumn("line", line)
    first = skip_rows + (header_row if header_row is not None else 0)
    top = numbered.where(F.col("line") == first).orderBy("file").limit(1).collect()
    options = {"sep": sep, "quote": '"', "escape": '"'}
    fields = next(csv.reader([top[0]["value"]], delimiter=sep)) if top else []
    names = [n if header_row is not None and n else f"c{i}" for i, n in enumerate(fields)]
    kept = numbered.where(F.col("line").isNull() | (F.col("line") > first if header_row is not None else F.col("line") >= first)).where(F.trim("value") != "")
    if not names:
        return kept.select().limit(0)
    parsed = F.from_csv("value", F.lit(", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)), options)
    return kept.select(parsed.alias("r")).select("r.*")


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """Fields (name, start from 0, width, type) of each line."""
    lines = spark.read.text(path)
    return lines.select(*(coerced(F.substring("value", start + 1, width), kind).alias(name) for name, start, width, kind in fields))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; without a schema each line is a VARIANT in column value."""
    return spark.read.schema(schema).json(path) if schema else spark.read.text(path).select(F.try_parse_json("value").alias("value"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.option("rowTag", row_tag).schema(schema).xml(path)


SYSLOG = r"^(?:<(\d+)>)?([A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: (.*)$"
CEF = r"^(?:.*?)CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"


def parse_syslog(lines: DataFrame, text: str = "value") -> DataFrame:
    """priority, at, host, program, pid, message; lines that are none are left out."""
    part = lambda i: F.regexp_extract(text, SYSLOG, i)
    return lines.where(F.col(text).rlike(SYSLOG)).select(
        part(1).try_cast("int").alias("priority"), part(2).alias("at"), part(3).alias("host"), part(4).alias("program"), part(5).try_cast("int").alias("pid"), part(6).alias("message"),
    )


def parse_cef(lines: DataFrame, text: str = "value") -> DataFrame:
    """version, vendor, product, device_version, signature, name, severity, and the extension's key=value pairs as a map."""
    part = lambda i: F.regexp_extract(text, CEF, i)
    names = ["version", "vendor", "product", "device_version", "signature", "name", "severity"]
    pairs = F.filter(F.split(F.regexp_replace(part(8), r" (?=\w+=)", "\n"), "\n"), lambda x: F.contains(x, F.lit("=")))
    return lines.where(F.col(text).rlike(CEF)).select(*(part(i + 1).alias(n) for i, n in enumerate(names)), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^([^=]+)=", 1), F.regexp_extract(x, "^[^=]+=(.*)$", 1)))).alias("extension"))


def parse_bulk(lines: DataFrame, order: str = "line_no", text: str = "value", source: str = "source") -> DataFrame:
    """Bulk logs of one file each: an action line, and but for delete the document line after it; update unwraps doc. Bad lines are skipped."""
    w = Window.partitionBy(source).orderBy(order)
    action = F.regexp_extract(text, r'^\s*\{\s*"(index|create|update|delete)"\s*:', 1)
    rows = lines.withColumn("action", action).withColumns({"nxt": F.lead(text).over(w), "nxt_action": F.lead("action").over(w)})
    body = F.when(F.col("action") == "update", F.get_json_object("nxt", "$.doc")).otherwise(F.col("nxt"))
    meta = lambda k: F.coalesce(*(F.get_json_object(text, f"$.{a}.{k}") for a in ("index", "create", "update", "delete")))
    out = rows.where("action <> ''").select("action", meta("_index").alias("index_name"), meta("_id").alias("id"), F.when(F.col("action") != "delete", body).alias("document"))
    return out.where("action = 'delete' OR document IS NOT NULL")


def parse_xes(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, pos, activity, at): one row for each event of each trace."""
    pair = "array<struct<_key:string,_value:string>>"
    traces = read_xml(spark, path, "trace", f"string {pair}, event array<struct<string:{pair},date:{pair}>>")
    value = lambda xs, key: F.get(F.filter(xs, lambda x: x["_key"] == key), 0)["_value"]
    each = traces.select(value(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("pos", "e"))
    return each.select("case_id", "pos", value(F.col("e.string"), "concept:name").alias("activity"), value(F.col("e.date"), "time:timestamp").alias("at"))


def range_read(df: DataFrame, ts: str, start: str, stop: str) -> DataFrame:
    """start <= ts < stop, which reaches the scan's partitions and row groups."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(stop).cast("timestamp")))


def write_series(df: DataFrame, path: str, ts: str) -> None:
    """Append-only measurements by day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """A keyed table from its versions: of each key the row with the highest version."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*version)).alias("r")).select("r.*")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Changed rows in place of those with their key."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def inferred_schema(spark: SparkSession, sample: DataFrame, column: str) -> T.StructType:
    """The schema of JSON text from one grouped aggregate over all rows."""
    merged = sample.select(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))").alias("s")).first()["s"]
    return T.StructType.fromDDL(f"v {merged.replace('OBJECT<', 'STRUCT<')}") if merged else T.StructType([])
