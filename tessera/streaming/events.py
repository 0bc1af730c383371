"""Structured Streaming forms of the event operators: windows with watermarks, rules, correlation, keyed state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import shared_path


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", per_trigger: int | None = None) -> DataFrame:
    """A table, a file or a folder of part files, as a stream; wall-clock times become UTC instants.

    A finished table's files are in no order of time, so all of them go into one trigger and no watermark finds a row late;
    ``per_trigger`` bounds the files of a trigger where they are known to be in order. The last letter of the path is a
    pattern, as Spark takes a single file for a folder otherwise.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(f"{sf_dir}/{table}.parque[t]")
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def windowed(stream: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour", by: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Counts and sums by tumbling or sliding event-time window; rows later than ``delay`` are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, gap: str, delay: str = "1 hour", by: str = "user_id", ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def correlated(left: DataFrame, right: DataFrame, by: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """Pairs of messages with the same key, the right one at most ``seconds`` after the left: state is dropped by watermark."""
    one = left.withWatermark("ts", delay).select(F.col(by).alias("k"), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    two = right.withWatermark("ts", delay).select(F.col(by).alias("k2"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    return one.join(two, F.expr(f"k = k2 AND right_ts > left_ts AND right_ts <= left_ts + interval {seconds} seconds")).select("k", "left_id", "right_id")


def last_values(stream: DataFrame, by: str = "user_id", keep: int = 5) -> DataFrame:
    """The last ``keep`` values of each key by time after every trigger, in whatever order they come, as keyed state (a count window)."""

    def update(key, batches, state):
        held = pd.DataFrame([tuple(x) for x in state.get[0]] if state.exists else [], columns=["ts", "event_id", "value"])
        for batch in batches:
            rows = batch[["ts", "event_id", "value"]].assign(ts=batch["ts"].astype("datetime64[us]").astype("int64"))
            held = (pd.concat([held, rows]) if len(held) else rows).sort_values(["ts", "event_id"]).tail(keep)
        state.update(([(int(t), int(i), float(v)) for t, i, v in held.itertuples(index=False)],))
        yield pd.DataFrame({by: [key[0]], "n": [len(held)], "avg_last": [held["value"].sum(skipna=False) / len(held)]})

    return stream.groupBy(by).applyInPandasWithState(update, f"{by} long, n long, avg_last double", "held array<struct<ts:long,event_id:long,value:double>>", "update", "NoTimeout")


def run_to_end(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Processes all that is there and returns the sink's table: the last trigger's rows for mode "complete", else all rows.

    The sink and its checkpoint lie in the shared folder; a batch that is run again overwrites its own output.
    """
    spark, base = stream.sparkSession, shared_path(stream.sparkSession, name)
    out = f"{base}/out"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch=0" if mode == "complete" else f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(out)


def with_rules(rules: dict[str, Callable]) -> Callable[[DataFrame], DataFrame]:
    """Adds rules_triggered, the names of the rules that hold for a row."""
    hits = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return lambda df: df.withColumn("rules_triggered", F.array_join(hits, ","))
