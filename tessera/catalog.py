"""Where queries are registered, and the helpers that they share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A side is broadcast only if Spark's own estimate of it is below this.
BROADCAST_BYTES = 32 << 20


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) as a query; ``sql`` is what it is checked against."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


class Tables:
    """The tables of one folder as attributes; only what a query selects is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Wall-clock timestamps are read as UTC instants, so that watermarks and windows take them.
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table with a broadcast hint if its rows times their widths, added up, allow it; else as it is, and Spark shuffles.

    Counts what is there: for written tables and other cheap plans, as the plan runs once for the count.
    """
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t in ("string", "binary") else F.coalesce(8 * F.size(c), F.lit(0)) + 16 if re.match(r"array<(big)?(int|long|double|float)", t) else F.lit(64 if "<" in t else 16) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.select(F.sum(width.cast("long")).alias("n")).first()["n"] or 0) <= limit else df


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side with a broadcast hint if Spark's estimate allows it and, as that is the size of the files for a stored table, so do its rows; else as it is."""
    return checked(df, limit) if estimated_bytes(df) <= limit else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors reach. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
