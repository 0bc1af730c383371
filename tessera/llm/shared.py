"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the operators' contracts: a word is a maximal run of characters that are neither space nor \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach: spark.checkpoint.dir.

    Where that is unset, a local session, whose executors are this process, gets a folder of its own; on a cluster it is an
    error, as no machine's own folder is one that all can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side is broadcast only if the bytes of its rows, added up, are at most this.
BROADCAST_BYTES = 32 << 20


def checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if the bytes of its rows, added up, allow it; else as it is, and Spark shuffles."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.select(F.sum(width.cast("long")).alias("n")).first()["n"] or 0) <= limit else df


def text_of(column: str = "text") -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python in small Arrow batches, unless the session has a setting of its own: ten thousand texts at a time are hundreds of MB outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


_held: dict[str, object] = {}


def held(name: str, make):
    """What a Python worker needs for many batches, made once. There is room for one such thing: the next operator's takes the place of the last one's."""
    if name not in _held:
        released()
        _held[name] = make()
    return _held[name]


def released() -> None:
    """For tasks that hold nothing of the kind: a worker that is used again gives back what the operator before it held."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps freed memory otherwise
        trim(0)


def slices(texts: list[str], most: int = 2_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, one text at least."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= most:
            n += len(texts[end])
            end += 1
        yield at, end
        at = end
