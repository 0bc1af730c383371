"""Ingestion in named steps: rows that a step can't take go to an error table with the step's name, in the same pass as the others.

A step is a set of columns that never raise (``try_`` forms) and a condition that says what is wrong with a row. What failed
once is not touched by later steps. One table is written, parted by outcome, and both results are read from it; counts of
each step are observed while it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..catalog import shared_path


@dataclass(frozen=True)
class Step:
    """``adds``: columns by name, over what the steps before made. ``error``: what is wrong with a row, null if nothing; it may use the columns added. ``explode``: (name, array) to make a row of each element of; an empty one is the error ``nothing``."""

    adds: dict[str, Column] = field(default_factory=dict)
    error: Column | None = None
    explode: tuple[str, Column] | None = None
    nothing: str = "nothing to store"


@dataclass(frozen=True)
class Ingested:
    rows: DataFrame
    errors: DataFrame  # the input's columns, failed_step and error
    counts: dict[str, int]  # failed rows by step; "stored": rows that went through

    def failed(self) -> int:
        return sum(n for step, n in self.counts.items() if step != "stored")


def ingest(df: DataFrame, workflow: list[str], steps: dict[str, Step], check: Callable[[DataFrame], None] | None = None) -> Ingested:
    """The steps named by ``workflow``, in order, over every row.

    An empty workflow and a step that ``steps`` lacks are errors before anything is read. Each input row ends in ``errors``
    once, or in ``rows`` once (once for each element where a step explodes). Added columns must not have names of the input.
    Repeated rows are taken each; an empty table gives two empty ones.
    """
    if not workflow:
        raise ValueError("a workflow needs a step")
    if unknown := [s for s in workflow if s not in steps]:
        raise ValueError(f"no step {unknown[0]!r}; there are {', '.join(steps)}")
    given = list(df.columns)
    if clash := {c for s in workflow for c in steps[s].adds} & set(given):
        raise ValueError(f"the input has a column {min(clash)!r} already")
    out = df.withColumns({"failed_step": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    ok = F.col("failed_step").isNull()
    for name in workflow:
        step = steps[name]
        for column, value in step.adds.items():
            out = out.withColumn(column, F.when(ok, value))
        wrong = step.error if step.error is not None else F.lit(None).cast("string")
        if step.explode:
            wrong = F.coalesce(wrong, F.when(F.coalesce(F.size(step.explode[1]), F.lit(0)) <= 0, F.lit(step.nothing)))
        out = out.withColumn("error", F.coalesce("error", F.when(ok, wrong)))
        out = out.withColumn("failed_step", F.when(ok & F.col("error").isNotNull(), F.lit(name)).otherwise(F.col("failed_step")))
        if step.explode:
            column, array = step.explode
            out = out.select("*", F.explode_outer(F.when(ok, array)).alias(column))
    seen = Observation()
    out = out.observe(seen, F.count_if(ok).alias("stored"), *(F.count_if(F.col("failed_step") == s).alias(s) for s in dict.fromkeys(workflow)))
    path = shared_path(df.sparkSession, "ingested")
    out.withColumn("outcome", F.when(ok, "stored").otherwise("failed")).write.partitionBy("outcome").parquet(path)
    table = df.sparkSession.read.schema(out.schema.add("outcome", "string")).parquet(path)
    return Ingested(table.where("outcome = 'stored'").drop("failed_step", "error", "outcome"), table.where("outcome = 'failed'").select(*given, "failed_step", "error"), dict(seen.get))
