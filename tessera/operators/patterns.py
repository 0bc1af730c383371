"""Complex-event patterns over keyed, ordered events.

Order-dependent matching is a chain of grouped minima, or a scan in two levels in which a key with very many events goes
in bins (operators.scans); no key's events are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import BIN_ROWS, carried, runs_of, sequence_within

SEQUENCE_ROWS = 10_000  # events of a key that are folded at a time

ALLEN = {
    "before": lambda a, b: a[1] < b[0], "after": lambda a, b: a[0] > b[1], "meets": lambda a, b: a[1] == b[0], "met_by": lambda a, b: a[0] == b[1],
    "overlaps": lambda a, b: (a[0] < b[0]) & (b[0] < a[1]) & (a[1] < b[1]), "overlapped_by": lambda a, b: (b[0] < a[0]) & (a[0] < b[1]) & (b[1] < a[1]),
    "during": lambda a, b: (a[0] > b[0]) & (a[1] < b[1]), "includes": lambda a, b: (a[0] < b[0]) & (a[1] > b[1]),
    "starts": lambda a, b: (a[0] == b[0]) & (a[1] < b[1]), "started_by": lambda a, b: (a[0] == b[0]) & (a[1] > b[1]),
    "finishes": lambda a, b: (a[1] == b[1]) & (a[0] > b[0]), "finished_by": lambda a, b: (a[1] == b[1]) & (a[0] < b[0]),
    "equals": lambda a, b: (a[0] == b[0]) & (a[1] == b[1]), "coincides": lambda a, b: (a[0] <= b[1]) & (b[0] <= a[1]),
}


def allen(relation: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """A relation between intervals (start, end)."""
    return ALLEN[relation](a, b)


def followed_by(df: DataFrame, key: str, kind: str, order: list[str], steps: list[str], within: int | None = None, bin_rows: int = SEQUENCE_ROWS) -> DataFrame:
    """key, matched: whether the kinds occur in order, for keys with any of them; ``within`` seconds from first to last.

    Without a limit each step is the earliest event after the step before, one grouped minimum a step. With one, bins of
    a key's events become maps of states that compose (see sequence_within). Either way no key's events are gathered.
    """
    named = df.where(F.col(kind).isin(steps))
    if within is not None:
        return sequence_within(named, key, order, kind, steps, within, bin_rows)
    keys = named.select(key).distinct()
    at = F.struct(*order)
    reached = named.where(F.col(kind) == steps[0]).groupBy(key).agg(F.min(at).alias("reached"))
    for s in steps[1:]:
        nxt = named.where(F.col(kind) == s).join(reached, key).where(at > F.col("reached"))
        reached = nxt.groupBy(key).agg(F.min(at).alias("reached"))
    return keys.join(reached, key, "left").select(key, F.col("reached").isNotNull().alias("matched"))


def contiguous(df: DataFrame, key: str, kind: str, order: list[str], steps: list[str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows that begin a strict sequence: the key's next events are exactly the steps."""
    return runs_of(df, [key], order, kind, steps, bin_rows)


def not_next(df: DataFrame, key: str, kind: str, order: list[str], first: str, never: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows of ``first`` whose key's next event is not ``never``, or that have none."""
    out = carried(df, [key], order, F.struct(F.col(kind).alias("kind")), "_next", backwards=True, inclusive=False, bin_rows=bin_rows)
    return out.where((F.col(kind) == first) & ~F.col("_next.kind").eqNullSafe(F.lit(never))).drop("_next")


def not_followed_by(df: DataFrame, key: str, kind: str, order: list[str], first: str, never: str, within: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows of ``first`` without ``never`` in the key's next ``within`` seconds."""
    named = df.where(F.col(kind).isin(first, never))
    out = carried(named, [key], order, F.when(F.col(kind) == never, F.unix_micros(order[0])), "_nxt", backwards=True, inclusive=False, bin_rows=bin_rows).where(F.col(kind) == first)
    return out.where(F.col("_nxt").isNull() | (F.col("_nxt") > F.unix_micros(order[0]) + within * 1_000_000)).drop("_nxt")


def until(df: DataFrame, key: str, kind: str, order: list[str], counted: str, stop: str) -> DataFrame:
    """How many of ``counted`` each key has before its first ``stop``: a grouped minimum and a count, no key is sorted."""
    at = F.struct(*order)
    first = df.where(F.col(kind) == stop).groupBy(F.col(key).alias("_k")).agg(F.min(at).alias("_first"))
    open_ = F.col("_first").isNull() | (at < F.col("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_k")), "left").groupBy(key).agg(F.count_if(open_ & (F.col(kind) == counted)).alias("n"))


def sliding_rate_limit(df: DataFrame, key: str, ts: str, tie: str, most: int, seconds: int) -> DataFrame:
    """key, tie, admitted: whether fewer than ``most`` admitted requests lie in the last ``seconds``; rejected ones don't count.

    Admission feeds back, so each key is folded in time order; what is carried is the last ``most`` admissions, one key's
    rows are streamed through an Arrow iterator, and memory does not grow with the key.
    """
    import pyarrow as pa

    def run(batches):
        held: dict = {"key": None, "at": []}
        for batch in batches:
            out = []
            for k, micros in zip(batch.column("k").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if k != held["key"]:
                    held = {"key": k, "at": []}
                live = [a for a in held["at"] if a > micros - seconds * 1_000_000]
                ok = len(live) < most
                held["at"] = [*live, micros] if ok else live
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(out, pa.bool_())], names=["k", "id", "admitted"])

    rows = df.select(F.col(key).alias("k"), F.col(tie).alias("id"), F.unix_micros(ts).alias("at"))
    out = rows.repartition("k").sortWithinPartitions("k", "at", "id").mapInArrow(run, f"k {dict(df.dtypes)[key]}, id {dict(df.dtypes)[tie]}, admitted boolean")
    return out.select(F.col("k").alias(key), F.col("id").alias(tie), "admitted")


def matches(df: DataFrame, key: str, kind: str, order: list[str], tree: tuple) -> DataFrame:
    """The keys for which a rule document's tree holds.

    ("event", condition): any event with it. ("threshold", condition, n): n or more. ("absence", condition): none.
    ("sequence", kinds) and ("sequence", kinds, seconds): the kinds in order, within that time. ("window", condition, n,
    seconds): n or more in a tumbling window of that length. ("and" | "or", trees...) and ("not", tree) combine them.
    Conditions are SQL text. Every leaf is one grouped pass; leaves meet on the key.
    """
    what, *rest = tree
    keys = df.select(key).distinct()
    if what == "and":
        return reduce(lambda a, b: a.join(b, key, "left_semi"), (matches(df, key, kind, order, t) for t in rest))
    if what == "or":
        return reduce(DataFrame.union, (matches(df, key, kind, order, t) for t in rest)).distinct()
    if what == "not":
        return keys.join(matches(df, key, kind, order, rest[0]), key, "left_anti")
    if what == "sequence":
        return followed_by(df, key, kind, order, rest[0], *rest[1:]).where("matched").select(key)
    hits = F.count_if(F.expr(rest[0]))
    if what == "window":
        at = F.floor(F.unix_micros(order[0]) / (rest[2] * 1_000_000))
        return df.groupBy(key, at.alias("_window")).agg(hits.alias("_n")).where(F.col("_n") >= rest[1]).select(key).distinct()
    least = {"event": lambda n: n >= 1, "absence": lambda n: n == 0, "threshold": lambda n: n >= rest[1]}
    if what not in least:
        raise ValueError(f"no rule {what!r}")
    return df.groupBy(key).agg(hits.alias("_n")).where(least[what](F.col("_n"))).select(key)


def one_by_one(df: DataFrame, key: str, order: list[str], failed: Column, stop: bool = True) -> DataFrame:
    """key, total, completed, failed of items run in order; with ``stop`` nothing runs after the first failure.

    The first failure is a grouped minimum, so no key's items are sorted or gathered.
    """
    at = F.struct(*order)
    items = df.select(key, at.alias("_at"), F.coalesce(failed, F.lit(True)).alias("_failed"))
    if not stop:
        return items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_failed")).alias("completed"), F.count_if("_failed").alias("failed"))
    first = items.where("_failed").groupBy(key).agg(F.min("_at").alias("_first"))
    ran = items.join(first, key, "left")
    return ran.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_first").isNull() | (F.col("_at") < F.col("_first"))).alias("completed"), F.max(F.when(F.col("_first").isNotNull(), 1).otherwise(0)).cast("long").alias("failed"))
