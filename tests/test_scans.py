"""Two-level scans: the same as brute force whatever the size of bins, and even tasks where one key has most rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, mining, patterns, scans

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
KINDS = ["view", "click", "purchase", "error"]


def made(seed, n=400):
    """Nine of ten events are one user's; many share an instant; one user is null."""
    rng = random.Random(seed)
    return [(i, T0 + timedelta(seconds=rng.randrange(n) * 60), rng.choice([None, 2, 3]) if rng.random() < 0.1 else 1, rng.choice(KINDS), float(rng.randrange(50))) for i in range(n)]


ROWS = made(1)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3)


def by_user(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out[r[2]].append(r)
    return out


BINS = pytest.mark.parametrize("bin_rows", [5, 40, 10**6])


@BINS
def test_carried(events, bin_rows):
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    for backwards in (False, True):
        for inclusive in (False, True):
            got = {r["event_id"]: r["x"] for r in scans.carried(events, ["user_id"], ["ts", "event_id"], value, "x", backwards, inclusive, bin_rows).collect()}
            want = {}
            for rows in by_user(ROWS).values():
                last = None
                for r in reversed(rows) if backwards else rows:
                    own = r[0] if r[3] == "error" else None
                    want[r[0]] = own if inclusive and own is not None else last
                    last = own if own is not None else last
            assert got == want


@BINS
def test_strict_runs(events, bin_rows):
    for steps in (["view", "click", "purchase"], ["view", "view"], ["error"], ["click"] * 4):
        want = {rows[i][0] for rows in by_user(ROWS).values() for i in range(len(rows)) if [r[3] for r in rows[i : i + len(steps)]] == steps}
        got = [r["event_id"] for r in patterns.contiguous(events, "user_id", "event_type", ["ts", "event_id"], steps, bin_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@BINS
def test_next_and_never(events, bin_rows):
    want_next, want_never = set(), set()
    for rows in by_user(ROWS).values():
        for i, r in enumerate(rows):
            if r[3] == "view":
                if i + 1 == len(rows) or rows[i + 1][3] != "click":
                    want_next.add(r[0])
                if not any(x[3] == "purchase" and x[1] <= r[1] + timedelta(seconds=300) for x in rows[i + 1 :]):
                    want_never.add(r[0])
    got = patterns.not_next(events, "user_id", "event_type", ["ts", "event_id"], "view", "click", bin_rows)
    assert {r["event_id"] for r in got.collect()} == want_next
    got = patterns.not_followed_by(events, "user_id", "event_type", ["ts", "event_id"], "view", "purchase", 300, bin_rows)
    assert {r["event_id"] for r in got.collect()} == want_never and 0 < len(want_never) < 100


@BINS
@pytest.mark.parametrize("steps", [["view", "click"], ["view", "click", "purchase", "error"], ["view", "view", "view"], ["error"]])
def test_sequences_within(events, bin_rows, steps):
    for seconds in (0, 60, 240, 3000):
        want = {}
        for user, rows in by_user(ROWS).items():
            named = [r for r in rows if r[3] in steps]
            if not named:
                continue
            hit = False
            for i, r in enumerate(named):
                if r[3] == steps[0] and not hit:
                    k = 1
                    for x in named[i + 1 :]:
                        if k < len(steps) and x[3] == steps[k]:
                            k += 1
                            end = x[1]
                    hit = len(steps) == 1 or (k == len(steps) and end - r[1] <= timedelta(seconds=seconds))
            want[user] = hit
        got = patterns.followed_by(events, "user_id", "event_type", ["ts", "event_id"], steps, seconds, bin_rows)
        assert {r["user_id"]: r["matched"] for r in got.collect()} == want


@BINS
def test_as_of(spark, events, bin_rows):
    left, right = events.where("event_type = 'view'").select("event_id", "ts", "user_id"), events.where("event_type = 'purchase'").select("ts", "user_id", F.col("value").alias("paid"))
    # Of right rows of one instant any may be the last: their values are made one.
    right = right.groupBy("user_id", "ts").agg(F.max("paid").alias("paid"))
    got = {r["event_id"]: r["paid"] for r in joins.as_of_join(left, right, ["user_id"], "ts", ["paid"], bin_rows).collect()}
    want = {}
    for rows in by_user(ROWS).values():
        for r in rows:
            if r[3] == "view":
                before = [x for x in rows if x[3] == "purchase" and x[1] <= r[1]]
                want[r[0]] = max((x[1], x[4]) for x in before)[1] if before else None
    assert got == want


@BINS
def test_running_sums_and_counts(events, bin_rows):
    got = {r["event_id"]: r["x"] for r in scans.running_sum(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") != "error", F.col("value")), "x", bin_rows).collect()}
    want, counts = {}, {}
    for rows in by_user(ROWS).values():
        total = 0.0
        for r in rows:
            total += r[4] if r[3] != "error" else 0.0
            want[r[0]] = total
            if r[3] == "click":
                counts[r[0]] = sum(x[3] == "purchase" and r[1] < x[1] <= r[1] + timedelta(seconds=900) for x in rows)
    assert got == pytest.approx(want)
    of = lambda kind: events.where(F.col("event_type") == kind)
    assert {r["event_id"]: r["n"] for r in joins.counts_within(of("click"), of("purchase"), ["user_id"], "ts", 900, "event_id", bin_rows).collect()} == counts


def test_until_and_follows(events):
    got = {r["user_id"]: r["n"] for r in patterns.until(events, "user_id", "event_type", ["ts", "event_id"], "view", "error").collect()}
    want, pairs = {}, Counter()
    for user, rows in by_user(ROWS).items():
        kinds = [r[3] for r in rows]
        want[user] = (kinds[: kinds.index("error")] if "error" in kinds else kinds).count("view")
        pairs.update(zip([None, *kinds], [*kinds, None], strict=True))
    assert got == want
    got = mining.directly_follows(events, "user_id", "event_type", ["ts", "event_id"])
    assert {(r["source"], r["target"]): r["n"] for r in got.collect()} == pairs


def test_tasks_are_even(spark):
    """Nine of ten rows in one key: no task of the scan has four times the median's rows."""
    n = 40_000
    rows = spark.range(n).select("id", F.timestamp_seconds(F.pow(F.col("id"), 2) / 1000).alias("ts"), F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"))
    bins = scans.binned(rows, ["k"], "ts", 500)
    parts = bins.repartition(16, "k", "bin").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(parts) == 16 and parts.max() < 4 * parts.median()
    sizes = bins.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("bin").collect()
    assert len(sizes) == 72 and max(r["n"] for r in sizes) <= 700 and all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:], strict=False))
    assert scans.binned(rows.where("k > 0"), ["k"], "ts", 500).where("bin IS NOT NULL").count() == 0


def test_odd_tables(spark, events):
    empty = events.limit(0)
    assert scans.carried(empty, ["user_id"], ["ts"], F.col("value"), "x").count() == 0
    assert patterns.followed_by(empty, "user_id", "event_type", ["ts"], ["view", "click"], 5).count() == 0
    same = events.withColumn("ts", F.lit(T0))  # one instant: a bin that cannot be parted
    assert scans.carried(same, ["user_id"], ["ts", "event_id"], F.col("event_id"), "x", bin_rows=5).where("x = event_id").count() == len(ROWS)
