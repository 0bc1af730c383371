"""Windows that close, late rows, restarts and the correlation buffer, on streams whose files come in a known order."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.streaming import closing
from tessera.streaming import events as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def add_file(spark, folder, rows):
    spark.createDataFrame([(i, T0 + timedelta(seconds=s), u, kind, v) for i, s, u, kind, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def in_order(spark, folder):
    """One file a trigger, in the order of writing."""
    return S.event_stream(spark, str(folder), per_trigger=1)


def run(stream, base):
    """Goes on from the checkpoint in ``base``; the rows of all runs so far."""
    out = f"{base}/out"
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out).collect()


def window_rows(files, seconds, delay):
    """What closes and what is late if each file is a trigger and the watermark moves after it."""
    open_, out, mark = {}, [], 0
    for rows in [*files, []]:
        for i, s, u, _, v in rows:
            at = int(T0.timestamp()) + s
            start = at // seconds * seconds
            if start + seconds <= mark:
                out.append((str(u), start, "late", 1, v, i))
            else:
                n, total = open_.get((u, start), (0, 0.0))
                open_[u, start] = n + 1, total + v
        mark = max([mark, *(int(T0.timestamp()) + s - delay for _, s, *_ in rows)])
        for u, start in [k for k in open_ if k[1] + seconds <= mark]:
            out.append((str(u), start, "closed", *open_.pop((u, start)), None))
    return Counter(out)


def made_files(seed, files=6, each=40):
    rng, rows, i = random.Random(seed), [], 0
    for k in range(files):
        part = []
        for _ in range(each):
            late = rng.random() < 0.15
            part.append((i, k * 7200 + rng.randrange(7200) - (rng.randrange(4 * 7200) if late else 0) + 40_000, rng.randrange(4), "view", float(rng.randrange(100))))
            i += 1
        rows.append(part)
    return rows


def test_each_row_is_counted_once(spark, tmp_path):
    files = made_files(4)
    for rows in files:
        add_file(spark, tmp_path, rows)
    got = run(closing.closing_windows(in_order(spark, tmp_path), 3600, "user_id", delay_seconds=1800), f"file://{tmp_path}/run")
    want = window_rows(files, 3600, 1800)
    assert Counter((r["key"], r["window_start"], r["kind"], r["n"], r["total"], r["row_id"]) for r in got) == want
    assert {k for _, _, k, *_ in want} == {"late", "closed"}


def test_a_run_goes_on_from_its_checkpoint(spark, tmp_path):
    files = made_files(5)
    for rows in files[:3]:
        add_file(spark, tmp_path, rows)
    run(closing.closing_windows(in_order(spark, tmp_path), 3600, "user_id", delay_seconds=1800), f"file://{tmp_path}/run")
    for rows in files[3:]:
        add_file(spark, tmp_path, rows)
    got = run(closing.closing_windows(in_order(spark, tmp_path), 3600, "user_id", delay_seconds=1800), f"file://{tmp_path}/run")
    assert Counter((r["key"], r["window_start"], r["kind"], r["n"], r["total"], r["row_id"]) for r in got) == window_rows(files, 3600, 1800)


def test_policies(spark, tmp_path):
    files = [[(i, s, 1, "view", 1.0) for i, s in part] for part in ([(0, 100), (1, 9000)], [(2, 50), (3, 20_000)], [(4, 60_000)])]
    for rows in files:
        add_file(spark, tmp_path, rows)
    stamped = in_order(spark, tmp_path).withColumn("arrived", F.timestamp_seconds(F.unix_seconds(F.lit(T0)) + F.col("event_id") * 5000))
    got = run(closing.closing_windows(stamped, 3600, "user_id", policy="ingestion", arrived="arrived", delay_seconds=0), f"file://{tmp_path}/a")
    assert {r["kind"] for r in got} == {"closed"} and sum(r["n"] for r in got) == 4  # the last window is open still
    got = run(closing.closing_windows(in_order(spark, tmp_path), 3600, "user_id", policy="processing", delay_seconds=0), f"file://{tmp_path}/b")
    assert not [r for r in got if r["kind"] == "late"]
    with pytest.raises(ValueError):
        closing.closing_windows(stamped, 3600, "user_id", policy="wall")
    with pytest.raises(ValueError):
        closing.closing_windows(stamped, 3600, "user_id", policy="ingestion")


def buffered(files, ttl, most, delay):
    held, known, out, mark = defaultdict(list), defaultdict(list), [], 0
    for rows in [*files, []]:
        for i, s, u, kind, _ in sorted(rows, key=lambda r: (r[1], r[3] == "message", r[0])):
            out += [(str(u), "expired", m, None) for m, at in held[u] if at + ttl <= s]
            held[u] = [(m, at) for m, at in held[u] if at + ttl > s]
            if kind == "subscription":
                known[u].append(i)
                out += [(str(u), "matched", m, i) for m, _ in held.pop(u, [])]
            elif known[u]:
                out += [(str(u), "matched", i, x) for x in known[u]]
            else:
                held[u].append((i, s))
                if len(held[u]) > most:
                    out.append((str(u), "evicted", held[u].pop(0)[0], None))
        mark = max([mark, *(s - delay for _, s, *_ in rows)])
        for u in held:
            out += [(str(u), "expired", m, None) for m, at in held[u] if at + ttl <= mark]
            held[u] = [(m, at) for m, at in held[u] if at + ttl > mark]
    return Counter(out)


def test_correlation_buffer(spark, tmp_path):
    rng, files, i = random.Random(9), [], 0
    for k in range(5):
        part = []
        for _ in range(40):
            part.append((i, k * 3000 + rng.randrange(3000), rng.randrange(12), "subscription" if rng.random() < 0.06 else "message", 0.0))
            i += 1
        files.append(part)
        add_file(spark, tmp_path, part)
    stream = closing.correlation_buffer(in_order(spark, tmp_path), "user_id", F.col("event_type") == "message", ttl_seconds=2000, most=3, delay_seconds=600)
    got = Counter((r["key"], r["outcome"], r["message_id"], r["subscription_id"]) for r in run(stream, f"file://{tmp_path}/run"))
    want = buffered(files, 2000, 3, 600)
    assert got == want and {x[1] for x in want} == {"matched", "expired", "evicted"}


def test_correlation_buffer_of_many_keys(spark, tmp_path):
    """Many keys of a shard, rows of earlier times in later triggers, and keys that only some triggers have."""
    rng, files = random.Random(4), []
    for k in range(5):
        files.append([(1000 * k + j, max(0, k * 1500 + rng.randrange(3000) - rng.choice([0, 0, 2500])), rng.randrange(90), "subscription" if rng.random() < 0.15 else "message", 0.0) for j in range(300)])
        add_file(spark, tmp_path, files[-1])
    stream = closing.correlation_buffer(in_order(spark, tmp_path), "user_id", F.col("event_type") == "message", ttl_seconds=1200, most=2, delay_seconds=5000, shards=2)
    got = Counter((r["key"], r["outcome"], r["message_id"], r["subscription_id"]) for r in run(stream, f"file://{tmp_path}/run"))
    want = buffered(files, 1200, 2, 5000)
    assert got == want and {x[1] for x in want} == {"matched", "expired", "evicted"}


def test_correlation_buffer_calls_state_by_shard():
    """5,000 keys take no more calls to the state and timers than one; matches go out in blocks."""
    calls = Counter()

    class Held:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            calls[name] += 1
            return {"exists": lambda: bool(self.rows), "get": lambda: iter(list(self.rows)), "put": lambda x: self.__setattr__("rows", x), "appendList": lambda x: self.rows.extend(x), "clear": self.rows.clear}[name]

    class Handle:
        def getListState(self, *_):
            return Held()

        def registerTimer(self, ms):
            calls["registerTimer"] += 1

    state = closing._Correlating(10**9, 100)
    state.init(Handle())
    rows = [(f"k{i % 5000}", i, i % 3 > 0, i) for i in range(20_000)] + [("hot", i, i >= 1000, i) for i in range(2000)]
    frame = pd.DataFrame(rows, columns=["key", "at", "is_message", "id"])
    first = list(state.handleInputRows((0,), iter([frame[:9000], frame[9000:]]), None))
    later = list(state.handleInputRows((0,), iter([pd.DataFrame([("hot", 5000, True, 9), ("k1", 5000, False, 8)], columns=frame.columns)]), None))
    assert sum(calls.values()) <= 16
    assert max(map(len, first)) <= 102_000 and sum((x["key"] == "hot").sum() for x in first) == 1_000_000
    assert sum((x["key"] == "hot").sum() for x in later) == 1000
    want = buffered([[(i, at, k, "message" if m else "subscription", 0.0) for k, at, m, i in rows if k != "hot"]], 10**9, 100, 0)
    assert Counter((r.key, r.outcome, r.message_id, None if pd.isna(r.subscription_id) else r.subscription_id) for x in first for r in x[x["key"] != "hot"].itertuples()) == want
