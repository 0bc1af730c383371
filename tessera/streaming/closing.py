"""Event time for real: windows that close when the watermark passes them, late rows aside, and a correlation buffer with time to live.

Both are keyed state with timers. Spark's operator drops rows behind the watermark before a processor sees them; so the
watermark is declared on a clock that runs ``AHEAD`` of event time, with a delay longer by as much: the watermark is
where it would be, and nothing is dropped that the processor has not looked at.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AHEAD = 36_500 * 86_400  # seconds; more than rows are ever late
#: What time a window goes by: the event's own, the time at which it came in, or that at which it is processed.
POLICIES = ("event", "ingestion", "processing")


def keyed_state(spark: SparkSession) -> None:
    """Timers and lists in state need the RocksDB store; a session's own choice of another one is left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name, "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_clock(stream: DataFrame, ts: str, delay_seconds: int) -> DataFrame:
    return stream.withColumn("clock", F.col(ts) + F.make_interval(secs=F.lit(AHEAD))).withWatermark("clock", f"{delay_seconds + AHEAD} seconds")


class _Closing(StatefulProcessor):
    """State of one window and shard of the keys: its keys' counts and sums so far. A timer at the window's end emits and clears it.

    Calls to the state and timers cost far more than rows, so they go by shard: what comes is added up and appended, and
    the list is added up again when it has twice the entries that it needs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getListState("sums", "key string, n long, total double")
        self.held = handle.getValueState("held", "entries long, least long")

    def _added(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby("key", sort=False).sum().reset_index()

    def _all(self) -> pd.DataFrame:
        return pd.DataFrame([(x[0], int(x[1]), float(x[2])) for x in self.sums.get()], columns=["key", "n", "total"])

    def _rows(self, sums: pd.DataFrame) -> list[tuple[str, int, float]]:
        return list(zip(sums["key"].tolist(), sums["n"].tolist(), sums["total"].tolist(), strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, start, end = key
        if end * 1000 <= timerValues.getCurrentWatermarkInMs():
            for batch in rows:
                yield pd.DataFrame({"key": batch["key"].to_numpy(), "window_start": start, "kind": "late", "n": 1, "total": batch["value"].astype(float).to_numpy(), "row_id": batch["row_id"].to_numpy()})
            return
        came = self._added([pd.DataFrame({"key": batch["key"], "n": 1, "total": batch["value"].astype(float).fillna(0.0)}).groupby("key", sort=False).sum().reset_index() for batch in rows])
        entries, least = self.held.get() if self.held.exists() else (0, 0)
        if not entries:
            self.handle.registerTimer(int(end) * 1000)
        if not entries or entries + len(came) > 2 * max(least, len(came)):
            came = self._added([self._all(), came]) if entries else came
            self.sums.put(self._rows(came))
            self.held.update((len(came), len(came)))
        else:
            self.sums.appendList(self._rows(came))
            self.held.update((int(entries) + len(came), int(least)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums = self._added([self._all()])
        self.sums.clear()
        self.held.clear()
        yield pd.DataFrame({"key": sums["key"], "window_start": key[1], "kind": "closed", "n": sums["n"], "total": sums["total"], "row_id": pd.array([None] * len(sums), dtype="Int64")})

    def close(self) -> None:
        pass


def closing_windows(stream: DataFrame, seconds: int, by: str, value: str = "value", ts: str = "ts", row_id: str = "event_id", delay_seconds: int = 3600, policy: str = "event", arrived: str | None = None, shards: int = 64) -> DataFrame:
    """Append-mode rows (key, window_start, kind, n, total, row_id): each window once, ``closed``, when the watermark has passed its end; each row that comes after that once, ``late``.

    ``policy`` "event" goes by ``ts``; "ingestion" by the column ``arrived`` that the source stamped rows with; "processing" by
    the time of the trigger. The last two never see a row late but for the order in which they are read. A null time or key
    belongs to no window and is left out; null values count but add nothing. State is at most two pairs of numbers for each
    open window of a key, kept together by window and ``shards`` parts of the keys, and goes with the window.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {', '.join(POLICIES)}")
    if policy == "ingestion" and not arrived:
        raise ValueError("the ingestion policy needs the column that rows are stamped with")
    keyed_state(stream.sparkSession)
    time = {"event": F.col(ts), "ingestion": F.col(arrived or ts), "processing": F.current_timestamp()}[policy]
    rows = stream.select(F.col(by).cast("string").alias("key"), time.alias("at"), F.col(value).cast("double").alias("value"), F.col(row_id).cast("long").alias("row_id")).where("key IS NOT NULL AND at IS NOT NULL")
    start = (F.floor(F.unix_seconds("at") / seconds) * seconds).cast("long")
    rows = with_clock(rows, "at", delay_seconds).withColumns({"shard": F.pmod(F.xxhash64("key"), F.lit(shards)), "start": start, "end": start + seconds})
    return rows.groupBy("shard", "start", "end").transformWithStateInPandas(_Closing(), "key string, window_start long, kind string, n long, total double, row_id long", "append", "eventTime")


class _Waiting:
    """The messages of a key that no subscription has taken, in the order in which they came; the next to expire is found without a look at all."""

    def __init__(self):
        self.held: OrderedDict[int, tuple[int, int]] = OrderedDict()
        self.by_time: list[tuple[int, int]] = []
        self.n = 0

    def add(self, i: int, at: int) -> None:
        self.held[self.n] = i, at
        heappush(self.by_time, (at, self.n))
        self.n += 1

    def until(self, at: int) -> list[int]:
        """Takes out what came no later than ``at``."""
        out = []
        while self.by_time and self.by_time[0][0] <= at:
            if found := self.held.pop(heappop(self.by_time)[1], None):
                out.append(found[0])
        return out

    def all(self) -> list[int]:
        out = [i for i, _ in self.held.values()]
        self.held.clear()
        self.by_time.clear()
        return out


class _Correlating(StatefulProcessor):
    """State of one shard of the correlation keys: their subscriptions, and the messages that no subscription has taken, oldest first.

    Calls to the state and timers cost far more than rows, so they go by shard: subscriptions are appended, what waits is
    written anew, and the one timer is that of what expires next. A key with a subscription has nothing that waits.
    """

    #: Rows of a block of matches; one message's may be more.
    block = 100_000

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, id long, at long")
        self.subscribed = handle.getListState("subscribed", "key string, ids array<long>")

    def _held(self) -> dict[str, _Waiting]:
        held: dict[str, _Waiting] = defaultdict(_Waiting)
        for key, i, at in self.waiting.get() if self.waiting.exists() else ():
            held[key].add(int(i), int(at))
        return held

    def _hold(self, held: dict[str, _Waiting]) -> None:
        rows = [(key, i, at) for key, w in held.items() for i, at in w.held.values()]
        if rows:
            self.waiting.put(rows)
            self.handle.registerTimer(-(-(min(at for *_, at in rows) + self.ttl) // 1000))
        else:
            self.waiting.clear()

    def _rows(self, out) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "outcome", "message_id", "subscription_id"]).astype({"message_id": "Int64", "subscription_id": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))  # of one shard in one trigger
        code, keys = pd.factorize(came["key"])
        at, is_message, ids = (came[c].to_numpy() for c in ("at", "is_message", "id"))
        order = np.lexsort((ids, is_message, at, code))
        code, at, is_message, ids = code[order], at[order], is_message[order].astype(bool), ids[order]

        # each key's subscriptions, those known first, one key's after the other's; and how many of them came before a row
        place = {k: c for c, k in enumerate(keys)}
        old = [(place[k], x) for k, x in self.subscribed.get() if k in place] if self.subscribed.exists() else []
        old_code = np.repeat(np.array([c for c, _ in old], dtype=np.int64), [len(x) for _, x in old])
        new_code, new = code[~is_message], ids[~is_message]
        sub_code = np.concatenate([old_code, new_code])
        subs = np.concatenate([*(np.asarray(x, dtype=np.int64) for _, x in old), new])[np.argsort(sub_code, kind="stable")]
        first = np.searchsorted(np.sort(sub_code), np.arange(len(keys)))
        new_before = np.cumsum(~is_message) - ~is_message
        before = new_before - new_before[np.searchsorted(code, np.arange(len(keys)))][code] + np.bincount(old_code, minlength=len(keys))[code]

        # what waits, and the first subscription that takes it
        out: list = []
        alone = np.flatnonzero(before == 0)
        if len(alone):
            held = self._held()
            for c, t, message, i in zip(code[alone].tolist(), at[alone].tolist(), is_message[alone].tolist(), ids[alone].tolist(), strict=True):
                w = held[keys[c]]
                out += [(keys[c], "expired", m, None) for m in w.until(t - self.ttl)]
                if not message:
                    out += [(keys[c], "matched", m, i) for m in w.all()]
                    continue
                w.add(i, t)
                if len(w.held) > self.most:
                    out.append((keys[c], "evicted", w.held.popitem(last=False)[1][0], None))
            self._hold(held)
        if len(new):
            at_key = np.flatnonzero(np.diff(new_code, prepend=-1))
            self.subscribed.appendList([(keys[c], x.tolist()) for c, x in zip(new_code[at_key].tolist(), np.split(new, at_key[1:]), strict=True)])
        if out:
            yield self._rows(out)

        # the others go to all subscriptions before them, block by block
        taken = np.flatnonzero(is_message & (before > 0))
        for part in np.split(taken, np.flatnonzero(np.diff(np.cumsum(before[taken]) // self.block)) + 1):
            if n := int(before[part].sum()):
                times = before[part]
                nth = np.arange(n) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"key": np.repeat(keys[code[part]], times), "outcome": "matched", "message_id": np.repeat(ids[part], times), "subscription_id": subs[np.repeat(first[code[part]], times) + nth]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs() * 1000
        out = [(k, "expired", m, None) for k, w in held.items() for m in w.until(now - self.ttl)]
        self._hold(held)
        if out:
            yield self._rows(out)

    def close(self) -> None:
        pass


def correlation_buffer(stream: DataFrame, by: str, is_message, row_id: str = "event_id", ts: str = "ts", ttl_seconds: int = 3600, most: int = 100, delay_seconds: int = 3600, shards: int = 256) -> DataFrame:
    """Append-mode rows (key, outcome, message_id, subscription_id) of messages (``is_message`` true) and subscriptions (false) that share a key.

    A message goes to all subscriptions of its key that came before (``matched``); one without any waits. A subscription
    takes all that wait. What has waited ``ttl_seconds`` is ``expired``, by the times of the key's later rows or by the
    watermark; a key keeps ``most`` waiting messages, beyond that the oldest is ``evicted``. Rows of a trigger are taken in
    the order of time, then subscriptions first, then id; triggers in the order they come. Each message has one outcome, or
    one for each subscription. Null keys, times and ids are left out. State is kept together by ``shards`` parts of the keys
    (a checkpoint's stay as many); a trigger reads that of the parts that it has rows or timers of.
    """
    keyed_state(stream.sparkSession)
    rows = stream.select(F.col(by).cast("string").alias("key"), F.col(ts).alias("t"), is_message.alias("is_message"), F.col(row_id).cast("long").alias("id")).where("key IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL AND is_message IS NOT NULL")
    rows = with_clock(rows, "t", delay_seconds).withColumns({"at": F.unix_micros("t"), "shard": F.pmod(F.xxhash64("key"), F.lit(shards))}).drop("t")
    return rows.groupBy("shard").transformWithStateInPandas(_Correlating(ttl_seconds * 1_000_000, most), "key string, outcome string, message_id long, subscription_id long", "append", "eventTime")
