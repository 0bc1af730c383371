"""Queries over the event stream: windows, patterns, temporal relations, correlation, rate limits, streaming runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions.predicates import condition
from ..operators import patterns as P
from ..streaming import closing as C
from ..streaming import events as S

ORDER = ["ts", "event_id"]


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(t):
    return S.windowed(t.events, "1 hour").select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_window", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(i) GROUP BY 1, 2")
def sliding_window(t):
    return S.windowed(t.events, "1 hour", "30 minutes").select(F.col("w.start").alias("window_start"), "event_type", "n")


SESSIONS = """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s"""


@query("session_window", SESSIONS)
def session_window(t):
    return S.sessions(t.events, "6 hours").select("user_id", F.col("w.start").alias("session_start"), "n")


@query("count_window", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)")
def count_window(t):
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-9, 0)
    return t.events.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("total"))


FOLLOWED = """WITH a AS (SELECT user_id, min((ts, event_id)) AS m FROM events WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT e.user_id, min((e.ts, e.event_id)) AS m FROM events e JOIN a USING (user_id) WHERE event_type = 'view' AND (e.ts, e.event_id) > a.m GROUP BY 1),
c AS (SELECT DISTINCT e.user_id FROM events e JOIN b USING (user_id) WHERE event_type = 'purchase' AND (e.ts, e.event_id) > b.m)
SELECT u.user_id, c.user_id IS NOT NULL AS matched FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup','view','purchase')) u LEFT JOIN c USING (user_id)"""


@query("pattern_followed_by", FOLLOWED)
def pattern_followed_by(t):
    return P.followed_by(t.events, "user_id", "event_type", ORDER, ["signup", "view", "purchase"])


@query("pattern_within", "SELECT user_id, bool_or(hit) AS matched FROM (SELECT e.user_id, e.event_type = 'signup' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (e.ts, e.event_id) AND p.ts <= e.ts + INTERVAL 20 MINUTE) AS hit FROM events e WHERE event_type IN ('signup', 'purchase')) GROUP BY 1")
def pattern_within(t):
    return P.followed_by(t.events, "user_id", "event_type", ORDER, ["signup", "purchase"], within=1200)


@query("pattern_or", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def pattern_or(t):
    return t.events.where("event_type IN ('error', 'signup')").groupBy("user_id").agg(F.min_by("event_id", F.struct(*ORDER)).alias("first_id"))


@query("pattern_and", "SELECT user_id, count(DISTINCT event_type) = 3 AS matched, count(*) AS n_hits FROM events WHERE event_type IN ('error', 'signup', 'view') GROUP BY 1")
def pattern_and(t):
    return t.events.where("event_type IN ('error', 'signup', 'view')").groupBy("user_id").agg((F.count_distinct("event_type") == 3).alias("matched"), F.count(F.lit(1)).alias("n_hits"))


@query("pattern_repeated", "SELECT user_id, count(*) FILTER (event_type = 'error') BETWEEN 10 AND 14 AS matched FROM events GROUP BY 1")
def pattern_repeated(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").between(10, 14).alias("matched"))


@query("pattern_absence", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def pattern_absence(t):
    return t.events.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("n")).where("n = 0").select("user_id")


@query("pattern_existence", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def pattern_existence(t):
    return t.events.where("event_type = 'purchase' AND value > 100").select("user_id").distinct()


@query("pattern_strict", "SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER w AS n1, lead(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND n1 = 'click' AND n2 = 'purchase'")
def pattern_strict(t):
    return P.contiguous(t.events, "user_id", "event_type", ORDER, ["view", "click", "purchase"]).select("event_id")


@query("pattern_not_next", "SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type = 'signup' AND nxt IS DISTINCT FROM 'view'")
def pattern_not_next(t):
    return P.not_next(t.events, "user_id", "event_type", ORDER, "signup", "view").select("event_id")


@query("pattern_not_followed_by", "SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (e.ts, e.event_id) AND p.ts <= e.ts + INTERVAL 1 DAY)")
def pattern_not_followed_by(t):
    return P.not_followed_by(t.events, "user_id", "event_type", ORDER, "view", "purchase", 86400).select("event_id")


@query("pattern_until", "SELECT user_id, count(*) FILTER (open AND event_type = 'view') AS n FROM (SELECT user_id, event_type, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 0 AS open FROM events) GROUP BY 1")
def pattern_until(t):
    return P.until(t.events, "user_id", "event_type", ORDER, "view", "error")


@query("pattern_followed_by_any", "SELECT e.event_id, count(p.event_id) AS n_after FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND p.ts <= e.ts + INTERVAL 6 HOUR WHERE e.event_type = 'click' GROUP BY 1")
def pattern_followed_by_any(t):
    """Purchases in the six hours after each click that has any, as a difference of running counts."""
    from ..operators.joins import counts_within

    of = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    return counts_within(of("click"), of("purchase"), ["user_id"], "ts", 6 * 3600, "event_id").where("n > 0").withColumnRenamed("n", "n_after")


ALLEN_SQL = {
    "before": "a1 < b0", "after": "a0 > b1", "meets": "a1 = b0", "met_by": "a0 = b1", "overlaps": "a0 < b0 AND b0 < a1 AND a1 < b1", "overlapped_by": "b0 < a0 AND a0 < b1 AND b1 < a1", "during": "a0 > b0 AND a1 < b1",
    "includes": "a0 < b0 AND a1 > b1", "starts": "a0 = b0 AND a1 < b1", "started_by": "a0 = b0 AND a1 > b1", "finishes": "a1 = b1 AND a0 > b0", "finished_by": "a1 = b1 AND a0 < b0", "equals": "a0 = b0 AND a1 = b1", "coincides": "a0 <= b1 AND b0 <= a1",
}
_PER_DAY = "SELECT user_id, date_trunc('day', ts) AS d, min(hour(ts)) AS a0, max(hour(ts)) AS a1 FROM events WHERE event_type = '{}' GROUP BY 1, 2"


@query("temporal_relations", f"SELECT user_id, d AS day, {', '.join(f'({x}) AS r_{n}' for n, x in ALLEN_SQL.items())} FROM (SELECT a.user_id, a.d, a.a0, a.a1, b.a0 AS b0, b.a1 AS b1 FROM ({_PER_DAY.format('view')}) a JOIN ({_PER_DAY.format('click')}) b ON a.user_id = b.user_id AND a.d = b.d)")
def temporal_relations(t):
    """All relations between each user's daily interval of views and that of clicks, in hours."""
    day = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    span = lambda kind, p: [F.min(F.when(F.col("event_type") == kind, F.hour("ts"))).alias(f"{p}0"), F.max(F.when(F.col("event_type") == kind, F.hour("ts"))).alias(f"{p}1")]
    both = day.agg(*span("view", "a"), *span("click", "b")).where("a0 IS NOT NULL AND b0 IS NOT NULL")
    a, b = (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1"))
    return both.select("user_id", "day", *(P.allen(n, a, b).alias(f"r_{n}") for n in ALLEN_SQL))


@query("message_correlation", "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.props = b.props WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 7 DAY")
def message_correlation(t):
    """Messages meet on the full set of correlation keys within the time to live."""
    from ..operators.joins import interval_join

    a = t.events.where("event_type = 'view'").select("user_id", "props", "ts", F.col("event_id").alias("left_id"))
    b = t.events.where("event_type = 'purchase'").select("user_id", "props", "ts", F.col("event_id").alias("right_id"))
    return interval_join(a, b, ["user_id", "props"], "ts", 7 * 86400).select("left_id", "right_id")


@query("rate_limit")
def rate_limit(t):
    """At most 3 admitted requests of a user in 6 hours. Feeds back, so SQL has no form for it; tested by brute force."""
    return P.sliding_rate_limit(t.events, "user_id", "ts", "event_id", 3, 6 * 3600)


@query("json_properties", "SELECT event_type, cast(json_extract(props, '$.k') AS BIGINT) // 10 AS decile, count(*) AS n FROM events GROUP BY 1, 2")
def json_properties(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type", F.floor(k / 10).cast("long").alias("decile")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    """The tumbling window as a streaming run to the end of the input."""
    out = S.run_to_end(S.windowed(S.event_stream(t.spark, t.sf_dir), "1 day"), "complete", "tumbling")
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_rules", "SELECT event_id, concat_ws(',', CASE WHEN value > 100 THEN 'high' END, CASE WHEN event_type = 'error' THEN 'failed' END) AS rules_triggered FROM events WHERE value > 100 OR event_type = 'error'")
def stream_rules(t):
    rules = S.with_rules({"high": condition("value", "gt", 100), "failed": condition("event_type", "eq", "error")})
    hits = rules(S.event_stream(t.spark, t.sf_dir)).where("rules_triggered <> ''").select("event_id", "rules_triggered")
    return S.run_to_end(hits, "append", "rules").select("event_id", "rules_triggered")


@query("stream_last_values", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_last FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY 1")
def stream_last_values(t):
    """A count window as keyed state."""
    out = S.run_to_end(S.last_values(S.event_stream(t.spark, t.sf_dir)), "update", "last")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "avg_last"), "epoch").alias("x"))
    return last.select("user_id", "x.n", F.round("x.avg_last", 6).alias("avg_last"))


@query("stream_correlation", "SELECT a.user_id AS k, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_correlation(t):
    e = lambda kind: S.event_stream(t.spark, t.sf_dir).where(F.col("event_type") == kind)
    return S.run_to_end(S.correlated(e("click"), e("purchase"), "user_id", 3600), "append", "correlation").select("k", "left_id", "right_id")


@query("stream_windows_closed", """WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT cast(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 DAY, ts) AS s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT key, cast(epoch(s) AS BIGINT) AS window_start, 'closed' AS kind, n, total FROM w, m WHERE s + INTERVAL 1 DAY <= mark""")
def stream_windows_closed(t):
    """Daily windows of each user in append mode: each once, when the watermark has passed its end. Files in no order go into one trigger, so no row is late here."""
    out = S.run_to_end(C.closing_windows(S.event_stream(t.spark, t.sf_dir), 86_400, "user_id"), "append", "closed")
    return out.select("key", "window_start", "kind", "n", F.round("total", 4).alias("total"))


@query("stream_correlation_buffer", """WITH r AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('purchase', 'signup')), m AS (SELECT * FROM r WHERE event_type = 'purchase'), s AS (SELECT * FROM r WHERE event_type = 'signup'),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM r), before AS (SELECT m.event_id AS m, s.event_id AS s FROM m JOIN s ON m.user_id = s.user_id AND s.ts <= m.ts),
waits AS (SELECT m.*, (SELECT arg_min(s.event_id, (s.ts, s.event_id)) FROM s WHERE s.user_id = m.user_id AND s.ts > m.ts AND s.ts < m.ts + INTERVAL 1 DAY) AS taken, (SELECT max(r.ts) FROM r WHERE r.user_id = m.user_id) AS last FROM m WHERE event_id NOT IN (SELECT m FROM before)),
o AS (SELECT m AS message_id, 'matched' AS outcome, s AS subscription_id FROM before UNION ALL SELECT event_id, 'matched', taken FROM waits WHERE taken IS NOT NULL UNION ALL SELECT event_id, 'expired', NULL FROM waits, mark WHERE taken IS NULL AND (last >= ts + INTERVAL 1 DAY OR mark >= ts + INTERVAL 1 DAY))
SELECT cast(user_id AS VARCHAR) AS key, o.outcome, o.message_id, o.subscription_id FROM o JOIN m ON m.event_id = o.message_id""")
def stream_correlation_buffer(t):
    """Purchases go to their user's signups before them, or wait a day for the next; what has waited that long expires. The bound of the buffer is not reached here; tests reach it."""
    rows = S.event_stream(t.spark, t.sf_dir).where("event_type IN ('purchase', 'signup')")
    out = S.run_to_end(C.correlation_buffer(rows, "user_id", F.col("event_type") == "purchase", ttl_seconds=86_400, most=1_000_000), "append", "buffer")
    return out.select("key", "outcome", "message_id", "subscription_id")
