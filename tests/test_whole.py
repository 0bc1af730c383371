"""Queries that go further than their SQL, or further than one small table shows, against brute force on small tables."""

import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.catalog import QUERIES

T0 = datetime(2024, 1, 1)


def run(spark, name, folder, **tables):
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{k}.parquet")
    return QUERIES[name](spark, str(folder)).collect()


ENTITY = r"\b[A-Z][a-zA-Z0-9\-]{2,}\b"
TURNS = [(1, 0, "Paris and Rome-2 met"), (1, 1, "caf\u00e9 \u201cBerlin\u201d PARIS, \u00c9Tat Caf\u00e9 Abc\u00bd Abc- Abc-\u00e9"), (1, 2, "paris Berlin Oslo_x"), (2, 1, "\u65e5\u672c Tokyo \u65e5Kyoto Kyoto"), (2, 0, "TOKYO"), (3, 0, None)]
CONVERSATIONS = [(c, n, "user", t) for c, n, t in TURNS], "conv_id long, turn long, role string, text string"


def test_entity_counts(spark, tmp_path):
    want = Counter(m for *_, t in TURNS for m in re.findall(ENTITY, t or ""))
    assert {r["name"]: r["n"] for r in run(spark, "entity_counts", tmp_path, conversations=CONVERSATIONS)} == want


def test_entity_dedup(spark, tmp_path):
    want = {}
    for c, _, t in sorted(TURNS, key=lambda x: x[:2]):
        for m in re.findall(ENTITY, t or ""):
            want.setdefault((c, m.lower()), m)
    assert {(r["doc_id"], r["key"]): r["name"] for r in run(spark, "entity_dedup", tmp_path, conversations=CONVERSATIONS)} == want


def test_containment_search(spark, tmp_path):
    docs = [(1, "x The quick brown fox jumps y"), (2, "the quick brown cow"), (3, None), (4, "")]
    asked = [(0, "The Quick Brown Fox"), (20, "the quick brown cow sleeps"), (21, "cow"), (40, "cow"), (60, "brown fox"), (80, "quick  brown")]
    got = run(spark, "containment_search", tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    assert {(r["qid"], r["doc_id"]) for r in got} == {(0, 1), (40, 2), (60, 1)}


def test_cooccurrence_pairs(spark, tmp_path):
    texts = ["Zoe and Amy and Bob and Cid and Dan and Eve and Zoe", "Amy Eve " + "x" * 900 + " Bob", None, ""]
    want = Counter()
    for t in texts:
        for k in range(max(-(-(len(t or "") - 800) // 680), 0) + 1):
            names = sorted(set(re.findall(ENTITY, (t or "")[680 * k : 680 * k + 800])))
            want.update((a, b) for i, a in enumerate(names) for b in names[i + 1 :])
    got = run(spark, "cooccurrence_pairs", tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r["a"], r["b"]): r["n"] for r in got} == want and want["Amy", "Zoe"] == 1 and want["Amy", "Eve"] == 2


EVENTS = [(i, T0 + timedelta(hours=3 * i), i % 2, "click" if i % 3 else "error", float(i * i)) for i in range(24)] + [(90 + i, T0 + timedelta(hours=3 * i, minutes=5), i % 2, "purchase", 500.0) for i in range(24)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of part files, the latest rows first."""
    out = tmp_path_factory.mktemp("parts")
    late_first = sorted(EVENTS, key=lambda r: r[1], reverse=True)
    for k in range(0, len(late_first), 12):
        spark.createDataFrame(late_first[k : k + 12], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{out}/events.parquet")
    return out


def test_streams_of_part_files(spark, folder):
    got = run(spark, "stream_tumbling", folder)
    assert sum(r["n"] for r in got) == len(EVENTS) and {(r["window_start"], r["event_type"]): r["n"] for r in got} == Counter((T0 + timedelta(days=(e[1] - T0).days), e[3]) for e in EVENTS)
    assert {r["event_id"] for r in run(spark, "stream_rules", folder)} == {e[0] for e in EVENTS if e[4] > 100 or e[3] == "error"}
    pairs = {(a[0], b[0]) for a in EVENTS for b in EVENTS if a[3] == "click" and b[3] == "purchase" and a[2] == b[2] and timedelta() < b[1] - a[1] <= timedelta(hours=1)}
    assert {(r["left_id"], r["right_id"]) for r in run(spark, "stream_correlation", folder)} == pairs


def test_last_values_in_any_order_of_files(spark, folder):
    from tessera.streaming import events as S

    want = {u: sum(e[4] for e in sorted((e for e in EVENTS if e[2] == u), key=lambda e: e[1:2] + e[:1])[-5:]) / 5 for u in (0, 1)}
    assert {r["user_id"]: r["avg_last"] for r in run(spark, "stream_last_values", folder)} == pytest.approx(want)
    steps = S.run_to_end(S.last_values(S.event_stream(spark, str(folder), per_trigger=1)), "update", "steps").collect()
    assert {u: max((r["epoch"], r["avg_last"]) for r in steps if r["user_id"] == u)[1] for u in want} == pytest.approx(want)


def test_no_group_is_gathered(spark, tmp_path):
    rows = [(1, 5.0), (1, None), (1, float("nan")), (1, 1.0), (1, 3.0), (1, 2.0), (2, 4.0), (2, 6.0), (2, None), (3, None), (3, None), (3, None)]
    got = run(spark, "custom_aggregation", tmp_path, events=(rows, "user_id long, value double"))
    assert {r["user_id"]: r["trimmed"] for r in got} == {1: 2.5, 2: 5.0, 3: None}
    orders = [(1, 7, 10.0, "1-A"), (2, 7, 2.5, "2-B"), (3, 8, None, None)]
    got = run(spark, "nested_counts", tmp_path, customer=([(7,), (8,), (9,)], "c_custkey long"), orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"))
    assert {tuple(r) for r in got} == {(7, 2, 12.5, "2-B"), (8, 1, 0.0, None), (9, 0, 0.0, None)}
    plans = "".join(QUERIES[q](spark, str(tmp_path))._jdf.queryExecution().toString() for q in ("custom_aggregation", "nested_counts"))
    assert "collect_list" not in plans and "Python" not in plans and "partial_sum" in plans


def test_cluster_heads(spark):
    """Far apart clusters: the first row of each."""
    from tessera.operators.evidence import cluster_heads

    rows = [(i, [100.0 * (i % 3) + i / 1000, 50.0 * (i % 3)], f"l{i}") for i in range(7, 67)]
    got = cluster_heads(spark.createDataFrame(rows, "vec_id long, v array<double>, label string"), "v", ["vec_id"], k=3).collect()
    assert sorted(r["vec_id"] for r in got) == [7, 8, 9] and {r["label"] for r in got} == {"l7", "l8", "l9"} and len({r["cluster"] for r in got}) == 3


def test_catch_event_clusters(spark, tmp_path):
    import zlib

    rows = [(i, T0 + timedelta(minutes=97 * i % 500), ["view", "click", "error"][i % 3], f"p{i % 4}") for i in range(60)]
    got = run(spark, "catch_event_clusters", tmp_path, events=(rows, "event_id long, ts timestamp, event_type string, props string"))
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        want.setdefault(zlib.crc32(f"{r[2]}|{r[3]}".encode()) % 5, []).append(r[0])
    assert {(r["cluster"], r["event_id"]) for r in got} == {(c, i) for c, ids in want.items() for i in ids[:3]}


def test_do_until_runs_once_at_least(spark):
    from tessera.functions.tensors import do_until

    out = spark.range(6).select("id", do_until(F.col("id"), 5, lambda a: a >= 4, lambda a, i: a + i).alias("v")).collect()

    def want(a):
        for i in range(1, 6):
            a += i
            if a >= 4:
                break
        return a

    assert {r["id"]: r["v"] for r in out} == {k: want(k) for k in range(6)}
