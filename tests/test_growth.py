"""What a task holds or a query moves must not grow faster than the input."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.catalog import QUERIES
from tessera.operators import compressed, graph, rdf, retrieval
from tessera.streaming import closing


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def peak_mb(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_set_search_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i % 700 if i % 50 else None, i // 700, ["w%d" % min(99, int(rng.expovariate(0.08))) for _ in range(rng.randint(0, 25))], 0.1 if i % 3 else 0.0) for i in range(1500)]
    rows = [(c, t, list(dict.fromkeys(w)), b) for c, t, w, b in rows]
    queries = [(c, w) for c, t, w, _ in rows if c is not None and c % 20 == 0] * 2
    monkeypatch.setattr(retrieval, "SEARCH_MB", 0.01)  # in several passes
    df = spark.createDataFrame(rows, "c long, t long, w array<string>, b double")
    got = retrieval.jaccard_top_k(df, spark.createDataFrame(queries, "q long, w array<string>"), "q", ["c", "t"], "w", 5, F.col("b"), 0.15)
    want = set()
    for q in {q for q, _ in queries}:
        scored = []
        for _, qw in (x for x in queries if x[0] == q):
            for c, t, w, b in rows:
                both = len(set(w) & set(qw))
                if both and (s := both / len(set(w) | set(qw)) + b) >= 0.15:
                    scored.append((-np.floor(s * 1e6 + 0.5) / 1e6, c is None, c or 0, t))
        want |= {(q, None if none else c, t, -s, i + 1) for i, (s, none, c, t) in enumerate(sorted(scored)[:5])}
    assert {(r["qid"], r["c"], r["t"], r["score"], r["rank"]) for r in got.collect()} == want


def test_set_search_writes_no_pairs_down(spark):
    """Nearly all turns share a word with all queries: no join may bring them together."""
    assert "Join" not in plan(QUERIES["memory_jaccard"](spark, "/root/testdata/sf0.001"))


def test_set_search_holds_blocks_alone():
    words = [[f"a{i % 40}", f"b{i % 3}", f"c{i}"] for i in range(6000)]
    asked = retrieval.QuerySets.of(np.arange(6000), pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(words), pa.array([0.0] * 6000)], names=["id", "words", "bonus"])
    out = []
    assert peak_mb(lambda: out.extend(retrieval.nearest_sets(iter([batch]), asked, ["id"], 3, 0.1, 6))) < 150
    best = {}
    for b in out:
        for q, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            best.setdefault(q, []).append((i, s))
    assert all(best[q][0] == (q, 1.0) and len(best[q]) == 3 for q in range(6000))


def brute(q, rows, k):
    scores = np.round(q @ rows.T, 6) + 0.0
    order = np.lexsort((np.broadcast_to(np.arange(len(rows)), scores.shape), -scores), axis=1)[:, :k]
    return order, np.take_along_axis(scores, order, axis=1)


def test_compressed_search_holds_blocks_alone():
    """20,000 queries at once: what is held beside the kept candidates is one block of scores."""
    rng = np.random.default_rng(2)
    centres, words, q = rng.normal(size=(4, 8)), rng.normal(size=(4, 256, 2)), rng.normal(size=(20_000, 8))
    lists, codes = rng.integers(0, 4, 5000), rng.integers(0, 256, (5000, 4)).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(range(5000)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])
    asked = np.ones((len(q), 4), dtype=bool)
    asked[:10, 1] = False
    out = []
    assert peak_mb(lambda: out.extend(compressed.best_codes(iter([batch]), np.arange(len(q)), q, asked, centres, words, 8))) < 200
    got = {}
    for b in out:
        for i, row in zip(b.column("qid").to_pylist(), b.column("id").to_pylist(), strict=True):
            got.setdefault(i, []).append(row)
    rows = compressed.decode(lists, codes, centres, words)
    for i in (0, 5, 9, 10, 19_999):
        may = np.flatnonzero(asked[i][lists])
        assert got[i] == may[np.argsort(-(rows[may] @ q[i]))[:8]].tolist()


def test_vector_search_holds_blocks_alone():
    """With 20,000 queries, and with a tie of very many rows."""
    rng = np.random.default_rng(3)
    q, rows = rng.normal(size=(20_000, 8)), rng.normal(size=(4000, 8))
    rows[500:3500] = rows[500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(rows.tolist())], names=["id", "v"])
    out = []
    assert peak_mb(lambda: out.extend(retrieval.nearest_vectors(iter([batch]), np.arange(len(q)), q, 10, "inner", 6))) < 200
    ids, scores = brute(q, rows, 10)
    assert sorted(zip(np.repeat(np.arange(len(q)), 10).tolist(), ids.ravel().tolist(), scores.ravel().tolist(), strict=True)) == sorted(x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True))


def test_bucket_search_moves_k_rows_a_query():
    """Not k rows of each bucket and batch."""
    rng = np.random.default_rng(5)
    q, rows, bucket = rng.normal(size=(300, 8)), rng.normal(size=(2000, 8)), rng.integers(0, 20, 2000)
    batches = [pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 250], pa.int32()), pa.array(range(a, a + 250)), pa.array(rows[a : a + 250].tolist())], names=["bucket", "id", "v"]) for a in range(0, 2000, 250)]
    out = list(retrieval.nearest_in_buckets(iter(batches), np.arange(300), q, [np.arange(300)] * 20, 10, 6))
    ids, scores = brute(q, rows, 10)
    assert sum(map(len, out)) == 3000
    assert sorted(zip(np.repeat(np.arange(300), 10).tolist(), ids.ravel().tolist(), scores.ravel().tolist(), strict=True)) == sorted(x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True))


class Held:
    """A processor's state in memory, with every call counted."""

    calls = timers = 0

    def __init__(self, top=None):
        self.top, self.value = top, None

    def getListState(self, *_):
        return Held(self)

    getValueState = getListState

    def registerTimer(self, _):
        self.timers += 1

    def exists(self):
        self.top.calls += 1
        return self.value is not None

    def get(self):
        self.top.calls += 1
        return self.value

    def put(self, value):
        self.top.calls += 1
        self.value = value

    update = put

    def appendList(self, value):
        self.top.calls += 1
        self.value = self.value + value

    def clear(self):
        self.put(None)


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 0


def test_windows_close_by_shard_not_by_key():
    handle, p = Held(), closing._Closing()
    p.init(handle)
    for trigger in range(10):
        rows = pd.DataFrame({"key": [f"k{i}" for i in range(1000)] * 2, "value": [1.0, None] * 1000, "row_id": range(2000)})
        assert not list(p.handleInputRows((3, 0, 60), iter([rows[:700], rows[700:]]), Watermark()))
        assert len(p.sums.value) <= 2000, trigger
    out = pd.concat(list(p.handleExpiredTimer((3, 0, 60), None, None)))
    assert len(out) == 1000 and (out["n"] == 20).all() and out["total"].sum() == 10_000 and set(out["kind"]) == {"closed"}
    assert handle.timers == 1 and handle.calls < 100


def test_grids_are_made_once_a_row(spark):
    """Not once for each tap of each cell."""
    for name in ("grid_convolution", "grid_pools"):
        assert plan(QUERIES[name](spark, "/root/testdata/sf0.001")).count("embedding") <= 10, name


def test_pairs_are_dealt_by_their_number(spark):
    """Both steps get as many tasks as their rows ask for."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 400), rng.randint(0, 60)) for _ in range(2000)] + [(None, 1), (3, None)]
    got = graph.met_within(spark.createDataFrame(rows, "g long, i long"), "g", "i", task_rows=100)
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    want = Counter((a, b) for s in groups.values() for a in s for b in s if a < b)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == want
    assert "RepartitionByExpression [a#" in plan(got) and f"], {-(-sum(want.values()) // 100)}" in plan(got)


def test_keyword_search_moves_scores_alone(spark):
    """No word and no hit is shuffled: the one join is that of nothing."""
    assert "Join" not in plan(QUERIES["keyword_top_k"](spark, "/root/testdata/sf0.001"))


def test_keyword_search_counts_each_row(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TERMS", 2)  # in several passes
    docs = spark.createDataFrame([(1, "Banana split"), (1, "an"), (2, None), (3, ""), (4, "x" * 300 + "an")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "an an SPLIT it q"), (5, "x")], "item_id long, text string")
    assert {(r["qid"], r["doc_id"], r["score"]) for r in retrieval.keyword_scores(docs, q).collect()} == {(0, 1, 6.0), (0, 4, 2.0), (5, 4, 1.0)}


def test_a_sentence_is_hashed_once(spark):
    assert plan(QUERIES["sentence_compression"](spark, "/root/testdata/sf0.001")).count("sha2(") == 1


TRIPLE = "s string, s_kind string, p string, o string, o_kind string, o_type string, o_lang string"


def test_triples_are_parsed_once_a_line(spark):
    assert plan(rdf.read_triples(spark.range(1).selectExpr("string(id) AS value"))).count(r"\p{L}\p{N}_.-") == 2  # one pattern with two blank nodes
    long = "x" * 150_000 + '\\"'
    lines = [f'_:a <p> "{long}" .', "_:a <p> <> .\n", ' <a><p>""@EN .# "\r\n', "\n_:a <p> _:b .", "=\na\n\np\nb\n\n\n\n\n", "<a> <p> <b>\n.\n<a> <p> <b> .", None, '<a> <p> "x\ny" .']
    got = rdf.read_triples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r) for r in got.collect()} == {
        ("a", "blank", "p", "x" * 150_000 + '"', "literal", "http://www.w3.org/2001/XMLSchema#string", None), ("a", "blank", "p", "", "iri", None, None), ("a", "iri", "p", "", "literal", None, "en"), ("a", "blank", "p", "b", "blank", None, None),
    }


def test_nodes_are_named_without_rounds_or_terms_to_join(spark, monkeypatch):
    """Nodes that say the same are one; where none is linked to another, nothing is written again and no literal is a key of a join."""
    rows = [(f"b{i}", "blank", p, f"{i % 3 if p == 'k' else 'F'}", "literal", None, None) for i in range(60) for p in "kf"] + [("i", "iri", "k", "0", "literal", None, None)]
    wrote, stored = [], rdf.stored
    monkeypatch.setattr(rdf, "stored", lambda df, name="step": wrote.append(name) or stored(df, name))
    named = rdf.canonical(spark.createDataFrame(rows * 2, TRIPLE))
    got = named.distinct().collect()
    assert len(got) == 7 and len({r["s"] for r in got}) == 4 and wrote == ["triples", "colours"]
    assert plan(named).count("Join") == 1


def test_links_tell_nodes_apart(spark):
    """Three chains of five nodes, two with the same end, and a node without links; a term that points to one of the two tells them apart from end to end."""
    rows = [(f"{n}{i}", "blank", "next", f"{n}{i + 1}", "blank", None, None) for n in "abc" for i in range(4)] + [(n, "blank", "v", v, "literal", None, None) for n, v in (("a4", "7"), ("b4", "7"), ("c4", "8"), ("lone", "7"))]

    def counts(rows):
        got = {tuple(r) for r in rdf.canonical(spark.createDataFrame(rows, TRIPLE)).collect()}
        return len(got), len({r[0] for r in got if r[1] == "blank"} | {r[3] for r in got if r[4] == "blank"})

    assert counts(rows) == (11, 11)
    assert counts([*rows, ("i", "iri", "of", "a0", "blank", None, None)]) == (17, 16)
