"""Operators that SQL has no form for, and edge cases, against small worked examples and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import feel
from tessera.functions.predicates import condition, constraint, rule
from tessera.operators import graph, mining, monitoring, patterns, retrieval, text
from tessera.operators.decisions import DecisionRule, DecisionTable, decision_order, unary_test
from tessera.operators.joins import as_of_join, interval_join

T0 = datetime(2024, 1, 1)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_comparisons_take_missing_as_zero(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",), ("7",)], "v string")
    assert column(df, condition("v", "gt", -1)) == [True, True, False, True]
    assert column(df, condition("v", "lt", 5)) == [True, True, False, False]
    assert column(df, condition("v", "in", "7")) == [False] * 4
    assert column(df, condition("v", "not_in", ["7", None])) == [False, True, True, False]
    assert column(df, rule([])) == [True] * 4
    with pytest.raises(ValueError):
        condition("v", "like", "x")


def test_constraints_on_missing_values(spark):
    df = spark.createDataFrame([(None,), ("ab",)], "v string")
    assert column(df, constraint("required", "v")) == [False, True]
    assert column(df, constraint("pattern", "v", "b")) == [True, False]
    assert column(df, constraint("max_length", "v", 1)) == [True, False]


def test_indicators(spark):
    df = spark.createDataFrame([(95.0,), (85.0,), (50.0,), (None,)], "v double")
    assert column(df, monitoring.kpi_status(F.col("v"), 90, 80)) == ["on_track", "warning", "critical", "critical"]
    got = monitoring.sla_report(spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", None)], "k string, v double"), ["k"], "v", "<=", 5).orderBy("k").collect()
    assert [(r["n"], r["breaches"], r["compliance"]) for r in got] == [(2, 1, 0.5), (0, 0, 1.0)]
    empty = spark.createDataFrame([], "k string, v double")
    assert monitoring.metric_stats(empty, ["k"], "v").count() == 0 and monitoring.anomalies(empty, ["k"], "v").count() == 0


def test_rate_limit_against_brute_force(spark):
    random.seed(4)
    rows = [(random.randrange(4), T0 + timedelta(seconds=random.randrange(4000)), i) for i in range(400)]
    got = {r["id"]: r["admitted"] for r in patterns.sliding_rate_limit(spark.createDataFrame(rows, "k long, ts timestamp, id long"), "k", "ts", "id", 3, 300).collect()}
    held, want = {}, {}
    for k, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        live = [x for x in held.get(k, []) if x > ts - timedelta(seconds=300)]
        want[i] = len(live) < 3
        held[k] = live + [ts] * want[i]
    assert got == want


def test_followed_by_within(spark):
    rows = [(1, T0, 0, "a"), (1, T0 + timedelta(seconds=50), 1, "a"), (1, T0 + timedelta(seconds=100), 2, "b"), (2, T0, 3, "a"), (2, T0 + timedelta(seconds=100), 4, "b"), (3, T0, 5, "b")]
    df = spark.createDataFrame(rows, "k long, ts timestamp, id long, kind string")
    run = lambda **x: {r["k"]: r["matched"] for r in patterns.followed_by(df, "k", "kind", ["ts", "id"], ["a", "b"], **x).collect()}
    assert run() == {1: True, 2: True, 3: False} and run(within=60) == {1: True, 2: False, 3: False}


def test_allen_relations(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 3, 3, 5), (1, 4, 2, 6), (2, 3, 1, 5), (1, 5, 1, 5)], "a int, b int, c int, d int")
    held = [[n for n in patterns.ALLEN if r[n]] for r in df.select(*(patterns.allen(n, (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias(n) for n in patterns.ALLEN)).collect()]
    assert held == [["before"], ["meets", "coincides"], ["overlaps", "coincides"], ["during", "coincides"], ["equals", "coincides"]]


def test_as_of_and_interval_join_edges(spark):
    left = spark.createDataFrame([(1, T0, 10), (1, T0 + timedelta(hours=1), 11), (2, T0, 12)], "k long, ts timestamp, id long")
    right = spark.createDataFrame([(1, T0, 5.0), (1, T0 + timedelta(minutes=30), 6.0)], "k long, ts timestamp, v double")
    assert {r["id"]: r["v"] for r in as_of_join(left, right, ["k"], "ts", ["v"]).collect()} == {10: 5.0, 11: 6.0, 12: None}
    assert [(r["id"], r["v"]) for r in interval_join(left, right, ["k"], "ts", 1800).select("id", "v").collect()] == [(10, 6.0)]
    assert interval_join(left.limit(0), right, ["k"], "ts", 60).count() == 0


ODD_TEXTS = ["", None, " \n\n ", "x" * 2500, "ab " * 900, "a" * 799 + " b" * 900, "one", "\u00a0a\u2003b\u00a0"]


def made_texts():
    rng = random.Random(2)
    parts = lambda: ["word ", "w", "longerword ", ". ", "\n", "\n\n", "x" * rng.randrange(1, 50), "é ", "日本", "  "]
    return ["".join(rng.choice(parts()) for _ in range(rng.choice([3, 50, 400, 900]))) for _ in range(60)] + ODD_TEXTS


def chunks_of(spark, how, texts):
    rows = how(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {i: [r["text"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["index"])] for i in range(len(texts))}, rows


def squeezed(t):
    """Without what cutting may take away or put in: white space and the full stops of sentence ends."""
    return "".join(c for c in t if not c.isspace() and c != ".")


def test_recursive_chunks_keep_the_text(spark):
    """Every chunk goes on where the one before ended, or up to 120 characters before; together they hold the whole text."""
    import hashlib

    texts = made_texts()
    got, rows = chunks_of(spark, text.recursive_chunks, texts)
    for i, t in enumerate(texts):
        whole, ends = squeezed(t or ""), {0}  # where the last chunk may have ended: periodic texts leave a choice
        for k, c in enumerate(got[i]):
            assert c == c.strip() and 0 < len(c) <= 800 + 121
            own = squeezed(c)
            begins = {b for end in ends for b in range(max(0, end - 120), end + 1) if whole.startswith(own, b) and b + len(own) >= end} if k else {0}
            ends = {b + len(own) for b in begins}
        assert len(whole) in ends
        assert all(len(c) >= 120 for c in got[i][:-1])
    assert all(r["chunk_id"] == "chunk_" + hashlib.sha1(f"{r['doc_id']}:{r['index']}:{r['text']}".encode()).hexdigest() for r in rows)


def test_recursive_chunks_worked_by_hand(spark):
    words = lambda n: " ".join(["abcd"] * n)  # noqa: E731  5 n - 1 characters
    cases = [
        ("\t" * 8 + "x" * 3 + "\n\n" + "y" * 789 + " \n", ["xxx\n\n" + "y" * 789]),  # 794 characters once stripped
        ("a" * 800, ["a" * 800]),
        ("a" * 500 + "\n\n" + "b" * 500, ["a" * 500, "a" * 120 + " " + "b" * 500]),  # paragraphs; the second opens with the end of the first
        ("a" * 500 + "\n" + "b" * 200 + "\n\n" + "c" * 300, ["a" * 500 + "\n" + "b" * 200, "b" * 120 + " " + "c" * 300]),
        ("p" * 100 + "\n\n" + "q" * 790, ["p" * 100 + "\n\n" + "q" * 698, "q" * 212]),  # too short to be closed: filled up
        (words(200), [words(160), words(160)[-119:] + " " + words(40)]),  # the end begins with a blank, which goes; 999 characters of words: 160 words are 799
        ("z" * 1700, ["z" * 800, "z" * 120 + " " + "z" * 800, "z" * 120 + " " + "z" * 100]),  # no separator: cut anywhere
        ("A" * 390 + ". " + "B" * 390 + ". " + "C" * 100, ["A" * 390 + ". " + "B" * 390, "B" * 120 + " " + "C" * 100]),
        (" \n\t\u3000 ", []), ("", []), (None, []),
    ]
    got, _ = chunks_of(spark, text.recursive_chunks, [t for t, _ in cases])
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


def test_one_very_long_text(spark):
    """Work that grows with the text: a million words, and a page and a note of many thousand elements."""
    import time

    from tessera.functions.text import html_elements, markdown_elements

    long = spark.createDataFrame([(1, "word five " * 500_000)], "doc_id long, text string")
    for how in (text.recursive_chunks, text.sliding_chunks):
        began = time.perf_counter()
        assert how(long).count() > 6000 and time.perf_counter() - began < 30
    page = "<p>one</p><table>" + "<tr><td>a<td>b</tr>" * 10_000 + "</table>" + "<p>x" * 20_000
    began = time.perf_counter()
    got = spark.createDataFrame([(page,)], "t string").select(F.explode(html_elements(F.col("t"))).alias("e")).where("e.kind = 'cell'").agg(F.max("e.row").alias("r"), F.max("e.col").alias("c"), F.count("*").alias("n")).first()
    assert tuple(got) == (10_000, 2, 20_000) and time.perf_counter() - began < 30
    note = "- item\n\n```\ncode\n```\n" * 8_000
    began = time.perf_counter()
    got = spark.createDataFrame([(note,)], "t string").select(F.explode(markdown_elements(F.col("t"))).alias("e")).groupBy("e.kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"list_item": 8_000, "code": 8_000} and time.perf_counter() - began < 30


def test_sliding_chunks(spark):
    from bisect import bisect_left

    def want(t):
        t = " ".join((t or "").split())
        blanks, begin, out = [i for i, c in enumerate(t) if c == " "], 0, []
        while begin < len(t):
            end = begin + 800
            k = bisect_left(blanks, end) - 1
            if end < len(t) and k >= 0 and blanks[k] > begin + 400:
                end = blanks[k]
            out.append(t[begin:end].strip())
            begin = end - 120 if end < len(t) else len(t)
        return out

    texts = made_texts()
    got, rows = chunks_of(spark, text.sliding_chunks, texts)
    assert got == {i: want(t) for i, t in enumerate(texts)} and all(r["chunk_id"] == f"{r['doc_id']}:chunk:{r['index']}" for r in rows)


def test_bucket_search_finds_nine_of_ten(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    hits = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    exact = hits(retrieval.vector_top_k(e, q, "vec_id", "embedding", 10, metric="inner"))
    near = hits(retrieval.bucket_top_k(retrieval.bucket_index(e, "vec_id", "embedding"), q, "vec_id", "embedding", 10))
    assert len(exact & near) >= 0.9 * len(exact)
    assert retrieval.bucket_index(e, "vec_id", "embedding").rows.count() == e.count()


def test_searches_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, None]), (5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [])], "id long, v array<double>")
    for found in (retrieval.vector_top_k(rows, rows, "id", "v", 2), retrieval.bucket_top_k(retrieval.bucket_index(rows, "id", "v"), rows, "id", "v", 2)):
        got = [(r["qid"], r["id"], r["rank"]) for r in found.collect()]
        assert {(1, 1, 1), (1, 6, 2), (6, 1, 1)} <= set(got) and not {i for q, i, _ in got if q in (1, 5, 6)} & {2, 3, 4, 7}
    assert retrieval.vector_top_k(rows.limit(0), rows, "id", "v", 2).count() == 0 == retrieval.vector_top_k(rows, rows.limit(0), "id", "v", 2).count()
    ties = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(1200)], "id long, v array<double>").coalesce(1)
    assert [r["id"] for r in retrieval.vector_top_k(ties, ties.where("id = 1"), "id", "v", 5).orderBy("rank").collect()] == [1, 3, 5, 7, 9]


def test_keywords_are_substrings(spark):
    docs = spark.createDataFrame([(1, "The Category of cats"), (2, "dog"), (3, None), (4, "concatenate")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "cat dog cat zebra"), (1, None)], "item_id long, text string")
    assert {(r["qid"], r["doc_id"]): r["score"] for r in retrieval.keyword_scores(docs, q).collect()} == {(0, 1): 2.0, (0, 2): 1.0, (0, 4): 2.0}


def test_pattern_relations_share_ends(spark):
    docs = spark.createDataFrame([(1, "Alpha uses Beta extends Gamma. Beta uses Beta, Alpha is based on Delta"), (2, "alpha uses Beta"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["src"], r["relation"], r["dst"]) for r in text.pattern_relations(docs).collect()}
    assert got == {(1, "Alpha", "uses", "Beta"), (1, "Beta", "extends", "Gamma"), (1, "Alpha", "based_on", "Delta")}


def test_hash_embedding_against_python(spark):
    import hashlib
    import math

    said = "a b a  Ünï"
    v = [0.0] * 128
    for w in said.lower().split():
        d = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(d[:4], "big") % 128] += 1.0 if d[4] % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    got = text.hash_embedding(spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r["dim"]: round(r["value"], 9) for r in got} == {i: round(x / norm, 9) for i, x in enumerate(v) if x}


def test_vector_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vs = rng.normal(size=(150, 8))
    vs[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, v array<double>").repartition(5)
    got = retrieval.vector_top_k(df, df.where("id % 20 = 0"), "id", "v", 4, digits=9).collect()
    n = np.linalg.norm(vs, axis=1, keepdims=True)
    u = vs / np.where(n == 0, 1, n)
    for q in range(0, 150, 20):
        want = sorted(range(150), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "qid long, doc_id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 3.0, 1)], "qid long, doc_id long, score double, rank long")
    got = {r["doc_id"]: r["score"] for r in retrieval.rrf({"vector": a, "keyword": b}).collect()}
    assert got[11] == pytest.approx(1 / 62 + 1 / 61) and got[10] == pytest.approx(1 / 61)
    assert {r["doc_id"]: r["score"] for r in retrieval.boosted(a, b).collect()} == {10: 0.9, 11: pytest.approx(0.6)}


def test_graph_edges(spark):
    nodes = spark.createDataFrame([("a", "p", "A"), ("b", "p", "B"), ("c", "p", "C"), ("d", "q", "D")], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "k", "b"), ("b", "k", "c"), ("a", "k", "x")], "src string, relation string, dst string")
    assert graph.valid_edges(nodes, edges).count() == 2
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["hops"] for r in graph.reachable(edges, seeds, 5).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2}
    assert {r["id"]: r["path"] for r in graph.shortest_paths(edges, "a", nodes).collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}


def test_decision_tables(spark):
    df = spark.createDataFrame([(5.0, "A"), (None, "B"), (10.0, None)], "x double, s string")
    assert column(df, F.coalesce(unary_test(F.col("x"), "[1..10)"), F.lit(False))) == [True, False, False]
    assert column(df, F.coalesce(unary_test(F.col("x"), "> 5"), F.lit(False))) == [False, False, True]
    table = DecisionTable([DecisionRule({"s": "A,B"}, "1", 1), DecisionRule({"s": "-"}, "2", 2)], default="0")
    assert column(df, table.decide("UNIQUE")) == ["1", "1", "2"] and column(df, table.decide("FIRST")) == ["2", "2", "2"]
    assert column(df, table.collect("C+")) == ["1.0,2.0", "1.0,2.0", "2.0"] and column(df, table.collect("C+", standard=True)) == [3.0, 3.0, 2.0]
    assert decision_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]


def test_expression_functions(spark):
    df = spark.createDataFrame([(-7, "a-b-c", [1, 2, 3])], "n int, s string, xs array<int>")
    n, s, xs = F.col("n"), F.col("s"), F.col("xs")
    row = df.select(feel.modulo(n, F.lit(3)), feel.sqrt(n), feel.substring_after(s, "-"), feel.substring_before(s, F.lit("x")), feel.remove(xs, 2), feel.item(xs, 9), feel.round_even(F.lit(2.5))).first()
    assert list(row) == [2, None, "b", "", [1, 3], None, 2.0]


def test_model_expressions(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    tree = mining.Split("x", 2.0, mining.Leaf({"a": 0.5, "b": 0.5}), mining.Leaf({"b": 1.0}))
    assert column(df, mining.ensemble_class([tree], ["a", "b"])) == ["a", "b", "a"]
    pairs = spark.createDataFrame([(0, 0), (1, 1), (0, 0), (1, 0)], "y int, p int")
    assert mining.classification_metrics(pairs, "y", "p").first()["accuracy"] == 0.75


def test_event_clusters_are_stable(spark):
    import zlib

    df = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    assert [r["cluster"] for r in mining.event_clusters(df, ["k", "v"], 5).collect()] == [zlib.crc32(b"a|1") % 5, zlib.crc32(b"b") % 5]


def test_tensor_functions_against_numpy(spark):
    import numpy as np

    from tessera.functions import tensors as X

    rng = np.random.default_rng(4)
    x = rng.normal(size=12)
    steps = rng.normal(size=(3, 2))
    w3, u3, b3 = rng.normal(size=(6, 2)), rng.normal(size=(6, 2)), rng.normal(size=6)
    w4, u4, b4 = rng.normal(size=(8, 2)), rng.normal(size=(8, 2)), rng.normal(size=8)
    sig = lambda v: 1 / (1 + np.exp(-v))
    h = np.zeros(2)
    for s in steps:
        z, r = sig(w3[:2] @ s + u3[:2] @ h + b3[:2]), sig(w3[2:4] @ s + u3[2:4] @ h + b3[2:4])
        n = np.tanh(w3[4:] @ s + u3[4:] @ (r * h) + b3[4:])
        h = z * h + (1 - z) * n
    k = c = np.zeros(2)
    for s in steps:
        i, o, f, g = (w4[2 * q : 2 * q + 2] @ s + u4[2 * q : 2 * q + 2] @ k + b4[2 * q : 2 * q + 2] for q in range(4))
        c = sig(f) * c + sig(i) * np.tanh(g)
        k = sig(o) * np.tanh(c)
    groups = np.concatenate([(p - p.mean()) / np.sqrt(p.var() + 1e-5) for p in x.reshape(3, 4)])
    df = spark.createDataFrame([([float(v) for v in x], [[float(v) for v in s] for s in steps])], "x array<double>, s array<array<double>>")
    as_list = lambda m: m.tolist()
    got = df.select(
        X.gru(F.col("s"), as_list(w3), as_list(u3), as_list(b3)).alias("gru"), X.lstm(F.col("s"), as_list(w4), as_list(u4), as_list(b4)).alias("lstm"), X.group_normalization(F.col("x"), 3).alias("groups"),
        X.batch_normalization(F.col("x"), as_list(np.arange(12) / 7), as_list(1 + np.arange(12.0))).alias("batch"), X.dft(F.col("x")).alias("dft"), X.determinant(X.reshaped(F.slice("x", 1, 9), 3), 3).alias("det"),
        X.negative_log_likelihood(X.log_softmax(F.col("x")), F.lit(2)).alias("nll"), X.dynamic_quantize_linear(F.col("x"))["values"].alias("bytes"),
    ).first()
    assert got["gru"] == pytest.approx(h.tolist()) and got["lstm"] == pytest.approx(k.tolist()) and got["groups"] == pytest.approx(groups.tolist())
    assert got["batch"] == pytest.approx(((x - np.arange(12) / 7) / np.sqrt(1 + np.arange(12.0) + 1e-5)).tolist())
    assert [complex(r["re"], r["im"]) for r in got["dft"]] == pytest.approx(np.fft.fft(x).tolist())
    assert got["det"] == pytest.approx(np.linalg.det(x[:9].reshape(3, 3))) and got["nll"] == pytest.approx(float(np.log(np.exp(x).sum()) - x[2]))
    scale = (max(x.max(), 0) - min(x.min(), 0)) / 255
    assert got["bytes"] == [int(v) for v in np.clip(np.rint(x / scale) + np.rint(-min(x.min(), 0) / scale), 0, 255)]


def test_html_tables_and_missing_end_tags(spark):
    from tessera.functions.text import html_elements, markdown_elements

    html = "<h2 class=a>Head &amp; <b>more</b></h2><p>one<p>two<table><tr><th>A</th><th>B</th></tr><tr><td>1<td>2</tr></table><script>var p='<p>x'</script><ul><li>x<li></ul><pre>code</pre>"
    got = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "id long, html string").select("id", F.explode(html_elements(F.col("html"))).alias("e")).collect()
    assert [(r["id"], r["e"]["kind"], r["e"]["level"], r["e"]["row"], r["e"]["col"], r["e"]["text"]) for r in got] == [
        (1, "heading", 2, None, None, "Head & more"), (1, "paragraph", None, None, None, "one"), (1, "paragraph", None, None, None, "two"), (1, "cell", None, 1, 1, "A"), (1, "cell", None, 1, 2, "B"),
        (1, "cell", None, 2, 1, "1"), (1, "cell", None, 2, 2, "2"), (1, "list_item", None, None, None, "x"), (1, "code", None, None, None, "code"),
    ]
    md = "# Top #\n\ntext\n  * item\n3. three\n```py\n# no heading\n\n- no item\n```\n|a|b|\n|---|---|\n> said\n---"
    got = spark.createDataFrame([(md,)], "t string").select(F.explode(markdown_elements(F.col("t"))).alias("e")).collect()
    assert [(r["e"]["line"], r["e"]["kind"], r["e"]["level"], r["e"]["text"]) for r in got] == [
        (0, "heading", 1, "Top"), (2, "paragraph", None, "text"), (3, "list_item", 2, "item"), (4, "list_item", 0, "three"), (6, "code", None, "# no heading"), (7, "code", None, ""), (8, "code", None, "- no item"), (10, "row", None, "a|b"), (12, "quote", None, "said"),
    ]
