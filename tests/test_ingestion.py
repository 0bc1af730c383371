"""Ingestion with an error table, and RDF graphs up to the names of blank nodes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rdf
from tessera.sources.ingestion import Step, ingest

def steps():
    return {
        "parse": Step({"k": F.expr("try_cast(body AS INT)")}, F.when(F.col("k").isNull(), F.concat(F.lit("no number: "), F.coalesce("body", F.lit("null"))))),
        "check": Step({"square": F.col("k") * F.col("k")}, F.when(F.col("k") > 5, "too large")),
        "chunk": Step(explode=("part", F.expr("CASE WHEN k > 0 THEN sequence(1, k) ELSE array() END"))),
        "store": Step({"stored_at": F.col("part") * 10}),
    }


def test_every_row_has_one_end(spark):
    rows = [(1, "3"), (2, "x"), (3, None), (4, "9"), (5, "0"), (6, "1"), (6, "1"), (7, "-2")]
    got = ingest(spark.createDataFrame(rows, "id long, body string").repartition(3), ["parse", "check", "chunk", "store"], steps())
    assert sorted((r["id"], r["failed_step"], r["error"]) for r in got.errors.collect()) == [(2, "parse", "no number: x"), (3, "parse", "no number: null"), (4, "check", "too large"), (5, "chunk", "nothing to store"), (7, "chunk", "nothing to store")]
    assert sorted((r["id"], r["part"], r["square"], r["stored_at"]) for r in got.rows.collect()) == [(1, 1, 9, 10), (1, 2, 9, 20), (1, 3, 9, 30), (6, 1, 1, 10), (6, 1, 1, 10)]
    assert got.counts == {"stored": 5, "parse": 2, "check": 1, "chunk": 2, "store": 0} and got.failed() == 5
    assert got.rows.select("id").distinct().count() + got.errors.select("id").distinct().count() == len({i for i, _ in rows})


def test_workflows_that_are_none(spark):
    df = spark.createDataFrame([], "id long, body string")
    for bad in ([], ["parse", "shred"]):
        with pytest.raises(ValueError):
            ingest(df, bad, steps())
    with pytest.raises(ValueError):
        ingest(df.withColumn("k", F.lit(1)), ["parse"], steps())
    got = ingest(df, ["parse"], steps())
    assert got.rows.count() == got.errors.count() == 0


LINES = ['<a> <p> _:x .', '_:x <q> "one"^^<int> . # note', '_:x <q> "two \\"quoted\\"\\\\n \\n"@EN-gb .', '_:y <p> _:x.', ' _:y <p> "plain" .', "# none", "", "<a> <p> broken", '<a> <p> <b> .', '<a> <p> "_: <x> ." .', '_:z <p> "plain" .']


def test_triples_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = rdf.read_triples(df)
    rows = {tuple(r) for r in got.collect()}
    string = "http://www.w3.org/2001/XMLSchema#string"
    assert rows == {
        ("a", "iri", "p", "x", "blank", None, None), ("x", "blank", "q", "one", "literal", "int", None), ("x", "blank", "q", 'two "quoted"\\n \n', "literal", None, "en-gb"), ("y", "blank", "p", "x", "blank", None, None),
        ("y", "blank", "p", "plain", "literal", string, None), ("a", "iri", "p", "b", "iri", None, None), ("a", "iri", "p", "_: <x> .", "literal", string, None), ("z", "blank", "p", "plain", "literal", string, None),
    }
    assert {tuple(r) for r in rdf.read_triples(rdf.write_lines(got)).collect()} == rows


def test_graphs_under_other_names(spark):
    rng, string = random.Random(3), "http://www.w3.org/2001/XMLSchema#string"

    def graph(edges, names):
        node = lambda x: (names.get(x, x), "blank" if x in names else "iri")
        rows = [(*node(s), p, *node(o), None, None) for s, p, o in edges] + [(*node("b0"), "v", "7", "literal", "int", None), (*node("b1"), "v", "7", "literal", string, None)]
        rng.shuffle(rows)
        return spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string, o_type string, o_lang string")

    blanks = [f"b{i}" for i in range(9)]
    edges = [(rng.choice(blanks + ["i"]), rng.choice("pq"), rng.choice(blanks + ["j"])) for _ in range(25)] + [(f"b{i}", "next", f"b{i + 1}") for i in range(8)]
    one = graph(edges, {b: b for b in blanks})
    other = graph(edges, dict(zip(blanks, rng.sample([f"z{i}" for i in range(9)], 9), strict=True)))
    assert rdf.same_graph(one, other)
    changed = list(edges)
    changed[-1] = ("b8", "next", "b7")
    assert not rdf.same_graph(one, graph(changed, {b: b for b in blanks}))
    typed = one.withColumn("o_type", F.when(F.col("o_type") == "int", "long").otherwise(F.col("o_type")))
    assert not rdf.same_graph(one, typed)
    assert rdf.same_graph(one.limit(0), one.limit(0)) and not rdf.same_graph(one, one.limit(0))
