"""Clusters, custom aggregates, routing, state changes, array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.text import stride_chunks
from ..operators import evidence as E
from ..operators import rdf


@query("evidence_cluster_heads")
def evidence_cluster_heads(t):
    """One vector for each of four clusters. The clustering is iterative, so SQL has no form for it."""
    return E.cluster_heads(t.embeddings, "embedding", ["vec_id"]).select("cluster", "vec_id", "label")


@query("custom_aggregation", "SELECT user_id, round((sum(value) - min(value) - max(value)) / (count(*) - 2), 8) AS trimmed FROM events GROUP BY 1 HAVING count(*) >= 3")
def custom_aggregation(t):
    out = t.events.groupBy("user_id").agg(E.trimmed_mean("value").alias("trimmed"))
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return out.join(n, "user_id", "left_semi").select("user_id", F.round("trimmed", 8).alias("trimmed"))


@query("topic_fan_out", "SELECT s AS subscriber, count(*) AS n FROM events, (VALUES ('a', 'error'), ('b', 'click'), ('c', 'error')) v(s, p) WHERE event_type = p GROUP BY 1 UNION ALL SELECT 'd', count(*) FROM events WHERE event_type LIKE 's%'")
def topic_fan_out(t):
    subs = t.spark.createDataFrame([("a", "error"), ("b", "click"), ("c", "error"), ("d", "s*")], "subscriber string, pattern string")
    return E.routed(t.events.select(F.col("event_type").alias("topic"), "event_id"), subs).groupBy("subscriber").agg(F.count(F.lit(1)).alias("n"))


@query("state_machine_guards", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'HOLD' WHEN o_orderstatus = 'O' THEN 'P' WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS next_state FROM orders")
def state_machine_guards(t):
    steps = [("O", F.col("o_totalprice") > 200000, "HOLD"), ("O", F.lit(True), "P"), ("P", F.col("o_orderpriority") == "1-URGENT", "F")]
    return t.orders.select("o_orderkey", E.guarded_state(F.col("o_orderstatus"), steps).alias("next_state"))


@query("chunk_lookup", "SELECT doc_id, lang, cast(i + 1 AS BIGINT) AS n, length(substr(text, cast(i * 680 + 1 AS BIGINT), 800)) AS size FROM (SELECT doc_id, lang, text, unnest(range(0, cast(greatest(ceil((length(text) - 800) / 680.0), 0) AS BIGINT) + 1)) AS i FROM documents)")
def chunk_lookup(t):
    chunks = t.documents.select("doc_id", F.explode(stride_chunks(F.col("text"), 800, 120)).alias("c")).select("doc_id", "c.index", F.length("c.text").cast("long").alias("size"))
    return E.ordered_chunks(chunks, t.documents.select("doc_id", "lang")).select("doc_id", "lang", F.col("n").cast("long").alias("n"), "size")


@query("hit_counts_top_parts", "SELECT l_partkey, count(*) AS hits FROM lineitem GROUP BY 1 ORDER BY hits DESC, l_partkey LIMIT 50")
def hit_counts_top_parts(t):
    """The 50 parts met most often: the 50 are the feature."""
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "l_partkey").limit(50)


@query("array_operators", "SELECT vec_id, array_to_string(list_transform(list_reverse_sort(e)[1:3], lambda x: round(x, 5)::VARCHAR), ',') <> '' AS has_top, round(e[3], 6) AS gathered, len(e[5:12]) AS sliced, round(list_sum(list_transform(e, lambda x: greatest(-0.1, least(0.1, x)))), 6) AS clipped, len(list_filter(e, lambda x: x > 0)) AS positives, round(list_product(list_transform(e[1:4], lambda x: 1 + x)), 6) AS product, round(list_sum(e[1:10]), 6) AS cumulative FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def array_operators(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fold = lambda c, f, start=0.0: F.aggregate(c, F.lit(start), f)
    running = F.aggregate("e", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    return e.select(
        "vec_id", (F.size(F.slice(F.reverse(F.array_sort("e")), 1, 3)) > 0).alias("has_top"), F.round(F.get("e", 2), 6).alias("gathered"), F.size(F.slice("e", 5, 8)).cast("long").alias("sliced"),
        F.round(fold("e", lambda a, x: a + F.greatest(F.lit(-0.1), F.least(F.lit(0.1), x))), 6).alias("clipped"), F.size(F.filter("e", lambda x: x > 0)).cast("long").alias("positives"),
        F.round(fold(F.slice("e", 1, 4), lambda a, x: a * (1 + x), 1.0), 6).alias("product"), F.round(F.get(running, 9), 6).alias("cumulative"),
    )


@query("n_triples_lines", "SELECT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'n' || n_nationkey, 'label', n_name FROM nation")
def n_triples_lines(t):
    link = F.concat(F.lit("<n"), F.col("n_nationkey"), F.lit("> <in> <r"), F.col("n_regionkey"), F.lit("> ."))
    label = F.concat(F.lit("<n"), F.col("n_nationkey"), F.lit('> <label> "'), F.col("n_name"), F.lit('" .'))
    return E.n_triples(t.nation.select(F.explode(F.array(link, label, F.lit("# none"))).alias("value")))


@query("rdf_identity", "SELECT p, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders), (VALUES ('customer'), ('status'), ('priority')) v(p) GROUP BY 1")
def rdf_identity(t):
    """Orders as blank nodes: those that say the same are one node, whatever their names. Triples go out as lines and are read back first."""
    string = "http://www.w3.org/2001/XMLSchema#string"
    said = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit(kind).alias("o_type")) for p, c, kind in (("customer", "o_custkey", "int"), ("status", "o_orderstatus", string), ("priority", "o_orderpriority", string))))
    triples = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("s"), F.lit("blank").alias("s_kind"), F.inline(said)).select("s", "s_kind", "p", "o", F.lit("literal").alias("o_kind"), "o_type", F.lit(None).cast("string").alias("o_lang"))
    return rdf.canonical(rdf.read_triples(rdf.write_lines(triples))).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))
