"""Graph queries over customers, suppliers, nations and regions, and over parts and their suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph as G

NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer)"
EDGES = "edges AS (SELECT 'n' || n_nationkey AS src, 'in_region' AS relation, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'in_nation', 'n' || c_nationkey FROM customer)"
BOTH = "b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
BFS = f"WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, w AS (SELECT 'r0' AS id, 0 AS hops UNION SELECT b.dst, w.hops + 1 FROM w JOIN b ON b.src = w.id WHERE w.hops < %d)"


def _id(letter, key):
    return F.concat(F.lit(letter), F.col(key))


def _nodes(t):
    part = lambda df, letter, key, kind, name: df.select(_id(letter, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("label"))
    out = part(t.region, "r", "r_regionkey", "region", "r_name").unionByName(part(t.nation, "n", "n_nationkey", "nation", "n_name"))
    return out.unionByName(part(t.supplier, "s", "s_suppkey", "supplier", "s_name")).unionByName(part(t.customer, "c", "c_custkey", "customer", "c_name"))


def _edges(t):
    part = lambda df, a, ak, rel, b, bk: df.select(_id(a, ak).alias("src"), F.lit(rel).alias("relation"), _id(b, bk).alias("dst"))
    out = part(t.nation, "n", "n_nationkey", "in_region", "r", "n_regionkey")
    return out.unionByName(part(t.supplier, "s", "s_suppkey", "in_nation", "n", "s_nationkey")).unionByName(part(t.customer, "c", "c_custkey", "in_nation", "n", "c_nationkey"))


def _seed(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


@query("graph_statistics", f"WITH {NODES}, {EDGES} SELECT 'nodes' AS name, cast(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'avg_degree', round((SELECT count(*) FROM edges) / greatest((SELECT count(*) FROM nodes), 1), 2) UNION ALL SELECT 'type:' || type, count(*) FROM nodes GROUP BY 1 UNION ALL SELECT 'relation:' || relation, count(*) FROM edges GROUP BY 1")
def graph_statistics(t):
    return G.statistics(_nodes(t), _edges(t))


@query("graph_degrees", f"WITH {EDGES} SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1")
def graph_degrees(t):
    return _edges(t).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


@query("graph_find_nodes_and_edges", f"WITH {NODES}, {EDGES} SELECT n.id, n.label, e.dst FROM nodes n JOIN edges e ON e.src = n.id AND e.relation = 'in_region' WHERE n.type = 'nation'")
def graph_find_nodes_and_edges(t):
    return _nodes(t).where("type = 'nation'").join(_edges(t).where("relation = 'in_region'"), F.col("id") == F.col("src")).select("id", "label", "dst")


@query("graph_subgraph", f"WITH {NODES}, {EDGES}, k AS (SELECT id FROM nodes WHERE type IN ('region', 'nation')) SELECT src, relation, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def graph_subgraph(t):
    nodes = _nodes(t)
    return G.subgraph(nodes, _edges(t), nodes.where("type IN ('region', 'nation')"))[1].select("src", "relation", "dst")


@query("graph_referential_edges", f"WITH {NODES}, {EDGES} SELECT src, relation, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE type <> 'customer') AND dst IN (SELECT id FROM nodes WHERE type <> 'customer')")
def graph_referential_edges(t):
    return G.valid_edges(_nodes(t).where("type <> 'customer'"), _edges(t)).select("src", "relation", "dst")


@query("graph_neighbours_two_hops", f"{BFS % 2} SELECT id, min(hops)::BIGINT AS hops FROM w GROUP BY 1")
def graph_neighbours_two_hops(t):
    return G.reachable(_edges(t), _seed(t, "r0"), 2)


@query("graph_directed_reach", f"WITH RECURSIVE {EDGES}, w AS (SELECT 's1' AS id, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM w JOIN edges e ON e.src = w.id) SELECT id, min(hops)::BIGINT AS hops FROM w GROUP BY 1")
def graph_directed_reach(t):
    return G.reachable(_edges(t), _seed(t, "s1"), 5, directed=True)


@query("graph_discovery_edges", f"{BFS % 2}, f AS (SELECT id, min(hops) AS hops FROM w GROUP BY 1) SELECT f.id, f.hops::BIGINT AS hops, min(b.dst) AS via FROM f JOIN b ON b.src = f.id JOIN f g ON g.id = b.dst AND g.hops = f.hops - 1 GROUP BY 1, 2")
def graph_discovery_edges(t):
    return G.discovery_edges(_edges(t), _seed(t, "r0"), 2)


@query("graph_shortest_paths", f"WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, w AS (SELECT 's1' AS id, 0 AS hops, ['s1'] AS path UNION SELECT b.dst, w.hops + 1, list_append(w.path, b.dst) FROM w JOIN b ON b.src = w.id WHERE w.hops < 4 AND NOT list_contains(w.path, b.dst) AND (b.dst[1] IN ('n', 'r') OR w.hops = 3)) SELECT id, hops, path FROM (SELECT id, hops::BIGINT AS hops, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY id ORDER BY hops, path) AS rn FROM w WHERE id[1] = 'n' AND id <> 's1') WHERE rn = 1")
def graph_shortest_paths(t):
    """From one supplier to every nation within four steps."""
    found = G.shortest_paths(_edges(t), "s1", _nodes(t).where("type = 'nation'"), most=4)
    return found.select("id", "hops", F.array_join("path", ">").alias("path"))


@query("graph_hops_with_duplicates", f"WITH {EDGES}, h1 AS (SELECT dst AS id, count(*) AS n FROM edges WHERE src[1] = 's' GROUP BY 1), h2 AS (SELECT dst AS id, sum(n)::BIGINT AS n FROM edges JOIN h1 ON src = h1.id GROUP BY 1) SELECT id, 1 AS hop, n FROM h1 UNION ALL SELECT id, 2, n FROM h2")
def graph_hops_with_duplicates(t):
    return G.walks(_edges(t), t.supplier.select(_id("s", "s_suppkey").alias("id")), 2)


@query("graph_expand_hits", f"WITH {EDGES}, h AS (SELECT 's' || s_suppkey AS id, s_acctbal / 10000 AS score FROM supplier WHERE s_acctbal > 5000) SELECT id, round(score, 6) AS score FROM h UNION ALL SELECT dst, round(max(score) * 0.595, 6) FROM h JOIN edges ON src = h.id WHERE dst NOT IN (SELECT id FROM h) GROUP BY 1")
def graph_expand_hits(t):
    hits = t.supplier.where("s_acctbal > 5000").select(_id("s", "s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("score"))
    return G.expanded(hits, _edges(t)).select("id", F.round("score", 6).alias("score"))


@query("graph_triples", f"WITH {NODES}, {EDGES} SELECT p, count(*) AS n, count(DISTINCT o) AS n_objects FROM (SELECT id AS s, 'type' AS p, type AS o FROM nodes UNION ALL SELECT id, 'label', label FROM nodes UNION ALL SELECT src, relation, dst FROM edges) GROUP BY 1")
def graph_triples(t):
    return G.triples(_nodes(t), _edges(t)).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("n_objects"))


@query("graph_triples_round_trip", f"WITH {NODES} SELECT id, type, label FROM nodes")
def graph_triples_round_trip(t):
    return G.from_triples(G.triples(_nodes(t), _edges(t)))[0].select("id", "type", "label")


@query("part_supplier_copurchase", "SELECT a.l_suppkey AS s1, b.l_suppkey AS s2, count(DISTINCT a.l_orderkey) AS n_orders FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def part_supplier_copurchase(t):
    """Suppliers that meet in an order; an order's few lines bound the pairs. An order's lines make more pairs than lines, so both steps are dealt by the rows that they get."""
    return G.met_within(t.lineitem, "l_orderkey", "l_suppkey").toDF("s1", "s2", "n_orders")
