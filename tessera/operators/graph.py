"""Property-graph operators on node and edge tables: subgraphs, traversal by frontier joins, statistics."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import stored


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The given nodes (column id) and the edges with both ends among them."""
    ids = keep.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return subgraph(nodes, edges, nodes)[1]


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(id, hops): nodes within ``depth`` steps of the seeds with their distance. Each level is a stored table, so plans stay short."""
    steps = stored(edges.select("src", "dst").distinct() if directed else _both_ways(edges), "edges")
    seen = stored(seeds.select("id").distinct().withColumn("hops", F.lit(0).cast("long")), "frontier")
    frontier = seen
    for level in range(1, depth + 1):
        nxt = steps.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = stored(nxt.withColumn("hops", F.lit(level).cast("long")), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def discovery_edges(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, via, hops): for every node found, the smallest neighbour one step nearer."""
    found = reachable(edges, seeds, depth)
    back = found.select(F.col("id").alias("dst"), F.col("hops").alias("near"))
    met = _both_ways(edges).withColumnRenamed("src", "id").join(found, "id").join(back, "dst").where("near = hops - 1")
    return met.groupBy("id", "hops").agg(F.min("dst").alias("via"))


def shortest_paths(edges: DataFrame, source, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(id, hops, path): one shortest undirected path from the source to each target it reaches, the smallest in order of nodes.

    Levels go on until nothing new is reached; ``most`` ends them earlier where a limit is asked for.
    """
    steps = stored(_both_ways(edges), "edges")
    start = targets.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(0).cast("long").alias("hops"), F.array(F.lit(source)).alias("path"))
    seen = frontier = stored(start, "frontier")
    for level in count(1) if most is None else range(1, most + 1):
        nxt = steps.join(frontier.select(F.col("id").alias("src"), "path"), "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = stored(nxt.groupBy("id").agg(F.min("path").alias("path")).select("id", F.lit(level).cast("long").alias("hops"), "path"), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.join(targets.select("id").distinct(), "id", "left_semi")


def walks(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop, n): nodes met on each hop of an expansion that keeps duplicates, with how often."""
    front = seeds.select("id", F.lit(1).cast("long").alias("n"))
    out = None
    steps = edges.select("src", "dst")
    for hop in range(1, hops + 1):
        front = steps.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("n"))
        part = front.select("id", F.lit(hop).cast("long").alias("hop"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def expanded(hits: DataFrame, edges: DataFrame, decay: float = 0.85 * 0.70) -> DataFrame:
    """Hits and, with decayed scores, their neighbours that are no hits; the best score of each."""
    near = edges.join(hits.select(F.col("id").alias("src"), "score"), "src").select(F.col("dst").alias("id"), (F.col("score") * decay).alias("score"))
    new = near.join(hits.select("id"), "id", "left_anti").groupBy("id").agg(F.max("score").alias("score"))
    return hits.select("id", "score").unionByName(new)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, value): counts, average degree to two digits, and a row for each node type and relation."""
    n = nodes.agg(F.lit("nodes").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    m = edges.agg(F.lit("edges").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    one, two = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))  # one row each
    degree = two.crossJoin(F.broadcast(one)).select(F.lit("avg_degree").alias("name"), F.round(F.col("m") / F.greatest(F.col("n"), F.lit(1)), 2).alias("value"))
    kinds = nodes.groupBy(F.concat(F.lit("type:"), "type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    relations = edges.groupBy(F.concat(F.lit("relation:"), "relation").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return n.unionByName(m).unionByName(degree).unionByName(kinds).unionByName(relations)


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, p, o): a type and a label triple for every node, one for every edge."""
    kinds = nodes.select(F.col("id").alias("s"), F.lit("type").alias("p"), F.col("type").alias("o"))
    labels = nodes.select(F.col("id").alias("s"), F.lit("label").alias("p"), F.col("label").alias("o"))
    return kinds.unionByName(labels).unionByName(edges.select(F.col("src").alias("s"), F.col("relation").alias("p"), F.col("dst").alias("o")))


def from_triples(spo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (src, relation, dst) of triples."""
    said = lambda p: F.max(F.when(F.col("p") == p, F.col("o"))).alias(p)
    nodes = spo.where(F.col("p").isin("type", "label")).groupBy(F.col("s").alias("id")).agg(said("type"), said("label"))
    return nodes, spo.where(~F.col("p").isin("type", "label")).select(F.col("s").alias("src"), F.col("p").alias("relation"), F.col("o").alias("dst"))


def met_within(rows: DataFrame, group: str, item: str, task_rows: int = 500_000) -> DataFrame:
    """(a, b, n), a before b: pairs of items that share a group, and how many groups they share.

    Spark gathers small partitions by their bytes before it is known that the join multiplies their rows, and adds up the
    pairs in the same task. So the numbers of partitions are set here, by the rows of the table and the pairs of the groups.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda n: max(least, -(-n // task_rows))
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("a")).where("g IS NOT NULL AND a IS NOT NULL")
    own = stored(own.repartition(parts(rows.count()), "g").distinct(), "members")
    n = own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).cast("long")).first()[0] or 0
    dealt = own.repartition(parts(2 * n), "g")
    pairs = dealt.join(dealt.withColumnRenamed("a", "b"), "g").where("a < b").select("a", "b")
    return pairs.repartition(parts(n), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
