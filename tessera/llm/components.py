"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), label the smallest node of its component. Self links are fine; no edges, no rows.

    Each round takes the least label among neighbours and then the label of that label, so the rounds needed grow with the
    logarithm of the longest chain. Every round is a written table, and what is joined is read from such tables, so that
    a node with very many neighbours can be split by the adaptive skew join.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("src", "dst"))
    labels = staged(both.groupBy("src").agg(F.min("dst").alias("d")).select(F.col("src").alias("node"), F.least("src", "d").alias("label")))
    for _ in range(most_rounds):
        heard = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["dst"], "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        new = staged(new)
        up = new.select(F.col("node").alias("root"), F.col("label").alias("higher"))
        jumped = staged(new.join(up, new["label"] == up["root"]).select("node", "old", F.least("label", "higher").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
