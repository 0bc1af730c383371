"""Evidence clusters, custom aggregates, routing by topic and guarded state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cluster_heads(df: DataFrame, vector: str, order: list[str], k: int = 4, seed: int = 1) -> DataFrame:
    """The first row, by ``order``, of each of at most k clusters of the vectors (distributed k-means)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(ready)
    placed = model.transform(ready).withColumn("cluster", F.col("prediction").cast("long")).drop("features", "prediction")
    return placed.groupBy("cluster").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("cluster", "r.*")


def trimmed_mean(value: str) -> Column:
    """A custom aggregate, by partial aggregates: the mean without the lowest and the highest value (of three or more), of finite values; null and NaN are left out."""
    v = F.nanvl(value, F.lit(None).cast("double"))
    n, rest = F.count(v), F.sum(v) - F.min(v) - F.max(v)
    return F.when(n >= 3, rest / F.nullif(n - 2, F.lit(0))).otherwise(F.avg(v))


def routed(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages for each subscriber of their topic; a pattern that ends in * takes all topics that begin so."""
    exact = messages.join(subscriptions.where(~F.col("pattern").endswith("*")), F.col("topic") == F.col("pattern"))
    begins = subscriptions.where(F.col("pattern").endswith("*")).withColumn("stem", F.regexp_replace("pattern", r"\*$", ""))
    # Patterns have few lengths: one row sends them along, and a topic's beginnings of these lengths meet the stems in an equi-join.
    sizes = begins.agg(F.array_sort(F.collect_set(F.length("stem"))).alias("sizes"))
    cut = F.explode(F.filter("sizes", lambda n: n <= F.length("topic"))).alias("size")
    parts = messages.crossJoin(F.broadcast(sizes)).select(*messages.columns, cut)
    prefix = parts.withColumn("beginning", F.expr("left(topic, size)")).join(begins, F.col("beginning") == F.col("stem")).drop("size", "beginning", "stem")
    return exact.unionByName(prefix).drop("pattern")


def guarded_state(state: Column, transitions: list[tuple[str, Column, str]]) -> Column:
    """The state after the first transition (from, guard, to) whose guard holds; a missing guard value is false, no transition keeps the state."""
    def step(out, t):
        source, guard, target = t
        return F.when((state == source) & F.coalesce(guard, F.lit(False)), target).otherwise(out)

    return reduce(step, reversed(transitions), state)


def ordered_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their document's columns and their number in it."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("index"))
    return chunks.withColumn("n", n).join(docs, "doc_id")


def n_triples(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, p, o) of lines <s> <p> <o> . or <s> <p> "o" . ; others are left out."""
    form = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"[^\s]*)\s*\.\s*$'
    part = lambda i: F.regexp_extract(text, form, i)
    return lines.where(F.col(text).rlike(form)).select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("o"))
