"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Word totals per source give the targets. The mix's blocks are dealt to sources by highest quotients, then, within a
source, to its shards in proportion to their words; each shard's documents, in a seeded order, form one stream of
words that is cut into blocks, and a run of words, from the start of a seeded block on and round the stream's end, gives
as many as the quota's blocks hold, so that all documents but those at the run's two ends go in whole or not at all. A
quota above the words of the stream takes it whole first. Only one row per source reaches the driver; one per shard, at
most ``max_shards`` of a source, reaches a task; documents are dealt by (source, shard), so that a large source is
spread over many tasks.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, read, text_of


def no_pieces() -> Column:
    return F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words that each source is to give: ``share`` of all words by weight, each at most ``most`` times its size, the excess reshared by weight.

    Sources are taken by code point, null last, and the weights repeat along them. If all sources reach their limit, the rest stays unused.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), set(weight), {}
    while open_:
        total = sum(weight[s] for s, _ in order if s in open_)
        over = [s for s, _ in order if s in open_ and left * weight[s] / total > cap[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ -= set(over)
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients share / (2 * seats so far + 1); ties go to the earlier entry.

    Starts from the rounded proportional seats and moves single seats until the highest quotient left out is not above the lowest one taken.
    """
    total = math.fsum(shares)
    if seats <= 0 or total <= 0:
        return [0] * len(shares)
    got = [int(seats * x / total + 0.5) for x in shares]
    nxt = [(-x / (2 * g + 1), i) for i, (x, g) in enumerate(zip(shares, got, strict=True)) if x > 0]
    last = [(x / (2 * g - 1), -i) for i, (x, g) in enumerate(zip(shares, got, strict=True)) if g > 0]
    heapq.heapify(nxt)
    heapq.heapify(last)
    while (gap := seats - sum(got)) > 0:
        for _ in range(gap):
            _, i = heapq.heappop(nxt)
            got[i] += 1
            heapq.heappush(nxt, (-shares[i] / (2 * got[i] + 1), i))
    while (gap := sum(got) - seats) > 0:
        for _ in range(gap):
            _, i = heapq.heappop(last)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(last, (shares[-i] / (2 * got[-i] - 1), i))
    return got


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 4, docs_per_shard: int = 512, max_shards: int = 65536, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken, copies, pieces, and the input row as ``row`` if ``carry``.

    ``size`` counts words (null text: 0), ``taken`` the words that the mix takes, repeats counted: ``copies`` of the whole
    document and the word ranges ``pieces`` (from, to; 0-based, end exclusive) of the last, partial pass over its shard.
    There is one range, of all words, for each document inside the pass; of a shard's documents at most two are taken in part, and
    two ranges, which do not meet, are left only where a document holds both ends of the pass.
    A source's taken words differ from its target by the rounding to whole blocks, and where the target is at its limit by
    at most a block for each shard. A null source
    is a source of its own; sources without words have target 0; an empty table gives an empty result. Rows that repeat
    an id or have none are documents of their own, dealt to shards by their texts as well; which of two that are alike in
    both a block falls on does not show in the result. Whole texts are counted, however long. The number of sources has to fit the driver: one short row each.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), word_count(text_of(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).rlike(WORD).alias("has_words"), *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if carry else [])
    )
    found = rows.groupBy("key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    named = [(r["key"][1:] if r["key"] != "n" else None, r["n"]) for r in found]
    target = source_targets(named, weights, share, most)
    order = sorted(range(len(found)), key=lambda i: (named[i][0] is None, named[i][0] or ""))
    quota = sainte_lague([target[named[i][0]] for i in order], round(sum(target.values()) / block_words))
    table = [(found[i]["key"], int(found[i]["n"]), float(target[named[i][0]]), q, min(max_shards, max(1, -(-found[i]["docs"] // docs_per_shard)))) for i, q in zip(order, quota, strict=True)]
    per_source = docs.sparkSession.createDataFrame(table, "key string, source_size long, target double, quota long, shards int")
    told = rows.join(F.broadcast(per_source), "key")
    # Rows without words are part of no shard: there may be very many that are alike.
    wordless = told.where("NOT has_words").select("doc_id", "source", F.lit(0).cast("long").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), no_pieces().alias("pieces"), *(["row"] if carry else []))
    dealt = told.where("has_words").withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", F.lit(seed)), F.col("shards")).cast("int"))

    def shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard", ignore_index=True)
        got = sainte_lague([float(x) for x in shards["words"]], int(shards["quota"].iloc[0]))
        give = [min(g * block_words, most * int(w)) for g, w in zip(got, shards["words"], strict=True)]
        return pd.DataFrame({"key": shards["key"], "shard": shards["shard"], "words": shards["words"].astype("int64"), "give": give})

    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    quotas = shards.groupBy("key").applyInPandas(shard_quotas, "key string, shard int, words long, give long")
    along = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(along)).join(quotas, ["key", "shard"])
    start, one = F.col("end") - F.col("size"), F.lit(1).cast("long")
    some = F.when(F.col("words") > 0, F.col("give") % F.col("words")).otherwise(0)
    whole = F.when(F.col("words") > 0, F.floor(F.col("give") / F.col("words"))).otherwise(0).cast("long")
    first = block_words * F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest(F.ceil(F.col("words") / block_words), one))
    last = F.col("first") + F.col("some")
    passed = ((F.lit(0).cast("long"), last - F.col("words")), (F.col("first"), last))  # what goes round the end comes first in the text
    cut = F.array(*(F.struct((F.greatest(lo, F.col("start")) - F.col("start")).alias("from"), (F.least(hi, F.col("words"), F.col("end")) - F.col("start")).alias("to")) for lo, hi in passed))
    ranges = F.filter(cut, lambda x: x["from"] < x["to"])
    out = laid.withColumns({"start": start, "some": some, "copies": whole, "first": first}).withColumn("pieces", F.when((F.col("size") > 0) & (F.col("some") > 0), ranges).otherwise(no_pieces()))
    taken = F.col("copies") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "pieces", *(["row"] if carry else [])).union(wordless)


def op10_mix_sources(spark, sf_dir) -> DataFrame:
    """All ``documents`` by source, with the weights and limits of mix_sources, and what it says of odd rows."""
    return mix_sources(read(spark, sf_dir, "documents"))
