"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash of what survives.

Each level narrows the next. A level's survivors are passed on as a bitmap of fixed size (``buckets`` rows of 4 KB),
so the broadcast is bounded whatever the input; a bitmap slot shared by two keys only lets a row through to the next,
stricter level. Full hashes are taken, and rows shuffled, for the survivors of both levels alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import read, staged, text_of

BITS = 32768  # of one row of bitmap_construct_agg: fixed by Spark


def _bitmap(keys: DataFrame, buckets: int, name: str) -> DataFrame:
    """Rows (<name>_bucket, <name>_map), at most ``buckets`` of them, of the keys that more than one row has."""
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(buckets * BITS))
    return (
        keys.groupBy(*keys.columns).count().where("count > 1")
        .select(slot.alias("slot"))
        .groupBy((F.floor(F.col("slot") / BITS)).cast("int").alias(f"{name}_bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BITS).alias(f"{name}_map"))
    )


def _survives(slot: Column, bitmap: Column) -> Column:
    """True where the slot's bit is set."""
    bit = slot % BITS
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _passed(rows: DataFrame, level: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    slot = F.pmod(F.xxhash64(*keys), F.lit(buckets * BITS))
    met = rows.join(F.broadcast(level), F.floor(slot / BITS).cast("int") == F.col(f"{name}_bucket"), "left")
    return met.withColumn(name, _survives(slot, F.col(f"{name}_map"))).drop(f"{name}_bucket", f"{name}_map")


def buckets_for(rows: int, most: int = 2048) -> int:
    """Rows of a bitmap with two slots for each row of the input, at most ``most`` (8 MB)."""
    return max(64, min(most, -(-2 * rows // BITS)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, buckets: int | None = None, digest: bool = False, tell_apart: bool = False) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, and text_sha256 if ``digest``.

    Texts are equal when identical; null counts as empty. The row with the largest id stays, and of rows that repeat that
    id with its text one: kept is true once for each text. A null id never outranks another. Whole texts are hashed,
    however long. Other columns of ``docs`` are not looked at. An empty table gives an empty result. ``digest`` asks for
    the SHA-256 of every row, for callers that need it; grouping uses it for survivors alone. ``buckets`` sizes the
    bitmaps, by default by the number of rows; it changes no result. ``tell_apart`` adds text_key (a hash of the text),
    grouped (whether the row has company) and stays (as kept).
    """
    buckets = buckets or buckets_for(docs.count())
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    sized = rows.withColumn("n", F.octet_length("t").cast("long"))
    by_length = _bitmap(sized.select("n"), buckets, "by_length")
    first = _passed(sized, by_length, ["n"], buckets, "by_length")
    prefix = F.when(F.col("by_length"), F.xxhash64(F.substring("t", 1, prefix_chars)))
    first = first.withColumn("p", prefix)
    by_prefix = _bitmap(first.where("by_length").select("n", "p"), buckets, "by_prefix")
    second = _passed(first, by_prefix, ["n", "p"], buckets, "by_prefix")
    whole = F.sha2("t", 256)
    met = F.col("by_length") & F.col("by_prefix")
    extra = {**({"text_sha256": whole} if digest else {}), **({"text_key": F.xxhash64("t")} if tell_apart else {})}
    more = list(extra)
    narrow = staged(second.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.when(met, whole).alias("full"), "n", *(c.alias(k) for k, c in extra.items())))
    # Grouped by length and hash but joined by hash: the groups get an exchange of their own, so that a large group's rows can be split.
    groups = narrow.where("full IS NOT NULL").groupBy("n", "full").agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size")).drop("n")
    grouped = narrow.where("full IS NOT NULL").join(groups, "full").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep.row_no")).alias("kept"), *more)
    alone = narrow.where("full IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    out = grouped.unionByName(alone)
    apart = [(F.col("group_size") > 1).alias("grouped"), F.col("kept").alias("stays")] if tell_apart else []
    return out.select("doc_id", "keep_id", "group_size", "kept", *more, *apart)


def staying(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that a verdict (doc_id, text_key, grouped, stays; one row for each of docs) lets stay, with all their columns.

    Rows are told apart by id and text; of rows alike in both one stays, if the verdict has one of them stay. Only rows
    that a bitmap of what goes lets through are shuffled; the others pass where they are.
    """
    gone = verdict.where("grouped").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.bool_or("stays").alias("one"), F.count_if(~F.col("stays")).alias("n")).where("n > 0").drop("n")
    gone = staged(gone)
    buckets = buckets_for(gone.count())
    slot = F.pmod(F.xxhash64("gone_id", "gone_key"), F.lit(buckets * BITS))
    level = gone.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / BITS).cast("int").alias("goes_bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITS).alias("goes_map"))
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("gone_id"), F.xxhash64(text_of(text_col)).alias("gone_key"))
    marked = _passed(keyed, level, ["gone_id", "gone_key"], buckets, "goes")
    left, right = marked.where("goes").alias("a"), gone.alias("b")
    same = F.col("a.gone_id").eqNullSafe(F.col("b.gone_id")) & (F.col("a.gone_key") == F.col("b.gone_key"))
    met = staged(left.join(right, same, "left").where("one IS NULL OR one").select("row", "a.gone_id", "a.gone_key", "one"))
    single = met.where("one").groupBy("gone_id", "gone_key").agg(F.first("row").alias("row")).select("row")
    return marked.where("NOT goes").select("row").union(met.where("one IS NULL").select("row")).union(single).select("row.*")


def op4_exact_dedup(spark, sf_dir) -> DataFrame:
    """All rows of ``documents``, with the digest of each; nulls, ties and repeated rows as in exact_dedup."""
    return exact_dedup(read(spark, sf_dir, "documents"), digest=True)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
