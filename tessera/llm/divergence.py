"""Source divergence audit: how far the term distributions of a language's sources lie apart, by a heavy-light split.

Counts are taken per task and added by (lang, source, term). The distance of two sources is the sum of the absolute
differences of their smoothed shares over all kept terms. If no term had been met, that sum would be the number of kept
terms times the difference of the two shares of an unmet term: the base. Terms met in many sources (heavy) are laid out as
dense tiles, sources by terms, and their sums are taken on whole rows of a tile. Of the others (light) there are only
postings: one correction for each posting against every other source's unmet share, by prefix sums over the sorted shares,
and one for each pair of postings of a term. All numbers are integers, so base, tiles and corrections add up exactly.
A language's sources are cut into blocks, and a tile holds the rows of one pair of blocks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checked, read, released, small_batches, staged, text_of

# Fixed values of the contract: a term is a run of letters A-Z or a-z and characters above \x7F; shares are in parts of SCALE.
TERM = re.compile(rb"[a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^a-z\x80-\xff]")
SCALE = 1_000_000_000
ADDED = 5

SLICE = 4 << 20  # bytes of text whose terms are listed at a time
ENTRIES = 250_000  # counts that a task holds before it hands them on
COUNTED = "lang string, source string, term string, n long, docs long"


def term_slices(low: bytes) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text, listed for bounded stretches that end between terms (a stretch is longer where a term is)."""
    at = 0
    while at < len(low):
        end = len(low)
        if end - at > SLICE and (m := BETWEEN.search(low, at + SLICE)):
            end = m.start()
        yield TERM.findall(low, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            words, have = list(c), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([have[w] for w in words], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "t")), strict=True):
            seen: set[bytes] = set()
            for words in term_slices(text.lower()):  # of bytes: A-Z only
                n[lang, source].update(words)
                seen.update(words)
            docs[lang, source].update(seen)
        if sum(map(len, n.values())) > ENTRIES:
            yield from counted()
    yield from counted()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it. Null counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)) in whole numbers; 0 where no term is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {ADDED} AS DECIMAL(19, 0))) DIV CAST({total} + {ADDED} * {kept} AS DECIMAL(20, 0)) ELSE 0 END").cast("long")


def tile_sums(p: np.ndarray, unmet: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Dense: for rows a, b of a tile the sum over its terms of |p_a - p_b| - |unmet_a - unmet_b|."""
    width = int(col.max()) + 1 if len(col) else 0
    tile = np.repeat(unmet[:, None], width, axis=1)
    tile[row, col] = p
    out = np.zeros((len(unmet), len(unmet)), dtype=np.int64)
    for a in range(len(unmet)):
        out[a] = np.abs(tile - tile[a]).sum(axis=1)
    return out - width * np.abs(unmet[:, None] - unmet[None, :])


def posting_sums(p: np.ndarray, unmet: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Sparse: the same sums from postings (row, col, p) that are sorted by col."""
    apart = np.abs(unmet[:, None] - unmet[None, :])
    one = np.zeros((len(unmet), len(unmet)), dtype=np.int64)
    for a in range(len(unmet)):
        v = np.sort(p[row == a])
        if len(v):
            sums = np.r_[0, np.cumsum(v)]
            k = np.searchsorted(v, unmet)
            one[a] = unmet * k - sums[k] + (sums[-1] - sums[k]) - unmet * (len(v) - k) - len(v) * apart[a]
    out = one + one.T
    at, d = np.arange(len(col)), 1
    while len(at := at[at + d < len(col)]) and len(at := at[col[at] == col[at + d]]):
        a, b = row[at], row[at + d]
        met = np.abs(p[at] - p[at + d]) - np.abs(p[at] - unmet[b]) - np.abs(p[at + d] - unmet[a]) + apart[a, b]
        np.add.at(out, (a, b), met)
        np.add.at(out, (b, a), met)
        d += 1
    return out


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; those without a term name the cell's sources and their unmet shares -> (lang, a, b, value), a before b."""
    released()
    held: list[pa.RecordBatch] = []

    def closed() -> pa.RecordBatch:
        cell = pa.Table.from_batches(held).combine_chunks()
        is_source = np.asarray(cell.column("term").is_null())
        sources = cell.filter(pa.array(is_source)).sort_by("gid")
        rows = cell.filter(pa.array(~is_source)).sort_by([("term", "ascending"), ("gid", "ascending")])
        gids = sources.column("gid").to_numpy()
        unmet = sources.column("p").to_numpy()
        p, row = rows.column("p").to_numpy(), np.searchsorted(gids, rows.column("gid").to_numpy())
        col = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.zeros(0, dtype=np.int64)
        kind, kept = cell.column("kind")[0].as_py(), int(sources.column("kept")[0].as_py())
        if kind == "base":
            sums = kept * np.abs(unmet[:, None] - unmet[None, :])
        else:
            sums = (tile_sums if kind == "heavy" else posting_sums)(p, unmet, row, col.astype(np.int64))
        block = sources.column("block").to_numpy()
        first, last = int(block.min()), int(cell.column("to_block")[0].as_py())
        a, b = np.nonzero(np.triu(np.ones_like(sums, dtype=bool), 1) & (block == first)[:, None] & (block == last)[None, :])
        names = sources.column("source").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array([cell.column("lang")[0].as_py()] * len(a), pa.string()), names.take(pa.array(a)).cast(pa.string()), names.take(pa.array(b)).cast(pa.string()), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])

    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column("cell").dictionary_encode()
        edges = [0, *(np.flatnonzero(np.diff(keys.indices.to_numpy())) + 1).tolist(), len(batch)]
        for at, end in zip(edges, edges[1:], strict=False):
            if held and held[0].column("cell")[0].as_py() != batch.column("cell")[at].as_py():
                yield closed()
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield closed()


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top_terms: int = 50, heavy_share: float = 0.25, block: int = 256, tile_terms: int = 1024, postings: int = 65_536) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each source of a language against its others and against the language.

    Each language keeps the terms that at least ``least_docs`` of its rows have. A group's share of a kept term with n of
    the group's N occurrences is p = 1 + floor(1e9 * (n + 5) / (N + 5 V)), V the kept terms; the language's is q. Part
    ``pair`` has the sum of |p_a - p_b| over all kept terms for each other source of the language (0 where none is kept);
    part ``term`` the first ``top_terms`` kept terms that the group has and whose p is above q, by p - q. Ranks start at 1,
    by value descending, then item in UTF-8 order.

    Null text, lang or source counts as empty. Rows that repeat an id are documents of their own. Groups without any term
    take part. Whole texts are read, however long, a stretch at a time. An empty table gives an empty result. Other columns
    are not looked at. A term is heavy if ``heavy_share`` of its language's sources have it (two at least); ``block``,
    ``tile_terms`` and ``postings`` bound what a task lays out and change no result. The result has a row for each ordered
    pair of a language's sources, which is what limits the number of sources.
    """
    kept = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("at")).where(F.col("docs") >= least_docs)
    kept = staged(kept.drop("docs"))
    met = kept.select("lang", "term", "lang_n", F.size("at").alias("sources_met"), F.inline("at"))
    groups = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    groups = groups.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    totals = met.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("total"))
    groups = groups.join(totals, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").select("lang", "source", "gid", F.coalesce("total", F.lit(0)).alias("total"))
    of_lang = kept.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = groups.groupBy(F.col("lang").alias("k")).agg(F.count(F.lit(1)).alias("sources"))
    groups = groups.join(sizes, F.col("lang") == F.col("k")).join(of_lang, F.col("lang") == F.col("l"), "left").withColumns({"kept": F.coalesce("kept", F.lit(0)), "lang_total": F.coalesce("lang_total", F.lit(0))})
    groups = groups.withColumns({"block": F.floor(F.col("gid") / block).cast("int"), "blocks": F.ceil(F.col("sources") / block).cast("int"), "zero": F.lit(0)}).withColumn("unmet", share("zero", "total", "kept"))
    groups = staged(groups.select("lang", "source", "gid", "total", "sources", "kept", "lang_total", "block", "blocks", "unmet"))
    rows = met.join(checked(groups), ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")})

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = ranked("term", rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top_terms)

    heavy = F.col("sources_met") >= F.greatest(F.lit(2), F.ceil(F.col("sources") * heavy_share))
    # Tiles of a language: enough for its kept terms, and for its postings (at most one for each term and source).
    tiles = F.when(heavy, F.ceil(F.col("kept") / tile_terms)).otherwise(F.ceil(F.col("kept") * F.col("sources") * heavy_share / postings)).cast("int")
    kind = F.when(heavy, "heavy").otherwise("light")
    light = rows.withColumns({"kind": kind, "tiles": F.greatest(tiles, F.lit(1))}).withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cell = F.concat_ws("\0", F.col("lang"), F.col("kind"), *(F.col(c).cast("string") for c in ("tile", "from_block", "to_block"))).alias("cell")
    columns = ("lang", "kind", "to_block", "source", "gid", "block", "kept", "term", "p")
    placed = lambda df: df.select("*", other).withColumns({"from_block": F.least("block", "other"), "to_block": F.greatest("block", "other")}).select(cell, *columns)
    laid = placed(light)
    used = light.select("lang", "kind", "tile").distinct().unionByName(groups.select("lang", F.lit("base").alias("kind"), F.lit(0).alias("tile")).distinct())
    named = placed(used.join(groups, "lang").withColumns({"term": F.lit(None).cast("string"), "p": F.col("unmet")}))
    cells = laid.withColumn("source", F.lit(None).cast("string")).unionByName(named).repartition("cell").sortWithinPartitions("cell")
    sums = staged(cells.mapInArrow(_pair_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    return ranked("pair", pairs).union(terms)


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    """All ``documents``, terms in at least 30 documents of a language; nulls, ties and repeated rows as in source_divergence."""
    return source_divergence(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
      LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER v + 5 * count(*) OVER v) AS p
      FROM c WINDOW v AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER v + 5 * count(*) OVER v) AS q FROM l WINDOW v AS (PARTITION BY lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
