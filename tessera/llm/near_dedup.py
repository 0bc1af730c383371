"""MinHash near-deduplication with fast similarity sketching, banding and exact verification.

A sketch has ``bands * rows`` coordinates. In round i every shingle is thrown into one hashed coordinate with the value
(i, hash); rounds go on until every coordinate is filled, and from round t on shingles go to coordinate i - t, so that
2t rounds always suffice. Texts with the same shingle set are one node from then on. Nodes that share a band form the
family of the band's smallest node; links are confirmed on the full shingle sets inside families. A family of up to
``block`` nodes and ``block_mb`` of sets is compared in one task. Of a larger one, every member is first compared with the head; members that
are not linked to it are dealt to squares by the size of their sets and by their distance from the head, both of which
differ little between linked ones, and compared, block by block, inside their square and with the squares next to it, and
with those linked members that the triangle inequality of the Jaccard distance leaves possible. Only links are emitted, never candidate pairs, and components come from an iterated
join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import BITS, _passed
from .shared import checked, read, released, slices, small_batches, staged, text_of
from .words import mix, shingle_sets

SLICE = 1_000_000  # characters of text whose shingles are hashed at a time
SKETCHED = "rid long, doc_id long, th long, n_shingles long, h1 long, h2 long, bands array<long>"


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set; equal coordinates are as likely as the sets' Jaccard similarity."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(2 * t):
        h = mix(flat ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        at = (h % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, owner * t + at, (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16)))
        done = (out.reshape(-1, t) != np.iinfo(np.uint64).max).all(axis=1)
        if done.all():
            break
        left = ~done[owner]
        flat, owner = flat[left], owner[left]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sketch), 1))
    cells = sketch.reshape(len(sketch), bands, rows)
    for k in range(rows):
        out = mix(out + cells[:, :, k])
    return out


def _sketch(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts, SLICE):
                part = batch.slice(at, end - at)
                sets = shingle_sets(texts[at:end], width)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(some), 0), dtype=np.uint64) if not some else band_keys(sketches([sets[i] for i in some], bands * rows), bands, rows)
                ends = np.zeros(len(sets) + 1, dtype=np.int32)
                ends[np.array(some, dtype=np.int64) + 1] = bands
                h1 = np.array([np.add.reduce(mix(s), dtype=np.uint64) for s in sets], dtype=np.uint64)
                h2 = np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(keys.ravel().view(np.int64)))],
                    names=["rid", "doc_id", "th", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _to_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts, SLICE):
                part = batch.slice(at, end - at)
                sets = shingle_sets(texts[at:end], width)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of up to a few hundred sets, by products of 0/1 matrices over the shingles that two or more share."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    shared = ~(new & np.r_[new[1:], True])
    col, owner = np.cumsum(new)[shared], owner[shared]
    out = np.zeros((n, n), dtype=np.float64)
    if len(col):
        col = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1
        step = max(64, (1 << 21) // n)
        for at in range(0, int(col[-1]) + 1, step):
            lo, hi = np.searchsorted(col, [at, at + step])
            grid = np.zeros((n, step), dtype=np.float32)
            grid[owner[lo:hi], col[lo:hi] - at] = 1
            out += grid @ grid.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out.astype(np.int64)


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Where 100 * intersection >= percent * union, given intersections and set sizes."""
    return 100 * both >= percent * (a + b - both)


def _links(percent: int):
    """Rows (grp, node, anchor, shingles) sorted by group -> links (a, b) inside each group; rows with anchor are not compared with each other."""

    def of(nodes: np.ndarray, anchor: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets])
        if len(nodes) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            hit = bool(linked(np.int64(both), sizes[0], sizes[1], percent)) and not anchor.all()
            return (nodes[:1], nodes[1:]) if hit else (nodes[:0], nodes[:0])
        hit = linked(common(sets), sizes[:, None], sizes[None, :], percent)
        hit &= ~(anchor[:, None] & anchor[None, :])
        hit[np.tril_indices(len(nodes))] = False
        # Of the links only a spanning forest is needed.
        parent = list(range(len(nodes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        keep = []
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True):
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                keep.append((i, j))
        at = np.array(keep, dtype=np.int64).reshape(-1, 2)
        return nodes[at[:, 0]], nodes[at[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[tuple[str, int, bool, bytes]] = []

        def closed() -> pa.RecordBatch:
            a, b = of(np.array([x[1] for x in held]), np.array([x[2] for x in held]), [np.frombuffer(x[3], dtype=np.uint64) for x in held])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "node", "anchor", "shingles")), strict=True):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield closed()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield closed()

    return run


def _shared_size(a: pd.Series, b: pd.Series) -> pd.Series:
    x = [np.frombuffer(v, dtype=np.uint64) for v in a]
    y = [np.frombuffer(v, dtype=np.uint64) for v in b]
    return pd.Series([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 512, block_mb: int = 64, buckets: int = 256, tell_apart: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z; a text's set holds its distinct ``width``-word shingles, or its whole sequence if it has
    fewer words. Texts without words have an empty set, link with nothing and stay. Two texts are linked if their sets'
    Jaccard similarity is ``percent`` / 100 or more; component_id is the smallest id that links lead to, and kept is
    doc_id = component_id. Null text counts as empty; repeated rows are linked with each other as any equal texts are.
    Rows with a null id take part; their component's id is the smallest there is, or null. Empty tables give no rows.
    Whole texts are hashed, however long, a bounded run of bytes at a time. Other columns are not looked at.
    The bands miss a pair at 80 % with a probability under 1e-5 (32 bands of 5 rows), one at 85 % under 1e-6 (24 bands).
    ``tell_apart`` adds text_key (a hash of the text), grouped (whether the row has company) and stays, which is true for
    exactly one row of each component, also where rows repeat an id.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("th", F.xxhash64("t"))
    seen = staged(given.mapInArrow(_sketch(bands, rows, width), SKETCHED))
    full = seen.where("n_shingles > 0")
    # Texts with one and the same set: one node, the others hang on it. Grouped with the size but joined without it, so that the groups get an exchange of their own.
    firsts = staged(full.groupBy("n_shingles", "h1", "h2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies")))
    many = firsts.where("copies > 1").select("h1", "h2", "node")
    same = full.select("rid", "h1", "h2").join(many, ["h1", "h2"]).select("rid", "node")
    nodes = full.join(firsts.select(F.col("node").alias("rid")), "rid", "left_semi")
    keyed = staged(nodes.select(F.col("rid").alias("node"), F.posexplode("bands").alias("band", "key")))
    heads = keyed.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    family = _families(staged(keyed.select("node", "key").join(heads, "key").select("key", "head", "node")))
    weighed = family.join(full.select(F.col("rid").alias("node"), "n_shingles"), "node")
    family = staged(weighed.select("fam", "head", "node", (F.col("n_shingles") * 8).alias("bytes")))
    needed = staged(family.select("node").distinct().join(seen.select(F.col("rid").alias("node"), "doc_id", "th"), "node"))
    slot = F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets * BITS))
    wanted = needed.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / BITS).cast("int").alias("wanted_bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITS).alias("wanted_map"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("th", F.xxhash64("t"))
    texts = _passed(texts, wanted, ["doc_id", "th"], buckets, "wanted").where("wanted")
    # Rows with the same id and text are one here; the join that follows is on what they are grouped by.
    known = F.coalesce("doc_id", F.lit(-1)).alias("d")
    texts = texts.select(known, "th", "t").groupBy("d", "th").agg(F.first("t").alias("t"))
    found = texts.join(needed.select(known, "th", "node"), ["d", "th"]).select("node", "t")
    sets = staged(found.mapInArrow(_to_sets(width), "node long, shingles binary"))

    blocks = lambda n, size: F.ceil(F.greatest(n / block, size / (block_mb << 20))).cast("int")
    sized = staged(family.groupBy("fam").agg(blocks(F.count(F.lit(1)), F.sum("bytes")).alias("blocks")))
    small = family.join(sized.where("blocks = 1").select("fam"), "fam", "left_semi")
    groups = small.join(sets, "node").select(F.col("fam").cast("string").alias("grp"), "node", F.lit(False).alias("anchor"), "shingles")
    links = groups.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_links(percent), "a long, b long")
    large = family.join(sized.where("blocks > 1").select("fam"), "fam", "left_semi")
    if large.limit(1).count():
        links = links.union(_large_links(large, sets, percent, blocks))
    # Components are found over nodes; copies take their node's.
    labels = staged(components(links))
    copied = same.join(labels, "node", "left").select("rid", F.coalesce("label", "node").alias("label"))
    single = labels.join(many.select("node"), "node", "left_anti").select(F.col("node").alias("rid"), "label")
    in_component = staged(seen.select("rid", "doc_id").join(copied.union(single), "rid"))
    # Of rows with the smallest id the first one: a null id is the largest here.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    least = staged(in_component.groupBy("label").agg(F.min("doc_id").alias("component_id"), first.alias("first")))
    named = in_component.join(least, "label").select("rid", "component_id", (F.col("rid") == F.col("first.rid")).alias("stays"))
    out = seen.select("rid", "doc_id", "n_shingles", "th").join(named, "rid", "left")
    component = F.when(F.col("stays").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    more = [F.col("th").alias("text_key"), F.col("stays").isNotNull().alias("grouped"), F.coalesce("stays", F.lit(True)).alias("stays")] if tell_apart else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)


def _families(met: DataFrame) -> DataFrame:
    """(fam, head, node) such that any two nodes of a bucket share a family, from rows (key, head, node) of the buckets.

    Many buckets of a group of copies have nearly the same members. So every node takes the smallest head that its
    buckets lead to, in two steps, for its family; a bucket whose nodes agree on that is covered, and only the others
    are families of their own. Families of the first sort have an even number, of the second an odd one.
    """
    first = met.groupBy("node").agg(F.min("head").alias("h"))
    reach = met.join(first, "node").groupBy("key").agg(F.min("h").alias("h"))
    own = staged(met.select("key", "node").join(reach, "key").groupBy("node").agg(F.min("h").alias("h")))
    mixed = met.join(own, "node").groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("key")
    rest = met.join(mixed, "key", "left_semi").select("head", "node").distinct()
    return own.select((F.col("h") * 2).alias("fam"), F.col("h").alias("head"), "node").union(rest.select(F.col("head") * 2 + 1, "head", "node"))


def _large_links(large: DataFrame, sets: DataFrame, percent: int, blocks) -> DataFrame:
    """Links inside families of more than one block: with the head, then, in cells of two blocks, among the rest. ``blocks`` gives their number for members and bytes."""
    overlap = F.pandas_udf(_shared_size, "long")
    large = staged(large.select("fam", "head", "node", "bytes"))
    head_sets = staged(sets.join(large.select(F.col("head").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("head"), F.col("shingles").alias("head_shingles")))
    met = large.join(sets, "node").join(head_sets, "head")
    met = met.withColumn("both", overlap("shingles", "head_shingles")).withColumn("either", F.length("shingles") / 8 + F.length("head_shingles") / 8 - F.col("both"))
    met = met.withColumns({"linked": 100 * F.col("both") >= percent * F.col("either"), "far": 1 - F.col("both") / F.col("either")})
    met = staged(met.select("fam", "head", "node", "bytes", "linked", "far"))
    to_head = met.where("linked AND head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # A member at distance x from the head can be linked to one at distance y only if |x - y| is at most the largest distance of a link.
    most = 1 - percent / 100 + 1e-9
    loose, weight = ~F.col("linked"), F.sum(F.when(~F.col("linked"), F.col("bytes")))
    per_family = staged(met.groupBy("fam").agg(blocks(F.count_if(loose), weight).alias("blocks"), F.min(F.when(loose, F.col("far"))).alias("nearest")).where("blocks > 0"))
    rest = met.where("NOT linked").join(per_family, "fam").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cell = lambda what, *parts: F.concat_ws(":", F.lit(what), *(p.cast("string") for p in parts)).alias("grp")
    k = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")
    # Sets of linked members differ in size by a factor of 100 / percent at most, and their distances from the head by most.
    span = float(np.log(100 / percent)) * (1 + 1e-9) or 1e-9
    across, down = F.floor(F.log(F.col("bytes") / 8) / span), F.floor(F.col("far") / most)
    squared = staged(rest.select("fam", "node", "bytes", across.alias("x"), down.alias("y")))
    squares = checked(staged(squared.groupBy("fam", "x", "y").agg(blocks(F.count(F.lit(1)), F.sum("bytes")).alias("parts"))))
    lot = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Each member goes to its own square and to the eight around it; of two neighbours the one ahead names their cells.
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    ways = F.inline(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((dx, dy) > (0, 0)).alias("ahead"), F.lit((dx, dy) == (0, 0)).alias("same")) for dx, dy in around)))
    mine = squared.join(squares, ["fam", "x", "y"]).select("fam", "node", "x", "y", lot.alias("lot"), ways).withColumns({"x2": F.col("x") + F.col("dx"), "y2": F.col("y") + F.col("dy")})
    others = squares.select("fam", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("parts").alias("parts2"))
    met_by = mine.join(others, ["fam", "x2", "y2"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)).alias("other"))
    forth = lambda a, b: F.when(F.col("ahead") | F.col("same"), a).otherwise(b)
    i = F.when(F.col("same"), F.least("lot", "other")).otherwise(forth(F.col("lot"), F.col("other")))
    j = F.when(F.col("same"), F.greatest("lot", "other")).otherwise(forth(F.col("other"), F.col("lot")))
    square = (forth(F.col("x"), F.col("x2")), forth(F.col("y"), F.col("y2")), forth(F.col("dx"), -F.col("dx")), forth(F.col("dy"), -F.col("dy")))
    among = met_by.select(cell("r", F.col("fam"), *square, i, j), "node", F.col("ahead").alias("anchor"))
    near = met.where("linked AND head <> node").join(per_family, "fam").where(F.col("nearest") - F.col("far") <= most)
    parts = staged(near.groupBy("fam").agg(blocks(F.count(F.lit(1)), F.sum("bytes")).alias("parts")))
    near = near.join(parts, "fam").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    anchors = near.select("fam", "node", "part", k).select(cell("n", F.col("fam"), F.col("k"), F.col("part")), "node", F.lit(True).alias("anchor"))
    close = rest.join(parts, "fam").where(F.col("far") <= 2 * most).select("fam", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    close = close.select(cell("n", F.col("fam"), F.col("own"), F.col("part")), "node", F.lit(False).alias("anchor"))
    cells = among.unionByName(anchors).unionByName(close).join(sets, "node")
    found = cells.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_links(percent), "a long, b long")
    return to_head.union(found)


def op1_near_duplicates(spark, sf_dir) -> DataFrame:
    """Three-word shingles, 85 % or more, of the whole texts of ``documents``; nulls, ties and repeated rows as in near_duplicates."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85, bands=24)
