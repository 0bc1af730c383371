"""Removal of repeated byte strings by suffix sorting: every ``width``-byte string that also starts earlier goes.

The strings that start at each place of a text are the suffixes to sort, as far as ``width`` bytes. They are dealt to bins by
content: each string's smallest hash of ``gram`` bytes names its bin, so equal strings meet there, at equal distances from
that gram, the anchor; consecutive strings with one anchor travel as one segment of text. Bins whose hash occurs once hold
nothing to find and stay where they are. In a bin the suffixes from the anchors on, and those of the reversed text
before them, are sorted deep-shallow: a multikey quicksort of eight-byte characters to a shallow depth, then a blind trie for
each group that is still together. Strings at one distance from their anchors are equal if and only if both orders keep
them together, by the lengths of common prefixes between neighbours; the earliest of each class stays.

A bin with very many segments is sorted in salted parts, and what is first in each part meets, by its hash, once more.
Texts that are equal as a whole are looked at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import BITS, _passed
from .shared import checked, read, released, slices, small_batches, staged, text_of
from .words import mix

STEP = 1 << 20  # starts whose strings are hashed at a time
SLICE = 2_000_000  # bytes of text that are cut into segments at a time
MEMBERS = 20_000  # segments that are sorted at a time, in whole bins
_MASK = np.uint64((1 << 21) - 1)  # room for a place in STEP starts
NO_ID = 2**63 - 1

class Rolling:
    """Hashes of all stretches of ``size`` bytes: differences of running sums of powers modulo 2**64, taken back by the inverse power."""

    def __init__(self, size: int, which: int, most: int = STEP + 4096):
        rng = np.random.default_rng([20240607, size, which])
        base = int(rng.integers(1, 2**61)) * 4 + 1
        self.size, self.values = size, rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self._run(base, most)
        self.inverse = self._run(pow(base, -1, 2**64), most)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out, step = np.ones(1, dtype=np.uint64), base
        while len(out) < n:
            out = np.r_[out, out * np.uint64(step)]
            step = step * step % 2**64
        return out[:n]

    def of(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix((sums[self.size :] - sums[: n + 1 - self.size]) * self.inverse[: n + 1 - self.size])


_rolling: dict[tuple[int, int], Rolling] = {}


def rolling(size: int, which: int = 0) -> Rolling:
    """Made once a worker, and the same in all."""
    if (size, which) not in _rolling:
        _rolling[size, which] = Rolling(size, which)
    return _rolling[size, which]


def segments(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: first start, number of starts, place of the anchor and hash of each run of strings with one anchor."""
    found = []
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + width - 1]
        if len(part) < width:
            break
        h = rolling(gram).of(part)
        least, have, want = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64), 1, width - gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & _MASK).astype(np.int64)
        inside = np.ones(len(place), dtype=bool)
        # The last width - 1 starts of each text lead beyond its end.
        near = ends[(ends > at) & (ends < at + len(place) + width)] - at
        marks = np.zeros(len(place) + 1, dtype=np.int64)
        np.add.at(marks, np.clip(near - width + 1, 0, len(place)), 1)
        np.add.at(marks, np.clip(near, 0, len(place)), -1)
        inside = np.cumsum(marks[:-1]) == 0
        new = inside & np.r_[True, (place[1:] != place[:-1]) | ~inside[:-1]]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[np.cumsum(inside)[first] - 1, inside.sum()]) if len(first) else first
        found.append((first + at, n, place[first] + at, h[place[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


def _laid(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    texts = batch.column("t").to_pylist()
    for at, end in slices(texts, SLICE):
        yield at, end, b"".join(texts[at:end]), np.cumsum([len(x) for x in texts[at:end]])


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for _, _, raw, ends in _laid(batch):
                h, n = np.unique(segments(np.frombuffer(raw, dtype=np.uint8), ends, width, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["anchor", "n"])

    return run


def _segments(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for at, end, raw, ends in _laid(batch):
                first, n, place, h = segments(np.frombuffer(raw, dtype=np.uint8), ends, width, gram)
                doc = np.searchsorted(ends, first, side="right")
                began = np.r_[0, ends][doc]
                cut = [raw[a:b] for a, b in zip(first.tolist(), (first + n + width - 1).tolist(), strict=True)]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("d").take(pa.array(doc)), part.column("th").take(pa.array(doc)), pa.array(first - began), pa.array(place - first), pa.array(cut, pa.binary())], names=["anchor", "d", "th", "start", "before", "seg"])

    return run


def shallow_sort(keys: np.ndarray, order: np.ndarray, start: np.ndarray, characters: int) -> None:
    """Multikey quicksort of all groups at once, in place. ``order`` has the row at each slot, ``start`` the first slot of its group; rows of a group that agree in all characters stay one group, in the order they had."""
    slots = np.arange(len(order))
    for c in range(characters):
        alone = np.r_[start[1:] != start[:-1], True] & (start == slots)
        left = slots[~alone]
        while len(left):
            key = keys[order[left], c]
            begins = np.flatnonzero(np.r_[True, start[left][1:] != start[left][:-1]])
            sizes = np.diff(np.r_[begins, len(left)])
            pivot = np.repeat(key[begins + sizes // 2], sizes)
            side = np.repeat(np.arange(len(begins)) * 3 + 1, sizes) + (key > pivot) - (key < pivot)
            moved = np.argsort(side, kind="stable")
            order[left], side = order[left][moved], side[moved]
            new = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            sizes = np.diff(np.r_[new, len(left)])
            start[left] = np.repeat(left[new], sizes)
            left = left[(side % 3 != 1) & (np.repeat(sizes, sizes) > 1)]


def blind_trie_order(keys: list[int]) -> list[int]:
    """Positions of the keys in ascending order, equal ones as they come. The trie has only the bit at which each node branches: a key goes down blindly, is compared with the leaf it meets, and is put in where the first different bit says."""
    root: list = [-1, [0]]  # a leaf: -1 and the positions with its key; a node: bit, zero side, one side
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while node[0] >= 0:
            node = node[1 + (key >> node[0] & 1)]
        if not (apart := (key ^ keys[node[1][0]]).bit_length()):
            node[1].append(i)
            continue
        bit, node = apart - 1, root
        while node[0] > bit:
            node = node[1 + (key >> node[0] & 1)]
        old, leaf = list(node), [-1, [i]]
        node[:] = [bit, old, leaf] if key >> bit & 1 else [bit, leaf, old]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[2], node[1]]
    return out


def sorted_with_prefixes(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among all, by group, then bytes; and for each rank the length of the prefix that it has in common with the one before it, -1 at the first of a group. Rows are padded with zeros to a multiple of eight bytes; shorter ones come first."""
    order = np.lexsort((lengths, group))
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    keys = strings.view(">u8").astype(np.uint64)
    shallow = min(shallow // 8, keys.shape[1])
    shallow_sort(keys, order, start, shallow)
    begins = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    rest = keys[order][:, shallow:]
    if rest.shape[1]:
        unlike = np.logical_or.reduceat((rest != rest[start]).any(axis=1), begins)
        ends = np.r_[begins[1:], len(order)]
        tails = np.ascontiguousarray(strings[:, shallow * 8 :])
        for a, b in zip(begins[unlike].tolist(), ends[unlike].tolist(), strict=True):
            rows = order[a:b]
            order[a:b] = rows[blind_trie_order([int.from_bytes(tails[r].tobytes(), "big") for r in rows.tolist()])]
    laid = strings[order]
    differ = laid[1:] != laid[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    common = np.r_[-1, np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))] if len(order) else np.zeros(0, dtype=np.int64)
    common[np.r_[True, group[order][1:] != group[order][:-1]][: len(order)]] = -1
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, common


def _padded(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, most: int, step: int) -> np.ndarray:
    """Rows of bytes from ``at`` on, forwards or backwards, with zeros behind."""
    across = np.arange(-(-max(most, 1) // 8) * 8)
    inside = across < lengths[:, None]
    return np.where(inside, data[np.where(inside, at[:, None] + step * across, 0)], 0).astype(np.uint8)


FOUND = "d long, th long, first long, last long, w1 long, w2 long"


def _sorted_bins(width: int, gram: int, shallow: int):
    """Rows sorted by bin -> ranges of starts (first, last) whose strings are repeated; and in salted bins, with a hash, starts whose strings are first there."""
    most = width - gram

    def looked_at(bins: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: bins.column(c).to_numpy() for c in ("anchor", "salt", "d", "th", "start", "before")}
        segs = bins.column("seg").to_pylist()
        order = np.lexsort((col["start"], col["th"], col["d"], col["salt"], col["anchor"]))
        col = {c: v[order] for c, v in col.items()}
        new = np.r_[True, (col["anchor"][1:] != col["anchor"][:-1]) | (col["salt"][1:] != col["salt"][:-1])]
        group = np.cumsum(new) - 1
        again = np.r_[False, ~new[1:] & (col["d"][1:] == col["d"][:-1]) & (col["th"][1:] == col["th"][:-1]) & (col["start"][1:] == col["start"][:-1])]  # a row alike in id and text
        have: set[tuple[int, bytes]] = set()
        keep, copy = [], []
        for i, (g, k, twice) in enumerate(zip(group.tolist(), order.tolist(), again.tolist(), strict=True)):
            if twice:
                continue
            if (g, segs[k]) in have:
                copy.append(i)
            else:
                have.add((g, segs[k]))
                keep.append(i)
        del have
        keep, copy = np.array(keep, dtype=np.int64), np.array(copy, dtype=np.int64)
        size = np.array([len(x) for x in segs], dtype=np.int64)[order]
        none = lambda n: pa.nulls(n, pa.int64())

        def ranges(i: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col["d"][i]), pa.array(col["th"][i]), pa.array(first), pa.array(last), none(len(i)), none(len(i))], names=["d", "th", "first", "last", "w1", "w2"])

        yield ranges(copy, col["start"][copy], col["start"][copy] + size[copy] - width)
        salted = col["salt"] >= 0
        company = np.bincount(group[keep], minlength=int(group[-1]) + 1) > 1
        keep = keep[company[group[keep]] | salted[keep]]
        if not len(keep):
            return
        mine = [segs[k] for k in order[keep].tolist()]
        data = np.frombuffer(b"".join(mine), dtype=np.uint8)
        length = size[keep]
        at = np.r_[0, np.cumsum(length)[:-1]]
        before, g = col["before"][keep], group[keep]
        right, right_common = sorted_with_prefixes(_padded(data, at + before, length - before, width, 1), length - before, g, gram + shallow)
        left, left_common = sorted_with_prefixes(_padded(data, at + before - 1, before, most, -1), before, g, shallow)
        anchor = col["start"][keep] + before  # place in the text
        high, low = before, before - (length - width)  # distances of the anchor from a segment's strings
        far, close = np.full(len(keep), -1), np.full(len(keep), most + 1)
        alone: list[tuple[np.ndarray, int]] = []
        for o in range(most + 1):
            some = np.flatnonzero((low <= o) & (o <= high))
            kind = np.cumsum(right_common < width - o)[right[some]] * (len(keep) + 1) + np.cumsum(left_common < o)[left[some]]
            first = np.unique(kind, return_index=True)[1]
            repeated = np.ones(len(some), dtype=bool)
            repeated[first] = False
            i = some[repeated]
            far[i], close[i] = o, np.minimum(close[i], o)
            alone.append((some[~repeated][salted[keep][some[~repeated]]], o))
        i = np.flatnonzero(far >= 0)
        yield ranges(keep[i], anchor[i] - far[i], anchor[i] - close[i])
        if sum(len(x) for x, _ in alone):
            i = np.concatenate([x for x, _ in alone])
            o = np.concatenate([np.full(len(x), k) for x, k in alone])
            spot = at[i] + before[i] - o
            w = np.zeros((2, len(i)), dtype=np.int64)
            for begin in range(0, len(data), STEP):
                part = data[begin : begin + STEP + width - 1]
                here = np.flatnonzero((spot >= begin) & (spot < begin + STEP))
                if len(here):
                    for k in (0, 1):
                        w[k, here] = rolling(width, 1 + k).of(part)[spot[here] - begin].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(col["d"][keep[i]]), pa.array(col["th"][keep[i]]), pa.array(anchor[i] - o), none(len(i)), pa.array(w[0]), pa.array(w[1])], names=["d", "th", "first", "last", "w1", "w2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if n >= MEMBERS and len(batch):
                # The bins that are whole: all before the last one held; what goes on in this batch waits.
                bins = pa.Table.from_batches(held).combine_chunks()
                last = [bins.column(c).to_numpy() for c in ("anchor", "salt")]
                edge = int(np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]))[-1]) + 1 if (last[0] != last[0][-1]).any() or (last[1] != last[1][-1]).any() else 0
                if edge:
                    yield from looked_at(bins.slice(0, edge))
                    held = bins.slice(edge).to_batches()
                    n = len(bins) - edge
            held.append(batch)
            n += len(batch)
        if n:
            yield from looked_at(pa.Table.from_batches(held).combine_chunks())

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((s["first"], s["to"]) for s in spans):
                if s[0] > end:
                    kept.update(text[at : s[0]])
                    runs += 1
                    removed += s[1] - s[0]
                elif s[1] > end:
                    removed += s[1] - end
                end = at = max(end, s[1])
            kept.update(text[at:])
            out.append((removed, runs, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("th"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["cut_d", "cut_th", "removed", "runs", "kept_sha"])


def _bitmap_of(keys: DataFrame, buckets: int, name: str) -> DataFrame:
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(buckets * BITS))
    return keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / BITS).cast("int").alias(f"{name}_bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITS).alias(f"{name}_map"))


def _buckets(rows: int, most: int = 2048) -> int:
    """Rows of a bitmap with 16 slots a key, at most ``most`` (8 MB)."""
    return max(16, min(most, -(-16 * rows // BITS)))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 32, shallow: int = 16, bin_segments: int = 1000, buckets: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A text is its UTF-8 bytes. Every byte goes that is covered by a string of ``width`` bytes which also starts earlier: in a
    row with a smaller id, or before in the same row. n_spans counts maximal removed runs; kept_sha256 is of the rest.

    Null counts as empty; shorter texts lose nothing. Rows with a null id come last. Rows that repeat an id come in the order
    of a hash of their texts, and of rows alike in both one comes first. Whole texts are read, however long. An empty table
    gives an empty result. Other columns are not looked at. ``gram``, ``shallow``, ``bin_segments`` and ``buckets`` (of the
    bitmaps that keep texts and segments from moving for nothing, at most 8 MB each) change no result.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), text_of(text_col).alias("t")).withColumn("th", F.xxhash64("t"))
    rows = staged(keyed.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "d", "th", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha")))
    # Grouped with the size but joined without it, so that the groups get an exchange of their own.
    firsts = staged(rows.groupBy("sha", "n_bytes").agg(F.min(F.struct("d", "th", "row_no")).alias("at")).select("sha", "n_bytes", "at.*"))
    looked = firsts.where(F.col("n_bytes") >= width).select("d", "th")
    size = buckets or _buckets(looked.count())
    texts = _passed(keyed.where(F.octet_length("t") >= width), _bitmap_of(looked, size, "looked"), ["d", "th"], size, "looked").where("looked").select("d", "th", F.col("t").cast("binary").alias("t"))

    counts = texts.select("t").mapInArrow(_anchors(width, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    twice = staged(counts.where("n > 1"))
    size = buckets or _buckets(twice.count())
    cut = texts.mapInArrow(_segments(width, gram), "anchor long, d long, th long, start long, before long, seg binary")
    cut = _passed(cut, _bitmap_of(twice.select("anchor"), size, "twice"), ["anchor"], size, "twice").where("twice").drop("twice")
    large = staged(twice.where(F.col("n") > bin_segments).select(F.col("anchor").alias("large"), F.ceil(F.col("n") / bin_segments).cast("int").alias("parts")))
    salt = F.coalesce(F.pmod(F.xxhash64("d", "th"), F.col("parts")).cast("int"), F.lit(-1))
    cut = cut.join(checked(large), F.col("anchor") == F.col("large"), "left").select("anchor", salt.alias("salt"), "d", "th", "start", "before", "seg")
    found = staged(cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_sorted_bins(width, gram, shallow), FOUND))
    # Strings that are first in their part of a bin, with those of the other parts: a hash has at most one row for each part.
    parts = found.where("w1 IS NOT NULL")
    met = parts.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.min(F.struct("d", "th", "first")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = parts.join(met, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).where(F.struct("d", "th", "first") > F.col("least")).select("d", "th", "first", F.col("first").alias("last"))
    ranges = found.where("w1 IS NULL").select("d", "th", "first", "last").union(later)
    spans = staged(ranges.groupBy("d", "th").agg(F.collect_list(F.struct("first", (F.col("last") + width).alias("to"))).alias("spans")))

    touched = spans.join(looked, ["d", "th"], "left_semi")
    size = buckets or _buckets(spans.count())
    moved = _passed(keyed, _bitmap_of(spans.select("d", "th"), size, "moved"), ["d", "th"], size, "moved").where("moved").select("d", "th", "t")
    one = moved.groupBy("d", "th").agg(F.first("t").cast("binary").alias("t"))
    done = staged(one.join(touched, ["d", "th"]).select("d", "th", "t", "spans").mapInArrow(_cut, "cut_d long, cut_th long, removed long, runs long, kept_sha string"))
    told = rows.join(firsts.select("sha", F.col("row_no").alias("first_row")), "sha")
    first = F.col("row_no") == F.col("first_row")
    told = told.join(done, first & (F.col("d") == F.col("cut_d")) & (F.col("th") == F.col("cut_th")), "left")
    gone = ~first & (F.col("n_bytes") >= width)
    pick = lambda whole, some, none: F.when(gone, whole).otherwise(F.coalesce(some, none))
    return told.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("runs"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256().hexdigest()), F.col("kept_sha"), F.col("sha")).alias("kept_sha256"),
    )


def op12_repeated_bytes(spark, sf_dir) -> DataFrame:
    """Strings of 100 bytes over all ``documents``; nulls, ties and repeated rows as in repeated_bytes."""
    return repeated_bytes(read(spark, sf_dir, "documents"))
