"""Packing token ids into fixed-length rows, best fit decreasing, and writing them as binary matrices.

Each task encodes its documents, ends each with the end id, cuts what is longer than a row into whole rows and a rest,
and packs the rests: in decreasing order, each goes to the row with the least room that suffices, which a segment tree
over amounts of room finds. Packing happens in windows of at most ``window`` tokens, so a task's memory is bounded and
nothing is shuffled; a lost task is simply run again, as the result depends on its input partition alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import codec_of, model_bytes, slices
from .shared import read, small_batches, text_of

SEGMENT = "struct<row:int,start:int,length:int,doc_id:bigint,doc_part:int,doc_offset:bigint>"
SCHEMA = f"shard int, matrix int, n_rows int, row_length int, n_tokens long, ids binary, position_ids binary, cu_seqlens array<int>, segments array<{SEGMENT}>"


class Room:
    """Rows by the room left in them; a segment tree over the amounts finds the least that is enough."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of at least ``need``; the last one put of equals."""
        i, tree = need + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(row, start) for each size (1 to length); larger sizes first, of equals the earlier."""
    room, out, rows = Room(length), [(0, 0)] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if (found := room.take(sizes[i])) is None:
            found = (rows, length)
            rows += 1
        row, left = found
        out[i] = (row, length - left)
        if left > sizes[i]:
            room.put(row, left - sizes[i])
    return out


def pack_window(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """Rows (ids, positions, segments) of documents (doc_id, ids with the end id)."""
    parts = [(d, k, at, ids[at : at + length]) for d, ids in docs for k, at in enumerate(range(0, len(ids), length))]
    placed = best_fit_decreasing([len(x[3]) for x in parts], length)
    n_rows = max((r for r, _ in placed), default=-1) + 1
    grid, places, segments = np.full((n_rows, length), pad, dtype=kind), np.zeros((n_rows, length), dtype=kind), [[] for _ in range(n_rows)]
    steps = np.arange(length)
    for (d, k, at, ids), (row, start) in zip(parts, placed, strict=True):
        grid[row, start : start + len(ids)] = ids
        places[row, start : start + len(ids)] = steps[: len(ids)]
        segments[row].append((start, len(ids), d, k, at))
    for row in range(n_rows):
        yield grid[row], places[row], sorted(segments[row], key=lambda s: s[0])


def pack_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, rows: int = 64, window: int = 4_000_000, end_id: int = 2, pad_id: int = 0) -> DataFrame:
    """Rows of SCHEMA: matrices of ``rows`` x ``length`` ids with where their segments lie.

    ``ids`` and ``position_ids`` are row-major little-endian matrices, 2 bytes a number if ids and positions fit, else 4;
    positions start at 0 in every segment. ``cu_seqlens`` are the cumulative segment lengths over the flattened matrix,
    padding at the end of a row being a segment without an entry in ``segments``. Every id of every document is in
    exactly one segment; a document longer than a row has several, with ``doc_part`` and ``doc_offset``. A null or empty
    text is its end id alone. Whole texts are encoded, however long. Ties of size go to the earlier document, ties of room
    to the row filled last. Repeated rows are packed each, a null id stays null; other columns go. An empty table gives no
    rows.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(given.value)
        kind = np.uint16 if len(codec.bytes_of) <= 65536 and length <= 65536 else np.int32
        shard, number = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def matrices() -> Iterator[pa.RecordBatch]:
            nonlocal number
            packed = list(pack_window(held, length, pad_id, kind))
            for at in range(0, len(packed), rows):
                some = packed[at : at + rows]
                cuts, segments = [0], []
                for r, (_, _, own) in enumerate(some):
                    for start, size, d, k, offset in own:
                        segments.append({"row": r, "start": start, "length": size, "doc_id": d, "doc_part": k, "doc_offset": offset})
                        cuts.append(r * length + start + size)
                    if cuts[-1] < (r + 1) * length:
                        cuts.append((r + 1) * length)
                yield pa.RecordBatch.from_pylist([{
                    "shard": shard, "matrix": number, "n_rows": len(some), "row_length": length, "n_tokens": sum(s["length"] for s in segments),
                    "ids": np.stack([x[0] for x in some]).tobytes(), "position_ids": np.stack([x[1] for x in some]).tobytes(), "cu_seqlens": cuts, "segments": segments,
                }], schema=OUT)
                number += 1

        for batch in batches:
            texts = batch.column("t").to_pylist()
            names = batch.column("doc_id").to_pylist()
            for at, end in slices(texts):
                for d, ids in zip(names[at:end], codec.encode(texts[at:end]), strict=True):
                    own = np.empty(len(ids) // 4 + 1, dtype=kind)
                    own[:-1] = np.frombuffer(ids, dtype=np.int32)
                    own[-1] = end_id
                    held.append((d, own))
                    n += len(own)
                if n >= window:
                    yield from matrices()
                    held, n = [], 0
        if held:
            yield from matrices()

    given_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return given_rows.mapInArrow(run, SCHEMA)


OUT = pa.schema([
    ("shard", pa.int32()), ("matrix", pa.int32()), ("n_rows", pa.int32()), ("row_length", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("segments", pa.list_(pa.struct([("row", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("doc_id", pa.int64()), ("doc_part", pa.int32()), ("doc_offset", pa.int64())]))),
])


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrices, one binary value each, to Parquet files by shard task, in place of what the path held.

    An empty table writes files without rows. ``matrix`` turns a row that is read back into its two arrays.
    """
    packed.write.mode("overwrite").parquet(path)


def matrix(row) -> tuple[np.ndarray, np.ndarray]:
    """The id and position matrices of one row of a packed table."""
    shape = (row["n_rows"], row["row_length"])
    kind = np.uint16 if len(row["ids"]) == 2 * shape[0] * shape[1] else np.int32
    return np.frombuffer(row["ids"], dtype=kind).reshape(shape), np.frombuffer(row["position_ids"], dtype=kind).reshape(shape)


def op9_packed_tokens(spark, sf_dir) -> DataFrame:
    """All ``documents`` as packed matrices; odd rows as in pack_tokens."""
    return pack_tokens(read(spark, sf_dir, "documents"), model_bytes(spark))
