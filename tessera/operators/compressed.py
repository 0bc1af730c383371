"""A compressed vector index: coarse lists, residuals in product-quantised codes, and exact reranking of the best.

A vector is its list's centre plus a residual. The residual's dimensions are cut into parts, and each part is one byte: the
nearest of 256 codewords. A search reads the codes of a query's nearest lists, a small share of the vectors' bytes, and
takes the true vectors of its best candidates alone. Centres and codewords are fitted on a bounded sample; all rows are
indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import stored
from .retrieval import BLOCK, Kept, _matrix, _passes, top_k


@dataclass(frozen=True)
class CompressedIndex:
    codes: DataFrame  # list, id, code
    vectors: DataFrame  # id, v
    centres: np.ndarray  # lists x size
    words: np.ndarray  # parts x 256 x width, on dimensions padded with zeros

    def bytes_read(self, rows: int, probes: int, candidates: int) -> float:
        """Of the bytes of ``rows`` vectors of 4-byte numbers, the share that a query reads: codes of its lists, and its candidates."""
        size = self.centres.shape[1]
        return (len(self.words) * rows * min(1.0, probes / max(len(self.centres), 1)) + 4 * size * min(candidates, rows)) / (4 * size * rows)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of the rows of x, fewer than k only if there are fewer rows; a centre that loses its rows stays where it is."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width; the last part is filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def encode(x: np.ndarray, centres: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each row and its code, a byte for each part."""
    lists = nearest(x, centres)
    rest = _split(x - centres[lists], len(words))
    return lists, np.stack([nearest(rest[:, p], words[p]) for p in range(len(words))], axis=1).astype(np.uint8)


def decode(lists: np.ndarray, codes: np.ndarray, centres: np.ndarray, words: np.ndarray) -> np.ndarray:
    rest = np.concatenate([words[p][codes[:, p]] for p in range(len(words))], axis=1)
    return centres[lists] + rest[:, : centres.shape[1]]


def compressed_index(rows: DataFrame, id_col: str, vector_col: str, lists: int = 16, parts: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 5) -> CompressedIndex:
    """All rows with a whole vector of the commonest length, in codes of ``parts`` bytes; fitted on about ``sample`` rows drawn by a hash of the id, twice that at most."""
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    sizes = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return CompressedIndex(spark.createDataFrame([], "list int, id long, code binary"), spark.createDataFrame([], "id long, v array<double>"), np.zeros((0, 0)), np.zeros((0, 256, 0)))
    size, n = sizes[0]["n"], sizes[0]["count"]
    given = given.where(F.size("v") == size)
    share = int(min(1.0, sample / n) * (1 << 30))
    x = np.array([r["v"] for r in given.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) <= share).orderBy("id").limit(2 * sample).collect()])
    rng, parts = np.random.default_rng(seed), min(parts, size)
    centres = k_means(x, lists, rounds, rng)
    rest = _split(x - centres[nearest(x, centres)], parts)
    words = np.zeros((parts, 256, rest.shape[2]))
    for p in range(parts):
        fitted = k_means(rest[:, p], 256, rounds, rng)
        words[p, : len(fitted)], words[p, len(fitted) :] = fitted, fitted[0]
    shared = spark.sparkContext.broadcast((centres, words))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes = encode(_matrix(batch.column("v"), size)[0], *shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

    codes = stored(given.mapInArrow(assign, "list int, id long, code binary"), "codes")
    return CompressedIndex(codes, given.select("id", F.col("v").cast("array<float>").alias("v")) if dict(rows.dtypes)[vector_col] == "array<float>" else given, centres, words)


def compressed_top_k(index: CompressedIndex, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int = 16, candidates: int = 64, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the k best rows by inner product among the ``candidates`` that look best by their codes in the query's ``probes`` nearest lists; scores are exact.

    Candidates meet their vectors by a join on the id, so that only they are read in full by whoever stores vectors by id.
    Queries go along in passes of bounded size. Queries of another length than the index have no result.
    """
    spark, kind = queries.sparkSession, "qid long, id long, score double"
    found = None
    for size, qids, vectors in _passes(queries, id_col, vector_col, candidates):
        if index.centres.shape[1:] != (size,):
            continue
        best_lists = np.argsort(-(vectors @ index.centres.T), axis=1)[:, :probes]
        asked = np.zeros((len(qids), len(index.centres)), dtype=bool)
        np.put_along_axis(asked, best_lists, True, axis=1)
        shared = spark.sparkContext.broadcast((qids, vectors, asked, index.centres, index.words))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return best_codes(batches, *shared.value, candidates)

        def exact(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value[:2]
            order = np.argsort(qid, kind="stable")
            for batch in batches:
                v = _matrix(batch.column("v"), size)[0]
                mine = q[order[np.searchsorted(qid, batch.column("qid").to_numpy(), sorter=order)]]
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(np.round((v * mine).sum(axis=1), digits) + 0.0)], names=["qid", "id", "score"])

        near = top_k(index.codes.mapInArrow(look, kind), ["qid"], "score", "id", candidates).select("qid", "id")
        part = near.join(index.vectors, "id").select("qid", "id", "v").mapInArrow(exact, kind)
        found = part if found is None else found.union(part)
    return top_k(spark.createDataFrame([], kind) if found is None else found, ["qid"], "score", "id", k)


def best_codes(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, asked: np.ndarray, centres: np.ndarray, words: np.ndarray, candidates: int) -> Iterator[pa.RecordBatch]:
    """Each task keeps the best candidates of a query while it reads its codes block by block, and only these move. ``asked`` tells the lists of each query."""
    kept = Kept(len(qids), candidates)
    for whole in batches:
        for at in range(0, len(whole), BLOCK):
            batch = whole.slice(at, BLOCK)
            lists, ids = batch.column("list").to_numpy(), batch.column("id").to_numpy()
            rows = decode(lists, np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(batch), -1), centres, words).T
            for first in range(0, len(q), BLOCK):
                s = np.where(asked[first : first + BLOCK][:, lists], q[first : first + BLOCK] @ rows, -np.inf)
                kept.offer(np.arange(first, first + len(s)), s, 0.0, lambda i, j, s=s: s[i, j], ids)
    yield from kept.rows(qids, ["qid", "id", "score"])
