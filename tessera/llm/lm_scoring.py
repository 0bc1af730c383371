"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts: every task counts the tokens of its training documents; Spark adds them up into one table. The most frequent
words form a bounded head that tasks get as a broadcast, the rest meets the table in a join, so only rare tokens move.

Model: the next token's score is the product of its vector with a linear combination of the two previous tokens'
vectors, plus a bias. Each task trains on all of its own training documents from a common start, by noise-contrastive
estimation in mini-batches; the parameters are averaged, weighted by tokens, in a tree of fixed fan-in. The score is a
sum over the two positions, so the normaliser of all pairs of contexts is one matrix product, and token
log-probabilities are exactly normalised. A token outside the model's vocabulary costs its class, and then its count
among such tokens with one added.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, held, read, slices, small_batches, staged, text_of

END = "\n"  # no word contains it
OTHER, STOP = 0, 1  # of the model's vocabulary
FLUSH = 400_000  # distinct words that a task holds before it hands them on
FAN_IN = 16
SCORED = "row_no long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, n_other long, other_logs double, tail array<struct<word:string,n:int>>"


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("t").to_pylist():
            held.update(tokens(text))
            held[END.encode()] += 1
            if len(held) > FLUSH:
                yield rows()
                held.clear()
    if held:
        yield rows()


class LogBilinear:
    """Vectors of context words (R) and predicted words (Q), a matrix for each context position (C) and biases (b)."""

    def __init__(self, size: int, width: int, counts: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size, self.width = size, width
        self.unigram = (counts + 1.0) / (counts.sum() + size)
        self.R = rng.normal(0, 0.3, (size, width)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (size, width)).astype(np.float32)
        self.C = np.stack([np.eye(width), np.eye(width) * 0.5]).astype(np.float32)
        self.b = np.log(self.unigram).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.R.ravel(), self.Q.ravel(), self.C.ravel(), self.b]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        v, d, flat = self.size, self.width, flat.astype(np.float32)
        self.R, self.Q = flat[: v * d].reshape(v, d).copy(), flat[v * d : 2 * v * d].reshape(v, d).copy()
        self.C, self.b = flat[2 * v * d : 2 * v * d + 2 * d * d].reshape(2, d, d).copy(), flat[2 * v * d + 2 * d * d :].copy()

    def _scatter(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = self.width
        cells = (at[:, None] * d + np.arange(d)).ravel()
        return np.bincount(cells, weights=rows.ravel(), minlength=self.size * d).reshape(self.size, d).astype(np.float32)

    def train(self, ids: np.ndarray, before: np.ndarray, before2: np.ndarray, rng: np.random.Generator, squares: list, batch: int = 4096, noise: int = 32, rate: float = 0.1) -> None:
        """One pass in random order; AdaGrad. ``squares`` keeps the sums of squared gradients."""
        log_noise = np.log(noise * self.unigram).astype(np.float32)
        edges = np.cumsum(self.unigram)
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            w, x, y = ids[pick], before[pick], before2[pick]
            z = np.minimum(np.searchsorted(edges, rng.random(noise)), self.size - 1)
            rx, ry, qw, qz = self.R[x], self.R[y], self.Q[w], self.Q[z]
            h = rx @ self.C[0] + ry @ self.C[1]
            g = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, qw) + self.b[w] - log_noise[w], -30, 30)))
            n = 1 / (1 + np.exp(-np.clip(h @ qz.T + self.b[z] - log_noise[z], -30, 30)))
            dh = g[:, None] * qw - n @ qz
            dq = self._scatter(w, g[:, None] * h)
            np.subtract.at(dq, z, n.T @ h)
            db = np.bincount(w, weights=g, minlength=self.size).astype(np.float32)
            np.subtract.at(db, z, n.sum(axis=0))
            dc = np.stack([rx.T @ dh, ry.T @ dh])
            dr = self._scatter(np.concatenate([x, y]), np.concatenate([dh @ self.C[0].T, dh @ self.C[1].T]))
            for k, (value, step) in enumerate(((self.R, dr), (self.Q, dq), (self.C, dc), (self.b, db))):
                squares[k] += step * step
                value += rate * step / np.sqrt(squares[k] + 1e-6)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, norm): log P(w | x, y) = first[x, w] + second[y, w] - norm[x, y], x the nearer context."""
        first = (self.R @ self.C[0]) @ self.Q.T
        second = (self.R @ self.C[1]) @ self.Q.T + self.b
        m, n = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        norm = np.log(np.maximum(np.exp(first - m) @ np.exp(second - n).T, 1e-30)) + m + n.T
        return first, second, norm


class Vocabulary:
    """The head: words with their counts, the model's words first."""

    def __init__(self, head: list[tuple[str, int]], model_words: int):
        self.index = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.logs = np.log10(np.array([n for _, n in head] + [0], dtype=np.float64) + 1)
        self.model_id = np.zeros(len(head) + 1, dtype=np.int64)
        k = STOP
        for i, (w, _) in enumerate(head):
            if w == END:
                self.model_id[i] = STOP
            elif k + 1 < model_words:
                k += 1
                self.model_id[i] = k

    def ids(self, texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words; head indices (-1: not in the head) of all texts, each with its end; tokens of each text."""
        words = [tokens(t) for t in texts]
        end = END.encode()
        flat = np.fromiter(map(self.index.get, (w for x in words for w in (*x, end)), repeat(-1)), dtype=np.int64, count=sum(map(len, words)) + len(words))
        return words, flat, np.array([len(x) + 1 for x in words], dtype=np.int64)

    def contexts(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.model_id[flat]
        own[np.cumsum(sizes) - 1] = STOP
        before, before2 = np.r_[STOP, own[:-1]], np.r_[STOP, STOP, own[:-2]][: len(own)]
        before2[np.cumsum(sizes) - sizes] = STOP
        return own, before, before2


def train(docs: DataFrame, head: list[tuple[str, int]], class_counts: np.ndarray, model_words: int, width: int) -> np.ndarray:
    """Averaged parameters of models trained on every task's documents (column t)."""
    spark = docs.sparkSession
    given, run_name = spark.sparkContext.broadcast((head, class_counts)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        vocabulary = held(f"words of {run_name}", lambda: Vocabulary(given.value[0], model_words))
        model, rng, n = LogBilinear(model_words, width, given.value[1]), np.random.default_rng(part), 0
        squares = [np.zeros_like(x) for x in (model.R, model.Q, model.C, model.b)]
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts):
                _, flat, sizes = vocabulary.ids(texts[at:end])
                model.train(*vocabulary.contexts(flat, sizes), rng, squares)
                n += len(flat)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(n)]), pa.array([(model.flat() * n).astype(np.float64).tobytes()], pa.binary())], names=["part", "weight", "total"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in group["total"])
        return pd.DataFrame({"part": group["part"].iloc[:1] // FAN_IN, "weight": [group["weight"].sum()], "total": [total.tobytes()]})

    kind = "part int, weight double, total binary"
    found, n = docs.select("t").mapInArrow(run, kind), docs.rdd.getNumPartitions()
    while True:
        found = found.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(add, kind)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    row = found.first()
    return LogBilinear(model_words, width, class_counts).flat() if row is None else np.frombuffer(row["total"], dtype=np.float64) / row["weight"]


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The end token, and the words whose counts are so high that there are at most ``most`` of them; the most frequent first.

    Counts are binned by their logarithm, and the lowest bin that still fits is the border: so few rows reach the driver
    from any number of partitions. Words of the bin on the border are all in or all out.
    """
    bin_of = F.floor(F.log2("n") * 64).cast("int")
    bins = sorted(((r["b"], r["count"]) for r in counts.groupBy(bin_of.alias("b")).count().collect()), reverse=True)
    border, n = None, 0
    for b, size in bins:
        n += size
        if n > most:
            break
        border = b
    chosen = counts.where((F.col("word") == END) | (bin_of >= (F.lit(border) if border is not None else F.lit(1 << 30)))).collect()
    return sorted(((r["word"], r["n"]) for r in chosen), key=lambda x: (x[0] != END, -x[1], x[0]))


@dataclass(frozen=True)
class LanguageModel:
    """What is learned: all counts as a table, the head of it, the classes' counts, the parameters and the totals."""

    counts: DataFrame
    head: list[tuple[str, int]]
    classes: np.ndarray
    params: np.ndarray
    total: int  # training tokens
    distinct: int
    other_size: int  # of the tokens outside the model's vocabulary: their number, their kinds and one for the unknown
    model_words: int
    width: int

    def parts(self) -> tuple[Vocabulary, LogBilinear]:
        model = LogBilinear(self.model_words, self.width, self.classes)
        model.load(self.params)
        return Vocabulary(self.head, self.model_words), model


def learn_model(learn: DataFrame, head_words: int = 200_000, model_words: int = 2048, width: int = 16) -> LanguageModel:
    """Counts and model of all texts of ``learn`` (column t, not null); no rows leave the untrained start.

    A task trains on the documents of its input partition, in order, so the parameters depend on how the input is laid out
    in files: the same files give the same scores, another layout gives a model of equal worth and slightly other scores.
    """
    counts = staged(learn.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = most_frequent(counts.where("length(word) <= 64"), head_words)
    vocabulary = Vocabulary(head, model_words)
    classes = np.zeros(model_words)
    np.add.at(classes, vocabulary.model_id[:-1], [float(n) for _, n in head])
    inside = int(sum(n for i, (_, n) in enumerate(head) if vocabulary.model_id[i] != OTHER))
    classes[OTHER] = total - inside
    other_size = (total - inside) + (distinct - int((vocabulary.model_id[:-1] != OTHER).sum())) + 1
    params = train(learn, head, classes, model_words, width)
    return LanguageModel(counts, head, classes, params, int(total), int(distinct), other_size, model_words, width)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", head_words: int = 200_000, model_words: int = 2048, width: int = 16) -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on the columns of ``docs``; the rest is learned from, all of it. Null text counts as
    empty: its one token is the end. Whole texts are scored, however long. Scores are log10 probabilities of the whole
    text and its end. Without training rows nothing is known, the base gives every token probability 1 and the model is
    the untrained start. Repeated rows are scored each and count each in training; a null id stays null; other columns
    go. An empty table gives no rows. ``head_words`` bounds what is broadcast (words of over 64 characters are never in
    the head). Scores depend on the file layout as learn_model says; the other columns do not.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("t"))
    return score_rows(rows, learn_model(rows.where("NOT held_out").select("t"), head_words, model_words, width))


def score_rows(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of rows (row_no, doc_id, held_out, t) by a model that has been learned."""
    given = rows.sparkSession.sparkContext.broadcast((model.head, model.classes, model.params))
    name, model_words, width = hashlib.sha256(model.params.tobytes()).hexdigest(), model.model_words, model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            own = LogBilinear(model_words, width, given.value[1])
            own.load(given.value[2])
            return Vocabulary(given.value[0], model_words), own.tables()

        words_of, (first, second, norm) = held(name, made)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts):
                words, flat, sizes = words_of.ids(texts[at:end])
                own, x, y = words_of.contexts(flat, sizes)
                begin = np.cumsum(sizes) - sizes
                add = lambda v: np.add.reduceat(v, begin)
                logs = words_of.logs[flat]
                tail, cuts, start = [], [0], 0
                for ws, n in zip(words, sizes.tolist(), strict=True):
                    tail += Counter([ws[i] for i in np.flatnonzero(flat[start : start + n - 1] < 0)]).items()
                    cuts.append(len(tail))
                    start += n
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array([w for w, _ in tail], pa.binary()).cast(pa.string()), pa.array([n for _, n in tail], pa.int32())], names=["word", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, end - at) for c in ("row_no", "doc_id", "held_out")]
                    + [pa.array(sizes), pa.array(add((flat >= 0).astype(np.int64))), pa.array(add(logs)), pa.array(add((first[x, own] + second[y, own] - norm[x, y]).astype(np.float64))), pa.array(add((own == OTHER).astype(np.int64))), pa.array(add(np.where(own == OTHER, logs, 0.0))), lists],
                    names=["row_no", "doc_id", "held_out", "n_tokens", "known", "logs", "model", "n_other", "other_logs", "tail"],
                )

    scored = staged(rows.mapInArrow(run, SCORED))
    rare = scored.select("row_no", F.explode("tail").alias("x")).select("row_no", "x.word", F.col("x.n").alias("tf"))
    met = rare.join(model.counts, "word").groupBy("row_no").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = scored.drop("tail").join(met, "row_no", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "more_logs": F.coalesce("more_logs", F.lit(0.0))})
    base = F.col("logs") + F.col("more_logs") - F.col("n_tokens") * math.log10(model.total + model.distinct + 1)
    score = F.col("model") / math.log(10) + F.col("other_logs") + F.col("more_logs") - F.col("n_other") * math.log10(model.other_size)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op3_lm_scores(spark, sf_dir) -> DataFrame:
    """All whole texts of ``documents``, learning from those whose crc32 modulo 7 is not 2 (a null id counts as learned from). Odd rows as in score_texts."""
    return score_texts(read(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
