"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton. A text is parsed against each
automaton into longest matches; the language that needs the fewest phrases, normalised by the text's length and the
size of the sample, wins. Automata are held as dense transition tables whose failing transitions already start the
next phrase, so that many blocks of text are parsed in step by array operations. Only the samples are broadcast: at
most ``train_bytes`` a language, and less where there are so many that their tables would outgrow ``table_mb``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, held, read, small_batches

UNKNOWN = "und"
BLOCK = 256  # bytes; a phrase never runs across the end of a block
NOT_LETTERS = re.compile(r"[\W\d_]+")
GROUP = 1 << 13  # blocks parsed in step


def normalised(text: str) -> bytes:
    """Lower case, with every run of other than letters as one space."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def dense_table(nxt: list[dict[int, int]], width: int) -> np.ndarray:
    """next state * width * 2, plus 1 where a new phrase starts. Symbol width - 1 pads: it changes nothing; width - 2 is unknown to all languages.

    A symbol that the sample lacks is a phrase and leads to the last state, from which every symbol starts another.
    """
    states = len(nxt) + 1
    start = np.full(width, (states - 1) * width * 2 + 1, dtype=np.int32)
    for c, t in nxt[0].items():
        start[c] = t * width * 2 + 1
    out = np.tile(start, (states, 1))
    rows = np.repeat(np.arange(len(nxt)), [len(d) for d in nxt])
    cols = np.fromiter((c for d in nxt for c in d), dtype=np.int64, count=len(rows))
    out[rows, cols] = np.fromiter((t for d in nxt for t in d.values()), dtype=np.int64, count=len(rows)) * width * 2
    out[:, width - 1] = np.arange(states) * width * 2
    return out.ravel()


class Parser:
    """Cross-parses texts against one automaton for each language."""

    def __init__(self, samples: list[tuple[str, bytes]]):
        self.languages = [x for x, _ in samples]
        used = sorted(set(b"".join(s for _, s in samples)))
        self.width = len(used) + 2
        self.pad = self.width - 1
        to = bytearray([self.width - 2] * 256)
        for i, b in enumerate(used):
            to[b] = i
        self.to = bytes(to)
        self.tables = [dense_table(suffix_automaton(s.translate(self.to)), self.width) for _, s in samples]
        self.bits = [math.log2(max(len(s), 2)) for _, s in samples]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each non-empty text by language."""
        blocks = np.array([-(-len(t) // BLOCK) for t in texts])
        pad = bytes([self.pad])
        flat = np.frombuffer(b"".join(t.translate(self.to) + pad * (-len(t) % BLOCK) for t in texts), dtype=np.uint8).reshape(-1, BLOCK)
        out = np.empty((len(flat), len(self.tables)), dtype=np.int64)
        for at in range(0, len(flat), GROUP):
            steps = np.ascontiguousarray(flat[at : at + GROUP].T).astype(np.int32)
            for k, table in enumerate(self.tables):
                count = np.ones(steps.shape[1], dtype=np.int32)
                v = table[steps[0]]  # opens the first phrase, which is counted already
                for row in steps[1:]:
                    v >>= 1
                    v += row
                    v = table.take(v)
                    count += v & 1
                out[at : at + GROUP, k] = count
        return np.add.reduceat(out, np.r_[0, np.cumsum(blocks)[:-1]], axis=0) if len(texts) else out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score for each text: one minus the ratio of the best to the second best entropy. Ties: the first language."""
        clean = [normalised(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
        given = [i for i, t in enumerate(clean) if t] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if given:
            entropy = self.phrases([clean[i] for i in given]) * np.array(self.bits) / np.array([[len(clean[i])] for i in given])
            best = entropy.argmin(axis=1)
            low = np.sort(entropy, axis=1)
            score = 1 - low[:, 0] / low[:, 1] if len(self.languages) > 1 else np.ones(len(given))
            for i, b, s in zip(given, best, score, strict=True):
                names[i], scores[i] = self.languages[b], float(min(max(s, 0.0), 1.0))
        return names, scores


def parser_of(samples: list[tuple[str, bytes]]) -> Parser:
    """Built once in each Python worker."""
    return held(f"parser {hashlib.sha256(repr(samples).encode()).hexdigest()}", lambda: Parser(samples))


def learn_samples(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = 40960, docs_per_language: int = 96, table_mb: int = 192) -> list[tuple[str, bytes]]:
    """(language, normalised training text) of every label that occurs with a text, ordered by language.

    ``train_bytes`` bounds the sample of a language; with so many languages that all tables would outgrow ``table_mb``,
    each gets the same smaller share, none is left out. About ``docs_per_language`` of a language's rows that differ in id
    or text are drawn by a hash of both, and each gives a stretch of at most a twentieth of the bound, from a place that the
    hash picks, so that no few long texts make up a sample, and rows that share an id (or have none) are drawn like any
    others. Null and blank texts and null labels teach nothing; rows alike in id and text teach once. The driver gets one
    row a language.
    """
    rows = train.where(F.col(lang_col).isNotNull() & (F.trim(F.col(text_col)) != "")).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)).alias("mark"), F.col(text_col).alias("t"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()
    if not counts:
        return []
    room = max(min(train_bytes, int(table_mb * 1e6 / len(counts) / (1.6 * 80 * 4))), 64)
    stretch = max(train_bytes // 20, 64)
    sizes = train.sparkSession.createDataFrame([(r["lang"], docs_per_language / max(r["n"], 1)) for r in counts], "lang string, share double")
    # One row a language, which the driver holds anyway, is sent along.
    drawn = rows.join(F.broadcast(sizes), "lang").where((F.pmod("mark", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("share") >= 1))
    cut = F.substring("t", (1 + F.pmod(F.xxhash64("mark", F.lit(6)), F.greatest(F.length("t") - stretch, F.lit(1)))).cast("int"), F.lit(stretch))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(drawn=group["mark"] % (1 << 30)).sort_values(["drawn", "mark", "t"])
        text = b" ".join(filter(None, map(normalised, group["t"])))[:room]
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "sample": [text]})

    once = drawn.select("lang", "mark", cut.alias("t")).groupBy("lang", "mark").agg(F.first("t").alias("t"))
    got = once.groupBy("lang").applyInPandas(gather, "lang string, sample binary").collect()
    return sorted((r["lang"], bytes(r["sample"])) for r in got if r["sample"])


def identify_language(docs: DataFrame, samples: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each input row: doc_id, lang_pred, score (0 to 1), and the input row as ``row`` if ``carry``.

    Null texts, texts without a letter and all texts if nothing was learned get ``und`` with score 0. Whole texts are
    parsed, however long. Ties go to the first language by name. Repeated rows get the same answer; other columns play
    no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(samples)
    more = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), *more)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parser_of(given.value)
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), 512):
                n, s = parser.predict(list(texts.iloc[at : at + 512]))
                names += n
                scores += s
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    # Called non-deterministic so that a filter on the prediction doesn't have every text parsed twice, by a second Python worker.
    once = predict.asNondeterministic()
    return rows.withColumn("p", once("t")).select("doc_id", "p.lang_pred", "p.score", *(["row"] if carry else []))


def op2_language_id(spark, sf_dir) -> DataFrame:
    """All ``documents``, learning from labelled ones whose crc32 modulo 4 is not 2; a null id counts as learned from. Odd rows as in identify_language."""
    docs = read(spark, sf_dir, "documents")
    samples = learn_samples(docs.where(crc_mod("doc_id", 4) != 2))
    found = identify_language(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
