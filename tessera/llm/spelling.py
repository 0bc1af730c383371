"""Spelling variants: words one edit apart, found by merging the light subtrees of tries, and the form that each leads to.

Two words one edit apart differ first at some position of the shorter one; all that lies before, and all that lies after,
is the same in both. So words are dealt to cells by length and by all their characters outside an interval of
positions, and a cell finds the pairs that differ first inside its interval: each pair is found in one cell. Intervals are
halves of a word at first; a cell with too many words is dealt anew with its interval halved, down to one position, where
a cell has no more words than there are pairs of letters.

A cell's words, sorted, are a trie whose inner nodes are the intervals of common prefixes. At each node the largest
subtree is the heavy path and stays; the words of all others are merged, with the character at the node skipped or
replaced, into an errata trie, and terminals that coincide with one another or with the words at hand are the pairs. A
word is merged as often as it is light, that is at most log2 of the cell's words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checked, read, released, small_batches, staged, text_of

# Fixed values of the contract: a run's letters (A-Z lower-cased before), and which occurrences lose a letter.
RUN = re.compile("[a-zÀ-ÿ]{7,}")
BETWEEN = re.compile("[^a-zÀ-ÿ]")
EVERY = 31
LEAST = 7

SLICE = 4 << 20  # characters of text whose runs are listed at a time
ENTRIES = 250_000  # counts that a task holds before it hands them on
CELL = ("short", "lo", "hi", "key")


def run_slices(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of LEAST letters or more, listed for bounded stretches that end between runs."""
    low = text.encode("utf-8", "replace").lower().decode("utf-8")  # of bytes: A-Z only
    at = 0
    while at < len(low):
        end = len(low)
        if end - at > SLICE and (m := BETWEEN.search(low, at + SLICE)):
            end = m.start()
        yield RUN.findall(low, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    n: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
            seed = zlib.crc32(f"{doc_id}:".encode())
            for runs in run_slices(text):
                for run, k in Counter(runs).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % EVERY:
                        n[run] += k
                    elif len(run) > LEAST:
                        n[run[: h % len(run)] + run[h % len(run) + 1 :]] += k
        if len(n) > ENTRIES:
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])
            n.clear()
    yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n) of the words with ``least`` occurrences or more; an occurrence is dealt its letter to lose by id and run."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by doubling and halving stretches."""
    most = min(len(a), len(b))
    at, step = 0, 8
    while at < most:
        end = min(at + step, most)
        if a[at:end] == b[at:end]:
            at, step = end, step * 2
        elif end - at == 1:
            return at
        else:
            most, step = end, max(1, (end - at) // 2)
    return at


def trie_nodes(words: list[str]) -> Iterator[tuple[int, list[int], int]]:
    """(depth, starts of the children, end) of every inner node of the trie of sorted distinct words; a word that ends at the node is the first child."""
    stack: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        depth, left = common_prefix(words[i - 1], words[i]) if i < len(words) else -1, i - 1
        while stack and stack[-1][0] > depth:
            d, starts = stack.pop()
            yield d, starts, i
            left = starts[0]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(i)
        elif depth >= 0:
            stack.append((depth, [left, i]))


def one_edit_pairs(words: list[str], short: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sorted distinct words of ``short`` and ``short`` + 1 characters, one of them at least of ``short``, that are one edit apart and differ first at a position from lo on and before hi (at hi too if that is the shorter one's end)."""
    index = {w: i for i, w in enumerate(words)}
    for depth, starts, end in trie_nodes(words):
        if not (lo <= depth < hi or depth == hi == short):
            continue
        ends = [*starts[1:], end]
        heavy = max(range(len(starts)), key=lambda k: (ends[k] - starts[k], k))
        before, way = words[starts[0]][:depth], words[starts[heavy]][depth]
        errata: dict[str, list[int]] = {}
        for k, (at, stop) in enumerate(zip(starts, ends, strict=True)):
            if k == heavy:
                continue
            for i in range(at, stop):
                w = words[i]
                rest = w[depth + 1 :]
                if len(w) > short:  # one character more: skipped
                    if (rest[:1] != w[depth]) and (j := index.get(before + rest)) is not None:
                        yield i, j
                    continue
                if (j := index.get(before + way + w[depth:])) is not None:  # the heavy path's character skipped
                    yield i, j
                if depth < len(w):  # replaced: against the heavy path, and against what was merged before
                    if (j := index.get(before + way + rest)) is not None:
                        yield i, j
                    met = errata.setdefault(rest, [])
                    yield from ((i, j) for j in met)
                    met.append(i)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and word -> for each word with near words in its cell: how many, and the first by n and code points."""
    released()
    held: list[tuple[str, int]] = []
    cell: tuple | None = None

    def closed() -> pa.RecordBatch:
        words, counts = [w for w, _ in held], [n for _, n in held]
        near: dict[int, list] = {}
        for i, j in one_edit_pairs(words, *cell[:3]):
            for a, b in ((i, j), (j, i)):
                if (x := near.get(a)) is None:
                    near[a] = [1, b]
                else:
                    x[0] += 1
                    if (-counts[b], words[b]) < (-counts[x[1]], words[x[1]]):
                        x[1] = b
        return pa.RecordBatch.from_arrays(
            [pa.array([words[a] for a in near], pa.string()), pa.array([x[0] for x in near.values()], pa.int64()), pa.array([counts[x[1]] for x in near.values()], pa.int64()), pa.array([words[x[1]] for x in near.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    for batch in batches:
        for *c, word, n in zip(*(batch.column(x).to_pylist() for x in (*CELL, "word", "n")), strict=True):
            if c != cell:
                if len(held) > 1:
                    yield closed()
                held, cell = [], c
            held.append((word, n))
    if len(held) > 1:
        yield closed()


def _cells(words: DataFrame) -> DataFrame:
    """Each word in the two halves of its own length and, as the longer of a pair, of the length below."""
    halves = F.filter(F.expr("flatten(transform(array(length(word), length(word) - 1), s -> array(struct(s AS short, 0 AS lo, s DIV 2 AS hi), struct(s AS short, s DIV 2 AS lo, s AS hi))))"), lambda x: x["short"] >= LEAST)
    return _keyed(words.select("word", "n", F.inline(halves)))


def _keyed(rows: DataFrame) -> DataFrame:
    key = F.concat(F.expr("left(word, int(lo))"), F.lit("\0"), F.expr("right(word, int(short - hi))"))
    return rows.select(*(F.col(c).cast("int").alias(c) for c in CELL[:3]), key.alias("key"), "word", "n")


def near_words(words: DataFrame, most_words: int = 1000) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct) that have near ones; ``most_words`` bounds a cell and changes no result."""
    cells, parts = staged(_cells(words)), []
    while True:
        sized = cells.where("hi - lo > 1").groupBy(*CELL).agg(F.count(F.lit(1)).alias("words"))
        large = staged(sized.where(F.col("words") > most_words).select(*CELL))
        if not large.limit(1).count():
            parts.append(cells)
            break
        parts.append(cells.join(checked(large), list(CELL), "left_anti"))
        again = cells.join(checked(large), list(CELL), "left_semi")
        parts_of = F.expr("array(struct(short, lo, (lo + hi) DIV 2 AS hi), struct(short, (lo + hi) DIV 2 AS lo, hi))")
        cells = staged(_keyed(again.select("word", "n", F.inline(parts_of))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = rows.repartition(*CELL).sortWithinPartitions(*CELL, "word").mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10, most_words: int = 1000) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Runs of letters are lower-cased in A-Z; a run whose crc32 with the row's id is divisible by 31 loses one letter. Words are
    the distinct results of at least 7 characters and 2 occurrences. Words are near if they are one inserted, deleted or
    replaced character apart. A word's form is its near word with most occurrences (ties: the smallest by code points) if
    that has ``ratio`` times its own or more; root is where forms lead in the end, the word itself if it has none.

    Null texts have no words; a null id counts as empty text before the colon; rows that repeat an id or a text count each.
    Whole texts are read, however long, a stretch at a time; a run is held whole. An empty table gives an empty result.
    Other columns are not looked at.
    """
    words = staged(word_counts(docs, id_col, text_col))
    near = near_words(words, most_words).withColumnRenamed("word", "near_to")
    told = words.join(near, F.col("word") == F.col("near_to"), "left")
    has = F.col("best_n") >= ratio * F.col("n")
    told = staged(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    # Each step up has ratio times the occurrences, so that a few doublings of the steps reach the end.
    up = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("step"), F.col("root").alias("higher"))
        up = staged(up.join(above, F.col("root") == F.col("step"), "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.drop("moved")
    roots = up.select(F.col("word").alias("rooted"), "root")
    return told.join(roots, F.col("word") == F.col("rooted"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir) -> DataFrame:
    """All words of ``documents``; nulls, ties and repeated rows as in spelling_variants."""
    return spelling_variants(read(spark, sf_dir, "documents"))
