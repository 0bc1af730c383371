"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens go into a trie. A node holds the best score, and the pieces of that segmentation, of the prefix that
it stands for; as both depend on the prefix alone, every prefix that pre-tokens share is scored once. The node at which
a pre-token ends has its count. Tries live in the Python worker and start anew beyond ``MAX_NODES``, words of over
``LONG_WORD`` characters, which share nothing worth keeping, are scored with the last few nodes alone, and long texts are
taken in runs of words, so memory is bounded; counts are added up per document where the document is, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import MARK, MODEL, UNIGRAM, Codec, model_bytes, slices
from .shared import held, read, small_batches, text_of

MAX_NODES = 600_000
MAX_WORDS = 600_000
LONG_WORD = 1000  # characters
RUN = 1_000_000  # characters of a text whose words are held at a time
SPACES = re.compile(r"[\x20\x09-\x0D]")


def unigram_scores(codec: Codec) -> dict[str, float]:
    """Piece -> log-probability: the model's own for a unigram model; for others, which have an order only, Zipf's law over the order of scores."""
    if codec.kind == UNIGRAM:
        return {p: codec.score[i] for p, i in codec.pieces.items()}
    order = sorted(codec.pieces, key=lambda p: (-codec.score[codec.pieces[p]], codec.pieces[p]))
    total = math.log(sum(1 / (k + 2) for k in range(len(order))))
    return {p: -math.log(k + 2) - total for k, p in enumerate(order)}


class Counted(dict):
    """Tokens of words; a word that is not kept is counted when asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        return self.count(MARK + word.decode("utf-8", "replace"))


class Trie:
    """Forward scores of prefixes under a unigram model; a character without a piece costs its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.loose = min(scores.values(), default=0.0) - 10.0
        self.words = Counted(self._rolled)
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def _scored(self, word: str, j: int, before) -> tuple[float, int]:
        """Best score of the first j characters and its pieces; of equal scores, the fewest pieces. ``before(i)`` gives both of the first i."""
        top, n = -math.inf, 0
        for size in range(1, min(j, self.longest) + 1):
            s, more = self.scores.get(word[j - size : j]), 1
            if s is None:
                if size > 1:
                    continue
                more = len(word[j - 1].encode("utf-8", "replace"))
                s = self.loose * more
            v, k = before(j - size)
            if v + s > top or v + s == top and k + more < n:
                top, n = v + s, k + more
        return top, n

    def _insert(self, word: str) -> int:
        """Pieces of the best segmentation."""
        node, path, child, best, count = 0, [0], self.child, self.best, self.count
        before = lambda i: (best[path[i]], count[path[i]])
        for j, c in enumerate(word, 1):
            nxt = child.get((node, c))
            if nxt is None:
                nxt = len(best)
                child[node, c] = nxt
                top, n = self._scored(word, j, before)
                best.append(top)
                count.append(n)
            node = nxt
            path.append(node)
        return count[node]

    def _rolled(self, word: str) -> int:
        """As _insert, with the last few prefixes in place of nodes."""
        width = self.longest + 1
        held = [(0.0, 0)] * width
        before = lambda i: held[i % width]
        for j in range(1, len(word) + 1):
            held[j % width] = self._scored(word, j, before)
        return held[len(word) % width][1]

    def counts(self, words: set[bytes]) -> None:
        """Adds what is missing of the words, in order, so that neighbours share prefixes."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
            new = list(words)
        for w in sorted(new):
            if len(self.best) > MAX_NODES:
                self._clear()
            self.words[w] = self._insert(MARK + w.decode("utf-8", "replace"))

    def of_text(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text, a run of words at a time."""
        at, n_words, n_tokens = 0, 0, 0
        while at < len(text):
            cut = found.start() if len(text) - at > RUN and (found := SPACES.search(text, at + RUN)) else len(text)
            words = text[at:cut].encode("utf-8", "replace").split()
            n, t = self.of_words([words])[0]
            n_words, n_tokens, at = n_words + n, n_tokens + t, cut
        return n_words, n_tokens

    def of_words(self, lists: list[list[bytes]]) -> list[tuple[int, int]]:
        """Words and tokens of each list."""
        self.counts({w for x in lists for w in x if len(w) <= LONG_WORD})
        return [(len(x), sum(map(self.words.__getitem__, x))) for x in lists]


def trie_of(model: bytes) -> Trie:
    """Made once in each Python worker."""
    return held(f"trie {hashlib.sha256(model).hexdigest()}", lambda: Trie(unigram_scores(Codec(model))))


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_tokens.

    Pre-tokens are the words of the whole text, however long it or they are, each with a word mark before it. Null and
    empty texts count 0. Ties between segmentations go to the fewest pieces. Repeated rows are counted each; other columns
    are not looked at. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(given.value)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts):
                part = texts[at:end]
                found = trie.of_words([t.encode("utf-8", "replace").split() for t in part]) if len(part) > 1 else [trie.of_text(part[0])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark, sf_dir) -> DataFrame:
    """Words and tokens of all whole texts of ``documents``; odd rows as in count_tokens."""
    return count_tokens(read(spark, sf_dir, "documents"), model_bytes(spark, MODEL))
