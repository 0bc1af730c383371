"""SentencePiece encoding and decoding by suffix-array matching.

The chunks of a batch that have not been met before are laid end to end and indexed by a suffix array. Every piece of
the vocabulary is binary-searched for its range of occurrences; the occurrences become edges, sorted by position. The
edges are then relaxed: for a unigram model along positions, for the best sum of scores; for a BPE model in the order
of piece scores, which is what defines that model's ids (the best path is another segmentation there, so it can't be
used). A chunk is a run of word marks with what follows up to the next mark or line end: no piece of the vocabulary
reaches over such a border, which is checked when a model is loaded.

Memory does not grow with the length of a text by more than its own size: long texts are taken in runs of chunks, and a
chunk longer than what is indexed at a time is indexed in overlapping stretches. It is cut where no piece reaches over;
a stretch without such a place is merged by itself, with arrays instead of objects.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held, read, slices, small_batches, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2  # of the model format: fixed values
MEMO = 500_000  # chunks whose ids a Python worker remembers
INDEXED = 500_000  # characters that are indexed at a time
RUN = 300_000  # characters of a text whose chunks are looked up at a time
LONG = 40  # characters of a chunk from which on it is merged by itself
NONE = np.iinfo(np.int32).max
UNICODE = range(0x110000)


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file's content; a path with a scheme is read by Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, model: bytes, memo: int = MEMO):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = dict(_fields(model))  # the last of a repeated field; the settings occur once
        trainer, normal = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.normalise = None if not normal.get(2) and not self.squeeze else sp.normalize
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.longest = max(map(len, self.pieces))
        if self.kind not in (UNIGRAM, BPE) or any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p or "\0" in p for p in self.pieces):
            raise ValueError("pieces over word borders, or a model that is neither unigram nor BPE")
        self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.sorted = sorted(self.pieces)
        width = self.longest
        self.codes = np.zeros((len(self.sorted), width), dtype=np.uint32)
        for i, p in enumerate(self.sorted):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        self.lengths = np.array([len(p) for p in self.sorted])
        self.ids = np.array([self.pieces[p] for p in self.sorted])
        self.bytes_of = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        order = sorted(self.pieces.values(), key=lambda i: -self.score[i])
        self.rank = np.full(n + 1, NONE, dtype=np.int32)  # by score, the best first; the last is for "no piece"
        self.rank[order] = np.arange(len(order))
        self.floor = min((self.score[i] for i in self.pieces.values()), default=0.0) - 10.0  # of a character without a piece: fixed by the format
        self.known: dict[str, bytes] = {}  # ids by key
        self.once: set[str] = set()
        self.memo, self.indexed = memo, min(INDEXED, memo)
        self.line_end = b""

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.normalise:
            return self.normalise(text)
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix else text

    def edges(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks in their concatenation; for every position and length the id of the piece that occurs there, or -1.

        The table holds the edges sorted by position: each row is a position's.
        """
        text = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum([0] + [len(c) + 1 for c in chunks[:-1]])
        array, low, high = self._packed(text) or self._general(text)
        count = high - low
        which = np.repeat(np.arange(len(self.sorted), dtype=np.int32), count)
        at = array.astype(np.int32)[np.arange(len(which), dtype=np.int32) - np.repeat((np.cumsum(count) - count - low).astype(np.int32), count)]
        table = np.full((len(text), self.longest + 1), -1, dtype=np.int32)
        table[at, self.lengths[which]] = self.ids[which]
        return starts, table

    def _packed(self, text: np.ndarray):
        """Suffix array and piece ranges where characters fit a byte and pieces 16 characters: suffixes are ranked by 8 and then by 16."""
        codes = np.flatnonzero(np.bincount(text))
        if len(codes) > 254 or self.longest > 16:
            return None
        n = len(text)
        to = np.zeros(len(UNICODE), dtype=np.uint64)
        to[codes] = np.arange(1, len(codes) + 1)  # the separator is the least and gets 1; 0 pads
        own = np.concatenate([to[text], np.zeros(16, dtype=np.uint64)])

        def pack(columns) -> np.ndarray:
            out = np.zeros(len(columns[0]), dtype=np.uint64)
            for c in columns:
                out = (out << np.uint64(8)) | c
            return out

        key = pack([own[k : n + k] for k in range(8)])
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        values = ranked[new]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)  # from 1; 0 is past the end
        both = rank * (n + 2) + np.concatenate([rank[8:], np.zeros(min(8, n), dtype=np.int64)])[:n]
        array = np.argsort(both)
        both = both[array]
        piece = np.where(self.codes < len(UNICODE), to[np.minimum(self.codes, len(UNICODE) - 1)], np.uint64(0))
        inside = np.arange(self.longest) < self.lengths[:, None]
        known = ((piece > 0) | ~inside).all(axis=1)
        piece = np.pad(np.where(inside, piece, np.uint64(0)), ((0, 0), (0, 16 - self.longest)))
        top = np.pad(np.where(inside, piece[:, : self.longest], np.uint64(255)), ((0, 0), (0, 16 - self.longest)), constant_values=255)
        first = np.searchsorted(values, pack(list(piece[:, :8].T))) + 1
        last = np.searchsorted(values, pack(list(top[:, :8].T)), "right") + 1  # exclusive
        long = self.lengths > 8
        low = np.where(long, first * (n + 2) + np.searchsorted(values, pack(list(piece[:, 8:].T))) + 1, first * (n + 2))
        high = np.where(long & (last > first), first * (n + 2) + np.searchsorted(values, pack(list(top[:, 8:].T)), "right") + 1, np.where(long, low, last * (n + 2)))
        low, high = np.searchsorted(both, low), np.searchsorted(both, high)
        return array, low, np.where(known, np.maximum(high, low), low)

    def _general(self, text: np.ndarray):
        """The same for any text and vocabulary, by doubling and a binary search that compares character by character."""
        n, step = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while step < self.longest:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            step *= 2
        array = np.argsort(rank, kind="stable")
        padded = np.concatenate([text, np.zeros(self.longest, dtype=np.uint32)])
        return array, self._bound(padded, array, False), self._bound(padded, array, True)

    def _bound(self, text: np.ndarray, array: np.ndarray, upper: bool) -> np.ndarray:
        """For every piece the first suffix that is not before it (``upper``: that neither is nor starts with it)."""
        lo, hi = np.zeros(len(self.sorted), dtype=np.int64), np.full(len(self.sorted), len(array), dtype=np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            at, want, sizes = array[mid], self.codes[open_], self.lengths[open_]
            before, equal = np.zeros(len(open_), dtype=bool), np.arange(len(open_))
            for k in range(self.longest):
                live = equal[sizes[equal] > k]
                if not live.size:
                    break
                have, need = text[at[live] + k], want[live, k]
                before[live[have < need]] = True
                differ = live[have != need]
                equal = live[have == need] if not differ.size else np.setdiff1d(live, differ, assume_unique=True)
                done = sizes[equal] == k + 1
                if upper:
                    before[equal[done]] = True
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        return lo

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, in runs of bounded size; an empty chunk has none."""
        out = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        most = self.indexed if self.longest < 63 else int(sizes.max(initial=0))  # a bit for each length of a piece
        for i in np.flatnonzero(sizes > most).tolist():
            out[i] = self._learn_long(chunks[i])
        which = np.flatnonzero((sizes > 0) & (sizes <= most))
        runs = np.cumsum(sizes[which]) // self.indexed
        for run in np.split(which, np.flatnonzero(np.diff(runs)) + 1) if len(which) else []:
            own = run[np.argsort(sizes[run] > LONG, kind="stable")].tolist()  # those merged together come first
            for i, ids in zip(own, self._learn_run([chunks[i] for i in own], int((sizes[run] <= LONG).sum())), strict=True):
                out[i] = ids
        return out

    def _learn_run(self, chunks: list[str], short: int) -> list[bytes]:
        """Ids of chunks that are indexed together, the first ``short`` of which are no longer than LONG."""
        starts, table = self.edges(chunks)
        if self.kind == BPE:
            done, relax = self._merge_all(chunks[:short], starts[:short], table) if short else [], self._merge
        else:
            done, relax = [], self._best
        left = zip(chunks[len(done) :], starts[len(done) :].tolist(), strict=True)
        return done + [np.array(relax(c, table[a : a + len(c)]), dtype=np.int32).tobytes() for c, a in left]

    def _learn_long(self, chunk: str) -> bytes:
        """Ids of a chunk longer than what is indexed at a time, cut where no edge reaches over: nothing on one side of such a place bears on the other."""
        lengths, reach, cuts = np.zeros(len(chunk), dtype=np.uint64), 0, array("q", [0])
        step = self.indexed - self.longest
        weights = np.uint64(1) << (np.uint64(8) * np.arange(-(-(self.longest + 1) // 8), dtype=np.uint64))
        for at in range(0, len(chunk), step):
            part = chunk[at : at + self.indexed]
            own = min(step, len(part))
            found = self.edges([part])[1][:own] >= 0
            lengths[at : at + own] = np.packbits(found, axis=1, bitorder="little").astype(np.uint64) @ weights
            ends = np.arange(at, at + own) + np.maximum(found.shape[1] - 1 - found[:, ::-1].argmax(axis=1), 1) * found.any(axis=1)
            ends = np.maximum(np.maximum.accumulate(ends), reach)
            border = np.r_[reach, ends[:-1]] <= np.arange(at, at + own)
            for p in (np.flatnonzero(border) + at).tolist():
                if p - cuts[-1] >= LONG // 2:
                    cuts.append(p)
            reach = int(ends[-1])
        cuts.append(len(chunk))
        out, held, size = bytearray(), [], 0
        for a, b in zip(cuts, cuts[1:]):
            if size + b - a > self.indexed:
                out += b"".join(self._learn(held))
                held, size = [], 0
            if b - a > self.indexed:
                out += (self._merge_long(chunk[a:b], lengths[a:b]) if self.kind == BPE else self._best_long(chunk[a:b], lengths[a:b]))
            else:
                held.append(chunk[a:b])
                size += b - a
        return bytes(out + b"".join(self._learn(held)))

    def _merge_all(self, chunks: list[str], starts: np.ndarray, table: np.ndarray) -> list[bytes]:
        """Merges in all chunks in step: in each round every chunk merges its best pair, the leftmost of equals."""
        sizes = np.array([len(c) for c in chunks])
        width, flat = self.longest + 1, table.ravel()
        begin = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(chunks)), sizes)
        stop = starts + sizes
        done_begin, done_owner = [], []

        def ranks(i: np.ndarray) -> np.ndarray:
            """Of the pair of symbol i and the next one; NONE if there is no such piece."""
            j = np.minimum(i + 1, len(begin) - 1)
            k = np.minimum(i + 2, len(begin) - 1)
            end = np.where((i + 2 < len(begin)) & (owner[k] == owner[i]), begin[k], stop[owner[i]])
            size = end - begin[i]
            ok = (i + 1 < len(begin)) & (owner[j] == owner[i]) & (size <= self.longest)
            return self.rank[np.where(ok, flat[begin[i] * width + np.where(ok, size, 0)], -1)]

        rank = ranks(np.arange(len(begin)))
        while len(begin):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.r_[heads, len(owner)])
            live = best < NONE
            if not live.all():
                keep = np.repeat(live, lengths)
                done_begin.append(begin[~keep])
                done_owner.append(owner[~keep])
                begin, owner, rank = begin[keep], owner[keep], rank[keep]
                best, lengths = best[live], lengths[live]
                if not len(begin):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            gone = np.ones(len(begin), dtype=bool)
            gone[hit + 1] = False
            begin, owner, rank = begin[gone], owner[gone], rank[gone]
            at = hit - np.arange(len(hit))  # each earlier merge took one symbol away
            rank[at] = ranks(at)
            before = at[(at > 0)] - 1
            rank[before] = ranks(before)
        begin, owner = np.concatenate(done_begin), np.concatenate(done_owner)
        order = np.argsort(begin)
        begin, owner = begin[order], owner[order]
        end = np.where(np.r_[owner[1:] == owner[:-1], False], np.r_[begin[1:], 0], stop[owner])
        ids = table[begin, end - begin]
        cuts = np.searchsorted(owner, np.arange(len(chunks) + 1))
        loose = set(owner[ids < 0].tolist())
        raw, cuts = ids.astype(np.int32).tobytes(), (cuts * 4).tolist()
        result = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in loose:
            own = slice(cuts[i] // 4, cuts[i + 1] // 4)
            out = [x for b, k in zip(begin[own].tolist(), ids[own].tolist(), strict=True) for x in ([k] if k >= 0 else self._loose(chunks[i][b - int(starts[i])]))]
            result[i] = np.array(self._joined(out), dtype=np.int32).tobytes()
        return result

    def _loose(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unk]

    def _merge(self, chunk: str, table: np.ndarray) -> list[int]:
        """Neighbours merge into the edge with the best score, the leftmost of equals, as long as there is one."""
        at, size = np.nonzero(table >= 0)
        edge = {(a, a + s): i for a, s, i in zip(at.tolist(), size.tolist(), table[at, size].tolist(), strict=True)}
        n = len(chunk)
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        score, agenda = self.score, []
        for a in range(n - 1):
            if (i := edge.get((a, a + 2))) is not None:
                agenda.append((-score[i], a, a + 1, a + 2))
        heapq.heapify(agenda)
        alive = [True] * n
        while agenda:
            _, a, m, b = heapq.heappop(agenda)
            if not alive[a] or end[a] != m or m >= n or not alive[m] or end[m] != b:
                continue
            end[a], alive[m] = b, False
            if b < n:
                prev[b] = a
                if (i := edge.get((a, end[b]))) is not None:
                    heapq.heappush(agenda, (-score[i], a, b, end[b]))
            if (p := prev[a]) >= 0 and (i := edge.get((p, b))) is not None:
                heapq.heappush(agenda, (-score[i], p, a, b))
        out, a = [], 0
        while a < n:
            i = edge.get((a, end[a]))
            out += self._loose(chunk[a]) if i is None else [i]
            a = end[a]
        return self._joined(out)

    def _merge_long(self, chunk: str, lengths: np.ndarray) -> bytes:
        """As _merge, for a chunk of any length; ``lengths`` has a bit for the length of each edge that begins at a position.

        Pairs wait by rank in arrays of positions. Ranks are taken in order, positions of a rank from the left; what a
        merge makes possible goes first if its rank is not behind.
        """
        n = len(chunk)
        end, prev, alive = array("i", range(1, n + 1)), array("i", range(-1, n - 1)), bytearray(b"\1") * n
        bits = memoryview(lengths)
        rank_of = {p: int(self.rank[i]) for p, i in self.pieces.items()}
        waiting: dict[int, array] = {}

        def rank(a: int) -> int:
            m = end[a]
            if m >= n:
                return NONE
            b = end[m]
            return rank_of[chunk[a:b]] if b - a <= self.longest and bits[a] >> (b - a) & 1 else NONE

        for a in range(n - 1):
            if (r := rank(a)) < NONE:
                waiting.setdefault(r, array("i")).append(a)
        ranks = list(waiting)
        heapq.heapify(ranks)
        now: list[tuple[int, int]] = []  # pairs made of late that are not behind the current rank

        def merge(a: int, current: int) -> None:
            m = end[a]
            end[a], alive[m] = end[m], 0
            if end[a] < n:
                prev[end[a]] = a
            for p in (a, prev[a]):
                if p >= 0 and (r := rank(p)) < NONE:
                    if r <= current:
                        heapq.heappush(now, (r, p))
                    else:
                        if r not in waiting:
                            waiting[r] = array("i")
                            heapq.heappush(ranks, r)
                        waiting[r].append(p)

        while ranks:
            current = heapq.heappop(ranks)
            for a in np.sort(np.frombuffer(waiting.pop(current), dtype=np.int32)):
                a = int(a)
                while now and now[0] < (current, a):
                    r, p = heapq.heappop(now)
                    if alive[p] and rank(p) == r:
                        merge(p, current)
                if alive[a] and rank(a) == current:
                    merge(a, current)
            while now:
                r, p = heapq.heappop(now)
                if alive[p] and rank(p) == r:
                    merge(p, current)
        out, a = array("i"), 0
        while a < n:
            i = self.pieces.get(chunk[a : end[a]]) if bits[a] >> (end[a] - a) & 1 else None
            out.extend(self._loose(chunk[a]) if i is None else [i])
            a = end[a]
        return out.tobytes()

    def _best_long(self, chunk: str, lengths: np.ndarray) -> bytes:
        """As _best, for a chunk of any length: only the scores of the last few positions and one length for each are held."""
        n, width = len(chunk), self.longest + 1
        bits, back = memoryview(lengths), array("i", bytes(4 * (n + 1)))
        best = [float("-inf")] * width
        best[0] = 0.0
        for a in range(n):
            here, known = best[a % width], bits[a]
            best[a % width] = float("-inf")
            for size in range(1, min(width, n - a + 1)):
                if known >> size & 1:
                    v = here + self.score[self.pieces[chunk[a : a + size]]]
                elif size == 1:
                    v = here + self.floor
                else:
                    continue
                if v > best[(a + size) % width]:
                    best[(a + size) % width], back[a + size] = v, size
        cuts, b = array("i"), n
        while b:
            cuts.append(b)
            b -= back[b]
        out, a = array("i"), 0
        for b in reversed(cuts):
            out.extend([self.pieces[chunk[a:b]]] if bits[a] >> (b - a) & 1 else self._loose(chunk[a]))
            a = b
        return out.tobytes()

    def _best(self, chunk: str, table: np.ndarray) -> list[int]:
        """The path of edges with the highest sum of scores; of equals the one found first, edges by position and length."""
        n = len(chunk)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        by = [[] for _ in range(n)]
        at, size = np.nonzero(table >= 0)
        for a, s, i in zip(at.tolist(), size.tolist(), table[at, size].tolist(), strict=True):
            by[a].append((s, i))
        for a in range(n):
            if all(s > 1 for s, _ in by[a]):
                by[a].append((1, -1))
            for s, i in sorted(by[a]):
                if (v := best[a] + (self.score[i] if i >= 0 else self.floor)) > best[a + s]:
                    best[a + s], back[a + s] = v, (a, i)
        out, b = [], n
        while b:
            a, i = back[b]
            out.append(self._loose(chunk[a]) if i < 0 else [i])
            b = a
        return self._joined([i for x in reversed(out) for i in x])

    def _joined(self, ids: list[int]) -> list[int]:
        """Neighbouring unknown ids are one."""
        return ids if self.byte else [x for k, x in enumerate(ids) if x != self.unk or k == 0 or ids[k - 1] != self.unk]

    def _keys(self, text: str) -> Iterator[list[str]]:
        """What a text's ids are looked up by, in runs of bounded size: its chunks, or where no normaliser and no run of blanks is involved, its words.

        A word stands for the word with a mark before it; one that begins with NUL for a line end and what follows it.
        """
        if self.normalise or not self.prefix or not text or text[0] == " " or "  " in text or MARK in text or "\0" in text:
            text, at = self.normalised(text), 0
            while at < len(text):
                cut = at + RUN
                while cut < len(text) and not (text[cut] == MARK != text[cut - 1]):  # a chunk begins there
                    cut = found if (found := text.find(MARK, cut + 1)) >= 0 else len(text)
                yield [MARK + c for c in self.chunks(text[at:cut])]
                at = cut
            return
        at = 0
        while len(text) - at > RUN and 0 <= (cut := text.find(" ", at + RUN)) < len(text) - 1:
            yield text[at:cut].replace("\n", " \0").split(" ")
            at = cut + 1
        yield (text[at:] if at else text).replace("\n", " \0").split(" ")

    def _all_keys(self, text: str) -> list[str]:
        runs = list(self._keys(text))
        return runs[0] if len(runs) == 1 else list(chain.from_iterable(runs))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32. Texts of up to RUN characters are looked up together, longer ones run by run."""
        short = [i for i, t in enumerate(texts) if len(t) <= RUN]
        out = [b""] * len(texts)
        for at, end in slices([texts[i] for i in short], 5 * self.memo):
            which = short[at:end]
            for i, ids in zip(which, self._looked_up([self._all_keys(texts[i]) for i in which]), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > RUN:
                out[i] = b"".join(self._looked_up([keys])[0] for keys in self._keys(t))
        if not self.byte:  # unknown ids next to each other over a border
            out = [np.array(self._joined(np.frombuffer(x, dtype=np.int32).tolist()), dtype=np.int32).tobytes() for x in out]
        return out

    def _looked_up(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of lists of keys, one after the other. What is longer than RUN is not remembered."""
        needed = set().union(*cut)
        new = list(needed.difference(self.known))
        self.once.difference_update(needed)
        if len(self.known) + len(new) > self.memo:  # what has been met in one call only goes first
            for k in self.once:
                del self.known[k]
            self.once.clear()
        if len(self.known) + len(new) > self.memo:
            self.known, new = {}, list(needed)
        self.once.update(new)
        if not self.line_end:
            self.line_end = self._learn(["\n"])[0]
        ids = self._learn([k[1:] if k[:1] in ("\0", MARK) and k else MARK + k for k in new])
        self.known.update(zip(new, ids, strict=True))
        self.known.update((k, self.line_end + i) for k, i in zip(new, ids, strict=True) if k[:1] == "\0")
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in cut]
        for k in new:
            if len(k) > RUN:
                del self.known[k]
                self.once.discard(k)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, as the format defines it: word marks are spaces and the first of them goes if the model added it."""
        ids, get = np.frombuffer(ids, dtype=np.int32), self.bytes_of.__getitem__
        text = b"".join(b"".join(map(get, ids[at : at + RUN].tolist())) for at in range(0, len(ids), RUN)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def codec_of(model: bytes, memo: int = MEMO) -> Codec:
    """Loaded once in each Python worker."""
    return held(f"codec {hashlib.sha256(model).hexdigest()} {memo}", lambda: Codec(model, memo))


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text back).

    Null text counts as empty and has no ids. Whole texts are encoded, however long. Decoding loses what the model's
    normaliser loses: with the identity normaliser only a literal word mark, which comes back as a space. Repeated rows
    are encoded each; other columns are not looked at. An empty table gives no rows. ``memo`` bounds the chunks that a Python worker remembers and
    the characters that it indexes at a time: it trades memory for time and changes no id.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(given.value, memo)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for at, end in slices(texts):
                ids = codec.encode(texts[at:end])
                same = [codec.decode(x) == t for x, t in zip(ids, texts[at:end], strict=True)]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(sizes), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for rows of ids, each whole row however long; null and empty ids give an empty text.

    Ids outside the model are an error. Repeated rows are decoded each; other columns go. An empty table gives no rows.
    """
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(given.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int32).tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir) -> DataFrame:
    """Ids of all whole texts of ``documents``; odd rows as in encode_texts."""
    return encode_texts(read(spark, sf_dir, "documents"), model_bytes(spark))
