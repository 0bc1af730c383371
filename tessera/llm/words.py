"""Hashes of words and word shingles of many texts at once, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
RUN = 1 << 20  # bytes that are hashed at a time
TABLED = 4096  # positions of a word with a factor from a table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _drawn(at: np.ndarray) -> np.ndarray:
    """An odd factor for each position in a word. Factors of different positions have nothing to do with each other, so periodic words get no equal sums."""
    return mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


_FACTORS = _drawn(np.arange(TABLED))


def _factors(at: np.ndarray) -> np.ndarray:
    out = _FACTORS[np.minimum(at, TABLED - 1)]
    if len(far := np.flatnonzero(at >= TABLED)):
        out[far] = _drawn(at[far])
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts with A-Z in lower case, and the number of words of each text.

    A hash is a sum over the word's bytes, so bytes are taken in runs of bounded size whatever the length of a word.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    ends_of_texts = np.cumsum(np.array([len(x) + 1 for x in raw], dtype=np.int64))
    whole = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    del raw
    found, begun = [], []
    total, length = np.zeros(1, dtype=np.uint64), 0  # of the word that runs into the next run
    for base in range(0, len(whole), RUN):
        data = whole[base : base + RUN]
        space = _IS_SPACE[data]
        begins, stops = ~space, space.copy()
        begins[1:] &= space[:-1]
        stops[1:] &= ~space[:-1]
        begins[0] &= not length
        stops[0] &= bool(length)
        starts, stops = np.flatnonzero(begins), np.flatnonzero(stops)
        begun.append(starts + base)
        opened = np.r_[0, starts] if length else starts
        if not len(opened):
            continue
        at = np.arange(len(data), dtype=np.int64)
        if opened[0]:
            at[: opened[0]] = 0
        at[opened[0] :] -= np.repeat(opened, np.diff(np.r_[opened, len(data)]))
        if length:
            at[: opened[1] if len(opened) > 1 else len(data)] += length
        value = _OF_BYTE[_LOWER[data]]
        value *= _factors(at)
        value[space] = 0
        sums = np.add.reduceat(value, opened)
        sizes = np.r_[stops, len(data)][: len(opened)] - opened
        if length:
            sums[:1] += total
            sizes[0] += length
        done = len(stops)
        found.append(mix(sums[:done] + sizes[:done].astype(np.uint64)))
        total, length = (sums[done : done + 1].copy(), int(sizes[done])) if len(opened) > done else (np.zeros(1, dtype=np.uint64), 0)
    starts = np.concatenate(begun) if begun else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0) if len(texts) else np.zeros(0, dtype=np.int64)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), counts


def shingle_sets(texts: list[str], width: int = 3) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a shorter text's whole sequence is one; no words: none."""
    words, counts = word_hashes(texts)
    n = len(words)
    run = words.copy()
    for k in range(1, min(width, n)):
        run[: n - k] = mix(run[: n - k] * np.uint64(3)) + words[k:]
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(mix(run[at : at + c - width + 1])))
        elif c:
            short = words[at : at + 1] * np.uint64(c + 16)
            for k in range(1, c):
                short = mix(short) + words[at + k]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out
