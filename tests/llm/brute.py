"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, width):
    w = lower_words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(rows, width, percent):
    """doc_id -> (set size, component) for (doc_id, text) rows with distinct ids."""
    sets = [shingles(t, width) for _, t in rows]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    common = Counter((a, b) for v in inverted.values() for k, b in enumerate(v) for a in v[:k])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def phrases(text, sample, block):
    """Greedy longest matches of text in sample, restarted at every block; a character that the sample lacks is a phrase."""
    n = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            size = 1
            while i + size < len(part) and part[i : i + size + 1] in sample:
                size += 1
            i += size
            n += 1
    return n


def highest_quotients(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats):
        i = max(range(len(shares)), key=lambda k: (shares[k] / (2 * got[k] + 1), -k))
        got[i] += 1
    return got
