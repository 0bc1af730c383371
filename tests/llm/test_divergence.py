"""Source divergence against plain Python, with cells small enough for many blocks, tiles and both kinds of terms."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top):
    """rows (lang, source, text) -> the result's rows, sorted."""
    counts, docs, out = {}, {}, []
    for lang, source, text in rows:
        words = TERM.findall(lower(text))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        docs.setdefault(lang or "", Counter()).update(set(words))
    for lang, groups in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept]

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(o, sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True))) for o in p if o != s]
            terms = [(t, x - y) for t, x, y in zip(kept, p[s], q, strict=True) if c[t] and x > y]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def made(seed, n=400):
    rng, words = random.Random(seed), ["the", "OF", "Ünï", "été", "naïve", "日本", "x", "İI"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = []
    for _ in range(n):
        source = f"s{min(int(rng.expovariate(0.3)), 12)}"
        mine = [w for k, w in enumerate(words) if k < 8 or (k * 7 + int(source[1:])) % 5 < 2]
        rows.append((rng.choice(["en", "fr"]), source, " ".join(rng.choice(mine) + rng.choice(["", ".", "7", "_"]) for _ in range(rng.randrange(30)))))
    return rows + [(None, None, "the the"), ("en", None, None), (None, "s1", ""), ("xx", "only", "word " * 9), ("en", "s1", rows[0][2]), ("en", "s1", rows[0][2])]


@pytest.mark.parametrize("more", [{}, {"block": 3, "tile_terms": 7, "postings": 20}, {"heavy_share": 1.0, "block": 5}, {"heavy_share": 0.0, "tile_terms": 30}])
def test_against_brute_force(spark, more):
    rows = made(3)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.source_divergence(docs, least_docs=5, top_terms=9, **more).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 9)


def test_long_texts_and_bounded_counts(spark, monkeypatch):
    rows = [("en", f"s{k % 3}", f"alpha Beta{'z' * (k % 4)} " * 50 + "q" * 500 + " end") for k in range(40)]
    want = brute(rows, 2, 50)
    docs = spark.createDataFrame([(*r, k, k, k) for k, r in enumerate(rows)], "lang string, source string, text string, n long, term long, docs long").coalesce(1)
    monkeypatch.setattr(divergence, "SLICE", 64)
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    assert [sorted(x) for x in divergence.term_slices(b"ab cd" * 30)] and sum((x for x in divergence.term_slices(b"ab cd " * 90)), []) == [b"ab", b"cd"] * 90
    assert sorted(map(tuple, divergence.source_divergence(docs, least_docs=2).collect())) == want


def test_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert divergence.source_divergence(spark.createDataFrame([], schema)).collect() == []
    got = divergence.source_divergence(spark.createDataFrame([(None, "a", None), (None, "b", "x")], schema)).collect()
    assert sorted(map(tuple, got)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_counts_beyond_long_products(spark):
    """SCALE times a count that no 64-bit product holds."""
    row = spark.createDataFrame([(4 * 10**15, 9 * 10**15, 3)], "n long, total long, kept long").select(divergence.share("n", "total", "kept").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**15 + 5) // (9 * 10**15 + 15)
