"""Spelling variants against plain Python."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import spelling
from tessera.llm.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(rows):
    """word -> (form, root, n, n_near, form_n), by the words that each word makes with one letter out."""
    n = counted(rows)
    made = defaultdict(set)
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            made[x].add(w)
    out, form = {}, {}
    for w, k in n.items():
        met = {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in made[v] if x != w and near(w, x)}
        best = min(met, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
        out[w] = (form[w], n[form[w]] if form[w] else None, len(met))
    full = {}
    for w, (f, fn, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        full[w] = (f, root, n[w], m, fn)
    return full


def table(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_pairs_of_a_cell():
    rng = random.Random(1)
    for _ in range(200):
        s = rng.choice([3, 4, 5, 6])
        letters = "abéc"[: rng.choice([2, 3])]
        words = sorted({"".join(rng.choice(letters) for _ in range(s + rng.randrange(2))) for _ in range(rng.randrange(2, 60))})
        want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b) and min(len(a), len(b)) == s)
        for cuts in ([0, s // 2, s], [0, s], list(range(s + 1))):
            got = [tuple(sorted((words[i], words[j]))) for lo, hi in zip(cuts, cuts[1:], strict=False) for i, j in spelling.one_edit_pairs(words, s, lo, hi)]
            assert sorted(got) == want  # each pair once


def test_common_prefix():
    rng = random.Random(2)
    for _ in range(500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(80)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("ab") for _ in range(rng.randrange(60)))
        assert spelling.common_prefix(a, b) == len(os.path.commonprefix([a, b]))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = table(QUERIES["op13_spelling_variants"](spark, SF))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(f for f, *_ in got.values())


def made(seed):
    """Words that are one or more edits from a few frequent ones, in chains of frequencies."""
    rng, base = random.Random(seed), ["abcabcab", "étéétéé", "aaaaaaaa", "internationalisation"]
    said = []
    for b in base:
        level, n = [b], 1200
        for _ in range(3):
            for w in level:
                said += [w] * n
            level = ["".join(rng.choice([c, c, c, c, "", c + c, "z", "ñ"]) for c in rng.choice(level)) for _ in range(12)]
            n //= 11
    rng.shuffle(said)
    return [(k % 40 if k % 7 else None, " ".join(said[k : k + 60]).title() if k % 3 else "-".join(said[k : k + 60])) for k in range(0, len(said), 60)]


@pytest.mark.parametrize("most", [1000, 4, 1])
def test_chains_ties_and_small_cells(spark, most):
    long = 40_000 if most > 4 else 50
    rows = [*made(5), (7, None), (8, ""), (9, "日本語 abcdef abcdefg abcdefg abcdefh abcdefh 1abcdefi1abcdefi"), (10, " ".join(["q" * n for n in (long, long, long + 1, long + 1)]))]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, word string, root string, n long")
    want = brute(rows)
    assert table(spelling.spelling_variants(docs, most_words=most)) == want
    assert any(root not in (w, f) for w, (f, root, *_) in want.items())  # two steps at least


def test_slices_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 16)
    monkeypatch.setattr(spelling, "ENTRIES", 2)
    rows = [(k % 3, "alphabet Alphabet alphabets betelgeuse " * (k + 1)) for k in range(9)]
    assert table(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "short words only")], "doc_id long, text string")).collect() == []
