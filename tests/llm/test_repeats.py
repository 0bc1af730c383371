"""Removal of repeated byte strings against plain Python."""

import hashlib
import os
import random

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, width):
    """rows (doc_id, text) -> the sorted results, each string looked up among all that start earlier. Alike rows and ids are taken as they come."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if (s := b[i : i + width]) in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n, letters="ab é", longest=160):
    """Texts of few letters, many of them put together from shared passages."""
    rng = random.Random(seed)
    said = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages, rows = [said(rng.randrange(5, 60)) for _ in range(12)], []
    for d in range(n):
        rows.append((d * 3 % n if n % 3 else d, "".join(rng.choice([rng.choice(passages), said(rng.randrange(1, 9))]) for _ in range(rng.randrange(longest // 20)))))
    return rows


def test_blind_trie():
    rng = random.Random(3)
    for _ in range(300):
        keys = [rng.choice([rng.randrange(4), rng.randrange(2**40), rng.randrange(2**40) << 60]) for _ in range(rng.randrange(1, 40))]
        assert repeats.blind_trie_order(keys) == sorted(range(len(keys)), key=lambda i: (keys[i], i))


@pytest.mark.parametrize("shallow", [0, 8, 16, 64])
def test_deep_shallow_sorting(shallow):
    rng = random.Random(shallow)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(25))) * rng.choice([1, 1, 2]) for _ in range(400)]
    groups = [rng.randrange(9) for _ in strings]
    most = max(map(len, strings))
    rows = np.zeros((len(strings), -(-most // 8) * 8), dtype=np.uint8)
    for i, s in enumerate(strings):
        rows[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
    rank, common = repeats.sorted_with_prefixes(rows, np.array([len(s) for s in strings]), np.array(groups), shallow)
    order = np.argsort(rank).tolist()
    assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings, strict=True))
    assert common.tolist() == [-1 if not k or groups[i] != groups[order[k - 1]] else len(os.path.commonprefix([strings[i], strings[order[k - 1]]])) for k, i in enumerate(order)]


def test_segments_name_equal_strings_alike(monkeypatch):
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    seen = {}
    for step in (1 << 20, 32):
        monkeypatch.setattr(repeats, "STEP", step)
        first, n, place, h = repeats.segments(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]), 12, 5)
        whole, ends, got = b"".join(texts), np.cumsum([len(t) for t in texts]).tolist(), []
        for f, k, p, x in zip(first.tolist(), n.tolist(), place.tolist(), h.tolist(), strict=True):
            for i in range(f, f + k):
                got.append(i)
                assert i <= p <= i + 7 and seen.setdefault(whole[i : i + 12], (x, p - i)) == (x, p - i)
        assert got == [i for e, t in zip(ends, texts, strict=True) for i in range(e - len(t), e - 11)]


@pytest.mark.parametrize("more", [{}, {"bin_segments": 3}, {"bin_segments": 1, "shallow": 0, "buckets": 1}, {"shallow": 64}])
def test_against_brute_force(spark, more, monkeypatch):
    rows = [*made(1, 150), (None, "ab" * 30), (500, None), (501, ""), (502, "a" * 11), (503, "a" * 400), (504, "ab" * 300), (-7, "é" * 40 + "ab" * 9), (505, made(1, 1)[0][1])]
    rows += [(600 + k, rows[k][1]) for k in range(40)] + [(700 + k, rows[140 - k][1][:-2] + "x") for k in range(40)]
    docs = spark.createDataFrame([(*r, 1, 2, "z", "z") for r in rows], "doc_id long, text string, d long, th long, seg string, sha string").repartition(3)
    assert result(repeats.repeated_bytes(docs, width=12, gram=4, **more)) == brute(rows, 12)


def test_bins_over_many_batches(spark, monkeypatch):
    rows = made(2, 400, "ab", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert result(repeats.repeated_bytes(docs, width=20, gram=8)) == brute(rows, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_alike(spark):
    """One of alike rows comes first; ids that repeat with other texts are ordered somehow, but the same string stays once."""
    text = "abcdefghij" * 20
    rows = [(5, text)] * 3 + [(None, text)] * 2 + [(9, "short")] * 2
    got = result(repeats.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    assert got == brute(rows, 100)
    rows = [(1, "x" + text), (1, "y" + text), (1, "z" + text)]
    got = result(repeats.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(r[2] for r in got) == [200 - 10, 200, 200]  # the first repeats itself but for its first period


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert repeats.repeated_bytes(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None), (2, ""), (3, "x" * 99)]
    assert result(repeats.repeated_bytes(spark.createDataFrame(rows, schema))) == brute(rows, 100)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = result(QUERIES["op12_repeated_bytes"](spark, SF))
    assert got == brute(rows, 100) and any(r[2] for r in got)
