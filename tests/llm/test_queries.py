"""The registered queries of this subpackage over whole tables: every contract column by plain Python, or by SQL where there is SQL."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring, mixing, near_dedup, packing, secrets, sentencepiece_codec
from tessera.llm.registry import QUERIES, SQL
from tessera.llm.shared import crc_mod, text_of

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def sources(spark):
    return {r["doc_id"]: (r["source"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang").collect()}


def result(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_near_duplicates(spark, texts):
    got = result(spark, "op1_near_duplicates")
    want = brute.components(list(texts.items()), 3, 85)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items()) and any(not r["kept"] for r in got.values())


def test_recall_of_near_duplicates(spark):
    """2,400 rows of 300 families around the threshold, against all pairs."""
    import random

    rng, rows = random.Random(8), []
    for family in range(300):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    want = brute.components(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, bands=24).collect()}
    missed = [d for d in want if got[d] != want[d]]
    assert not missed and len({c for _, c in want.values()}) > 300


def test_language_id(spark, texts, sources):
    got = result(spark, "op2_language_id")
    learned = {lang for d, (_, lang) in sources.items() if lang and brute.crc(d, 4) != 2}
    assert all(r["held_out"] == (brute.crc(d, 4) == 2) and 0 <= r["score"] <= 1 for d, r in got.items()) and got.keys() == texts.keys()
    for d, r in got.items():
        letters = any(c.isalpha() for c in texts[d] or "")
        assert (r["lang_pred"] in learned) if letters else (r["lang_pred"] == "und")
    held = [d for d, (_, lang) in sources.items() if lang and got[d]["held_out"] and any(c.isalpha() for c in texts[d] or "")]
    assert sum(got[d]["lang_pred"] == sources[d][1] for d in held) >= 0.95 * len(held)


def test_lm_scores(spark, texts):
    got = result(spark, "op3_lm_scores")
    said = {d: [*brute.lower_words(t), None] for d, t in texts.items()}
    c = Counter(w for d, ws in said.items() if brute.crc(d, 7) != 2 for w in ws)
    total = sum(c.values())
    for d, ws in said.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (brute.crc(d, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model is better on what it has not seen


def test_lm_scores_token_by_token(spark, texts):
    """The score of every text by the learned parameters, one token at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), text_of("text").alias("t"))
    model = lm_scoring.learn_model(rows.where("NOT held_out").select("t"), head_words=300, model_words=64, width=8)
    vocabulary, lm = model.parts()
    count = {r["word"]: r["n"] for r in model.counts.collect()}
    own = {w.decode(): int(vocabulary.model_id[i]) for w, i in vocabulary.index.items()}
    context = lambda w: own.get(w, lm_scoring.OTHER)
    log_p = {}

    def of(w, x, y):
        if (x, y) not in log_p:
            s = (lm.R[x].astype(float) @ lm.C[0] + lm.R[y].astype(float) @ lm.C[1]) @ lm.Q.T.astype(float) + lm.b
            m = s.max()
            log_p[x, y] = s - m - math.log(np.exp(s - m).sum())
        return log_p[x, y][w] / math.log(10)

    known = {w for w, k in own.items() if k != lm_scoring.OTHER}
    outside = {w: n for w, n in count.items() if w not in known}
    size = sum(outside.values()) + len(outside) + 1
    for r in lm_scoring.score_rows(rows, model).where("doc_id % 3 = 0").collect():
        x = y = lm_scoring.STOP
        score = 0.0
        for w in [*brute.lower_words(texts[r["doc_id"]]), lm_scoring.END]:
            k = context(w)
            score += of(k, x, y) + (0 if k != lm_scoring.OTHER else math.log10((outside.get(w, 0) + 1) / size))
            x, y = k, x
        assert r["score"] == pytest.approx(score, rel=1e-3, abs=1e-2)


def test_exact_dedup_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op4_exact_dedup"](spark, SF)
    want = con.sql(SQL["op4_exact_dedup"])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.select(*df.columns).fetchall())


WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALNUM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def scanned(text):
    """(start, kind, end) of the contract's three kinds by a character scanner, without regular expressions."""
    out, low, n = [], lower_az(text), len(text)

    def assign(i):
        word = next((w for w in WORDS if low.startswith(w, i)), None)
        if word is None:
            return None
        k = i + len(word)
        k += k < n and text[k] in "\"'"
        while k < n and text[k] == " ":
            k += 1
        if k >= n or text[k] not in ":=":
            return None
        k += 1
        while k < n and text[k] == " ":
            k += 1
        k += k < n and text[k] in "\"'"
        begin = k
        while k < n and text[k] in ALNUM | set("+/_.=-"):
            k += 1
        return (k, k - begin) if k > begin else None

    i = 0
    while i < n:
        if found := assign(i):
            if found[1] >= 8:
                out.append((i, 0, found[0]))
            i = found[0]
        else:
            i += 1
    i = 0
    while i < n:
        k = i + 4
        while text.startswith("AKIA", i) and k < n and ("A" <= text[k] <= "Z" or "0" <= text[k] <= "9"):
            k += 1
        if text.startswith("AKIA", i) and k > i + 4:
            if k - i >= 16:
                out.append((i, 1, k))
            i = k
        else:
            i += 1
    at = 0
    for inside, run in groupby(text, lambda c: c in "0123456789abcdef"):
        size = len(list(run))
        if inside and size >= 32:
            out.append((at, 2, at + size))
        at += size
    return sorted(out)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_secrets(spark, texts):
    got = result(spark, "op5_scan_secrets")
    for d, t in texts.items():
        base, r = scanned(t or ""), got[d]
        n = Counter(k for _, k, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2]) and r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r["spans"].split(","))


def test_secrets_of_made_texts(spark):
    """Texts made of pieces of matches: base spans by the scanner, linked spans by comparing every part with every other."""
    import random

    rng = random.Random(3)
    pieces = [*WORDS, "PassWord", "ſecret", "TOKEN", '"', "'", " ", "  ", ":", "=", "abcdefgh", "x", "hunter2", "AKIA", "AKIAABCDEFGHIJKL", "Q", "0f", "ab12" * 8, "é", "🙂", "\n", "user: bob ", "login=eve_1 ", "account_id: 12345 ", " aB3" + "dE5" * 12 + "fG7 ", "https://db.example.com/x ", "host: db.example.com ", "x" * 120, " "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))) for i in range(1500)]
    more = 0
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scope=200).collect():
        text = rows[r["doc_id"]][1]
        base = scanned(text)
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        parts = secrets.parts_of(text, *secrets.base_spans(text))
        spans = set(base)
        for s, k, e, part, weak in parts:
            near = [(p, w) for at, _, _, p, w in parts if abs(at - s) <= 200]
            other = {secrets.ID: secrets.SECRET, secrets.SECRET: secrets.ID}.get(part)
            sorts = {p for p, _ in near}
            linked = {secrets.ID, secrets.SECRET} <= sorts if other is None else other in sorts and ((other, False) in near or secrets.PLACE in sorts)
            if weak and linked:
                spans.add((s, k, e))
        assert r["spans"] == listed(spans)
        more += len(spans) > len(base)
    assert more > 50


def test_token_counts(spark, texts):
    got = result(spark, "op6_token_counts")
    assert all(got[d]["n_words"] == len(brute.WORD.findall(t or "")) and (got[d]["n_tokens"] >= got[d]["n_words"]) for d, t in texts.items())


def test_quality_rules(spark, texts):
    got = result(spark, "op7_quality_rules")
    for d, t in texts.items():
        r = got[d]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality(t)
        assert not (r["base_failed"] and r["kept"])


def test_sentencepiece(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = result(spark, "op8_sentencepiece")
    assert all(got[d]["ids"] == library.encode(t or "") and got[d]["n_tokens"] == len(got[d]["ids"]) and got[d]["round_trip"] for d, t in texts.items())


def test_packed_tokens(spark, texts, tmp_path):
    ids = {d: r["ids"] for d, r in result(spark, "op8_sentencepiece").items()}
    packing.write_packed(QUERIES["op9_packed_tokens"](spark, SF), str(tmp_path / "packed"))
    parts, rows = defaultdict(list), spark.read.parquet(str(tmp_path / "packed")).collect()
    for r in rows:
        grid, places = packing.matrix(r)
        assert grid.shape[1] == 2048 and r["cu_seqlens"][-1] == grid.size
        for s in r["segments"]:
            cells = slice(s["start"], s["start"] + s["length"])
            assert places[s["row"], cells].tolist() == list(range(s["length"]))
            parts[s["doc_id"]].append((s["doc_offset"], grid[s["row"], cells].tolist()))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in parts.items()} == {d: [*x, 2] for d, x in ids.items()}


def test_mix_sources(spark, texts, sources):
    got = result(spark, "op10_mix_sources")
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t in texts.items()}
    total, taken = Counter(), Counter()
    for d, r in got.items():
        total[sources[d][0]] += sizes[d]
        taken[sources[d][0]] += r["taken"]
        assert r["size"] == sizes[d] and 0 <= r["taken"] <= 2 * r["size"]
    # Weights 5, 2, 1 along the sources by code point, null last; what is over twice a source's words is shared anew.
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]:
        for s in over:
            target[s] = 2.0 * total[s]
        open_ -= set(over)
        left = 1.5 * sum(total.values()) - sum(target.values())
        if not open_:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for d, r in got.items():
        assert r["source_size"] == total[sources[d][0]] and r["target"] == pytest.approx(target[sources[d][0]])
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    assert {d: r["taken"] for d, r in result(spark, "op10_mix_sources").items()} == {d: r["taken"] for d, r in got.items()}


def test_small_sources_meet_their_targets(spark):
    rows = [(0, "a " * 100, "s"), (1, "b c d e", "t"), (2, "f", "u"), (3, "g " * 5000, "v"), (4, None, "w"), (None, "h i j", None), (5, "k " * 37, "s"), (5, "k " * 37, "s")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 4 for s in target)


def test_every_query_is_tested_here():
    assert set(QUERIES) == {f"op{n}_{x}" for n, x in enumerate(["near_duplicates", "language_id", "lm_scores", "exact_dedup", "scan_secrets", "token_counts", "quality_rules", "sentencepiece", "packed_tokens", "mix_sources", "source_divergence", "repeated_bytes", "spelling_variants"], 1)}
    assert zlib.crc32(b"7") % 4 == brute.crc(7, 4)
