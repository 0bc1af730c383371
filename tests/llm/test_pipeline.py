"""The stages of the pipeline on a small table, each judged on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402
from .test_llm_operators import ENGLISH, FRENCH, made  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(i, made(rng, ENGLISH, 60), "en", f"s{i % 4}") for i in range(60)] + [(100 + i, made(rng, FRENCH, 60), "fr", "s1") for i in range(40)]
    rows += [(200, rows[3][1], "en", "s0"), (201, rows[3][1], "en", "s0"), (202, rows[4][1] + " more", "en", "s2"), (203, None, "en", "s2"), (204, "12 34", None, None), (205, rows[5][1] + "\n\nend", None, None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    found = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found.append((name, before, docs.collect(), docs.columns))
    assert all(cols == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, _, cols in found[:-1])
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    _, before, after, _ = found[0]
    assert ids(after) == [d for d in ids(before) if d not in (203, 204)] and all(r["lang"] for r in after)
    _, before, after, _ = found[1]
    assert ids(after) == [d for d in ids(before) if d not in (3, 200)]
    _, before, after, _ = found[2]
    want = brute.components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == sorted({c for _, c in want.values()}) and 202 not in ids(after)
    _, before, after, _ = found[3]
    words = {r["doc_id"]: brute.WORD.findall(r["text"]) for r in before}
    for r in after:
        own = brute.WORD.findall(r["text"])
        at = iter(words[r["doc_id"]])
        assert own and all(w in at for w in own) and r["n_chars"] == len(r["text"])  # words of the document, in their order
    assert len(before) < len(after) <= 2 * len(before)
    _, before, after, _ = found[4]
    assert len(before) == len(after) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_mix_joins_nothing_across_gaps(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    mix = corpus_pipeline.mixed(spark, docs, "").collect()
    assert mix and all(r["text"] in (texts[r["doc_id"]] or "") for r in mix)
    assert sum(r["text"] != texts[r["doc_id"]] for r in mix) <= 2 * 5  # two ends for each source


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, gone_id string, t string, one string"


def odd_rows(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "x", "y", "z", "w") for r in rows], ODD)


def test_one_row_of_each_text_stays(spark):
    rng = random.Random(4)
    long = made(rng, ENGLISH, 40_000)
    near = made(rng, ENGLISH, 80)
    rows = [(1, "A b"), (1, "B c"), (2, "A b"), (2, "A b"), (None, "A b"), (None, "C d"), (3, None), (4, ""), (5, long), (5, long), (6, long + " tail"), (7, near), (7, near + " end"), (7, near), (None, near), (9, near + " fin")]
    docs = odd_rows(spark, rows)
    exact = corpus_pipeline.exactly_deduplicated(spark, docs, "")
    assert exact.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in exact.collect()))) == sorted(map(str, [(1, "B c"), (2, "A b"), (None, "C d"), (4, ""), (5, long), (6, long + " tail"), (7, near), (7, near + " end"), (9, near + " fin")]))
    for given in (docs, exact):
        got = corpus_pipeline.nearly_deduplicated(spark, given, "")
        left = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert got.columns == docs.columns and sum(t == long for _, t in left) == 1 and sum((t or "").startswith(near) for _, t in left) == 1
        assert sum((t or "").strip() == "" for _, t in left) == sum((r["text"] or "").strip() == "" for r in given.collect())
        assert {d for d, t in left if (t or "").startswith(near)} == {7} and sum(t == "A b" for _, t in left) == 1 and (1, "B c") in left


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = odd_rows(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_repeated_rows_and_null_ids(spark):
    rng = random.Random(6)
    text = made(rng, ENGLISH, 60)
    docs = odd_rows(spark, [(1, text), (1, text), (None, text), (2, None), (2, "12")])
    kept = corpus_pipeline.identified(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    mix = corpus_pipeline.mixed(spark, kept, "")
    assert mix.columns == docs.columns and mix.count() > 0 and all(r["text"] in text for r in mix.collect())
    assert corpus_pipeline.encoded(spark, kept, "").count() == 3
