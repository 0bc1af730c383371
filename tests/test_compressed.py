"""The compressed vector index against the exact search."""

import numpy as np
import pytest

from tessera.operators import compressed, retrieval


def hits(df):
    return {(r["qid"], r["id"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("sf,probes", [("0.01", 16), ("0.1", 16)])
def test_nine_of_ten_at_a_share_of_the_bytes(spark, sf, probes):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    index = compressed.compressed_index(e, "vec_id", "embedding")
    assert index.codes.count() == e.count()
    want, got = hits(retrieval.vector_top_k(e, q, "vec_id", "embedding", 10, metric="inner")), hits(compressed.compressed_top_k(index, q, "vec_id", "embedding", 10, probes))
    both = want.keys() & got.keys()
    assert len(both) >= 0.9 * len(want) and all(got[x] == want[x] for x in both)
    if e.count() >= 1000:
        assert index.bytes_read(e.count(), probes, 64) < 0.15


def test_codes_are_near_what_they_stand_for():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 10)) + rng.normal(size=(4, 10))[rng.integers(0, 4, 3000)] * 8
    centres = compressed.k_means(x, 4, 8, rng)
    rest = compressed._split(x - centres[compressed.nearest(x, centres)], 5)
    words = np.stack([compressed.k_means(rest[:, p], 256, 8, rng) for p in range(5)])
    lists, codes = compressed.encode(x, centres, words)
    assert codes.shape == (3000, 5) and codes.dtype == np.uint8
    back = compressed.decode(lists, codes, centres, words)
    assert ((x - back) ** 2).sum() < 0.05 * ((x - centres[lists]) ** 2).sum()
    assert compressed._split(x, 3).shape == (3000, 3, 4) and not compressed._split(x, 3)[:, 2, 2:].any()


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, None, 1.0]), (5, [0.0, 0.0, 0.0]), (6, [1.0, 0.0, 2.0]), (7, []), (None, [1.0, 1.0, 1.0])], "id long, v array<double>")
    index = compressed.compressed_index(rows, "id", "v")
    got = [(r["qid"], r["id"], r["rank"]) for r in compressed.compressed_top_k(index, rows.where("id IS NOT NULL"), "id", "v", 2).collect()]
    assert {(1, 1, 1), (1, 6, 2), (6, 1, 1)} <= set(got) and {q for q, *_ in got} == {1, 5, 6}
    empty = compressed.compressed_index(rows.limit(0), "id", "v")
    assert compressed.compressed_top_k(empty, rows.where("id = 1"), "id", "v", 2).count() == 0
