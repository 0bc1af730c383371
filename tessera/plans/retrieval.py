"""Retrieval queries. The query set is fixed: rows whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions.vectors import jaccard, tokens
from ..operators import retrieval as R
from ..operators.compressed import compressed_index, compressed_top_k
from ..operators.fusion import train_fusion

K = 10
TOKENS = "list_filter(regexp_split_to_array(replace(lower({}), 'ß', 'ss'), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
_LOW = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
BM25 = f"""bd AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), bt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2),
bs AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM bd), bp AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM bd) WHERE term IN (SELECT term FROM bt) GROUP BY 1, 2),
bf AS (SELECT term, count(*) AS df FROM bp GROUP BY 1), bm25 AS (SELECT qid, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM bp JOIN bt USING (term) JOIN bf USING (term), bs GROUP BY 1, 2),
kw AS (SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= {K})"""
VEC = f"""vs AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e),
vec AS (SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= {K})"""


def _queries(t):
    return t.benchmark.where("item_id % 20 = 0")


def _keyword(t, k=K):
    return R.top_k(R.bm25(t.documents, _queries(t)).withColumn("score", F.round("score", 6)), ["qid"], "score", "doc_id", k)


def _vector(t, k=K):
    return R.vector_top_k(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", k).withColumnRenamed("id", "doc_id")


@query("bm25_top_k", f"WITH {BM25} SELECT qid, doc_id, score, rank FROM kw")
def bm25_top_k(t):
    return _keyword(t).select("qid", "doc_id", "score", "rank")


@query("keyword_top_k", f"WITH q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({_LOW.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2), s AS (SELECT qid, doc_id, cast(sum(times) AS DOUBLE) AS score FROM documents d JOIN q ON contains(lower(d.text), q.term) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}")
def keyword_top_k(t):
    return R.top_k(R.keyword_scores(t.documents, _queries(t)), ["qid"], "score", "doc_id", K)


@query("vector_cosine_top_k", f"WITH {VEC} SELECT qid, doc_id, score, rank FROM vec")
def vector_cosine_top_k(t):
    return _vector(t).select("qid", "doc_id", "score", "rank")


@query("vector_inner_product_top_k", f"SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e)) WHERE rank <= {K}")
def vector_inner_product_top_k(t):
    hits = R.vector_top_k(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", K, metric="inner")
    return hits.select("qid", F.col("id").alias("doc_id"), "score", "rank")


@query("vector_bucket_top_k")
def vector_bucket_top_k(t):
    """As the inner product search, through buckets: an approximation, so its recall is tested against the exact search."""
    index = R.bucket_index(t.embeddings, "vec_id", "embedding")
    return R.bucket_top_k(index, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", K).select("qid", F.col("id").alias("doc_id"), "score", "rank")


@query("vector_compressed_top_k")
def vector_compressed_top_k(t):
    """As the inner product search, over product-quantised codes with exact reranking: its recall is tested against the exact search."""
    index = compressed_index(t.embeddings, "vec_id", "embedding")
    return compressed_top_k(index, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", K).select("qid", F.col("id").alias("doc_id"), "score", "rank")


@query("retrieval_plan", f"SELECT item_id, CASE WHEN n <= 3 THEN 1 WHEN n <= 12 THEN 3 ELSE 5 END AS queries, CASE WHEN n <= 3 THEN 5 WHEN n <= 12 THEN 10 ELSE 20 END AS k, n > 3 AS rerank, greatest(3, least(20, CASE WHEN n < 5 THEN 5 WHEN n < 12 THEN 8 ELSE 12 END + greatest(-1, least(1, item_id % 5 - 2)))) AS chosen_k FROM (SELECT item_id, len({TOKENS.format('text')}) AS n FROM benchmark)")
def retrieval_plan(t):
    n = F.size(tokens(F.col("text")))
    return t.benchmark.select("item_id", *(c.alias(k) for k, c in R.query_plan(n).items()), R.chosen_k(n, F.col("item_id") % 5 - 2).alias("chosen_k"))


@query("filter_after_top_k", f"WITH {VEC} SELECT v.qid, v.doc_id, v.score FROM vec v JOIN embeddings a ON a.vec_id = v.qid JOIN embeddings b ON b.vec_id = v.doc_id WHERE a.label = b.label")
def filter_after_top_k(t):
    """A metadata filter above the limit: fewer than k rows may be left."""
    label = lambda c: t.embeddings.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
    return _vector(t).join(label("qid"), "qid").join(label("doc_id"), "doc_id").where("qid_label = doc_id_label").select("qid", "doc_id", "score")


@query("reciprocal_rank_fusion", f"WITH {BM25}, {VEC} SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM kw UNION ALL SELECT qid, doc_id, rank FROM vec) GROUP BY 1, 2")
def reciprocal_rank_fusion(t):
    return R.rrf({"vector": _vector(t), "keyword": _keyword(t)}).withColumn("score", F.round("score", 9))


@query("weighted_rank_fusion", f"WITH {BM25}, {VEC}, n AS (SELECT item_id AS qid, len({TOKENS.format('text')}) AS n FROM benchmark) SELECT qid, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT kw.qid, doc_id, rank, CASE WHEN coalesce(n, 0) <= 4 THEN 1.35 ELSE 1.0 END::DOUBLE AS w FROM kw LEFT JOIN n USING (qid) UNION ALL SELECT vec.qid, doc_id, rank, CASE WHEN coalesce(n, 0) > 12 THEN 1.3 ELSE 1.0 END::DOUBLE FROM vec LEFT JOIN n USING (qid)) GROUP BY 1, 2")
def weighted_rank_fusion(t):
    sizes = t.benchmark.select(F.col("item_id").alias("qid"), F.size(tokens(F.col("text"))).alias("n"))
    return R.length_weighted_rrf({"vector": _vector(t), "keyword": _keyword(t)}, sizes).withColumn("score", F.round("score", 9))


@query("cross_filter_boost", f"WITH {BM25}, {VEC} SELECT v.qid, v.doc_id, round(v.score * CASE WHEN k.doc_id IS NULL THEN 1.0 ELSE 1.2 END, 6) AS score FROM vec v LEFT JOIN kw k USING (qid, doc_id)")
def cross_filter_boost(t):
    return R.boosted(_vector(t), _keyword(t)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("centred_scores", f"WITH {BM25} SELECT qid, doc_id, round(least(1, greatest(0, 0.5 + 0.5 * (score - avg(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END)), 6) AS score FROM kw WINDOW w AS (PARTITION BY qid)")
def centred_scores(t):
    return R.min_max_centred(_keyword(t)).select("qid", "doc_id", F.round("score", 6).alias("score"))


_Z = "least(1, greatest(0, 0.5 + 0.2 * (score - avg(score) OVER (PARTITION BY qid)) / CASE WHEN stddev_pop(score) OVER (PARTITION BY qid) = 0 THEN 1 ELSE stddev_pop(score) OVER (PARTITION BY qid) END))"
_W = [round(w, 12) for w in R.softmax([0.45, 0.35])]


@query("three_way_fusion", f"WITH {BM25}, {VEC} SELECT qid, doc_id, round(1 / (1 + exp(-sum(part) / 3)), 6) AS score FROM (SELECT qid, doc_id, {_W[1]}::DOUBLE * {_Z} / rank AS part FROM kw UNION ALL SELECT qid, doc_id, {_W[0]}::DOUBLE * {_Z} / rank FROM vec) GROUP BY 1, 2")
def three_way_fusion(t):
    fused = R.three_way_fusion({"vector": _vector(t), "keyword": _keyword(t)}, {"vector": 0.45, "keyword": 0.35})
    return fused.withColumn("score", F.round("score", 6))


@query("multi_source_merge", f"WITH {BM25}, {VEC} SELECT qid, doc_id, round(max(score), 6) AS score FROM (SELECT qid, doc_id, score * 0.85 AS score FROM kw UNION ALL SELECT qid, doc_id, score FROM vec) GROUP BY 1, 2")
def multi_source_merge(t):
    return R.multi_source_merge({"vector": _vector(t), "keyword": _keyword(t)}).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("first_wins_merge", f"WITH {BM25}, {VEC} SELECT qid, doc_id, coalesce(v.score, k.score) AS score, CASE WHEN v.score IS NULL THEN 1 ELSE 0 END AS list_no FROM vec v FULL JOIN kw k USING (qid, doc_id)")
def first_wins_merge(t):
    return R.first_wins([_vector(t), _keyword(t)])


@query("rerank_blend", f"""WITH {BM25}, m AS (SELECT kw.*, {TOKENS.format('b.text')} AS qt, {TOKENS.format('d.text')} AS dt, contains(lower(d.text), lower(b.text)) AS phrase FROM kw JOIN benchmark b ON b.item_id = kw.qid JOIN documents d USING (doc_id)),
r AS (SELECT qid, doc_id, score, round(0.45 * len(list_intersect(qt, dt)) / len(list_distinct(qt)) + 0.3 * len(list_intersect(qt, dt)) / len(list_distinct(dt)) + CASE WHEN phrase THEN 0.15 ELSE 0 END + least(0.2, len(list_intersect(qt, dt)) / sqrt(len(dt))), 6) AS rerank FROM m)
SELECT qid, doc_id, rerank, round(0.7 * score + 0.3 * rerank, 6) AS final FROM r""")
def rerank_blend(t):
    return R.blended(_keyword(t), t.documents, _queries(t)).select("qid", "doc_id", "rerank", F.round("final", 6).alias("final"))


@query("containment_search", "SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON item_id % 20 = 0 AND contains(lower(d.text), lower(b.text))")
def containment_search(t):
    """The whole text of each query in all documents."""
    return R.containing(t.documents, _queries(t))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"


@query("memory_jaccard", f"SELECT qid, conv_id, turn, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, conv_id, turn) AS rank FROM (SELECT q.conv_id AS qid, c.conv_id, c.turn, round(len(list_intersect({_WORDS.format('q.text')}, {_WORDS.format('c.text')})) / len(list_distinct(list_concat({_WORDS.format('q.text')}, {_WORDS.format('c.text')})))::DOUBLE + CASE WHEN c.role = 'user' THEN 0.1 ELSE 0 END, 6) AS score FROM conversations c, (SELECT * FROM conversations WHERE conv_id % 20 = 0 AND turn = 0 AND text <> '') q) WHERE score >= 0.15) WHERE rank <= 10")
def memory_jaccard(t):
    """The first turn of every twentieth conversation against all turns, by shared tokens."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda x: x != ""))
    c = t.conversations.select("conv_id", "turn", "role", words.alias("w"))
    bonus = F.when(F.col("role") == "user", 0.1).otherwise(0.0)
    return R.jaccard_top_k(c, c.where("conv_id % 20 = 0 AND turn = 0"), "conv_id", ["conv_id", "turn"], "w", 10, bonus, least=0.15)


@query("session_search", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE contains(lower(text), 'the')) WHERE rn <= 10")
def session_search(t):
    """The first ten turns of each session that contain the text: the ten are the feature."""
    hits = t.conversations.where(F.contains(F.lower("text"), F.lit("the")))
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn <= 10").select("conv_id", "turn")


@query("pair_jaccard", f"SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect({_WORDS.format('a.text')}, {_WORDS.format('b.text')})) / nullif(len(list_distinct(list_concat({_WORDS.format('a.text')}, {_WORDS.format('b.text')}))), 0)::DOUBLE, 0), 6) AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def pair_jaccard(t):
    w = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\r\f]+"), lambda x: x != ""))
    nxt = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return t.conversations.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(w(F.col("text")), w(F.col("next_text"))), 6).alias("score"))





_STEP = "1 / (1 + exp(-(w0 * a + w1 * b + w2 * g + bias))) - y"


@query("fusion_training", f"""WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS a, (length(text) - length(replace(text, ' ', ''))) / greatest(n_chars, 1)::DOUBLE AS b, toxic::DOUBLE AS g, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n FROM s),
w AS (SELECT 0::BIGINT AS k, (1 / 3.0)::DOUBLE AS w0, (1 / 3.0)::DOUBLE AS w1, (1 / 3.0)::DOUBLE AS w2, 0::DOUBLE AS bias, 0::DOUBLE AS loss
UNION ALL SELECT k + 1, w0 - 0.05 * e * a, w1 - 0.05 * e * b, w2 - 0.05 * e * g, bias - 0.05 * e, (CASE WHEN i = 0 THEN 0 ELSE loss END) + e * e FROM (SELECT w.*, s.*, {_STEP} AS e FROM w, n, s WHERE w.k < 2 * n.n AND s.i = w.k % n.n))
SELECT round(w0, 6) AS vector, round(w1, 6) AS keyword, round(w2, 6) AS graph, round(bias, 6) AS bias, round(loss / n, 6) AS loss FROM w, n WHERE k = 2 * n""")
def fusion_training(t):
    """The fusion model trained on all labelled documents in the order of their ids, twice through; bins of 64 here, so that even a small table goes in many."""
    docs = t.documents.select("doc_id", F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("vector"), ((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))) / F.greatest("n_chars", F.lit(1))).alias("keyword"))
    samples = t.labels.join(docs, "doc_id").select("doc_id", "vector", "keyword", F.col("toxic").alias("graph"), "quality")
    m = train_fusion(samples, ["vector", "keyword", "graph"], "quality", ["doc_id"], rate=0.05, epochs=2, bin_rows=64)
    return t.spark.createDataFrame([(*m.weights, m.bias, m.loss)], "vector double, keyword double, graph double, bias double, loss double").select(*(F.round(c, 6).alias(c) for c in ("vector", "keyword", "graph", "bias", "loss")))
