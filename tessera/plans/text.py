"""Text queries over documents, pages and conversations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..functions.vectors import cells_cosine, tokens
from ..operators import text as O

WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


@query("stride_chunks", "SELECT doc_id, cast(i AS INTEGER) AS index, substr(text, cast(i * 680 + 1 AS BIGINT), 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 800) / 680.0), 0) AS BIGINT) + 1)) AS i FROM documents)")
def stride_chunks(t):
    return t.documents.select("doc_id", F.explode(X.stride_chunks(F.col("text"), 800, 120)).alias("c")).select("doc_id", "c.index", F.col("c.text").alias("chunk"))


@query("recursive_chunks")
def recursive_chunks(t):
    """Recursion over separators and a fold with overlap: tested against an independent version."""
    return O.recursive_chunks(t.documents)


@query("sliding_chunks", """WITH RECURSIVE c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents),
w AS (SELECT doc_id, x, 0 AS b0, CASE WHEN length(x) > 800 AND contains(substr(x, 402, 399), ' ') THEN 800 - strpos(reverse(substr(x, 1, 800)), ' ') ELSE least(800, length(x)) END AS stop FROM c WHERE x <> ''
UNION ALL SELECT doc_id, x, b0, CASE WHEN length(x) > b0 + 800 AND contains(substr(x, b0 + 402, 399), ' ') THEN b0 + 800 - strpos(reverse(substr(x, b0 + 1, 800)), ' ') ELSE least(b0 + 800, length(x)) END FROM (SELECT doc_id, x, stop - 120 AS b0 FROM w WHERE stop < length(x))),
f AS (SELECT doc_id, b0, trim(substr(x, b0 + 1, stop - b0)) AS text FROM w), g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b0) - 1 AS index, text FROM f WHERE text <> '') SELECT doc_id, cast(index AS INTEGER) AS index, doc_id || ':chunk:' || index AS chunk_id, text FROM g""")
def sliding_chunks(t):
    return O.sliding_chunks(t.documents)


@query("hash_embedding", f"WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY 1, 2), c AS (SELECT doc_id, cast('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 128 AS dim, CAST(sum(CASE WHEN cast('0x' || substr(sha256(w), 9, 2) AS BIGINT) % 2 = 0 THEN n ELSE -n END) AS DOUBLE) AS v FROM w GROUP BY 1, 2) SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 8) AS value FROM c WHERE v <> 0")
def hash_embedding(t):
    return O.hash_embedding(t.documents).withColumn("value", F.round("value", 8))


ASKED = "the report that was for the other"
_CELL = "cast('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 128 AS dim, CAST(sum(CASE WHEN cast('0x' || substr(sha256(w), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v"


@query("sentence_compression", f"""WITH d AS (SELECT doc_id, text, string_split(text, '. ') AS parts FROM documents), s AS (SELECT doc_id, i, parts[i] AS t, len(parts) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, {_CELL} FROM (SELECT doc_id, i, unnest({WORDS.format('t')}) AS w FROM s) GROUP BY 1, 2, 3), q AS (SELECT {_CELL} FROM (SELECT unnest({WORDS.format(repr(ASKED))}) AS w) GROUP BY 1),
r AS (SELECT doc_id, i, round(coalesce(sum(c.v * q.v), 0) / (sqrt(sum(c.v * c.v)) * (SELECT sqrt(sum(v * v)) FROM q)), 9) AS score FROM c LEFT JOIN q USING (dim) GROUP BY 1, 2 HAVING sum(c.v * c.v) > 0),
k AS (SELECT doc_id, s.i, t, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, s.i) AS rn FROM s LEFT JOIN r USING (doc_id, i))
SELECT doc_id, string_agg(t, '. ' ORDER BY i) AS text FROM k WHERE n = 1 OR rn <= greatest(1, n // 2) GROUP BY 1 UNION ALL SELECT doc_id, text FROM d WHERE text IS NULL""")
def sentence_compression(t):
    """The half of the sentences that is nearest to a question by cosine, in order; of equals the earlier."""
    asked = t.spark.range(1).select(O.hash_cells(F.lit(ASKED)).alias("c")).first()["c"]
    dense = [0.0] * 128
    for x in asked:
        dense[x["dim"]] = x["v"]
    vector, length = F.array(*map(F.lit, dense)), F.lit(math.sqrt(sum(x * x for x in dense)))
    return O.compress_sentences(t.documents, lambda s: F.round(cells_cosine(O.hash_cells(s), vector, length), 9))


# Letters and numerals outside ASCII become underscores, which are as much part of a word: so RE2's ASCII borders are Unicode's.
_ASCII = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) > 127 AND regexp_matches(c, '[\\p{{L}}\\p{{N}}]') THEN '_' ELSE c END), '')"
_NAMES = "regexp_extract_all({}, '\\b[A-Z][a-zA-Z0-9\\-]{{2,}}\\b')"


@query("entity_counts", f"SELECT name, count(*) AS n FROM (SELECT unnest({_NAMES.format(_ASCII.format('text'))}) AS name FROM conversations) GROUP BY 1")
def entity_counts(t):
    """Over all turns."""
    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), "text")
    return O.entity_mentions(turns).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("entity_dedup", f"SELECT conv_id AS doc_id, lower(name) AS key, arg_min(name, (turn, pos)) AS name FROM (SELECT conv_id, turn, unnest(x) AS name, generate_subscripts(x, 1) AS pos FROM (SELECT conv_id, turn, {_NAMES.format(_ASCII.format('text'))} AS x FROM conversations)) GROUP BY 1, 2")
def entity_dedup(t):
    """Over all turns of a conversation, in their order."""
    turns = t.conversations.select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    along = F.col("doc_id.turn").cast("long") * (1 << 32) + F.col("pos")
    found = O.entity_mentions(turns).select(F.col("doc_id.conv_id").alias("doc_id"), "name", "confidence", along.alias("pos"))
    best = O.deduplicated(found.withColumn("doc", F.col("doc_id").cast("string")), ["doc", "name"], "confidence", "pos")
    return best.select("doc_id", F.lower("name").alias("key"), "name")


def _stated(t):
    """Texts with relations in them: names of customers' segments and nations, in phrases that share ends."""
    name = lambda c: F.concat(F.lit("Item"), F.col(c) % 7)
    said = F.concat_ws(" ", name("o_orderkey"), F.lit("uses"), name("o_custkey"), F.lit("extends"), F.concat(F.lit("Item"), (F.col("o_orderkey") + F.col("o_custkey")) % 5), F.lit("is based on"), F.lower("o_orderpriority"), F.lit("and improves"), name("o_custkey"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), said.alias("text")).unionByName(t.conversations.select((-F.col("conv_id") - 1).alias("doc_id"), "text"))


_SAID = "SELECT o_orderkey AS doc_id, concat_ws(' ', 'Item' || o_orderkey % 7, 'uses', 'Item' || o_custkey % 7, 'extends', 'Item' || (o_orderkey + o_custkey) % 5, 'is based on', lower(o_orderpriority), 'and improves', 'Item' || o_custkey % 7) AS text FROM orders UNION ALL SELECT -conv_id - 1, text FROM conversations"
_STATED = " UNION ALL ".join(f"SELECT doc_id, x, regexp_extract_all(y, '([\\p{{L}}\\p{{N}}_]+) {p} ([\\p{{L}}\\p{{N}}_]+)', 1) AS s, regexp_extract_all(y, '([\\p{{L}}\\p{{N}}_]+) {p} ([\\p{{L}}\\p{{N}}_]+)', 2) AS d, '{r}' AS relation FROM n" for p, r in (("is based on", "based_on"), ("extends", "extends"), ("improves", "improves"), ("uses", "uses")))


@query("pattern_relations", f"WITH t AS ({_SAID}), n AS (SELECT doc_id, text AS y, {_NAMES.format(_ASCII.format('text'))} AS x FROM t), p AS ({_STATED}), u AS (SELECT doc_id, x, unnest(s) AS src, relation, unnest(d) AS dst FROM p) SELECT doc_id, src, relation, dst, 0.6::DOUBLE AS confidence FROM u WHERE list_contains(x, src) AND list_contains(x, dst) AND src <> dst")
def pattern_relations(t):
    """Relations between entities of the same text, over made phrases and all turns."""
    return O.pattern_relations(_stated(t))


@query("relation_dedup", f"WITH t AS ({_SAID}), n AS (SELECT doc_id, text AS y, {_NAMES.format(_ASCII.format('text'))} AS x FROM t), p AS ({_STATED}), u AS (SELECT doc_id, x, unnest(s) AS src, relation, unnest(d) AS dst FROM p) SELECT lower(src) AS src_key, lower(dst) AS dst_key, relation, min(doc_id) AS doc_id, max(0.6::DOUBLE + doc_id % 3 / 10.0::DOUBLE) AS confidence FROM (SELECT *, max(doc_id % 3) OVER (PARTITION BY lower(src), lower(dst), relation) AS top FROM u WHERE list_contains(x, src) AND list_contains(x, dst) AND src <> dst) WHERE doc_id % 3 = top GROUP BY 1, 2, 3")
def relation_dedup(t):
    """Of relations that differ in case only the most confident, of equals the first."""
    found = O.pattern_relations(_stated(t)).withColumn("confidence", F.col("confidence") + F.col("doc_id") % 3 / F.lit(10.0))
    best = O.deduplicated(found, ["src", "dst", "relation"], "confidence", "doc_id")
    return best.select(F.lower("src").alias("src_key"), F.lower("dst").alias("dst_key"), "relation", "doc_id", "confidence")


@query("cooccurrence_pairs", f"WITH d AS (SELECT {_ASCII.format('text')} AS x, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT list_sort(list_distinct({_NAMES.format('substr(x, cast(i * 680 + 1 AS BIGINT), 800)')})) AS names FROM (SELECT x, unnest(range(0, cast(greatest(ceil((n - 800) / 680.0), 0) AS BIGINT) + 1)) AS i FROM d)), p AS (SELECT names, unnest(range(1, len(names) + 1)) AS i FROM c) SELECT a, b, count(*) AS n FROM (SELECT names[i] AS a, unnest(names[i + 1:]) AS b FROM p) GROUP BY 1, 2")
def cooccurrence_pairs(t):
    """All pairs of distinct entities of each chunk of the documents."""
    chunks = t.documents.select(F.explode(X.stride_chunks(F.col("text"), 800, 120)).alias("c")).select("c.text")
    return O.cooccurrences(chunks).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("combined_hash", "SELECT c_custkey, sha256(c_name || CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE '' END) AS digest, sha256(c_name) AS one FROM customer")
def combined_hash(t):
    return t.customer.select("c_custkey", X.combined_hash(F.col("c_name"), F.lit(""), F.col("c_mktsegment")).alias("digest"), F.sha2("c_name", 256).alias("one"))


_HTML = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g')"
for _n, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML if _n != '&lt;' else 'regexp_replace(' + _HTML + ', $$<[^>]*>$$, $$ $$, $$g$$)'}, '{_n}', '{_c}')"


@query("html_text", f"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim(regexp_replace({_HTML}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_text(t):
    return t.pages.select("page_id", X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("text"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


_TAG = f"(?:{X.BLOCKS})"
_CLEAN = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g')"
_PLAIN = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
for _n, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_n}', '{_c}')"


@query("html_elements", f"""WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages), t AS (SELECT page_id, regexp_extract_all(h, '(?i)<(/?{_TAG})\\b[^>]*>', 1) AS tags, regexp_split_to_array(h, '(?i)</?{_TAG}\\b[^>]*>') AS texts FROM c),
e AS (SELECT page_id, i AS pos, lower(tags[i + 1]) AS tag, texts[i + 2] AS x FROM (SELECT *, unnest(range(0, len(tags))) AS i FROM t)), r AS (SELECT *, sum(CASE WHEN tag = 'tr' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS row FROM e),
k AS (SELECT page_id, pos, tag, row, sum(CASE WHEN tag IN ('td', 'th') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, row ORDER BY pos) AS col, trim(regexp_replace({_PLAIN}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM r)
SELECT page_id, cast(pos AS INTEGER) AS pos, CASE WHEN tag[1] = 'h' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'title' THEN 'title' WHEN tag IN ('td', 'th') THEN 'cell' WHEN tag = 'pre' THEN 'code' WHEN tag = 'blockquote' THEN 'quote' ELSE 'caption' END AS kind, CASE WHEN tag[1] = 'h' THEN cast(tag[2] AS INTEGER) END AS level, CASE WHEN tag IN ('td', 'th') THEN cast(row AS INTEGER) END AS row, CASE WHEN tag IN ('td', 'th') THEN cast(col AS INTEGER) END AS col, text FROM k WHERE text <> '' AND regexp_full_match(tag, 'h[1-6]|p|li|title|td|th|pre|blockquote|figcaption')""")
def html_elements(t):
    """Headings, paragraphs, list items, cells with row and column and the like of every page, in order."""
    return t.pages.select("page_id", F.explode(X.html_elements(F.col("html"))).alias("e")).select("page_id", "e.*")


@query("markdown_elements", "SELECT c_custkey, k.line, k.kind, CASE k.kind WHEN 'heading' THEN cast(c_nationkey % 6 + 1 AS INTEGER) WHEN 'list_item' THEN k.line - 3 END AS level, CASE k.line WHEN 0 THEN c_name WHEN 2 THEN 'Plain *text* of ' || c_custkey WHEN 3 THEN c_mktsegment WHEN 5 THEN '# code ' || c_name WHEN 8 THEN c_name || ' | ' || c_nationkey WHEN 10 THEN 'said ' || c_custkey END AS text FROM customer, (VALUES (0, 'heading'), (2, 'paragraph'), (3, 'list_item'), (5, 'code'), (8, 'row'), (10, 'quote')) k(line, kind)")
def markdown_elements(t):
    """Lines of made Markdown by kind."""
    hashes = F.repeat(F.lit("#"), F.col("c_nationkey") % 6 + 1)
    lines = F.concat_ws("\n", F.concat_ws(" ", hashes, "c_name", F.lit("##")), F.lit(""), F.concat(F.lit("Plain *text* of "), "c_custkey"), F.concat(F.lit("- "), "c_mktsegment"), F.lit("```sql"), F.concat(F.lit("# code "), "c_name"), F.lit("```"), F.lit(" "), F.concat(F.lit("| "), "c_name", F.lit(" | "), "c_nationkey", F.lit(" |")), F.lit("|---|:-:|"), F.concat(F.lit("> said "), "c_custkey"))
    return t.customer.select("c_custkey", F.explode(X.markdown_elements(lines)).alias("e")).select("c_custkey", "e.line", "e.kind", "e.level", "e.text")


_FORMS = {"heading": "^ {0,3}(#{1,6})[ \\t]+(.*?)[ \\t#]*$", "list_item": "^([ \\t\\r\\f]*)(?:[-*+]|\\d+[.)])[ \\t]+(.*)$", "row": "^[ \\t\\r\\f]*()\\|(.*)\\|[ \\t\\r\\f]*$", "quote": "^ {0,3}()>[ \\t]?(.*)$"}
_OF = lambda what, last: "CASE WHEN n % 2 = 1 THEN " + what[0] + " " + " ".join(f"WHEN regexp_matches(s, '{f}') THEN {what[1].format(k=k, f=f)}" for k, f in _FORMS.items()) + f" ELSE {last} END"


@query("markdown_of_documents", f"""WITH l AS (SELECT doc_id, i AS line, ls[i + 1] AS s FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS (SELECT *, regexp_matches(s, '^[ \\t\\r\\f]*(```|~~~)') AS fence FROM l), n AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM m),
k AS (SELECT * FROM n WHERE NOT fence AND (n % 2 = 1 OR (NOT (regexp_matches(s, '^[ \\t\\r\\f|:-]*$') AND contains(s, '-')) AND trim(s) <> '')))
SELECT doc_id, cast(line AS INTEGER) AS line, {_OF(("'code'", "'{k}'"), "'paragraph'")} AS kind, CASE WHEN n % 2 = 1 THEN NULL WHEN regexp_matches(s, '{_FORMS["heading"]}') THEN cast(length(regexp_extract(s, '{_FORMS["heading"]}', 1)) AS INTEGER) WHEN regexp_matches(s, '{_FORMS["list_item"]}') THEN cast(length(regexp_extract(s, '{_FORMS["list_item"]}', 1)) AS INTEGER) END AS level,
{_OF(("s", "trim(regexp_extract(s, '{f}', 2))"), "trim(s)")} AS text FROM k""")
def markdown_of_documents(t):
    """Every line of every document by kind."""
    return t.documents.select("doc_id", F.explode(X.markdown_elements(F.col("text"))).alias("e")).select("doc_id", "e.*")


_T = "list_distinct(list_filter(" + WORDS.format("replace(lower(q), 'ß', 'ss')") + ", lambda x: length(x) > 3))"


@query("evidence_scores", f"""WITH p AS (SELECT q.conv_id, q.turn, q.text AS q, a.text AS a FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND q.text IS NOT NULL AND a.text IS NOT NULL), s AS (SELECT *, {_T} AS terms, list_filter({WORDS.format("replace(lower(a), 'ß', 'ss')")}, lambda x: length(x) > 5) AS said FROM p)
SELECT conv_id, turn, cast(round(cast(0.65::DOUBLE * len(list_filter(terms, lambda x: contains(lower(a), x))) / greatest(len(terms), 1) + 0.35::DOUBLE * least(1.0, length(a) / 4000.0::DOUBLE) AS DECIMAL(18, 12)), 4) AS DOUBLE) AS coverage,
CASE WHEN len(terms) = 0 THEN 1.0 ELSE round(len(list_filter(terms, lambda x: contains(lower(a), x))) / len(terms), 8) END AS completeness, CASE WHEN a = '' THEN 0.0 ELSE least(1.0, len(regexp_extract_all(a, '\\[[0-9]+\\]')) / 2) END AS citations,
CASE WHEN a = '' THEN 1.0 WHEN len(said) = 0 THEN 0.0 ELSE round(len(list_filter(said, lambda x: NOT contains(lower(q), x))) / len(said), 8) END AS unsupported FROM s""")
def evidence_scores(t):
    """Scores of each turn after a user's as an answer to it."""
    c = t.conversations
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")).join(after, ["conv_id", "turn"]).where("q IS NOT NULL AND a IS NOT NULL")
    scored, q, a = pairs.withColumn("terms", X.query_terms(F.col("q"))), F.col("q"), F.col("a")
    return scored.select("conv_id", "turn", X.coverage(F.col("terms"), a).alias("coverage"), F.round(X.completeness(F.col("terms"), a), 8).alias("completeness"), X.citation_score(a, F.lit(2)).alias("citations"), F.round(X.unsupported(a, q), 8).alias("unsupported"))


@query("citation_numbers", "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, source) AS number, source, snippet FROM (SELECT l_orderkey, cast(l_suppkey AS VARCHAR) AS source, min(l_linenumber) AS first, substr(arg_min(l_returnflag || l_linestatus, (l_linenumber, l_returnflag || l_linestatus)), 1, 180) AS snippet FROM lineitem GROUP BY 1, 2)")
def citation_numbers(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("source"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("text"))
    return O.citations(e, "doc_id", "source", "l_linenumber", "text")


@query("token_statistics", f"SELECT lang, count(*) AS n_docs, sum(len({WORDS.format('text')}))::BIGINT AS n_tokens, max(len({WORDS.format('text')})) AS longest FROM documents GROUP BY 1")
def token_statistics(t):
    n = F.size(tokens(F.col("text"))).cast("long")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))


_TERMS = "list_distinct(list_filter(" + WORDS.format("replace(lower(q), 'ß', 'ss')") + ", lambda x: length(x) > 3))"


@query("retrieval_scores", f"""WITH q AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0 AND text IS NOT NULL), e AS (SELECT q.conv_id, {_TERMS} AS terms, {WORDS.format("replace(lower(c.text), 'ß', 'ss')")} AS said FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn > 0 AND c.text <> '')
SELECT conv_id, round(avg(len(list_intersect(terms, said)) / greatest(len(terms), 1)), 8) AS score FROM e GROUP BY 1""")
def retrieval_scores(t):
    """How well the later turns of a conversation, as evidence, cover its first one. Each turn is scored by itself and the mean is taken by partial aggregates."""
    first = t.conversations.where("turn = 0 AND text IS NOT NULL").select("conv_id", F.col("text").alias("q"))
    each = t.conversations.where("turn > 0 AND text <> ''").join(first, "conv_id").select("conv_id", X.retrieval_score(F.col("q"), F.array("text")).alias("s"))
    return each.groupBy("conv_id").agg(F.round(F.avg("s"), 8).alias("score"))
