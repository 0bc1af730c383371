"""Text expressions as Columns: chunks of fixed stride, hashes, entities, markup removal, evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let, tokens


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def stride_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (index, text): windows of ``size`` characters, each ``overlap`` into the one before; all of the text is covered."""
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


#: What a word border lies between: letters and numerals of all scripts, and the underscore. Java's own border knows ASCII only.
_IN_WORD = r"[\p{L}\p{N}_]"
ENTITY = rf"(?<!{_IN_WORD})[A-Z][a-zA-Z0-9\-]{{2,}}(?:(?<={_IN_WORD})(?!{_IN_WORD})|(?<=-)(?={_IN_WORD}))"


def entities(text: Column) -> Column:
    """Capitalised words of three letters or more, between Unicode word borders."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


#: What white space is in the chunkers: all of Unicode's.
BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

#: Phrases and the relations that they state.
_WORD = r"([\p{L}\p{N}_]+)"
RELATIONS = [(f"{_WORD} {phrase} {_WORD}", name) for phrase, name in (("is based on", "based_on"), ("extends", "extends"), ("improves", "improves"), ("uses", "uses"))]


def combined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts that are not empty, one after the other."""
    return F.sha2(F.concat_ws("", *(F.when(p != "", p) for p in parts)), 256)


def html_text(html: Column) -> Column:
    """Visible text: no comments, scripts and styles, tags as blanks, the common character references resolved."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapsed(out)


#: Tags that begin an element of their own: fixed values of the markup.
BLOCKS = "h[1-6]|title|p|li|td|th|tr|table|ul|ol|pre|blockquote|figcaption|div|article|section|nav|header|footer|aside|body|br"
_KIND = {"li": "list_item", "td": "cell", "th": "cell", "p": "paragraph", "pre": "code", "blockquote": "quote", "title": "title", "figcaption": "caption", **{f"h{i}": "heading" for i in range(1, 7)}}


def html_elements(html: Column) -> Column:
    """Array of (pos, kind, level, row, col, text): headings, paragraphs, list items, table cells and the like that have text.

    An element's text goes from its tag to the next block tag, so that missing end tags do no harm. Rows and columns count
    the cells of all tables of the page, from 1.
    """
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    kinds = F.create_map(*(F.lit(x) for k in _KIND.items() for x in k))
    tag = rf"(?i)<(/?(?:{BLOCKS}))\b[^>]*>"

    def elements(tags: Column, texts: Column, row: Column) -> Column:
        """Of one table row, or of what stands before the first: an entry for each tag, with a kind if it is an element."""
        cells = F.filter(F.transform(tags, lambda t, i: F.when(t.isin("td", "th"), i)), lambda i: i.isNotNull())
        entry = lambda t, i, c: F.struct(F.try_element_at(kinds, t).alias("kind"), F.when(t.rlike("^h[1-6]$"), F.substring(t, 2, 1).cast("int")).alias("level"), F.when(t.isin("td", "th"), row).alias("row"), F.when(t.isin("td", "th"), F.array_position(c, i).cast("int")).alias("col"), html_text(F.get(texts, i + 1)).alias("text"))
        return let(cells, lambda c: F.transform(tags, lambda t, i: entry(t, i, c)))

    # A page is cut at the tags that open a row: the rows before a cell are the cuts before it.
    parts = F.split(clean, r"(?i)<tr\b[^>]*>")
    of_part = lambda part, row: let(F.transform(F.regexp_extract_all(part, F.lit(tag), F.lit(1)), F.lower), lambda tags: let(F.split(part, tag), lambda texts: F.transform(elements(tags, texts, row), lambda e: F.struct(row.alias("rows"), e.alias("e")))))
    each = F.transform(F.flatten(F.transform(parts, of_part)), lambda x, i: F.struct((i + x["rows"]).alias("pos"), *(x["e"][f].alias(f) for f in ("kind", "level", "row", "col", "text"))))
    return F.filter(each, lambda x: x["kind"].isNotNull() & (x["text"] != ""))


def markdown_elements(text: Column) -> Column:
    """Array of (line, kind, level, text): headings, list items, table rows, quotes, code inside fences and paragraphs; blank lines and fences are none."""
    # A text is cut at its fences, of which every second one closes: what lies between an odd one and the next is code.
    parts = F.split(text, r"(?md)^[^\S\n]*(?:```|~~~)[^\n]*$")
    line = lambda s, fence, code: F.struct(s.alias("s"), fence.alias("fence"), code.alias("c"))

    def lines_of(p: Column, k: Column, n: Column) -> Column:
        """The lines of a part; the first of all but the first part is the fence before it, and the last of all but the last is what stands before the next fence."""
        own = F.split(p, "\n")
        whole = let(own, lambda ls: F.when(k == n - 1, ls).otherwise(F.slice(ls, F.lit(1), F.size(ls) - 1)))
        return F.transform(whole, lambda s, i: line(s, (k > 0) & (i == 0), k % 2 == 1))

    forms = {"heading": r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$", "list_item": r"^(\s*)(?:[-*+]|\d+[.)])[ \t]+(.*)$", "row": r"^\s*()\|(.*)\|\s*$", "quote": r"^ {0,3}()>[ \t]?(.*)$"}

    def element(s: Column, code: Column, i: Column) -> Column:
        kind, body, level = F.when(code, "code"), F.when(code, s), F.when(F.lit(False), 0)
        for k, form in forms.items():
            kind, body = kind.when(s.rlike(form), k), body.when(s.rlike(form), F.trim(F.regexp_extract(s, form, 2)))
            level = level.when(code | ~s.rlike(form), None) if k not in ("heading", "list_item") else level.when(~code & s.rlike(form), F.length(F.regexp_extract(s, form, 1)))
        return F.struct(i.alias("line"), kind.otherwise("paragraph").alias("kind"), level.otherwise(None).cast("int").alias("level"), body.otherwise(F.trim(s)).alias("text"))

    rule = lambda s: s.rlike(r"^[\s|:-]*$") & s.contains("-")  # noqa: E731  of a table, or a thematic break
    lines = let(parts, lambda ps: F.flatten(F.transform(ps, lambda p, k: lines_of(p, k, F.size(ps)))))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["fence"].alias("fence"), x["c"].alias("c"))), lambda x: ~x["fence"] & (x["c"] | (~rule(x["s"]) & (F.trim(x["s"]) != ""))))
    return F.transform(kept, lambda x: element(x["s"], x["c"], x["i"]))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def query_terms(text: Column) -> Column:
    """Distinct terms of more than three characters."""
    return F.array_distinct(F.filter(tokens(text), lambda x: F.length(x) > 3))


def coverage(terms: Column, evidence: Column) -> Column:
    """0.65 of the share of terms that the evidence contains, 0.35 of its length up to 4000 characters; four digits."""
    low = F.lower(evidence)
    lexical = F.size(F.filter(terms, lambda x: F.contains(low, x))) / F.greatest(F.size(terms), F.lit(1))
    score = 0.65 * lexical + 0.35 * F.least(F.lit(1.0), F.length(evidence) / 4000.0)
    return F.round(score.cast("decimal(18,12)"), 4).cast("double")


def completeness(terms: Column, answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda x: F.contains(low, x))) / F.size(terms))


def retrieval_score(query: Column, evidence: Column) -> Column:
    """Of an array of evidence texts: the mean share of the query's distinct terms of more than three characters that are among a text's tokens; empty texts don't count, no texts: 0."""
    terms = query_terms(query)
    texts = F.filter(evidence, lambda x: x.isNotNull() & (x != ""))
    share = lambda q: lambda x: F.size(F.array_intersect(q, tokens(x))) / F.greatest(F.size(q), F.lit(1))
    return let(terms, lambda q: F.coalesce(F.try_divide(F.aggregate(F.transform(texts, share(q)), F.lit(0.0), lambda a, x: a + x), F.size(texts)), F.lit(0.0)))


def unsupported(answer: Column, evidence: Column) -> Column:
    """Share of the answer's terms of more than five characters that the evidence lacks; no answer: 1, no such terms: 0."""
    low, terms = F.lower(evidence), F.filter(tokens(answer), lambda x: F.length(x) > 5)
    share = F.size(F.filter(terms, lambda x: ~F.contains(low, x))) / F.size(terms)
    return F.when(F.coalesce(answer, F.lit("")) == "", 1.0).when(F.size(terms) == 0, 0.0).otherwise(share)


def citation_score(answer: Column, n_evidence: Column) -> Column:
    """Citations like [3] for each piece of evidence, at most 1."""
    n = F.regexp_count(answer, F.lit(r"\[[0-9]+\]"))
    return F.when((F.coalesce(answer, F.lit("")) == "") | (n_evidence == 0), 0.0).otherwise(F.least(F.lit(1.0), n / n_evidence))
