"""RDF graphs as triples: reading and writing N-Triples with blank nodes and typed literals, and identity of graphs up to the names of blank nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import stored

#: Fixed by the format: an IRI, a blank node, a literal with its type or language.
_IRI, _BLANK = r"<([^<>\x00-\x20]*)>", r"_:([\p{L}\p{N}_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_-])?)"
_LITERAL = r'(")((?:[^"\\\n\r]++|\\.)*+)"(?:\^\^<([^<>\x00-\x20]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
_PLAIN = "http://www.w3.org/2001/XMLSchema#string"
_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'))


def _unescaped(c: Column) -> Column:
    """Backslash pairs first, by way of a character that no text may hold."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for name, char in _ESCAPES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("\0"), F.lit("\\"))


def _escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for name, char in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def read_triples(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, s_kind, p, o, o_kind, o_type, o_lang); kinds iri, blank and literal. Comments, blank lines and lines that are none are left out. A literal without a type is a string.

    The pattern runs once a line: its groups are written one below the other, as no group holds a line break, after a sign
    that no triple's line begins with; where it fails, the line stays as it was. Off a generator, it isn't run again for the filter.
    """
    groups = "=\n" + "\n".join(f"${i}" for i in range(1, 10)) + "\n"
    found = lines.select(F.col(text).alias("line"), F.explode(F.array(F.regexp_replace(text, LINE, groups))).alias("groups")).where("groups <> line")
    part = lambda i: F.get("g", F.lit(i))
    literal, blank, tag = part(6) != "", part(5) != "", part(9) != ""
    return found.select(F.split("groups", "\n").alias("g")).select(
        F.when(part(2) != "", part(2)).otherwise(part(1)).alias("s"), F.when(part(2) != "", "blank").otherwise("iri").alias("s_kind"), part(3).alias("p"),
        F.when(literal, _unescaped(part(7))).when(blank, part(5)).otherwise(part(4)).alias("o"), F.when(literal, "literal").when(blank, "blank").otherwise("iri").alias("o_kind"),
        F.when(literal, F.when(part(8) != "", part(8)).when(~tag, F.lit(_PLAIN))).alias("o_type"), F.when(literal & tag, F.lower(part(9))).alias("o_lang"),
    )


def write_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line in ``value`` for each triple."""
    node = lambda c, kind: F.when(F.col(kind) == "blank", F.concat(F.lit("_:"), c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_type") != _PLAIN, F.concat(F.lit("^^<"), "o_type", F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)
    return triples.select(F.concat_ws(" ", node("s", "s_kind"), F.concat(F.lit("<"), "p", F.lit(">")), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o", "o_kind")), F.lit(".")).alias("value"))


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _sums(ends: DataFrame) -> DataFrame:
    """What each node's ends (node, way, p, of) say, whatever their order. They are added up as hashes, so that a node with very many is split over tasks."""
    mark = lambda k: F.xxhash64(F.lit(k), "way", "p", "of")
    return ends.groupBy("node").agg(F.bit_xor(mark(1)).alias("x"), F.sum(F.shiftright(mark(2), 8)).alias("y"), F.count(F.lit(1)).alias("m"))


def _renamed(t: DataFrame, end: str, colours: DataFrame) -> DataFrame:
    """The triples with the blank nodes at one end named by their colours. Others are dealt to no task by a term that most of them may share."""
    kind = F.col(f"{end}_kind")
    named = t.where(kind == "blank").join(colours.toDF(end, "colour"), end, "left").withColumn(end, F.coalesce(F.concat(F.lit("c"), F.lower(F.hex("colour"))), end))
    return named.select(t.columns).union(t.where(~kind.eqNullSafe("blank")))


def canonical(triples: DataFrame, most_rounds: int = 100) -> DataFrame:
    """The distinct triples with every blank node named by what it is connected to, whatever it was called.

    A blank node's colour is hashed from its triples with IRIs and literals, once. Those of nodes that are linked to blank
    nodes are hashed again from their own and the others' colours, seen from it, round by round, until a round tells no more
    nodes apart; a graph without such links needs no round. Nodes that no round tells apart share a name.
    """
    t = stored(triples.distinct(), "triples")
    out = t.where("s_kind = 'blank' AND o_kind <> 'blank'").select(F.col("s").alias("node"), F.lit(0).alias("way"), "p", F.xxhash64("o_kind", "o", "o_type", "o_lang").alias("of"))
    into = t.where("o_kind = 'blank' AND s_kind <> 'blank'").select("o", F.lit(1), "p", F.xxhash64("s_kind", "s"))
    colours = stored(_sums(out.union(into)).select("node", F.xxhash64("x", "y", "m").alias("colour")), "colours")
    links = t.where("s_kind = 'blank' AND o_kind = 'blank'")
    if _some(links):
        ends = stored(links.select(F.col("s").alias("node"), F.lit(0).alias("way"), "p", F.col("o").alias("other")).union(links.select("o", F.lit(1), "p", "s")), "ends")
        linked = stored(ends.select("node").distinct().join(colours, "node", "left").select("node", F.coalesce("colour", F.lit(0).cast("long")).alias("colour")), "linked")
        n = linked.select("colour").distinct().count()
        for _ in range(most_rounds):
            seen = ends.join(linked.toDF("other", "of"), "other")
            linked = stored(linked.join(_sums(seen), "node").select("node", F.xxhash64("colour", "x", "y", "m").alias("colour")), "linked")
            now = linked.select("colour").distinct().count()
            if now <= n:
                break
            n = now
        colours = stored(colours.join(linked, "node", "left_anti").union(linked), "colours")
    named = _renamed(t, "s", colours)
    return _renamed(named, "o", colours) if _some(t.where("o_kind = 'blank'")) else named


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs have the same triples but for the names of blank nodes (as far as canonical tells nodes apart)."""
    x, y = (stored(canonical(g).groupBy("s", "s_kind", "p", "o", "o_kind", "o_type", "o_lang").count(), "graph") for g in (a, b))
    return not x.exceptAll(y).union(y.exceptAll(x)).limit(1).count()
