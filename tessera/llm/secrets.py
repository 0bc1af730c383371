"""Secret scans with multipart credential linking.

Base matches (key assignments, access identifiers, long hex runs) always count. Weak parts - named identifiers, bare
base64-like values, short assigned values, endpoints - are reported only where complementary parts lie in the same
scope, a stretch of ``scope`` code points to either side. The parts are joined as intervals by a range window over each
document's parts; documents without weak parts pass through with their base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import read, small_batches, text_of

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the whole match of [0-9a-f]+
KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
IDENT = re.compile(r"""(?:access_?key(?:_?id)?|key_?id|client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.IGNORECASE | re.ASCII)
IDENT_WORDS = (b"key", b"client", b"account", b"user", b"login")

FOUND = "doc_id string, row_no long, base array<struct<start:int,kind:int,end:int>>, parts array<struct<start:int,kind:int,end:int,part:int,weak:boolean>>"
ID, SECRET, PLACE = 0, 1, 2


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base matches, by start and kind; and of assignments whose value is too short to count."""
    low, out, short = text.encode("utf-8", "replace").lower(), [], []
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            (out if m.end(2) - m.start(2) >= 8 else short).append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out), short


def parts_of(text: str, base: list[tuple[int, int, int]], short: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, part, weak): strong parts from the base matches, weak ones beside them. No weak part, or nothing to go with it: none."""
    low = text.encode("utf-8", "replace").lower()
    begins, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    free = lambda s, e: not (k := bisect_left(begins, e)) or ends[k - 1] <= s
    weak = [(s, KINDS.index("value"), e, SECRET, True) for s, _, e in short]
    if any(w in low for w in IDENT_WORDS):
        weak += [(m.start(), KINDS.index("ident"), m.end(), ID, True) for m in IDENT.finditer(text) if free(m.start(), m.end())]
    weak += [(m.start(), KINDS.index("value"), m.end(), SECRET, True) for m in VALUE.finditer(text) if free(m.start(), m.end()) and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    strong = [(s, k, e, ID if k == 1 else SECRET, False) for s, k, e in base]
    if {ID, SECRET} - {x[3] for x in weak + strong}:
        return []
    if b"http" in low or b"host" in low or b"endpoint" in low or b"server" in low:
        weak += [(m.start(), KINDS.index("endpoint"), m.end(), PLACE, True) for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
    return sorted(weak + strong) if weak else []


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, row_no, text in zip(batch["doc_id"], batch["row_no"], batch["t"], strict=True):
            base, short = base_spans(text)
            rows.append((doc_id, row_no, base, parts_of(text, base, short)))
        yield pd.DataFrame(rows, columns=["doc_id", "row_no", "base", "parts"])


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. A weak identifier or value is reported if a part of the other sort starts at
    most ``scope`` code points away and one of these is strong or an endpoint is in scope as well; an endpoint, if both
    sorts are in scope. Whole texts are scanned, however long. Of matches that overlap within a kind the leftmost counts;
    spans with the same start are listed by kind. Repeated rows are scanned each for itself, a null id stays null; other
    columns are not looked at. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    # Ids pass pandas as text: beside a null, a long would become a double.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), text_of(text_col).alias("t"))
    found = rows.mapInPandas(_scan, FOUND)
    # The base spans go with one part of each row alone; with all, a text of many parts would carry their square.
    each = found.select("doc_id", "row_no", "base", F.posexplode_outer("parts").alias("pos", "x")).withColumn("base", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("base")))
    near = Window.partitionBy("row_no").orderBy("at").rangeBetween(-scope, scope)
    near_by = lambda what: F.coalesce(F.max(F.when(what, 1)).over(near), F.lit(0)) == 1
    part, weak = F.col("x.part"), F.col("x.weak")
    each = each.withColumn("at", F.coalesce(F.col("x.start"), F.lit(0))).withColumns({
        "with_id": near_by(part == ID), "with_secret": near_by(part == SECRET), "with_place": near_by(part == PLACE),
        "with_strong_id": near_by((part == ID) & ~weak), "with_strong_secret": near_by((part == SECRET) & ~weak),
    })
    linked = (
        F.when(part == ID, F.col("with_secret") & (F.col("with_strong_secret") | F.col("with_place")))
        .when(part == SECRET, F.col("with_id") & (F.col("with_strong_id") | F.col("with_place")))
        .otherwise(F.col("with_id") & F.col("with_secret"))
    )
    span = F.struct(F.col("x.start").alias("start"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"))
    whole = each.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("base", ignorenulls=True).alias("base"), F.collect_list(F.when(weak & linked, span)).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return whole.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.array_distinct(F.concat("base", "more")))).alias("spans"),
    )


def op5_scan_secrets(spark, sf_dir) -> DataFrame:
    """All whole texts of ``documents``; odd rows as in scan_secrets."""
    return scan_secrets(read(spark, sf_dir, "documents"))
