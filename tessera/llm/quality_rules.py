"""Quality rules as a learned decision list, in DataFrame functions throughout.

Counts of each text give a few features. Sequential covering then learns an ordered list of rules from labelled rows:
each rule is a conjunction of feature thresholds that is grown for information gain on two thirds of the rows, pruned
on the other third, and kept only if it is precise there; what it covers is set aside before the next is grown. The
labelled rows, a bounded sample, are counted once by their binned features; rules are grown from those counts. The list
becomes one conditional expression that Spark evaluates for every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WORD, crc_mod, read, staged, text_of

SYMBOLS = "#*$%&|<>"  # fixed by the contract
WINDOW = 8  # words; fixed by the contract


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the array."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: _let(starts(p), lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])))

    def starts(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(p, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1)), lambda x: x["i"]))

    return F.when(F.size(words) >= WINDOW, _let(words, of)).otherwise(F.lit(0).cast("long"))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text; null counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    rows = rows.select("doc_id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w")).alias("n_repeat_words"),
    )


#: name -> expression over the counts
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100.0D * n_dup_lines / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); what it covers is to be dropped."""

    terms: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.terms)


def decision_list(rules: list[Rule]) -> Column:
    """The verdict as one ordered conditional: false at the first rule that covers a row, else true."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.sql()), F.lit(False)) if out is None else out.when(F.expr(r.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 6, max_terms: int = 3, precision: float = 0.9, least: int = 10) -> list[Rule]:
    """Ordered rules for label ``bad`` (boolean) from rows with doc_id and the counts of text_counts; ``weight``, if there, is how often a row counts. No rows or one class: no rules."""
    names = list(FEATURES)
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1).cast("long")
    valued = staged(labelled.select("bad", (crc_mod("doc_id", 3) != 2).alias("grow"), weight.alias("weight"), *(F.expr(e).alias(f) for f, e in FEATURES.items())))
    cuts = valued.agg(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10000).alias(f) for f in names)).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in names}
    binned = valued.select("bad", "grow", "weight", *(sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)).alias(f) for f in names))
    # A row for each combination of bins that a labelled row has: as many as the sample has rows at most.
    cube = [(r["grow"], dict(zip(names, r[2:-1], strict=True)), r["bad"], r["n"]) for r in binned.groupBy("grow", "bad", *names).agg(F.sum("weight").alias("n")).collect()]

    def covers(terms, at: dict) -> bool:
        return all(at[f] <= k if op == "<=" else at[f] > k for f, op, k in terms)

    def counts(taken, terms) -> dict:
        """(grow, feature, bin) -> (bad, good) among the rows that the terms cover and no rule has taken."""
        cell: dict = {}
        for grow, at, bad, n in cube:
            if covers(terms, at) and not any(covers(t, at) for t in taken):
                for f in names:
                    p, q = cell.get((grow, f, at[f]), (0, 0))
                    cell[grow, f, at[f]] = (p + n, q) if bad else (p, q + n)
        return cell

    def totals(cell: dict, grow: bool) -> tuple[int, int]:
        own = [v for (g, f, _), v in cell.items() if g == grow and f == names[0]]
        return sum(p for p, _ in own), sum(n for _, n in own)

    rules, taken = [], []
    for _ in range(max_rules):
        terms: list[tuple[str, str, int]] = []
        held = []  # (bad, good) of the pruning rows after each term
        cell = counts(taken, terms)
        p0, n0 = totals(cell, True)
        while p0 >= least and n0 > 0 and len(terms) < max_terms:
            best = None
            for f in names:
                p = n = 0
                for k in range(len(edges[f])):
                    dp, dn = cell.get((True, f, k), (0, 0))
                    p, n = p + dp, n + dn
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp >= least:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0]:
                                best = (gain, f, op, k)
            if best is None or best[0] <= 1e-9:
                break
            terms.append(best[1:])
            cell = counts(taken, terms)
            p0, n0 = totals(cell, True)
            held.append((totals(cell, False), (p0, n0)))
        if not terms:
            break
        # Prune: the shortest run of terms whose held-out rows are worth most.
        worth = [(p - n) / max(p + n, 1) for (p, n), _ in held]
        keep = worth.index(max(worth)) + 1
        (p, n), (gp, gn) = held[keep - 1]
        terms = terms[:keep]
        if p + gp < least or p < precision * (p + n) or gp < precision * (gp + gn):
            break
        taken.append(terms)
        rules.append(Rule(tuple((f, op, float(edges[f][k])) for f, op, k in terms)))
    return rules


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20000, **learner) -> DataFrame:
    """One row for each input row: doc_id, the counts, base_failed and kept.

    ``base_failed``: under 20 words, or over 30 % of them in repeated windows. ``kept``: not base_failed, and no learned
    rule covers the row. Rules are learned from the documents that ``labels`` (doc_id, quality 0 or 1; null is no label)
    covers; of more than ``max_labelled`` labelled ids a share by hash of the id is used. Null text counts as empty, and so
    fails; whole texts are counted, however long, with all words of a text in one array. An empty table gives an empty
    result; without labels only the base rules hold. Repeated rows are judged alike; repeated labels weigh repeatedly, and
    ids that have labels of both kinds count for both; a label without an id is no label.
    """
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.count_if(F.col("quality") == 0).alias("label_bad"), F.count_if(F.col("quality") != 0).alias("label_good"))
    share = min(1.0, max_labelled / max(given.count(), 1))
    # One row a labelled id, about max_labelled at most, and so fit to be sent to every task: no text is shuffled for it.
    given = F.broadcast(given.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labelled = text_counts(own.join(given, own["doc_id"] == given["label_id"], "left_semi")).join(given, F.col("doc_id") == F.col("label_id"))
    kinds = F.inline(F.array(*(F.struct(F.lit(bad).alias("bad"), F.col(n).alias("weight")) for bad, n in ((True, "label_bad"), (False, "label_good")))))
    labelled = labelled.drop("label_id").select("*", kinds).where("weight > 0")
    rules = learn(labelled, **learner)
    counted = text_counts(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), (~failed & decision_list(rules)).alias("kept"))


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    """All whole texts of ``documents``, with rules learned from ``labels``; odd rows as in quality_rules."""
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
