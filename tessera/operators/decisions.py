"""Decision tables compiled to Columns: unary tests, hit policies, collect aggregations, boxed contexts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?"


def unary_test(c: Column, test: str) -> Column:
    """-, * and empty: anything. [1..5], (1..5), [1..5): ranges. <, <=, >, >= n. a, b or [a, b]: any of. not(...). Else equality as text."""
    test = test.strip()
    if test in ("", "-", "*"):
        return F.lit(True)
    if m := re.fullmatch(r"not\((.*)\)", test):
        return ~unary_test(c, m[1])
    if m := re.fullmatch(rf"([\[(])\s*({_NUMBER})\s*(?:\.\.|,)\s*({_NUMBER})\s*([\])])", test):
        if ".." in test or m[1] == "(" or m[4] == ")":
            low = c > float(m[2]) if m[1] == "(" else c >= float(m[2])
            return low & (c < float(m[3]) if m[4] == ")" else c <= float(m[3]))
    if m := re.fullmatch(rf"(<=|>=|<|>)\s*({_NUMBER})", test):
        x = float(m[2])
        return {"<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[m[1]]
    if m := re.fullmatch(r"\[(.*)\]", test):
        test = m[1]
    wanted = [x.strip().strip('"') for x in test.split(",")]
    return c.cast("string").isin(wanted)


@dataclass(frozen=True)
class DecisionRule:
    tests: dict[str, str]
    output: str
    priority: int = 0


class DecisionTable:
    """Rules over input columns. A missing input matches only what matches anything."""

    def __init__(self, rules: list[DecisionRule], default: str | None = None):
        self.rules, self.default = rules, default

    def matches(self) -> Column:
        """Array of (rule, priority, output) of the rules that match, in rule order."""
        def one(i: int, r: DecisionRule) -> Column:
            hit = reduce(lambda a, b: a & b, (F.coalesce(unary_test(F.col(k), v), F.lit(False)) for k, v in r.tests.items()), F.lit(True))
            return F.when(hit, F.struct(F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.output).alias("output")))

        return F.filter(F.array(*(one(i, r) for i, r in enumerate(self.rules))), lambda x: x.isNotNull())

    def decide(self, policy: str) -> Column:
        """UNIQUE, ANY: the first match. FIRST, PRIORITY: the highest priority, of equals the first. COLLECT, RULE_ORDER: all in rule order. OUTPUT_ORDER: all by ascending priority."""
        hits, default = self.matches(), F.lit(self.default).cast("string")
        if policy in ("UNIQUE", "ANY"):
            return F.coalesce(F.get(hits, 0)["output"], default)
        ranked = F.array_sort(F.transform(hits, lambda x: F.struct((-x["priority"]).alias("p"), x["rule"].alias("r"), x["output"].alias("o"))))
        if policy in ("FIRST", "PRIORITY"):
            return F.coalesce(F.get(ranked, 0)["o"], default)
        if policy in ("COLLECT", "RULE_ORDER"):
            return F.array_join(F.transform(hits, lambda x: x["output"]), ",")
        if policy == "OUTPUT_ORDER":
            up = F.array_sort(F.transform(hits, lambda x: F.struct(x["priority"].alias("p"), x["rule"].alias("r"), x["output"].alias("o"))))
            return F.array_join(F.transform(up, lambda x: x["o"]), ",")
        raise ValueError(f"no hit policy {policy!r}")

    def collect(self, symbol: str, standard: bool = False) -> Column:
        """Aggregates the numeric outputs. Here C+ lists, C# adds, C< and C> take the least and the most, CC counts; ``standard`` gives C+ the sum and C# the count."""
        xs = F.filter(F.transform(self.matches(), lambda x: x["output"].try_cast("double")), lambda x: x.isNotNull())
        total = F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x))
        count = F.size(xs).cast("double")
        how = {"C+": total if standard else None, "C#": count if standard else total, "C<": F.array_min(xs), "C>": F.array_max(xs), "CC": count}
        if symbol not in how:
            raise ValueError(f"no aggregation {symbol!r}")
        return F.array_join(xs.cast("array<string>"), ",") if how[symbol] is None else how[symbol]


def boxed_context(df: DataFrame, entries: dict[str, Column]) -> DataFrame:
    """Entries in order, earlier ones visible to later ones."""
    for name, value in entries.items():
        df = df.withColumn(name, value)
    return df


def decision_order(needs: dict[str, list[str]]) -> list[str]:
    """Decisions after what they need; a cycle is an error."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter({k: sorted(v) for k, v in sorted(needs.items())}).static_order())
