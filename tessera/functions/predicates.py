"""Event and row predicates as Columns, two-valued: a predicate on missing data is true or false, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    """As a double; null and empty text are 0, other text that is no number is null."""
    text = c.cast("string")
    return F.when(c.isNull() | (text == ""), F.lit(0.0)).otherwise(text.try_cast("double"))


def _compare(c: Column, value, how) -> Column:
    return F.coalesce(how(_number(c), _number(F.lit(value))), F.lit(False))


def _listed(c: Column, value) -> Column:
    if not isinstance(value, (list, tuple, set)):
        return F.lit(False)
    some = [v for v in value if v is not None]
    return F.coalesce(c.isin(some), F.lit(False)) | (c.isNull() if len(some) < len(list(value)) else F.lit(False))


OPERATORS = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: _compare(c, v, lambda a, b: a > b),
    "gte": lambda c, v: _compare(c, v, lambda a, b: a >= b),
    "lt": lambda c, v: _compare(c, v, lambda a, b: a < b),
    "lte": lambda c, v: _compare(c, v, lambda a, b: a <= b),
    "in": _listed,
    "not_in": lambda c, v: ~_listed(c, v),
    "exists": lambda c, v: c.isNotNull(),
    "not_exists": lambda c, v: c.isNull(),
    "contains": lambda c, v: F.coalesce(F.contains(c.cast("string"), F.lit(str(v))), F.lit(False)),
}


def condition(field: str, op: str, value=None) -> Column:
    """One condition. An unknown operator is an error when the plan is built."""
    if op not in OPERATORS:
        raise ValueError(f"no operator {op!r}")
    return OPERATORS[op](F.col(field), value)


def rule(conditions: list[tuple], enabled: bool = True) -> Column:
    """All conditions (field, op, value); none: true. A disabled rule is false."""
    return reduce(lambda a, b: a & b, (condition(*c) for c in conditions), F.lit(True)) if enabled else F.lit(False)


def starts_with_pattern(c: Column, pattern: str) -> Column:
    """Whether the text begins with a match of the pattern; a missing text passes."""
    return F.coalesce(c.rlike(f"^(?:{pattern})"), F.lit(True))


def constraint(kind: str, field: str, *args) -> Column:
    """A row constraint as a condition that holds for valid rows. Missing values fail "required" alone."""
    c = F.col(field)
    holds = {
        "required": lambda: c.isNotNull(),
        "pattern": lambda: c.rlike(f"^(?:{args[0]})"),
        "min": lambda: c >= args[0],
        "max": lambda: c <= args[0],
        "range": lambda: c.between(*args),
        "min_length": lambda: F.length(c) >= args[0],
        "max_length": lambda: F.length(c) <= args[0],
        "enum": lambda: c.isin(*args),
        "not_enum": lambda: ~c.isin(*args),
        "multiple_of": lambda: c % args[0] == 0,
        "positive": lambda: c > 0,
        "before": lambda: c < F.lit(args[0]).cast("timestamp"),
        "after": lambda: c > F.lit(args[0]).cast("timestamp"),
        "check": lambda: F.expr(args[0]),
        "not_null": lambda: c.isNotNull(),
        "length": lambda: F.length(c) == args[0],
        "min_inclusive": lambda: c >= args[0],
        "max_inclusive": lambda: c <= args[0],
        "min_exclusive": lambda: c > args[0],
        "max_exclusive": lambda: c < args[0],
        "total_digits": lambda: F.length(F.regexp_replace(c.cast("string"), r"\D|^[-0.]+", "")) <= args[0],
        "fraction_digits": lambda: F.length(F.regexp_extract(c.cast("string"), r"\.(\d*?)0*$", 1)) <= args[0],
        "white_space": lambda: c == {"replace": F.regexp_replace(c, r"[\t\n\r]", " "), "collapse": F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))}[args[0]],
        "must": lambda: F.expr(args[0]),
        "when": lambda: ~F.coalesce(F.expr(args[0]), F.lit(False)) | F.expr(args[1]),
        "some_values_from": lambda: F.exists(c, lambda x: x.isin(*args)),
        "all_values_from": lambda: F.forall(c, lambda x: x.isin(*args)),
        "min_cardinality": lambda: F.size(c) >= args[0],
    }
    if kind not in holds:
        raise ValueError(f"no constraint {kind!r}")
    return F.coalesce(holds[kind](), F.lit(kind not in ("required", "not_null")))


def key_violations(df: DataFrame, kind: str, keys: list[str], other: DataFrame | None = None, other_keys: list[str] | None = None) -> DataFrame:
    """The keys that break a constraint of a table, with how many rows have each.

    primary_key: null in part or repeated; unique: repeated, nulls don't count; foreign_key: not among the other table's keys, nulls don't count.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    if kind == "primary_key":
        return counted.where(missing | (F.col("n") > 1))
    if kind == "unique":
        return counted.where(~missing & (F.col("n") > 1))
    if kind == "foreign_key":
        known = other.select(*(F.col(o).alias(k) for o, k in zip(other_keys or keys, keys, strict=True))).distinct()
        return counted.where(~missing).join(known, keys, "left_anti")
    raise ValueError(f"no constraint of a table {kind!r}")


# --- spreadsheets: filters and formats ---------------------------------------------------------------------------------


def _period(unit: str, n: int, d: Column, now: Column) -> Column:
    """Whether d lies in the n-th period from now's; weeks begin on Monday."""
    begin = F.date_trunc(unit, now)
    shifted = F.date_add(begin.cast("date"), 7 * n) if unit == "week" else F.add_months(begin.cast("date"), n * {"month": 1, "quarter": 3, "year": 12}[unit])
    return F.date_trunc(unit, d) == shifted.cast("timestamp")


#: Filters relative to a clock: fixed names.
PERIODS = {f"{word}{unit.capitalize()}": (unit, n) for word, n in (("last", -1), ("this", 0), ("next", 1)) for unit in ("week", "month", "quarter", "year")}
DAYS = {"yesterday": -1, "today": 0, "tomorrow": 1}


def dynamic_filter(kind: str, value: Column, now: Column | None = None, mean: Column | None = None) -> Column:
    """One of the 18 dynamic filters: of dates relative to ``now``, or of numbers relative to the column's ``mean``. Missing values pass none."""
    if kind in PERIODS:
        out = _period(*PERIODS[kind], value, now)
    elif kind in DAYS:
        out = F.datediff(value, now) == DAYS[kind]
    elif kind == "yearToDate":
        out = (F.date_trunc("year", value) == F.date_trunc("year", now)) & (value <= now)
    elif kind in ("aboveAverage", "belowAverage"):
        out = value > mean if kind == "aboveAverage" else value < mean
    else:
        raise ValueError(f"no filter {kind!r}")
    return F.coalesce(out, F.lit(False))


ERRORS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"]  # fixed values

#: cell comparisons: fixed names
CELL_IS = {
    "lessThan": lambda c, a: c < a, "lessThanOrEqual": lambda c, a: c <= a, "greaterThan": lambda c, a: c > a, "greaterThanOrEqual": lambda c, a: c >= a, "equal": lambda c, a: c == a, "notEqual": lambda c, a: c != a,
    "between": lambda c, a, b: c.between(a, b), "notBetween": lambda c, a, b: ~c.between(a, b),
}
FORMATS = {
    "containsText": lambda c, a: F.contains(c, F.lit(a)), "notContainsText": lambda c, a: ~F.contains(c, F.lit(a)), "beginsWith": lambda c, a: F.startswith(c, F.lit(a)), "endsWith": lambda c, a: F.endswith(c, F.lit(a)),
    "containsBlanks": lambda c: c.isNull() | (F.trim(c.cast("string")) == ""), "notContainsBlanks": lambda c: c.isNotNull() & (F.trim(c.cast("string")) != ""),
    "containsErrors": lambda c: c.cast("string").isin(*ERRORS), "notContainsErrors": lambda c: ~F.coalesce(c.cast("string").isin(*ERRORS), F.lit(False)),
}


def cell_format(kind: str, c: Column, *args) -> Column:
    """Whether a conditional format of a cell by itself applies; a missing value takes none but those of blanks and errors."""
    if kind == "cellIs":
        return F.coalesce(CELL_IS[args[0]](c, *args[1:]), F.lit(False))
    if kind == "expression":
        return F.coalesce(F.expr(args[0]), F.lit(False))
    if kind == "timePeriod":
        return F.coalesce(dynamic_filter(args[0], c, *args[1:]), F.lit(False))
    return F.coalesce(FORMATS[kind](c, *args), F.lit(False))


def scaled(c: Column, low: Column, high: Column) -> Column:
    """Where a value lies between the least and the most, 0 to 1: what data bars and colour scales show."""
    return F.coalesce(F.try_divide(c - low, high - low), F.lit(0.0))


def icon(c: Column, low: Column, high: Column, icons: int = 3) -> Column:
    """The icon's number: equal shares of the span."""
    return F.least(F.lit(icons - 1), F.floor(scaled(c, low, high) * icons)).cast("int")
