"""The functions of the decision expression language as Columns; arguments are Columns, types are known when a plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F



def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """With the divisor's sign."""
    return a - b * F.floor(a / b)


def round_even(n: Column, digits: int = 0) -> Column:
    return F.bround(n, digits)


def sqrt(n: Column) -> Column:
    return F.when(n >= 0, F.sqrt(n))


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, _total(xs) / F.size(xs))


def total(xs: Column) -> Column:
    return _total(xs)


def contains(s: Column, sub: Column) -> Column:
    return F.coalesce((s != "") & F.contains(s, sub), F.lit(False))


def string_length(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def trim(s: Column) -> Column:
    """All white space at the ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def substring_before(s: Column, m: Column) -> Column:
    return F.when(F.contains(s, m), F.call_function("substring_index", s, m, F.lit(1))).otherwise("")


def substring_after(s: Column, m: str) -> Column:
    """What follows the first match, up to the next one."""
    return F.coalesce(F.get(F.split(s, re.escape(m)), 1), F.lit(""))


def list_contains(xs: Column, v) -> Column:
    return F.coalesce(F.array_contains(xs, v), F.lit(False))


def week_of_year(d: Column) -> Column:
    """Weeks begin on Monday; days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("long")


def day_of_week(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def insert_before(xs: Column, pos: int, item: Column) -> Column:
    return F.array_insert(xs, pos, item)


def remove(xs: Column, pos: int) -> Column:
    return F.filter(xs, lambda _, i: i != pos - 1)


def sublist(xs: Column, start: int, length: int) -> Column:
    return F.slice(xs, start, length)


def flatten(xs: Column) -> Column:
    return F.flatten(xs)


def number(s: Column, group: str = ",", decimal: str = ".") -> Column:
    """A double from text with grouping and decimal marks; null if it is none."""
    return F.replace(F.replace(s, F.lit(group), F.lit("")), F.lit(decimal), F.lit(".")).try_cast("double")


def item(xs: Column, i: int) -> Column:
    """1-based; out of range is null."""
    return F.get(xs, i - 1) if i > 0 else F.lit(None)


def in_range(x: Column, low, high, open_low: bool = False, open_high: bool = False) -> Column:
    return (x > low if open_low else x >= low) & (x < high if open_high else x <= high)


def for_return(xs: Column, f) -> Column:
    return F.transform(xs, f)


def some(xs: Column, f) -> Column:
    return F.exists(xs, f)


def every(xs: Column, f) -> Column:
    return F.forall(xs, f)


def duration(text: Column) -> Column:
    """PnYnMnDTnHnMnS as a map of its parts."""
    part = lambda p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0))
    names = {"years": r"^P(?:.*?)?(\d+)Y", "months": r"^P[^T]*?(\d+)M", "days": r"(\d+)D", "hours": r"T.*?(\d+)H", "minutes": r"T.*?(\d+)M", "seconds": r"T.*?(\d+)S"}
    return F.create_map(*(x for n, p in names.items() for x in (F.lit(n), part(p))))


# --- types, clock, contexts ------------------------------------------------------------------------------------------


def not_(v: Column) -> Column:
    """True for false, null, 0 and empty text; a Column of another type than boolean is compared with its empty value."""
    kind = F.typeof(v)
    text = v.cast("string")
    return F.when(v.isNull(), True).when(kind == "boolean", text == "false").when(kind == "string", text == "").when(kind.rlike(_NUMBERS), text.try_cast("double") == 0).otherwise(False)


def is_defined(v: Column) -> Column:
    return v.isNotNull()


def is_null(v: Column) -> Column:
    return v.isNull()


_NUMBERS = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
_KINDS = {
    "number": _NUMBERS, "string": "^string$", "boolean": "^boolean$", "list": "^array", "context": "^(struct|map|object)", "date": "^date$", "time": "^time", "date and time": "^timestamp", "duration": "^interval",
}


def _is(kind: str, v: Column, variant: bool) -> Column:
    """By the column's type, or for a variant by each value's own."""
    found = F.lower(F.schema_of_variant(v)) if variant else F.typeof(v)
    return v.isNotNull() & F.coalesce(found.rlike(_KINDS[kind]), F.lit(False))


def is_number(v: Column, variant: bool = False) -> Column:
    return _is("number", v, variant)


def is_string(v: Column, variant: bool = False) -> Column:
    return _is("string", v, variant)


def is_boolean(v: Column, variant: bool = False) -> Column:
    return _is("boolean", v, variant)


def is_list(v: Column, variant: bool = False) -> Column:
    return _is("list", v, variant)


def is_context(v: Column, variant: bool = False) -> Column:
    return _is("context", v, variant)


def instance_of(v: Column, kind: str, variant: bool = False) -> Column:
    """Whether a value is of a kind; an unknown kind is none that anything is of."""
    return _is(kind.lower(), v, variant) if kind.lower() in _KINDS else F.lit(False)


def now() -> Column:
    """The query's time as ISO text; one query has one time."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def context(**entries: Column) -> Column:
    """{k: v} as a struct."""
    return F.struct(*(v.alias(k) for k, v in entries.items()))


def matching(xs: Column, **wanted) -> Column:
    """The contexts of a list whose entries equal the wanted ones."""
    return F.filter(xs, lambda x: F.forall(F.array(*(x[k].eqNullSafe(v if isinstance(v, Column) else F.lit(v)) for k, v in wanted.items())), lambda b: b) if wanted else F.lit(True))


def sorted_by(xs: Column, precedes) -> Column:
    """By what ``precedes`` gives for an element, then by the element."""
    return F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(precedes(x).alias("p"), x.alias("x")))), lambda s: s["x"])


class Functions:
    """Functions of the expression language by name, with named parameters; a body is a Python function of Columns."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[str, ...], object]] = {}

    def define(self, name: str, parameters: tuple[str, ...], body) -> None:
        self.known[name] = (parameters, body)

    def invoke(self, name: str, **bindings: Column) -> Column:
        """A parameter without a binding is null; an unknown one is an error."""
        if name not in self.known:
            raise KeyError(f"no function {name!r}")
        parameters, body = self.known[name]
        if extra := set(bindings) - set(parameters):
            raise ValueError(f"{name} has no parameters {sorted(extra)}")
        return body(*(bindings.get(p, F.lit(None)) for p in parameters))
