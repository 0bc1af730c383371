"""Vector and token-set expressions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def tokens(text: Column) -> Column:
    """Case-folded tokens between white space."""
    return F.filter(F.split(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[ \t\n\r\f]+"), lambda x: x != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; lambdas share no subexpressions otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_cells(text: Column, dims: int = 128) -> Column:
    """Array of (dim, v), v a signed count of the tokens by hash, not 0: the first 8 hex digits of SHA-256 give the cell and the next two the sign.

    A token becomes cell * 2, plus 1 for a minus; sorted, a cell's tokens are neighbours.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f]+"), lambda x: x != "")
    digit = lambda d, i: F.position(F.substring(d, i, 1), F.lit("0123456789abcdef")) - 1
    # Of the first 8 digits only the last two matter where dims divides 256; of the next two only the last one tells odd from even.
    at = (lambda d: (digit(d, 7) * 16 + digit(d, 8)) % dims) if 256 % dims == 0 else (lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long") % dims)
    codes = F.transform(words, lambda w: let(F.sha2(w, 256), lambda d: (at(d) * 2 + digit(d, 10) % 2).cast("int")))
    cell = lambda x: F.shiftright(x, 1)

    def summed(s: Column, starts: Column) -> Column:
        run = lambda i, k: F.slice(s, i + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - i)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + 1 - 2 * (x % 2))
        return F.filter(F.transform(starts, lambda i, k: F.struct(cell(F.get(s, i)).alias("dim"), total(run(i, k)).alias("v"))), lambda x: x["v"] != 0)

    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (cell(F.get(s, i)) != cell(F.get(s, F.greatest(i - 1, F.lit(0))))))
    found = let(F.array_sort(codes), lambda s: F.when(F.size(s) > 0, let(starts(s), lambda st: summed(s, st))))
    return F.coalesce(found, F.array().cast("array<struct<dim:int,v:double>>"))


def cells_norm(cells: Column) -> Column:
    return F.sqrt(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))


def cells_cosine(cells: Column, vector: Column, length: Column | None = None) -> Column:
    """Of hash_cells and a dense vector, whose ``length`` may be given; 0 where either has no length. The cells are computed once."""
    dot = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["v"] * F.get(vector, x["dim"]))
    whole = norm(vector) if length is None else length
    return let(cells, lambda c: F.coalesce(F.try_divide(dot(c), cells_norm(c) * whole), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def rerank_score(query: Column, text: Column, contains: Column) -> Column:
    """Recall, precision, phrase and overlap of query and text tokens: weights .45, .3, .15 and up to .2, to six digits."""
    q, d = F.array_distinct(query), F.array_distinct(text)
    both = F.size(F.array_intersect(q, d)).cast("double")
    recall, precision = F.coalesce(F.try_divide(both, F.size(q)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(d)), F.lit(0.0))
    dense = F.least(F.lit(0.2), F.coalesce(F.try_divide(both, F.sqrt(F.size(text).cast("double"))), F.lit(0.0)))
    return F.round(0.45 * recall + 0.3 * precision + F.when(contains, 0.15).otherwise(0.0) + dense, 6)


def softmax(weights: list[float]) -> list[float]:
    import math

    e = [math.exp(w - max(weights)) for w in weights]
    return [x / sum(e) for x in e]


def folded(items: Column, done_type: str, opened: Column, step, last, block: int = 512) -> Column:
    """What a fold over an array closes on its way: ``step(a, x)`` gives (done, open) from a state with these fields, ``last(open)`` an array of what is left at the end.

    Spark copies a fold's whole state at every step, so the steps are taken in blocks that begin with nothing done, and
    only the blocks' results are gathered over the whole array.
    """
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    none = F.array().cast(f"array<{done_type}>")

    def over(values: Column) -> Column:
        def add(a: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(values, k * block + 1, block), state(none, a["open"]), step)
            return let(part, lambda r: state(F.concat(a["done"], F.array(r["done"])), r["open"]))

        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block) - 1, F.lit(0)).cast("int"))
        return F.aggregate(blocks, state(F.array().cast(f"array<array<{done_type}>>"), opened), add, lambda a: F.concat(F.flatten(a["done"]), last(a["open"])))

    return let(items, over)
