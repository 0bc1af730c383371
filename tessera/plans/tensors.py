"""Operators of model graphs over nations, line items, parts and embeddings. Vectors are reported by the sum of value times place, which tells order and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import draws as D
from ..functions import grids as G2
from ..functions import spectra as SP
from ..functions import tensors as X


def _mark(x: Column) -> Column:
    return F.round(F.aggregate(F.transform(x, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5)


def _sql_mark(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda v, i: cast(v AS DOUBLE) * i)), 5)"


_ERF = "(sign({0}) * (1 - (({1}) * (0.254829592 + ({1}) * (-0.284496736 + ({1}) * (1.421413741 + ({1}) * (-1.453152027 + ({1}) * 1.061405429))))) * exp(-({0}) * ({0}))))"
_erf = lambda x: _ERF.format(x, f"1 / (1 + 0.3275911::DOUBLE * abs({x}))")
_UNARY = {
    "acos": "acos(x)", "acosh": "acosh(1 + abs(x))", "asin": "asin(x)", "asinh": "asinh(x)", "atan": "atan(x)", "atanh": "atanh(x)", "cos": "cos(x)", "cosh": "cosh(x)", "sin": "sin(x)", "sinh": "sinh(x)", "tan": "tan(x)", "tanh": "tanh(x)", "exp": "exp(x)", "log": "ln(2 + x)",
    "erf": _erf("x"), "gelu": f"0.5 * x * (1 + {_erf('(x / sqrt(2::DOUBLE))')})", "shrink": "CASE WHEN x < -0.5 OR x > 0.5 THEN x ELSE 0 END", "neg": "-x", "ceil": "ceil(x)", "floor": "floor(x)", "round": "round_even(x * 9, 0)", "sign": "sign(x)",
}
_INSIDE = {"acosh": lambda x: 1 + F.abs(x), "log": lambda x: 2 + x, "round": lambda x: x * 9}


@query("tensor_unary", "SELECT n_nationkey, " + ", ".join(f"round(cast({e} AS DOUBLE), 6) + 0.0 AS {n}_" for n, e in _UNARY.items()) + ", isnan(CASE WHEN n_nationkey % 5 = 0 THEN 'nan'::DOUBLE ELSE x END) AS is_nan_, isinf(CASE WHEN n_nationkey % 4 = 0 THEN '-inf'::DOUBLE ELSE x END) AS is_inf_ FROM (SELECT n_nationkey, (n_nationkey - 12) / 13.0::DOUBLE AS x FROM nation)")
def tensor_unary(t):
    x, k = (F.col("n_nationkey") - 12) / F.lit(13.0), F.col("n_nationkey")
    odd = lambda every, v: F.when(k % every == 0, F.lit(float(v))).otherwise(x)
    values = (F.round(X.UNARY[n](_INSIDE.get(n, lambda v: v)(x)).cast("double"), 6) + 0.0 for n in _UNARY)
    return t.nation.select("n_nationkey", *(v.alias(f"{n}_") for n, v in zip(_UNARY, values, strict=True)), X.UNARY["is_nan"](odd(5, "nan")).alias("is_nan_"), X.UNARY["is_inf"](odd(4, "-inf")).alias("is_inf_"))


_BINARY = {
    "add": "a + b", "sub": "a - b", "mul": "a * b", "div": "a / nullif(b, 0)", "pow": "pow(a, b)", "mod": "a - b * floor(a / b)", "max": "greatest(a, b)", "min": "least(a, b)", "mean": "(a + b) / 2", "prelu": "CASE WHEN a >= 0 THEN a ELSE a * b END",
    "equal": "a = b", "greater": "a > b", "less": "a < b", "xor": "(a > 0) <> (b > 0)", "and": "a > 0 AND b > 0", "or": "a > 0 OR b > 0",
}
_TRUE = ("equal", "greater", "less", "xor", "and", "or")


@query("tensor_binary", "SELECT p_partkey, " + ", ".join(f"{e} AS {n}_" if n in _TRUE else f"round({e}, 6) AS {n}_" for n, e in _BINARY.items()) + ", cast(greatest(-128, least(127, round_even(a * 10 / 0.25, 0) + 3)) AS INTEGER) AS quantized, round((greatest(-128, least(127, round_even(a * 10 / 0.25, 0) + 3)) - 3) * 0.25, 6) AS back, p_size << 2 AS shifted, p_size >> 1 AS halved FROM (SELECT p_partkey, p_size, (p_size % 7 - 3) / 2.0::DOUBLE AS a, (p_partkey % 5 + 1) / 1.0::DOUBLE AS b FROM part)")
def tensor_binary(t):
    a, b = (F.col("p_size") % 7 - 3) / F.lit(2.0), (F.col("p_partkey") % 5 + 1) / F.lit(1.0)
    own = {n: X.BINARY[n](a, b) if n in _TRUE else F.round(X.BINARY[n](a, b), 6) for n in _BINARY}
    q = X.quantize_linear(a * 10, 0.25, 3)
    return t.part.select("p_partkey", *(c.alias(f"{n}_") for n, c in own.items()), q.alias("quantized"), F.round(X.dequantize_linear(q, 0.25, 3), 6).alias("back"), X.bit_shift(F.col("p_size"), 2).alias("shifted"), X.bit_shift(F.col("p_size"), -1).alias("halved"))


_E = "(SELECT vec_id, embedding::DOUBLE[] AS e, list_max(embedding::DOUBLE[]) AS mx, list_avg(embedding::DOUBLE[]) AS mean, len(embedding) AS n FROM embeddings)"
_LSE = "(mx + ln(list_sum(list_transform(e, lambda x: exp(x - mx)))))"
_VAR = "list_avg(list_transform(e, lambda x: (x - mean) * (x - mean)))"
_VECTOR = {
    "softmax": _sql_mark(f"list_transform(e, lambda x: exp(x - {_LSE}))"), "log_softmax": _sql_mark(f"list_transform(e, lambda x: x - {_LSE})"), "hardmax": "cast(list_position(e, mx) AS DOUBLE)", "log_sum_exp": f"round({_LSE}, 6)",
    "log_sum": "round(ln(list_sum(list_transform(e, lambda x: abs(x)))), 6)", "sum_square": "round(list_sum(list_transform(e, lambda x: x * x)), 6)", "prod": "round(list_product(list_transform(e, lambda x: 1 + x / 10)), 6)",
    "cum_sum": _sql_mark("list_transform(e, lambda x, i: list_sum(e[1:i]))"), "cum_prod": _sql_mark("list_transform(e, lambda x, i: list_product(list_transform(e[1:i], lambda y: 1 + y / 10)))"),
    "layer": _sql_mark(f"list_transform(e, lambda x: (x - mean) / sqrt({_VAR} + 0.00001))"), "rms": _sql_mark("list_transform(e, lambda x: x / sqrt(list_avg(list_transform(e, lambda y: y * y)) + 0.00001))"), "l2": _sql_mark("list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))"), "l1": _sql_mark("list_transform(e, lambda x: x / list_sum(list_transform(e, lambda y: abs(y))))"),
    "top": _sql_mark("list_reverse_sort(e)[1:5]"), "gathered": _sql_mark("[e[1], e[-1], e[4]]"), "padded": _sql_mark("list_concat([7, 7], e, [7])"), "tiled": _sql_mark("list_concat(e, e)"), "scattered": _sql_mark("list_concat([e[1], 9.0], e[3:])"),
    "compressed": _sql_mark("list_filter(e, lambda x: x > 0)"), "places": "cast(list_sum(list_transform(list_filter(range(0, n), lambda i: e[i + 1] > 0.1), lambda i: i)) AS DOUBLE)", "turned": _sql_mark("list_concat(list_reverse(e[1:5]), e[6:])"),
    "max_pool": _sql_mark("list_transform(range(0, (n - 4) // 2 + 1), lambda i: list_max(e[i * 2 + 1:i * 2 + 4]))"), "average_pool": _sql_mark("list_transform(range(0, (n - 4) // 2 + 1), lambda i: list_avg(e[i * 2 + 1:i * 2 + 4]))"), "lp_pool": _sql_mark("list_transform(range(0, (n - 4) // 2 + 1), lambda i: sqrt(list_sum(list_transform(e[i * 2 + 1:i * 2 + 4], lambda x: x * x))))"),
    "convolved": _sql_mark("list_transform(range(0, n - 2), lambda i: 0.5 * e[i + 1] - e[i + 2] + 2 * e[i + 3] + 0.1)"), "loss": f"round({_LSE} - e[vec_id % 3 + 1], 6)", "split_at": _sql_mark("e[cast(ceil(n / 3) AS BIGINT) + 1:2 * cast(ceil(n / 3) AS BIGINT)]"), "global_lp": "round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6)",
    "scale": "round((greatest(0, mx) - least(0, list_min(e))) / 255, 8)", "lrn": _sql_mark("list_transform(e, lambda x, i: x / pow(1 + 0.0001 / 3 * list_sum(list_transform(e[greatest(i - 1, 1):i + 1], lambda y: y * y)), 0.75))"),
}


@query("tensor_vectors", "SELECT vec_id, " + ", ".join(f"{e} AS {n}" for n, e in _VECTOR.items()) + f" FROM {_E}")
def tensor_vectors(t):
    e = F.col("e")
    r = lambda c, n=6: F.round(c, n)
    near = F.transform(e, lambda v: 1 + v / 10)
    made = {
        "softmax": _mark(X.softmax(e)), "log_softmax": _mark(X.log_softmax(e)), "hardmax": _mark(X.hardmax(e)), "log_sum_exp": r(X.reduce_log_sum_exp(e)), "log_sum": r(F.log(X.total(F.transform(e, F.abs)))), "sum_square": r(X.total(F.transform(e, lambda v: v * v))),
        "prod": r(F.aggregate(near, F.lit(1.0), lambda a, v: a * v)), "cum_sum": _mark(X.cum_sum(e)), "cum_prod": _mark(X.cum_prod(near)), "layer": _mark(X.layer_normalization(e)), "rms": _mark(X.rms_normalization(e)), "l2": _mark(X.lp_normalization(e)), "l1": _mark(X.lp_normalization(e, 1)),
        "top": _mark(X.top_k(e, 5)), "gathered": _mark(X.gather(e, [0, -1, 3])), "padded": _mark(X.pad(e, 2, 1, 7.0)), "tiled": _mark(X.tile(e, 2)), "scattered": _mark(X.scatter(e, {1: 9.0})), "compressed": _mark(X.compress(e, F.transform(e, lambda v: v > 0))),
        "places": X.total(F.transform(X.non_zero(F.transform(e, lambda v: F.when(v > 0.1, 1.0).otherwise(0.0))), lambda i: i.cast("double"))), "turned": _mark(X.reverse_sequence(e, F.lit(5))),
        "max_pool": _mark(X.pooled(e, 4, 2, "max")), "average_pool": _mark(X.pooled(e, 4, 2, "average")), "lp_pool": _mark(X.pooled(e, 4, 2, "lp")), "convolved": _mark(X.convolved(e, [0.5, -1.0, 2.0], bias=0.1)), "loss": r(X.softmax_cross_entropy(e, (F.col("vec_id") % 3).cast("int"))),
        "split_at": _mark(F.get(X.split(e, 3), 1)), "global_lp": r(X.global_pool(e, "lp")), "scale": r(X.dynamic_quantize_linear(e)["scale"], 8), "lrn": _mark(X.local_response_normalization(e)),
    }
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", *(made[n].alias(n) for n in _VECTOR))


_M = "SELECT p_partkey, (p_size % 7)::DOUBLE AS a, (p_partkey % 5 + 1)::DOUBLE AS b, (p_size % 3 - 1)::DOUBLE AS c, (p_partkey % 4 + 2)::DOUBLE AS d FROM part"


@query("tensor_matrices", f"""SELECT p_partkey, a * 1 + 2 * (b * 3) + 3 * (a * 2 + b * 1) AS times_rows, (a + b * 2) + 3 * (c + d * 2) + 2 * (a * 3 + b * 4) + 4 * (c * 3 + d * 4) AS product, 0.5 * (a + b * 2) + 1 AS gemm_, a * d - b * c AS det2, a * (d * 2 - 1) - b * (c * 2 - 3) + 4 * (c - d * 3) AS det3, a + 2 * c + 3 * b + 4 * d AS turned,
a + 2 * b + 3 * 0 + 4 * d AS upper_, a + 2 * 0 + 3 * c + 4 * d AS lower_, a * c + 2 * a * d + 3 * b * c + 4 * b * d AS outer_, 1 + 2 * 0 + 3 * 0 + 4 * 1.0::DOUBLE AS eye_, a + 2 * b + 3 * c + 4 * d AS reshaped_ FROM ({_M})""")
def tensor_matrices(t):
    a, b, c, d = (F.col("p_size") % 7).cast("double"), (F.col("p_partkey") % 5 + 1).cast("double"), (F.col("p_size") % 3 - 1).cast("double"), (F.col("p_partkey") % 4 + 2).cast("double")
    two = F.array(F.array(a, b), F.array(c, d))
    three = F.array(F.array(a, b, F.lit(4.0)), F.array(c, d, F.lit(1.0)), F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)))
    flat = lambda m: F.aggregate(F.transform(F.flatten(m), lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    product = X.transposed(X.matmul(two, X.matrix([[1, 3], [2, 4]])))
    # ordered by columns: row 1 column 1, row 2 column 1, row 1 column 2, row 2 column 2
    weigh = F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0), F.lit(4.0))
    total = F.aggregate(F.zip_with(F.flatten(product), weigh, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)
    return t.part.select(
        "p_partkey", flat(X.matmul(F.array(F.array(a, b)), X.matrix([[1, 0, 2], [0, 3, 1]]))).alias("times_rows"), total.alias("product"), F.get(F.get(X.gemm(two, X.matrix([[1, 3], [2, 4]]), 2.0, 0.5, 0.5), 0), 0).alias("gemm_"),
        X.determinant(two, 2).alias("det2"), X.determinant(three, 3).alias("det3"), flat(X.transposed(two)).alias("turned"), flat(X.triangle(two)).alias("upper_"), flat(X.triangle(two, upper=False)).alias("lower_"),
        flat(X.outer(F.array(a, b), F.array(c, d))).alias("outer_"), flat(X.eye(F.lit(2))).alias("eye_"), flat(X.reshaped(F.array(a, b, c, d), 2)).alias("reshaped_"),
    )


_WINDOW = "list_sum(list_transform(range(0, n), lambda i: ({0} - {1} * cos(2 * pi() * i / n) + {2} * cos(4 * pi() * i / n)) * (i + 1)))"


@query("tensor_text_and_windows", f"""SELECT p_partkey, p_name || '-' || p_brand AS joined, array_to_string(string_split(p_name, ' '), '|') AS parts, regexp_full_match(p_name, '[a-z]+ ring') AS full_, coalesce(nullif(list_position(['red', 'small'], split_part(p_name, ' ', 1)), 0), 0) - 1 AS category, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> 'ring'), lambda w: upper(w)), ' ') AS normal,
2.0::DOUBLE * len(list_filter(string_split(p_name, ' '), lambda w: w = 'ring')) + 0.5::DOUBLE * len(list_filter(string_split(p_name, ' '), lambda w: w = 'red')) AS tf_idf, round({_WINDOW.format('0.5', '0.5', '0.0')}, 5) AS hann, round({_WINDOW.format('25 / 46.0::DOUBLE', '21 / 46.0::DOUBLE', '0.0')}, 5) AS hamming, round({_WINDOW.format('0.42', '0.5', '0.08')}, 5) AS blackman, CASE WHEN p_size % 3 = 1 THEN 1.0::DOUBLE ELSE 0 END + 2 * CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END AS hot, p_size + 10.0::DOUBLE AS vector FROM (SELECT *, p_size % 6 + 2 AS n FROM part)""")
def tensor_text_and_windows(t):
    name, words, n = F.col("p_name"), F.split("p_name", " "), (F.col("p_size") % 6 + 2).cast("int")
    hot = X.one_hot(F.col("p_size") % 3, 3)
    vector = X.dict_vector(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("ten"), F.lit(10.0)), ["size", "none", "ten"])
    return t.part.select(
        "p_partkey", F.concat_ws("-", "p_name", "p_brand").alias("joined"), F.array_join(words, "|").alias("parts"), X.regex_full_match(name, "[a-z]+ ring").alias("full_"), X.category(F.get(words, 0), ["red", "small"]).cast("long").alias("category"),
        F.array_join(X.string_normalized(words, "upper", ["ring"]), " ").alias("normal"), X.total(X.tf_idf(words, {"ring": 2.0, "red": 0.5})).alias("tf_idf"), *(_mark(X.window_values(k, n)).alias(k) for k in ("hann", "hamming", "blackman")),
        (F.get(hot, 1) + 2 * F.get(hot, 2)).alias("hot"), X.total(F.map_values(X.zip_map(vector, ["a", "b", "c"]))).alias("vector"),
    )


_GAUSS = "ln({p}::DOUBLE) - 0.5 * (ln(2 * pi() * {v1}) + ln(2 * pi() * {v2})) - 0.5 * (power(l_discount - {m1}, 2) / {v1} + power(l_tax - {m2}, 2) / {v2})"
_BAYES = [_GAUSS.format(p=0.3, m1=0.02, v1=0.001, m2=0.03, v2=0.002), _GAUSS.format(p=0.7, m1=0.07, v1=0.002, m2=0.05, v2=0.001)]


@query("tensor_models", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_BAYES[0]} >= {_BAYES[1]} THEN 'low' ELSE 'high' END AS bayes, round(x1, 6) AS rnn_, round(l_quantity - 0.1 * (0.9 * 0.5 + l_discount), 6) AS momentum_, round(l_quantity - 0.1 * l_discount / (sqrt(0.25 + l_discount * l_discount) + 0.000001), 6) AS adagrad_, round(l_quantity - 0.01 * sqrt(1 - 0.999::DOUBLE) / (1 - 0.9::DOUBLE) * (0.1 * l_discount) / (sqrt(0.001 * l_discount * l_discount) + 0.00000001), 5) AS adam_,
CASE l_linenumber % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 ELSE 3.5 END::DOUBLE AS embedded, CASE WHEN l_quantity >= 26 THEN l_quantity WHEN l_quantity >= 13 THEN l_quantity * 2 WHEN l_quantity >= 6.5 THEN l_quantity * 4 ELSE l_quantity * 8 END AS looped FROM (SELECT *, tanh(0.5 * l_tax + 0.3 * tanh(0.5 * l_discount + 0.1) + 0.1) AS x1 FROM lineitem)""")
def tensor_models(t):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.array("l_discount", "l_tax")
    steps = F.transform(x, lambda v: F.array(v))
    bayes = X.naive_bayes(x, {"low": (0.3, [0.02, 0.03], [0.001, 0.002]), "high": (0.7, [0.07, 0.05], [0.002, 0.001])})
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", bayes.alias("bayes"), F.round(F.get(X.rnn(steps, [[0.5]], [[0.3]], [0.1]), 0), 6).alias("rnn_"), F.round(X.momentum(q, d, F.lit(0.5), 0.1)["x"], 6).alias("momentum_"),
        F.round(X.adagrad(q, d, F.lit(0.25), 0.1)["x"], 6).alias("adagrad_"), F.round(X.adam(q, d, F.lit(0.0), F.lit(0.0), 1, 0.01)["x"], 5).alias("adam_"), F.get(X.embedding((F.col("l_linenumber") % 3).cast("int"), [[1.5], [2.5], [3.5]]), 0).alias("embedded"),
        X.loop(q, 3, lambda v: v < 26, lambda v, _: v * 2).alias("looped"),
    )


@query("tensor_sequences", "SELECT p_partkey, array_to_string([p_size, 3], ',') AS erased, array_to_string([p_size, 9, 2, 3], ',') AS inserted, array_to_string([p_size, 2], ',') AS popped, array_to_string([p_size, 2, 3, 4], ',') AS pushed, p_size % 2 = 0 AS has_, CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS got, list_sum(list_transform(range(0, p_size + 1), lambda i: i))::BIGINT AS ranged, CASE WHEN p_size > 25 THEN 'then' ELSE 'else' END AS branch FROM part")
def tensor_sequences(t):
    size = F.col("p_size")
    xs = F.array(size, F.lit(2), F.lit(3))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    maybe = F.when(size % 2 == 0, size)
    return t.part.select(
        "p_partkey", text(X.sequence_erase(xs, 1)).alias("erased"), text(X.sequence_insert(xs, F.lit(9), 1)).alias("inserted"), text(X.sequence_pop(xs)).alias("popped"), text(F.array_append(xs, 4)).alias("pushed"), X.optional_has_element(maybe).alias("has_"),
        F.coalesce(maybe, F.lit(-1)).alias("got"), F.aggregate(F.sequence(F.lit(0), size), F.lit(0).cast("long"), lambda a, i: a + i).alias("ranged"), F.when(size > 25, "then").otherwise("else").alias("branch"),
    )


_KERNEL = [[0.5, -1.0, 2.0], [0.0, 3.0, 0.25], [1.0, 1.0, -0.5]]
_TAPS = " + ".join(f"({k}::DOUBLE) * e[(i + {u}) * 8 + j + {v} + 1]" for u, row in enumerate(_KERNEL) for v, k in enumerate(row))


@query("grid_convolution", f"SELECT vec_id, cast(i AS INTEGER) AS i, cast(j AS INTEGER) AS j, round({_TAPS}, 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 6)) AS j)")
def grid_convolution(t):
    """Each vector as a grid of eight rows, under a kernel of three by three."""
    out = t.embeddings.select("vec_id", G2.convolved(X.reshaped(F.col("embedding").cast("array<double>"), 8), _KERNEL).alias("g"))
    return out.select("vec_id", F.posexplode("g").alias("i", "row")).select("vec_id", "i", F.posexplode("row").alias("j", "value")).withColumn("value", F.round("value", 6))


@query("grid_pools", "SELECT vec_id, cast(i AS INTEGER) AS i, cast(j AS INTEGER) AS j, list_max(w) AS largest, round(list_sum(w) / 4, 6) AS mean FROM (SELECT vec_id, i, j, [e[i * 16 + j * 2 + 1], e[i * 16 + j * 2 + 2], e[i * 16 + 8 + j * 2 + 1], e[i * 16 + 8 + j * 2 + 2]] AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j))")
def grid_pools(t):
    grid = t.embeddings.select("vec_id", X.reshaped(F.col("embedding").cast("array<double>"), 8).alias("g"))
    both = grid.select("vec_id", G2.pooled(F.col("g"), (2, 2)).alias("a"), G2.pooled(F.col("g"), (2, 2), how="average").alias("b"))
    cells = both.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "r")).select("vec_id", "i", F.posexplode(F.arrays_zip(F.col("r.a").alias("largest"), F.col("r.b").alias("mean"))).alias("j", "c"))
    return cells.select("vec_id", "i", "j", "c.largest", F.round("c.mean", 6).alias("mean"))


@query("fourier_power", "SELECT vec_id, cast(k AS INTEGER) AS k, round(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2), 6) AS power FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM embeddings), (SELECT unnest(range(0, 33)) AS k) GROUP BY vec_id, k")
def fourier_power(t):
    """The power spectrum of each vector, by a transform in six stages."""
    x = t.embeddings.select("vec_id", F.slice(SP.fourier(F.col("embedding").cast("array<double>"), 64), 1, 33).alias("f"))
    return x.select("vec_id", F.posexplode("f").alias("k", "c")).select("vec_id", "k", F.round(F.col("c.re") * F.col("c.re") + F.col("c.im") * F.col("c.im"), 6).alias("power"))


@query("random_draws")
def random_draws(t):
    """Draws keyed by customer, the same on any partitioning; hashes that SQL does not have, so frequencies and repeats are tested."""
    key = F.col("c_custkey")
    return t.customer.select(key, D.uniform(key, 0, 11).alias("u"), D.normal(key, 0, 11).alias("z"), D.bernoulli(F.lit(0.25), key, 1, 11).alias("hit"), D.multinomial([5, 2, 1], key, 4, 11).alias("places"))
