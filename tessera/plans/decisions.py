"""Decision tables and expression functions over orders, parts, nations and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import feel
from ..operators.decisions import DecisionRule, DecisionTable, boxed_context, decision_order

TABLE = DecisionTable([
    DecisionRule({"o_totalprice": "> 250000", "o_orderstatus": "-"}, "30", 5),
    DecisionRule({"o_totalprice": "[100000..300000]", "o_orderstatus": "O,P"}, "20", 9),
    DecisionRule({"o_totalprice": "(0..150000)", "o_orderstatus": "not(F)"}, "10", 1),
    DecisionRule({"o_totalprice": "-", "o_orderstatus": '"F"'}, "5", 9),
], default="0")
_H = ["o_totalprice > 250000", "o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('O', 'P')", "o_totalprice > 0 AND o_totalprice < 150000 AND o_orderstatus <> 'F'", "o_orderstatus = 'F'"]
_O, _P = ["30", "20", "10", "5"], [5, 9, 1, 9]


def _case(order):
    return "CASE " + " ".join(f"WHEN {_H[i]} THEN '{_O[i]}'" for i in order) + " ELSE '0' END"


def _list(order):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_H[i]} THEN '{_O[i]}' END" for i in order) + ")"


_FIRST = sorted(range(4), key=lambda i: (-_P[i], i))
_UP = sorted(range(4), key=lambda i: (_P[i], i))


@query("decision_single_hit", f"SELECT o_orderkey, {_case(range(4))} AS unique_, {_case(range(4))} AS any_, {_case(_FIRST)} AS first_, {_case(_FIRST)} AS priority_ FROM orders")
def decision_single_hit(t):
    return t.orders.select("o_orderkey", *(TABLE.decide(p).alias(f"{p.lower()}_") for p in ("UNIQUE", "ANY", "FIRST", "PRIORITY")))


@query("decision_many_hits", f"SELECT o_orderkey, {_list(range(4))} AS collect_, {_list(range(4))} AS rule_order, {_list(_UP)} AS output_order FROM orders")
def decision_many_hits(t):
    return t.orders.select("o_orderkey", TABLE.decide("COLLECT").alias("collect_"), TABLE.decide("RULE_ORDER").alias("rule_order"), TABLE.decide("OUTPUT_ORDER").alias("output_order"))


_X = "list_filter([" + ", ".join(f"CASE WHEN {_H[i]} THEN {_O[i]}::DOUBLE END" for i in range(4)) + "], lambda x: x IS NOT NULL)"


@query("decision_collect", f"SELECT o_orderkey, list_sum(x) AS c_sum, list_min(x) AS c_min, list_max(x) AS c_max, len(x)::DOUBLE AS c_count, list_sum(x) AS standard_sum FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def decision_collect(t):
    return t.orders.select("o_orderkey", TABLE.collect("C#").alias("c_sum"), TABLE.collect("C<").alias("c_min"), TABLE.collect("C>").alias("c_max"), TABLE.collect("CC").alias("c_count"), TABLE.collect("C+", standard=True).alias("standard_sum"))


@query("decision_relation_lookup", "SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS band FROM customer")
def decision_relation_lookup(t):
    """Rules given as rows: a range join on a relation of three."""
    from ..catalog import small

    bands = t.spark.createDataFrame([(float("-inf"), 1000.0, "low"), (1000.0, 6000.0, "mid"), (6000.0, float("inf"), "high")], "low double, high double, band string")
    return t.customer.join(small(bands), (F.col("c_acctbal") >= F.col("low")) & (F.col("c_acctbal") < F.col("high"))).select("c_custkey", "band")


@query("boxed_context", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000 AS large FROM lineitem")
def boxed_context_query(t):
    out = boxed_context(t.lineitem, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("net") * (1 + F.col("l_tax")), "large": F.col("gross") > 50000})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "net", "gross", "large")


@query("decision_service", "SELECT o_orderkey, o_totalprice > 150000 AS big, CASE WHEN o_totalprice > 150000 AND o_orderpriority = '1-URGENT' THEN 'now' WHEN o_totalprice > 150000 THEN 'soon' ELSE 'later' END AS plan FROM orders")
def decision_service(t):
    """Decisions in the order of what they need."""
    made = {"plan": F.when(F.col("big") & (F.col("o_orderpriority") == "1-URGENT"), "now").when(F.col("big"), "soon").otherwise("later"), "big": F.col("o_totalprice") > 150000}
    order = [n for n in decision_order({"plan": ["big"], "big": []})]
    return boxed_context(t.orders, {n: made[n] for n in order}).select("o_orderkey", "big", "plan")


@query("feel_numeric", """SELECT p_partkey, abs(p_size - 25) AS abs_, cast(ceil(p_retailprice) AS BIGINT) AS ceil_, cast(floor(p_retailprice) AS BIGINT) AS floor_, round_even(p_retailprice, 0) AS round_, ((-p_size) % 7 + 7) % 7 AS modulo_, CASE WHEN p_size >= 25 THEN round(sqrt(p_size - 25), 8) END AS sqrt_, p_size BETWEEN 5 AND 10 AS between_, p_size > 5 AND p_size <= 10 AS half_open, round_even(p_retailprice / 7, 2) AS decimal_ FROM part""")
def feel_numeric(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        "p_partkey", F.abs(size - 25).alias("abs_"), F.ceil(price).alias("ceil_"), F.floor(price).alias("floor_"), feel.round_even(price).alias("round_"), feel.modulo(-size, F.lit(7)).cast("int").alias("modulo_"),
        F.round(feel.sqrt(size - 25), 8).alias("sqrt_"), feel.in_range(size, 5, 10).alias("between_"), feel.in_range(size, 5, 10, open_low=True).alias("half_open"), feel.round_even(price / 7, 2).alias("decimal_"),
    )


@query("feel_string", """SELECT p_partkey, contains(p_name, 'ring') AS contains_, starts_with(p_name, 'small') AS starts, ends_with(p_name, 'ring') AS ends_, length(p_name) AS length_, substr(p_name, 2, 3) AS sub, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trim_, regexp_replace(p_name, '[aeiou]', '*', 'g') AS replace_,
CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS before_, split_part(p_name, ' ', 2) AS after_, floor(p_retailprice) + 0.5::DOUBLE AS number_ FROM part""")
def feel_string(t):
    n = F.col("p_name")
    price = F.concat_ws(",", F.floor(F.col("p_retailprice") / 1000).cast("string"), F.format_string("%03d", F.floor(F.col("p_retailprice")) % 1000))
    return t.part.select(
        "p_partkey", feel.contains(n, F.lit("ring")).alias("contains_"), F.startswith(n, F.lit("small")).alias("starts"), F.endswith(n, F.lit("ring")).alias("ends_"), feel.string_length(n).cast("long").alias("length_"),
        F.substring(n, 2, 3).alias("sub"), F.upper(n).alias("up"), F.lower("p_brand").alias("low"), feel.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trim_"), F.regexp_replace(n, "[aeiou]", "*").alias("replace_"),
        feel.substring_before(n, F.lit(" ")).alias("before_"), feel.substring_after(n, " ").alias("after_"), feel.number(F.concat(price, F.lit(".5"))).alias("number_"),
    )


_L = "[p_size, p_size % 7, 3, p_size]"


@query("feel_list", f"""SELECT p_partkey, list_sum({_L})::DOUBLE AS sum_, list_avg({_L}) AS mean_, list_min({_L}) AS min_, list_max({_L}) AS max_, len({_L}) AS count_, list_contains({_L}, 5) AS contains_, coalesce(list_position({_L}, 3), 0) AS index_, array_to_string(list_concat([p_size], CASE WHEN p_size % 7 <> p_size THEN [p_size % 7] ELSE []::INTEGER[] END, CASE WHEN 3 NOT IN (p_size, p_size % 7) THEN [3] ELSE []::INTEGER[] END), ',') AS distinct_,
array_to_string(list_reverse({_L}), ',') AS reverse_, array_to_string(list_sort({_L}), ',') AS sort_, array_to_string({_L}[2:3], ',') AS sub, array_to_string(list_concat({_L}, [9]), ',') AS append_, array_to_string(list_concat([{_L}[1]], {_L}[3:]), ',') AS removed, array_to_string(list_concat([{_L}[1], 0], {_L}[2:]), ',') AS inserted, array_to_string(flatten([{_L}, [1]]), ',') AS flat,
array_to_string(list_transform({_L}, lambda x: x * 2), ',') AS doubled, len(list_filter({_L}, lambda x: x > 40)) > 0 AS some_, len(list_filter({_L}, lambda x: x > 0)) = 4 AS every_, {_L}[2] AS second FROM part""")
def feel_list(t):
    size = F.col("p_size")
    xs = F.array(size, size % 7, F.lit(3), size)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.part.select(
        "p_partkey", feel.total(xs).alias("sum_"), feel.mean(xs).alias("mean_"), F.array_min(xs).alias("min_"), F.array_max(xs).alias("max_"), F.size(xs).cast("long").alias("count_"), feel.list_contains(xs, 5).alias("contains_"),
        F.array_position(xs, 3).alias("index_"), text(F.array_distinct(xs)).alias("distinct_"), text(F.reverse(xs)).alias("reverse_"), text(F.array_sort(xs)).alias("sort_"), text(feel.sublist(xs, 2, 2)).alias("sub"),
        text(F.concat(xs, F.array(F.lit(9)))).alias("append_"), text(feel.remove(xs, 2)).alias("removed"), text(feel.insert_before(xs, 2, F.lit(0))).alias("inserted"), text(feel.flatten(F.array(xs, F.array(F.lit(1))))).alias("flat"),
        text(feel.for_return(xs, lambda x: x * 2)).alias("doubled"), feel.some(xs, lambda x: x > 40).alias("some_"), feel.every(xs, lambda x: x > 0).alias("every_"), feel.item(xs, 2).alias("second"),
    )


@query("feel_date", "SELECT o_orderkey, dayname(o_orderdate) AS day_name, dayofyear(o_orderdate) AS day_of_year, cast(strftime(o_orderdate, '%W') AS BIGINT) AS week_, month(o_orderdate) AS month_, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders")
def feel_date(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", feel.day_of_week(d).alias("day_name"), F.dayofyear(d).cast("long").alias("day_of_year"), feel.week_of_year(d).alias("week_"), F.month(d).cast("long").alias("month_"), F.date_format(d, "yyyy-MM-dd").alias("text"))


@query("feel_duration", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS years, CASE WHEN p_size % 3 = 0 THEN p_size % 12 ELSE 0 END AS months, CASE WHEN p_size % 5 < 3 THEN p_size % 5 ELSE 0 END AS days, CASE WHEN p_size % 4 = 1 THEN p_partkey % 24 ELSE 0 END AS hours, CASE WHEN p_size % 4 = 1 AND p_size % 3 = 1 THEN p_size ELSE 0 END AS minutes, CASE WHEN p_size % 4 = 1 AND p_size % 3 = 2 THEN p_size ELSE 0 END AS seconds FROM part")
def feel_duration(t):
    """Durations with some of their parts only."""
    size, key = F.col("p_size"), F.col("p_partkey")
    part = lambda on, v, unit: F.when(on, F.concat(v.cast("string"), F.lit(unit))).otherwise("")
    time = F.when(size % 4 == 1, F.concat(F.lit("T"), (key % 24).cast("string"), F.lit("H"), part(size % 3 == 1, size, "M"), part(size % 3 == 2, size, "S"))).otherwise("")
    parts = feel.duration(F.concat(F.lit("P"), part(size % 2 == 0, size, "Y"), part(size % 3 == 0, size % 12, "M"), part(size % 5 < 3, size % 5, "D"), time))
    return t.part.select("p_partkey", *(parts[n].alias(n) for n in ("years", "months", "days", "hours", "minutes", "seconds")))


_TYPED = ["'1.5'", "'\"a\"'", "'true'", "'[1]'", "'{\"a\": 1}'"]
_OF = {"number": 0, "string": 1, "boolean": 2, "list": 3, "context": 4}


@query("feel_types", "SELECT p_partkey, " + ", ".join(f"m = {k} AS is_{n}, m = {k} AS of_{n}" for n, k in _OF.items()) + ", m < 5 AS is_defined, m >= 5 AS is_null, p_size % 2 <> 0 AS not_flag, p_size % 7 = 0 AS not_number, p_size % 3 = 0 AS not_text, true AS static_number, false AS static_list, cast(current_date AS VARCHAR) AS today FROM (SELECT *, p_size % 6 AS m FROM part)")
def feel_types(t):
    """Types of values that differ from row to row, as variants, and of columns."""
    size = F.col("p_size")
    m = size % 6
    values = t.part.select("p_partkey", "p_size", F.parse_json(F.get(F.array(*(F.lit(x.strip("'")) for x in _TYPED), F.lit(None)), m)).alias("v"), F.when(size % 3 == 0, "").otherwise("x").alias("s"))
    v = F.col("v")
    tests = {"number": feel.is_number, "string": feel.is_string, "boolean": feel.is_boolean, "list": feel.is_list, "context": feel.is_context}
    return values.select(
        "p_partkey", *(c for n, f in tests.items() for c in (f(v, True).alias(f"is_{n}"), feel.instance_of(v, n, True).alias(f"of_{n}"))), feel.is_defined(v).alias("is_defined"), feel.is_null(v).alias("is_null"),
        feel.not_(size % 2 == 0).alias("not_flag"), feel.not_(size % 7).alias("not_number"), feel.not_(F.col("s")).alias("not_text"), feel.is_number(size).alias("static_number"), feel.instance_of(size, "list").alias("static_list"), feel.today().alias("today"),
    )


@query("feel_contexts", "SELECT p_partkey, array_to_string(list_transform(list_filter([{'k': p_size % 3, 'v': 1}, {'k': 1, 'v': p_size}, {'k': 2, 'v': 3}], lambda x: x.k = 1), lambda x: x.v), ',') AS matched, p_size AS size, p_name AS name, array_to_string(list_transform(list_sort([{'p': abs(p_size - 20), 'x': p_size}, {'p': 10, 'x': 10}, {'p': 10, 'x': 30}]), lambda s: s.x), ',') AS sorted, p_retailprice * 1.2::DOUBLE + 1 AS invoked FROM part")
def feel_contexts(t):
    """Contexts, lists filtered by a context, sorting by a function, and functions invoked with named parameters."""
    size = F.col("p_size")
    c = feel.context(size=size, name=F.col("p_name"))
    pairs = F.array(feel.context(k=size % 3, v=F.lit(1)), feel.context(k=F.lit(1), v=size), feel.context(k=F.lit(2), v=F.lit(3)))
    known = feel.Functions()
    known.define("gross", ("price", "extra"), lambda price, extra: price * 1.2 + F.coalesce(extra, F.lit(0)))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return t.part.select(
        "p_partkey", text(F.transform(feel.matching(pairs, k=1), lambda x: x["v"])).alias("matched"), c["size"].alias("size"), c["name"].alias("name"),
        text(feel.sorted_by(F.array(size, F.lit(10), F.lit(30)), lambda x: F.abs(x - 20))).alias("sorted"), known.invoke("gross", price=F.col("p_retailprice"), extra=F.lit(1)).alias("invoked"),
    )


@query("feel_registered_function", "SELECT p_partkey, p_retailprice * 1.2 + p_size AS scored FROM part")
def feel_registered_function(t):
    """A user function as a SQL function: its body is inlined by the optimizer."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_scored(price DOUBLE, size INT) RETURNS DOUBLE RETURN price * 1.2D + size")
    return t.part.select("p_partkey", F.call_function("tessera_scored", "p_retailprice", "p_size").alias("scored"))
