"""Readers on files written here."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators.evidence import n_triples
from tessera.sources import readers as R


def test_delimited_with_bad_and_blank_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,when,ok,price\n1,2024-01-02,YES,"1.5"\n2,,no,x\n,bad,,\n')
    got = R.read_delimited(spark, str(tmp_path / "a.csv"), {"id": "long", "when": "date", "ok": "boolean", "price": "double"}, defaults={"id": -1}).collect()
    assert [(r["id"], str(r["when"]), r["ok"], r["price"], r["price_raw"], r["when_raw"]) for r in got] == [(1, "2024-01-02", True, 1.5, None, None), (2, "None", False, None, "x", None), (-1, "None", None, None, None, "bad")]


def test_coerced_kinds(spark):
    df = spark.createDataFrame([("AAEC", "123e4567-e89b-12d3-a456-42661417400A")], "b string, u string")
    r = df.select(R.coerced(F.col("b"), "binary"), R.coerced(F.col("u"), "uuid"), R.coerced(F.col("b"), "uuid")).first()
    assert bytes(r[0]) == b"\0\1\2" and r[1] == "123e4567-e89b-12d3-a456-42661417400a" and r[2] is None


def test_event_log_keeps_event_borders(spark, tmp_path):
    e = lambda a, at: f'<event><string key="concept:name" value="{a}"/><date key="time:timestamp" value="{at}"/></event>'
    (tmp_path / "log.xes").write_text(f'<log><trace><string key="concept:name" value="t1"/>{e("submit", "2024-01-01")}{e("approve", "2024-01-02")}</trace><trace><string key="concept:name" value="t2"/>{e("submit", "2024-01-03")}</trace></log>')
    got = R.parse_xes(spark, str(tmp_path / "log.xes")).orderBy("case_id", "pos").collect()
    assert [tuple(r) for r in got] == [("t1", 0, "submit", "2024-01-01"), ("t1", 1, "approve", "2024-01-02"), ("t2", 0, "submit", "2024-01-03")]


def test_logs_skip_bad_lines(spark):
    lines = spark.createDataFrame([("x", 0, '{"index":{"_index":"i","_id":"1"}}'), ("x", 1, '{"a":1}'), ("x", 2, "rubbish"), ("x", 3, '{"delete":{"_index":"i","_id":"2"}}')], "source string, line_no long, value string")
    assert [(r["action"], r["id"], r["document"]) for r in R.parse_bulk(lines).orderBy("id").collect()] == [("index", "1", '{"a":1}'), ("delete", "2", None)]
    assert R.parse_syslog(spark.createDataFrame([("no log",), ("<13>Feb  5 17:32:18 h su: hi there",)], "value string")).first()["message"] == "hi there"
    r = R.parse_cef(spark.createDataFrame([("CEF:0|a|b|1|9|n|3|src=1 msg=two words",)], "value string")).first()
    assert r["extension"] == {"src": "1", "msg": "two words"}


def test_keyed_tables(spark):
    base = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    assert sorted(R.latest(base, ["k"], ["n"]).select("k", "v").collect()) == [(1, "b"), (2, "c")]
    assert R.upsert(base.where("n = 1"), base.where("n = 2"), ["k"]).count() == 2
    at = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 2),)], "ts timestamp")
    assert R.range_read(at, "ts", "2024-01-01", "2024-01-02").count() == 1


def test_schema_of_json_and_triples(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2.5, "c": [1]}',)], "j string")
    assert {f.name for f in R.inferred_schema(spark, df, "j")["v"].dataType} == {"a", "b", "c"}
    lines = spark.createDataFrame([('<a> <p> "x \\" y"@en .',), ("junk",)], "value string")
    assert [tuple(r) for r in n_triples(lines).collect()] == [("a", "p", 'x \\" y')]


def test_delimited_below_a_title(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"f{k}.csv").write_text(f"Report {k}\n\nunits;of;year\nid;name;amount\n{k}1;\"a;b\";2.5\n\n{k}2;;x\n")
    got = R.read_delimited(spark, str(tmp_path), {"id": "long", "amount": "double"}, sep=";", skip_rows=2, header_row=1)
    assert sorted((r["id"], r["amount"], r["amount_raw"]) for r in got.collect()) == [(11, 2.5, None), (12, None, "x"), (21, 2.5, None), (22, None, "x")]
    plain = R.read_delimited(spark, str(tmp_path / "f1.csv"), sep=";", skip_rows=4, header_row=None)
    assert plain.columns == ["c0", "c1", "c2"] and sorted(map(tuple, plain.collect())) == [("11", "a;b", "2.5"), ("12", None, "x")]
