import pytest
from pyspark.sql import functions as F

from vektorium.operators import filters as FL
from vektorium.operators.filters import Filter

CASES = [
    ({"category": "tech"}, Filter("category", "eq", "tech"), True),
    ({"category": "sports"}, Filter("category", "eq", "tech"), False),
    ({"count": 10}, Filter("count", "eq", 10), True),
    ({"status": "inactive"}, Filter("status", "ne", "active"), True),
    ({"score": 75}, Filter("score", "gt", 50), True),
    ({"score": 25}, Filter("score", "gt", 50), False),
    ({"age": 18}, Filter("age", "gte", 18), True),
    ({"temperature": 75}, Filter("temperature", "lt", 100), True),
    ({"limit": 10}, Filter("limit", "lte", 10), True),
    ({"color": "blue"}, Filter("color", "in", ["red", "blue", "green"]), True),
    ({"color": "yellow"}, Filter("color", "in", ["red", "blue"]), False),
    ({"d": "This is a vector database"}, Filter("d", "contains", "vector"), True),
    ({"d": "This is a search engine"}, Filter("d", "contains", "database"), False),
    ({"n": 5}, Filter("n", "eq", 5.0), True),
    ({"s": "a"}, Filter("s", "gte", "a"), True),
    ({"s": "b"}, Filter("s", "gt", "a"), False),
    ({"x": float("nan")}, Filter("x", "eq", float("nan")), False),
    ({"x": float("nan")}, Filter("x", "gt", 1.0), False),
    ({"s": "x"}, Filter("s", "ne", 5), True),
    ({"s": "x"}, Filter("missing", "ne", 5), False),
    ({"s": "x"}, Filter("missing", "eq", 5), False),
    ({"a": [1, 2]}, Filter("a", "eq", [1, 2.0]), True),
    ({"a": [1, 2]}, Filter("a", "in", [[3], [1, 2]]), True),
]


@pytest.mark.parametrize("doc,f,want", CASES)
def test_columns(spark, doc, f, want):
    (name, value), = doc.items()
    df = spark.createDataFrame([(value,)], [name])
    assert df.select(FL.lower(df.schema, f)).first()[0] is want


def test_null_is_missing(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert df.select(FL.lower(df.schema, Filter("x", "ne", 5)), FL.lower(df.schema, Filter("x", "eq", 5))).first()[:] == (False, False)


@pytest.mark.parametrize("doc,f,want", [
    ('{"k": null}', Filter("k", "ne", 5), True), ('{"k": null}', Filter("k", "eq", None), True), ("{}", Filter("k", "ne", 5), False), ('{"k": 5}', Filter("k", "eq", 5.0), True),
    ('{"k": "5"}', Filter("k", "eq", 5), False), ('{"k": "abc"}', Filter("k", "contains", "b"), True), ('{"k": true}', Filter("k", "eq", True), True), ('{"k": 7.5}', Filter("k", "gte", 7), True), ('{"k": "x"}', Filter("k", "in", ["x"]), True),
])
def test_json(spark, doc, f, want):
    df = spark.createDataFrame([(doc,)], ["j"]).select(F.try_parse_json("j").alias("d"))
    assert df.select(FL.lower_json(F.col("d"), f)).first()[0] is want


def test_and_and_empty(spark):
    df = spark.range(10)
    assert FL.apply(df, []).count() == 10
    assert FL.apply(df, [Filter("id", "gte", 3), Filter("id", "lt", 5)]).count() == 2
    assert FL.apply(df.limit(0), [Filter("id", "eq", 3)]).count() == 0


def test_unknown_operator():
    with pytest.raises(ValueError):
        Filter("a", "like", "b")


def test_violations(spark):
    df = spark.createDataFrame([(1, 1.5, "x"), (None, 2.0, None)], "a int, b double, c string")
    rows = df.select(FL.violations(df, {"a": "float", "b": "int", "c": "bool", "zzz": "int"}).alias("v")).collect()
    assert [r.v for r in rows] == [["b", "c"], []]


def test_pushed_to_the_scan(spark, sf):
    from vektorium.plans.explain import analyse

    s = analyse(FL.apply(spark.read.parquet(f"{sf}/lineitem.parquet"), [Filter("l_quantity", "gt", 40)]).select("l_orderkey"), run=True)
    assert any("GreaterThan(l_quantity" in p for p in s.pushed_filters) and s.read_columns == ["l_orderkey", "l_quantity"] and s.rows_out > 0
