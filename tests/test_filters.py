import json

import pytest
from pyspark.sql import functions as F

from chronoframe.plans.filters import (
    And, Contains, Eq, Exists, Gt, Gte, Lt, Matches, Ne, Not, Or, from_dict, from_text,
)
from chronoframe.plans.query import Query, count, distinct, group_by, max_of, min_of, sum_of


@pytest.fixture
def keys(spark):
    def run(docs, *filters, typed=None):
        if typed:
            df = spark.createDataFrame([(k, *v) for k, v in docs.items()], f"key string, {typed}")
            q = Query()
        else:
            rows = [(k, json.dumps(v)) for k, v in docs.items()]
            df = spark.createDataFrame(rows, "key string, j string").select("key", F.parse_json("j").alias("v"))
            q = Query(value="v")
        return {r.key for r in q.where(*filters).run(df).select("key").collect()}

    return run


def test_null_is_not_missing(keys):
    parcels = {"p1": {"carrier": "rail"}, "p2": {"carrier": None, "kg": 3}, "p3": {"kg": 8}, "p4": {"carrier": "road"}}
    assert keys(parcels, Eq("carrier", None)) == {"p2"}
    assert keys(parcels, Exists("carrier")) == {"p1", "p4"}
    assert keys(parcels, Ne("carrier", "rail")) == keys(parcels, Not(Eq("carrier", "rail"))) == {"p2", "p3", "p4"}


def test_numbers(keys):
    depths = {"trench": {"m": -10935.5}, "shore": {"m": 0}, "hill": {"m": 12}, "moon": {"m": 3.8e8}, "sign": {"m": "12"}}
    assert keys(depths, Lt("m", 0)) == {"trench"}
    assert keys(depths, Gt("m", 0)) == {"hill", "moon"}
    assert keys(depths, Gte("m", 12.0)) == {"hill", "moon"}
    assert keys(depths, Eq("m", 12)) == {"hill"}


def test_null_is_less(keys):
    docs = {"null": {"v": None}, "one": {"v": 1}, "none": {}}
    assert keys(docs, Lt("v", 5)) == {"null", "one"}


def test_strings(keys):
    docs = {n: {"name": n} for n in ("", " ", "a", "A", "aa", "über")}
    assert keys(docs, Gt("name", "a")) == {"aa", "über"}
    assert keys(docs, Contains("name", "")) == set(docs)


def test_paths(keys):
    orders = {
        "o1": {"buyer": {"address": {"town": "Ulm"}}, "lines": [{"qty": 4}, {"qty": 1}]},
        "o2": {"buyer": {"address": None}, "lines": []},
        "o3": {"buyer": "Ulm"},
    }
    assert keys(orders, Eq("buyer.address.town", "Ulm")) == {"o1"}
    assert keys(orders, Exists("buyer.address")) == {"o1"}
    assert keys(orders, Gt("lines.0.qty", 3)) == {"o1"} and keys(orders, Exists("lines.2.qty")) == set()


def test_de_morgan(keys):
    docs = {f"{a}{b}": {"a": a == "t", "b": b == "t"} for a in "tf" for b in "tf"}
    a, b = Eq("a", True), Eq("b", True)
    assert keys(docs, Not(Or([a, b]))) == keys(docs, And([Not(a), Not(b)])) == {"ff"}
    assert keys(docs, Not(And([a, b]))) == keys(docs, Or([Not(a), Not(b)]))
    assert keys(docs, And([])) == set(docs) and keys(docs, Or([])) == set()


def test_regex(keys):
    files = {"log": {"f": "run-07.log"}, "tmp": {"f": "run-07_log"}, "ü": {"f": "rün-12.log"}, "none": {"f": None}, "n": {"f": 7}}
    assert keys(files, Matches("f", r"\d+\.log$")) == {"log", "ü"}
    assert keys(files, Matches("f", "^r.n-")) == {"log", "tmp", "ü"}
    assert keys(files, Matches("f", "(unclosed")) == set()


def test_contains_members_and_keys(keys):
    docs = {"list": {"t": ["x", 1]}, "object": {"t": {"x": 0}}, "text": {"t": "axb"}, "none": {}}
    assert keys(docs, Contains("t", "x")) == {"list", "object", "text"}
    assert keys(docs, Contains("t", 1)) == {"list"}


def test_parsers():
    assert from_text("age >= 30") == Gte("age", 30)
    assert from_text("name != 'x'") == Ne("name", "x")
    assert from_text("on = true") == Eq("on", True)
    assert from_dict({"a": 1, "b": 2}) == And([Eq("a", 1), Eq("b", 2)])
    with pytest.raises(ValueError):
        from_dict({"field": "a", "op": "almost", "value": 1})


def test_typed_unlike_kinds_are_false(keys):
    docs = {"a": (1, "x"), "b": (None, None)}
    assert keys(docs, Gt("n", "x"), typed="n int, s string") == set()
    assert keys(docs, Ne("n", "x"), typed="n int, s string") == {"a", "b"}
    assert keys(docs, Eq("nowhere", 1), typed="n int, s string") == set()


def test_sorting(spark):
    rows = [("mia", "gold", 40), ("noa", "iron", 7), ("ola", "gold", 12), ("pia", None, 1), ("rui", "iron", 90)]
    df = spark.createDataFrame(rows, "key string, rank string, points int")
    by = lambda up: [r.key for r in Query().sort("rank", up).sort("points").run(df).collect()]
    assert by(True) == ["ola", "mia", "noa", "rui", "pia"]
    assert by(False) == ["pia", "noa", "rui", "ola", "mia"]
    docs = spark.createDataFrame([("w", '{"t":"x"}'), ("x", "{}"), ("y", '{"t":null}'), ("z", '{"t":-2}')], "key string, j string")
    docs = docs.select("key", F.parse_json("j").alias("v"))
    assert [r.key for r in Query(value="v").sort("t").run(docs).collect()] == ["y", "z", "w", "x"]


def test_projection_comes_first(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 1, 2)], "key string, x int, y int")
    assert [r.key for r in Query().project("y").sort("x").run(df).collect()] == ["a", "b"]
    assert Query().project("y").agg(sum_of("x")).run(df).first()[0] == 0.0
    assert Query().sort("x").limit(1).agg(sum_of("x")).run(df).first()[0] == 1.0
    assert Query().where(Gt("x", 5)).agg(sum_of("x")).run(df).first()[0] == 0.0
    assert Query().where(Gt("x", 5)).agg(count()).run(df).first()[0] == 0


def test_grouping(spark):
    df = spark.createDataFrame([("a", "u", 1), ("b", "u", 2), ("c", None, 4)], "key string, g string, n int")
    got = {r.g: r.total for r in Query().agg(group_by("g", total=sum_of("n"))).run(df).collect()}
    assert got == {"u": 3.0, None: 4.0}
    assert {r.value for r in Query().agg(distinct("g")).run(df).collect()} == {"u"}


def test_documents_aggregate_as_they_sort(spark):
    docs = spark.createDataFrame([(str(i), json.dumps({"n": n, "g": i % 2})) for i, n in enumerate((9, 10, 100.5))], "key string, j string")
    docs = docs.select("key", F.parse_json("j").alias("v"))
    q = Query(value="v")
    assert [q.agg(a("n")).run(docs).first()[0] for a in (min_of, max_of)] == ["9", "100.5"]
    assert q.project("n").run(docs).columns == ["key", "n"]
    assert [r.key for r in q.project("n").sort("n", False).limit(1).run(docs).collect()] == ["2"]
    both = q.agg(group_by("g", by=group_by("n", c=count()), total=sum_of("n"))).run(docs)
    assert {(r.g, r.n, r.total, r.c) for r in both.collect()} == {("0", "9", 109.5, 1), ("0", "100.5", 109.5, 1), ("1", "10", 10.0, 1)}
    with pytest.raises(ValueError):
        q.agg(group_by("g", a=group_by("n", c=count()), b=group_by("n", c=count()))).run(docs)
