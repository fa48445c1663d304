import pytest
from pyspark.sql import functions as F
from quillspark.functions import values as V
from quillspark.plans import where as W


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "5.0"), (2, "5"), (3, '"abc"'), (4, "null"), (5, None), (6, "true"), (7, '["Alpha", ["beta", 3]]'), (8, '{"k": "Gamma"}'), (9, "12.5"), (10, '"ABD"')]
    return spark.createDataFrame(data, "id int, j string").select("id", V.json_value(F.col("j")).alias("v"))


def run(rows, clause, only=None):
    df = rows if only is None else rows.filter(F.col("id").isin(only))
    return sorted(r["id"] for r in df.filter(W.compile_where(W.parse_where(clause), lambda n: F.col("v") if n == "x" else None)).collect())


def test_equality_tells_missing_from_null(rows):
    assert run(rows, "x == 5") == [1]
    assert run(rows, "x != 5") == [2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert run(rows, "x == null") == [4]
    assert run(rows, "x == true") == [6]
    assert run(rows, "y == 5") == [] and len(run(rows, "y != 5")) == 10


def test_order_needs_like_types(rows):
    assert run(rows, "x > 5", [1, 2, 5, 9]) == [9]
    assert run(rows, "x >= 'abc'", [3, 5, 10]) == [3]
    for bad in ("x > 5", "x > true", "x < null"):
        with pytest.raises(Exception, match="type mismatch"):
            run(rows, bad)
    with pytest.raises(Exception, match="type mismatch"):
        run(rows, "x starts_with 'a'", [7])


def test_sides_that_decide_stop_the_rest(rows):
    assert run(rows, "x == 'zzz' and x > 5", [1, 3, 4]) == []
    assert run(rows, "x contains 'a' or x > 5", [3, 9]) == [3, 9]


def test_contains_goes_inside_and_ignores_case(rows):
    assert run(rows, "x contains 'A'") == [3, 7, 8, 10]
    assert run(rows, "x contains 'BETA'") == [7]
    assert run(rows, "x contains 'k'") == []
    assert run(rows, "x starts_with 'ab' or x ENDSWITH 'BD'", [3, 10, 5]) == [3, 10]


def test_grammar():
    t = W.parse_where("not a == 1 and (b contains 'x' or c.d != \"y\")")
    assert t.op == "and" and t.parts[0].op == "not" and t.parts[1].op == "or"
    assert W.parse_where("  ") is None
    assert W.fields_of(t) == {"a", "b", "c.d"}
    for bad in ("a = 1", "a <> 1", "a ==", "(a == 1", "a == 1 b", "a == 'x", "== 1", "a == 1..2", "a == b", "a is null"):
        with pytest.raises(W.QueryParseError):
            W.parse_where(bad)


def test_sort_clause():
    assert W.parse_sort("b:nulls_last:desc, a") == [W.SortKey("b", True, True), W.SortKey("a")]
    assert W.parse_sort("") == []
    for bad in ("a,,b", "a:b", ":desc", "a:"):
        with pytest.raises(W.QueryParseError):
            W.parse_sort(bad)


@pytest.mark.parametrize(("clause", "want"), [("x", [None, 1, 2]), ("x:nulls_last", [1, 2, None]), ("x:desc", [2, 1, None]), ("x:desc:nulls_last", [None, 2, 1])])
def test_descending_turns_nulls_around(spark, clause, want):
    df = spark.createDataFrame([(2.0, "a"), (None, "b"), (1.0, "c")], "x double, p string")
    by = W.compile_sort(W.parse_sort(clause), lambda n: V.scalar_value(F.col("x"), "number"), F.col("p"), F.col("p"))
    assert [r["x"] for r in df.orderBy(*by).collect()] == want


def test_values(spark):
    data = [("[1,2,3]",), ('{"a":1}',), ('"é\\n"',), ("nope",), ("1e3",), ("",)]
    got = [r["v"] for r in spark.createDataFrame(data, "j string").select(V.json_value(F.col("j")).alias("v")).collect()]
    assert [(g["rank"], g["len"]) for g in got] == [(4, 3), (5, 1), (3, None), (3, None), (2, None), (3, None)]
    assert got[2]["s"] == "é\n" and got[3]["repr"] == '"nope"' and got[4]["n"] == 1000.0


def test_coercion(spark):
    one = lambda j, kind: spark.createDataFrame([(j,)], "j string").select(V.coerce(V.json_value(F.col("j")), kind, False).alias("x")).first()["x"]
    assert one("true", "number") == "1.0" and one('" 7 "', "number") == "7.0" and one('"x"', "number") is None
    assert one('"Yes"', "bool") == "true" and one("0", "bool") == "false" and one("2", "bool") is None
    assert one('"2024-01-02"', "date") == "2024-01-02" and one('"2024-01-02T1"', "date") is None
    assert one("null", "string") == "" and one("[1]", "string") is None
    with pytest.raises(Exception, match="bases.coercion.invalid_value"):
        spark.createDataFrame([("x",)], "j string").select(V.coerce(V.json_value(F.col("j")), "number")).collect()
