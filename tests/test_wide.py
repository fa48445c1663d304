import datetime

import pytest
from quillspark.operators import wide as W

PROPS = "property_id string, file_id string, key string, value_type string, value_json string, updated_at string, cells string"


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("number", ["1", "1.5", "-2e3", "true", "false", '" 3 "', '"+2089"', '"3778e1"', '".5"', "null", " 7 "], ['"Infinity"', '"NaN"', "NaN", "Infinity", '"21%"', '"65,5"', '""', "[1]", "{}", "01", "+1", "{a: 1}", "1 2", '"1\n', '"1_000"', '"١"']),
        ("bool", ["true", "0", "1", '" Yes "', '"FALSE"', '"1"', "null"], ["2", "0.5", "-1", '"on"', '""', "[true]", "True", "{}"]),
        ("date", ['"2024-02-29"', '"2024-03-01T08:20:00.000+02:00"', '"2023-10-12 17:06"', '"2023-10-27T09:28:00Z"', "null"], ['"2023-02-29"', '"2024-13-01"', '"2024-3-1"', '"2024/03/01"', "20240301", '"2024-03"', '"2024-03-01x"', '"0000-01-01"', '["2024-03-01"]', '"2024-03-01T25:00"', '"2024-03-01T"']),
        ("string", ['"x"', "1", "true", "null", '""'], ["[1]", "{}", "x", "'x'", '"\t"']),
        ("json", ["[1, 2]", '{"a": [null]}', "1", "null", '"x"'], ["[1, 2,]", "{a: 1}", "x", "", '{"a": NaN}', "[1] x"]),
    ],
)
def test_read_value(kind, good, bad):
    for g in good:
        assert W.read_value(g, kind)[0], (kind, g)
    for b in bad:
        assert not W.read_value(b, kind)[0], (kind, b)
    assert W.read_value(None, kind) == (True, None)


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([("due", "date"), ("n", "number"), ("ok", "bool"), ("s", "string"), ("j", "json")] * 2, "prop_key string, target_type string")


def props(spark, rows):
    return spark.createDataFrame([(f"p{i}", f, k, "string", v, t, "clash") for i, (f, k, v, t) in enumerate(rows)], PROPS)


def test_latest_cell_wins_in_any_order(spark, schema):
    rows = [
        ("a", "n", "1", "2023-01-01T00:00:00.000Z"),
        ("a", " N ", "2", "2023-03-01T00:00:00.000Z"),
        ("a", "n", "oops", "2023-02-01T00:00:00.000Z"),
        ("a", "due", '"2024-05-06T10:00"', "2023-01-01T00:00:00.000Z"),
        ("b", "OK", '"yes"', None),
        ("b", "s", "5", "2023"),
        ("b", "j", "[1, 2]", "2023"),
        ("b", "other", "1", "2023"),
        ("c", "other", "1", "2023"),
        (None, "n", "1", "2023"),
        ("d", None, "1", "2023"),
        ("e", "n", None, "2023"),
        ("t", "n", "8", "2023"),
        ("t", "n", "9", "2023"),
    ]
    for order in (rows, rows[::-1]):
        p = props(spark, rows).union(props(spark, rows)) if order is rows else props(spark, rows).orderBy("property_id", ascending=False)
        out = {r["file_id"]: r for r in W.wide_table(p, schema).collect()}
        assert set(out) == {"a", "b", "e", "t"}
        assert out["a"]["n"] == 2.0 and out["a"]["due"] == datetime.date(2024, 5, 6)
        assert (out["b"]["ok"], out["b"]["s"], out["b"]["j"]) == (True, "5", "[1, 2]")
        assert out["e"]["n"] is None and out["t"]["n"] == 9.0


def test_bad_cells(spark, schema):
    p = props(spark, [("a", "n", '"x"', "1"), ("a", "n", "1", "0"), ("b", "n", '"x"', "0"), ("b", "n", "1", "1"), ("c", "due", "[", "1"), ("d", "s", "{}", "1")])
    assert {(r["file_id"], r["prop_key"]) for r in W.bad_cells(p, schema).collect()} == {("a", "n"), ("c", "due"), ("d", "s")}


def test_runs_in_pieces_equal_one(spark, schema):
    p = props(spark, [(f"f{i % 7}", k, str(i), f"2023-{1 + i % 12:02d}-01") for i in range(200) for k in ("n", "s")])
    columns = W.wide_schema(schema)
    whole = {(r["file_id"], str(r["cells"])) for r in W.compact(W.sparse_deltas(p, columns)).collect()}
    parts = [W.compact(W.sparse_deltas(p.filter(f"pmod(xxhash64(property_id), 3) = {i}"), columns)) for i in range(3)]
    assert {(r["file_id"], str(r["cells"])) for r in W.compact(*parts).collect()} == whole


def test_log_in_any_order(spark, schema, tmp_path):
    """Batches in any order, twice, and compactions between them, give the table of all rows; only touched parts are merged."""
    p = props(spark, [(f"f{i % 17}", k, str(i), f"2023-{1 + i % 5:02d}-{1 + i % 28:02d}") for i in range(300) for k in ("n", "s", "due")])
    columns = W.wide_schema(schema)
    want = {tuple(r) for r in W.wide_table(p, schema).collect()}
    log = W.WideLog(spark, str(tmp_path / "log"), columns, parts=4)
    assert log.cells().collect() == [] and log.compact() == 0
    for n, month in enumerate(("03", "01", "05", "01", "02", "04")):
        log.append(p.filter(f"substr(updated_at, 6, 2) = '{month}'"), f"b{n}")
    assert log.compact(most_runs=3) == 4 and all(len(f) == 1 for f in log.runs().values())
    assert {tuple(r) for r in W.typed(log.cells(), columns).collect()} == want
    log.append(p.filter("file_id = 'f3'"), "again")
    before = log.runs()
    assert log.compact(most_runs=1) == 1
    assert sum(log.runs()[k] == v for k, v in before.items()) == 3
    assert {tuple(r) for r in W.typed(log.cells(), columns).collect()} == want


def test_hot_entity_and_long_values(spark, schema):
    p = props(spark, [("hot", "n", str(i), f"{i:06d}") for i in range(3000)] + [("long", "s", '"' + "x" * 500_000 + '"', "1")])
    out = {r["file_id"]: r for r in W.wide_table(p, schema).collect()}
    assert out["hot"]["n"] == 2999.0 and len(out["long"]["s"]) == 500_000


def test_empty(spark, schema):
    none = spark.createDataFrame([], PROPS)
    assert W.wide_table(none, schema).collect() == [] and W.bad_cells(none, schema).collect() == []
    no_schema = schema.filter("false")
    one = props(spark, [("a", "n", "1", "1")])
    assert W.wide_table(one, no_schema).columns == ["file_id"] and W.bad_cells(one, no_schema).collect() == []


def test_bad_schema(spark):
    make = lambda rows: spark.createDataFrame(rows, "prop_key string, target_type string")
    for rows in ([("a", "number"), ("a", "bool")], [("a", "decimal")]):
        with pytest.raises(ValueError):
            W.wide_schema(make(rows))
    with pytest.raises(ValueError):
        W.wide_table(props(spark, [("a", "n", "1", "1")]), make([("file_id", "string")]))
