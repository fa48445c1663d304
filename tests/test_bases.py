import json

import pytest
from quillspark.operators import baseview
from quillspark.plans import bases as B

FILES = "file_id string, normalized_path string, match_key string, absolute_path string, is_markdown boolean"
PROPS = "property_id string, file_id string, key string, value_type string, value_json string, updated_at string"


def vault(spark, notes):
    files = [(f, p, p, "/" + p, p.endswith(".md")) for f, p, _ in notes]
    props = [(f"{f}:{k}", f, k, "x", v if isinstance(v, str) and v.startswith("raw:") is False and isinstance(v, str) and v[:1] in '"[{ntf0123456789-' else json.dumps(v), "1") for f, _, kv in notes for k, v in kv.items()]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(props, PROPS)


def run(spark, notes, view, **page):
    files, props = vault(spark, notes)
    plan = B.compile_view(B.find_view(B.views_of({"views": [{"type": "table", **view}]}), None), **page)
    return baseview.collect_view(plan, files, props), baseview.execute(plan, files, props)


THREE = [
    ("f1", "notes/alpha.md", {"status": "active", "due": 2.0, "assignee": "a"}),
    ("f2", "notes/beta.md", {"status": "paused", "due": 3.0, "assignee": "b"}),
    ("f3", "other/gamma.md", {"status": "active", "due": 5.0}),
]


def test_filter_sort_project(spark):
    out, _ = run(spark, THREE, {"source": "notes", "filters": [{"key": "status", "op": "eq", "value": "active"}], "columns": ["title", "due", "nothing"]})
    assert out["total"] == 1
    assert out["rows"] == [{"file_id": "f1", "file_path": "notes/alpha.md", "title": "alpha", "due": 2.0, "nothing": None}]
    due = next(s for s in out["summaries"] if s["column"] == "due")
    assert (due["count"], due["min"], due["max"], due["avg"]) == (1, "2.0", "2.0", 2.0)


def test_groups(spark):
    notes = [("a", "a.md", {"status": "active", "priority": 2.0}), ("b", "b.md", {"status": "active", "priority": 3.0}), ("c", "c.md", {"status": "paused", "priority": 5.0}), ("d", "d.md", {}), ("e", "e.md", {"status": "null"})]
    view = {"group_by": ["status"], "aggregates": [{"alias": "n", "op": "count", "key": "ignored"}, {"alias": "total", "op": "sum", "key": "priority"}, {"alias": "least", "op": "min", "key": "priority"}], "sorts": [{"key": "priority", "direction": "desc"}]}
    out, _ = run(spark, notes, view)
    assert [(r["status"], r["n"], r["total"], r["least"], r["file_id"]) for r in out["rows"]] == [("active", 2, 5.0, 2.0, "b"), ("paused", 1, 5.0, 5.0, "c"), (None, 2, 0.0, None, "d")]
    assert out["total"] == 3
    none, _ = run(spark, notes, {"filters": [{"key": "status", "op": "eq", "value": "zzz"}], "aggregates": [{"alias": "n", "op": "count"}]})
    assert none["rows"] == []


def test_relation_and_rollup(spark):
    notes = [
        ("p", "notes/projects/p.md", {"meetings": ["notes/meetings/m1.md", "[[notes/meetings/m2]]", "[[notes/meetings/missing]]"]}),
        ("m1", "notes/meetings/m1.md", {"minutes": 30.0}),
        ("m2", "notes/meetings/m2.md", {"minutes": 45.0}),
    ]
    view = {"source": "notes/projects", "relations": ["meetings"], "rollups": [{"alias": "sum", "relation": "meetings", "target": "minutes", "op": "sum"}, {"alias": "n", "relation": "meetings", "target": "minutes", "op": "count"}, {"alias": "most", "relation": "meetings", "target": "minutes", "op": "max"}], "columns": ["meetings", "sum", "n", "most"]}
    out, result = run(spark, notes, view)
    row = out["rows"][0]
    assert (row["sum"], row["n"], row["most"]) == (75.0, 2, 45.0)
    assert [m["resolved"] for m in row["meetings"]] == [True, True, False] and row["meetings"][2]["reason"] == "relation_target_not_found"
    assert result.diagnostics.count() == 1


def test_many_rows_and_paging(spark):
    notes = [(f"f{i:04d}", f"n/{i:04d}.md", {"due": float(i % 17)}) for i in range(1300)]
    view = {"filters": [{"key": "due", "op": "gte", "value": 3}], "sorts": [{"key": "due"}], "columns": ["due"]}
    out, _ = run(spark, notes, view, page=2, page_size=20)
    want = sorted((i % 17, f"n/{i:04d}.md") for i in range(1300) if i % 17 >= 3)
    assert out["total"] == len(want)
    assert [(r["due"], r["file_path"]) for r in out["rows"]] == want[20:40]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [
        ("eq", 5, []),
        ("eq", 5.0, ["num"]),
        ("not_eq", 5.0, ["arr", "none", "null", "obj", "str"]),
        ("gt", 5, ["arr", "obj", "str"]),
        ("lte", 5, ["null", "num"]),
        ("contains", "AB", ["arr", "str"]),
        ("contains", "nul", ["null"]),
        ("in", ["abc", 5.0], ["num", "str"]),
        ("not_in", "x", ["arr", "none", "null", "num", "obj", "str"]),
        ("exists", True, ["arr", "null", "num", "obj", "str"]),
        ("exists", False, ["none"]),
        ("starts_with", "ab", ["str"]),
        ("not_starts_with", "ab", ["arr", "none", "null", "num", "obj"]),
        ("ends_with", "c", ["str"]),
        ("starts_with", ["a"], []),
    ],
)
def test_filters(spark, op, value, want):
    notes = [("num", "1.md", {"x": 5.0}), ("str", "2.md", {"x": "abc"}), ("null", "3.md", {"x": "null"}), ("none", "4.md", {}), ("arr", "5.md", {"x": ["zab", "q"]}), ("obj", "6.md", {"x": {"k": 1}})]
    out, _ = run(spark, notes, {"filters": [{"key": "x", "op": op, "value": value}], "columns": ["x"]})
    assert sorted(r["file_id"] for r in out["rows"]) == want


YAML = """
filters:
  and:
    - file.inFolder("notes/projects")
    - '!file.name.startsWith("draft")'
    - note.status != "done"
    - "!due.isEmpty()"
views:
  - table
  - type: table
    name: Open
    order: [file.name, note.status]
    columnSize: {note.status: 80}
    sort: [{property: file.path, direction: DESC, nulls: last}]
    extra: 1
"""


def test_documents():
    a, b = B.parse_base(YAML)
    assert a.name == "table-1" and a.source == "notes/projects" == b.source
    assert [(f.key, f.op, f.value) for f in a.filters] == [("title", "not_starts_with", "draft"), ("status", "not_eq", "done"), ("due", "exists", True)]
    assert [c.key for c in b.columns] == ["title", "status"] and b.columns[1].width == 80
    assert b.sorts == (B.Sort("path", True, True),) and b.extras == {"extra": 1}
    assert B.decode_config(B.to_config([a, b])) == [a, b]
    assert B.decode_config(json.dumps({"raw": YAML})) == [a, b]


@pytest.mark.parametrize("text", ["", "a: 1", "views: 1", "views: [timeline]", "views: [{name: x}]", "views: [{type: table, filters: [{key: a, op: like, value: 1}]}]", "views: []\nfilters: {and: [a or b]}", "views: []\nfilters: {and: ['file.inFolder(\"a\")', 'file.inFolder(\"b\")']}", "views: [\n", "a: 1\na: 2"])
def test_bad_documents(text):
    with pytest.raises(B.BaseError):
        B.parse_base(text)


def test_diagnostics_and_registry():
    v = [B.View("a", columns=(B.Column("x", hidden=True), B.Column("X", hidden=True))), B.View("A")]
    assert [d.code for d in B.diagnose(B.to_config(v))] == ["bases.view.duplicate_name", "bases.column.duplicate_key", "bases.table.all_columns_hidden", "bases.table.missing_columns"]
    with pytest.raises(B.BaseError):
        B.find_view(v, "a")
    with pytest.raises(B.BaseError):
        B.compile_view(v[0], page=0)
    assert [c.key for c in B.with_columns(v[:1], "A", [B.Column("y")])[0].columns] == ["y"]
    assert B.required_keys(B.View("v", filters=(B.Filter("Status", "eq", 1),), columns=(B.Column("status"), B.Column("b")))) == ("Status", "b")
