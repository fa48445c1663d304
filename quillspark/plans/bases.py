"""Declarative table views (`.base` documents): parsing, validation, and plans."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

# fixed values: accepted spellings
FILTER_OPS = {
    "eq": ("eq", "=", "=="),
    "not_eq": ("neq", "ne", "not_eq", "!=", "<>"),
    "gt": ("gt", ">"),
    "gte": ("gte", ">="),
    "lt": ("lt", "<"),
    "lte": ("lte", "<="),
    "contains": ("contains",),
    "in": ("in",),
    "not_in": ("not_in", "notin", "not-in"),
    "exists": ("exists",),
    "starts_with": ("starts_with", "startswith"),
    "not_starts_with": ("not_starts_with", "notstartswith", "not-starts-with"),
    "ends_with": ("ends_with", "endswith"),
}
NULL_ORDERS = {False: ("first", "nulls_first", "nullsfirst"), True: ("last", "nulls_last", "nullslast")}
AGGREGATES = ("count", "sum", "min", "max")
FIELD_ALIASES = {"file.name": "title", "file.path": "path", "file.folder": "file_folder", "file.ext": "file_ext"}
EXPRESSION_OPS = (("!=", "not_eq"), (">=", "gte"), ("<=", "lte"), ("==", "eq"), (">", "gt"), ("<", "lt"))
KNOWN_VIEW_KEYS = ("type", "name", "source", "filters", "sorts", "sort", "columns", "order", "columnSize", "group_by", "aggregates", "relations", "rollups")
# -----------------------------------


class BaseError(ValueError):
    def __init__(self, message: str, where: str | None = None) -> None:
        super().__init__(message)
        self.where = where


@dataclass(frozen=True)
class Filter:
    key: str
    op: str
    value: object


@dataclass(frozen=True)
class Sort:
    key: str
    desc: bool = False
    nulls_last: bool = False


@dataclass(frozen=True)
class Column:
    key: str
    label: str | None = None
    width: int | None = None
    hidden: bool = False


@dataclass(frozen=True)
class Aggregate:
    alias: str
    op: str
    key: str | None = None


@dataclass(frozen=True)
class Rollup:
    alias: str
    relation: str
    target: str
    op: str


@dataclass(frozen=True)
class View:
    name: str
    kind: str = "table"
    source: str | None = None
    filters: tuple[Filter, ...] = ()
    sorts: tuple[Sort, ...] = ()
    columns: tuple[Column, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    relations: tuple[str, ...] = ()
    rollups: tuple[Rollup, ...] = ()
    extras: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TablePlan:
    view: View
    keys: tuple[str, ...]  # required property keys
    columns: tuple[Column, ...]
    limit: int
    offset: int
    summaries: bool = True


@dataclass(frozen=True, order=True)
class Diagnostic:
    rank: int  # errors first
    code: str
    field: str
    message: str

    @property
    def severity(self) -> str:
        return ("error", "warning")[self.rank]


def alias_of(name: str) -> str:
    """A field's own name: `file.name` and the like, and `note.x` as x."""
    low = name.strip()
    return FIELD_ALIASES.get(low, low[5:] if low.startswith("note.") else low)


def _need(ok: bool, message: str, where: str) -> None:
    if not ok:
        raise BaseError(f"{where}: {message}", where)


def _text(m: dict, key: str, where: str, default: str | None = None) -> str:
    v = m.get(key, default)
    _need(isinstance(v, str), f"'{key}' must be a string", where)
    _need(bool(v.strip()), f"'{key}' must not be empty", where)
    return v.strip()


def _list(m: dict, key: str, where: str) -> list:
    v = m.get(key)
    _need(v is None or isinstance(v, list), f"'{key}' must be a sequence", where)
    return v or []


def _one_of(value: str, table: dict, where: str) -> object:
    low = value.strip().lower()
    for name, spellings in table.items():
        if low in spellings:
            return name
    raise BaseError(f"{where}: unsupported value '{value}'", where)


def parse_expression(text: str) -> tuple[str | None, Filter | None]:
    """A root filter: (folder, None) for `file.inFolder("x")`, else (None, condition)."""
    t = text.strip()
    negated, body = t.startswith("!"), t.removeprefix("!").strip()

    def argument(function: str) -> str | None:
        m = re.fullmatch(rf"{re.escape(function)}\(\s*(['\"])(.*)\1\s*\)", body)
        return m[2] if m else None

    folder = argument("file.inFolder")
    if folder is not None and not negated:
        return folder.strip().strip("/"), None
    prefix = argument("file.name.startsWith")
    if prefix is not None:
        return None, Filter("title", "not_starts_with" if negated else "starts_with", prefix)
    if body.endswith(".isEmpty()"):
        name = body.removesuffix(".isEmpty()").strip()
        if re.fullmatch(r"[\w.\- ]+", name):
            return None, Filter(alias_of(name), "exists", negated)
    if not negated:
        for sign, op in EXPRESSION_OPS:
            left, found, right = body.partition(sign)
            if found and re.fullmatch(r"[\w.\- ]+", left.strip()) and right.strip():
                return None, Filter(alias_of(left.strip()), op, _scalar(right.strip()))
    raise BaseError(f"unsupported root filter expression: {text}", "filters.and")


def _scalar(text: str) -> object:
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    try:
        v = json.loads(text)
    except ValueError:
        return text
    return v if not isinstance(v, list | dict) else text


def _parse_view(entry: object, i: int, source: str | None, defaults: list[Filter]) -> View:
    where = f"views[{i}]"
    if isinstance(entry, str):
        _need(entry.strip().lower() == "table", f"unsupported value '{entry}'", f"{where}.type")
        return View(f"table-{i + 1}", source=source, filters=tuple(defaults))
    _need(isinstance(entry, dict), "a view is a string or a mapping", where)
    _need(_text(entry, "type", f"{where}.type").lower() == "table", f"unsupported value '{entry['type']}'", f"{where}.type")
    filters = list(defaults)
    for j, f in enumerate(_list(entry, "filters", where)):
        at = f"{where}.filters[{j}]"
        _need(isinstance(f, dict) and "value" in f, "a filter has key, op and value", at)
        filters.append(Filter(_text(f, "key", at), _one_of(_text(f, "op", at), FILTER_OPS, at), f["value"]))
    sorts = []
    for j, s in enumerate(_list(entry, "sorts" if entry.get("sorts") is not None else "sort", where)):
        at = f"{where}.sorts[{j}]"
        _need(isinstance(s, dict), "a sort is a mapping", at)
        direction = str(s.get("direction", "asc")).strip().lower()
        _need(direction in ("asc", "desc"), f"unsupported value '{direction}'", at)
        key = _text(s, "key" if "key" in s else "property", at)
        sorts.append(Sort(alias_of(key), direction == "desc", bool(_one_of(str(s.get("nulls", "first")), NULL_ORDERS, at))))
    columns = []
    if entry.get("columns") is not None:
        for j, c in enumerate(_list(entry, "columns", where)):
            at = f"{where}.columns[{j}]"
            if isinstance(c, str):
                c = {"key": c}
            _need(isinstance(c, dict), "a column is a string or a mapping", at)
            _need(isinstance(c.get("hidden", False), bool), "'hidden' must be a boolean", at)
            columns.append(Column(alias_of(_text(c, "key", at)), c.get("label"), c.get("width"), c.get("hidden", False)))
    else:
        sizes = entry.get("columnSize") if isinstance(entry.get("columnSize"), dict) else {}
        for j, c in enumerate(_list(entry, "order", where)):
            _need(isinstance(c, str), "a column name is a string", f"{where}.order[{j}]")
            columns.append(Column(alias_of(c), width=sizes.get(c)))
    aggregates = []
    for j, a in enumerate(_list(entry, "aggregates", where)):
        at = f"{where}.aggregates[{j}]"
        _need(isinstance(a, dict), "an aggregate is a mapping", at)
        op = _text(a, "op", at).lower()
        _need(op in AGGREGATES, f"unsupported value '{op}'", at)
        aggregates.append(Aggregate(_text(a, "alias", at), op, alias_of(a["key"]) if isinstance(a.get("key"), str) else None))
    relations = []
    for j, r in enumerate(_list(entry, "relations", where)):
        relations.append(alias_of(r) if isinstance(r, str) else _text(r, "key", f"{where}.relations[{j}]"))
    rollups = []
    for j, r in enumerate(_list(entry, "rollups", where)):
        at = f"{where}.rollups[{j}]"
        _need(isinstance(r, dict), "a rollup is a mapping", at)
        op = _text(r, "op", at).lower()
        _need(op in AGGREGATES, f"unsupported value '{op}'", at)
        rollups.append(Rollup(_text(r, "alias", at), _text(r, "relation", at), _text(r, "target", at), op))
    groups = [alias_of(g) for g in _list(entry, "group_by", where)]
    own = _text(entry, "source", where) if entry.get("source") is not None else source
    name = _text(entry, "name", where) if entry.get("name") is not None else f"table-{i + 1}"
    extras = {k: v for k, v in entry.items() if k not in KNOWN_VIEW_KEYS}
    return View(name, "table", own, tuple(filters), tuple(sorts), tuple(columns), tuple(groups), tuple(aggregates), tuple(relations), tuple(rollups), extras)


def parse_base(text: str) -> list[View]:
    """Views of a `.base` document."""
    from quillspark.sources.yaml12 import YamlError, load

    if not text.strip():
        raise BaseError(".base document is empty")
    try:
        root = load(text)
    except YamlError as e:
        raise BaseError(f"failed to parse .base yaml: {e}") from e
    return views_of(root)


def views_of(root: object) -> list[View]:
    _need(isinstance(root, dict), "the root must be a mapping", ".base")
    _need("views" in root, "required field is missing", "views")
    _need(isinstance(root["views"], list), "expected a sequence", "views")
    source, defaults = None, []
    filters = root.get("filters")
    if filters is not None:
        _need(isinstance(filters, dict), "expected a mapping", "filters")
        _need(filters.get("and") is None or isinstance(filters["and"], list), "expected a sequence", "filters.and")
        for text in filters.get("and") or []:
            _need(isinstance(text, str), "expected a string", "filters.and[]")
            folder, clause = parse_expression(text)
            if clause is not None:
                defaults.append(clause)
            elif source is not None and source != folder:
                raise BaseError(f"unsupported root filter expression: {text}", "filters.and")
            else:
                source = folder
    return [_parse_view(v, i, source, defaults) for i, v in enumerate(root["views"])]


def to_config(views: list[View]) -> str:
    """Views as the JSON that is stored."""
    return json.dumps({"views": [asdict(v) for v in views]}, ensure_ascii=False)


def decode_config(config: str) -> list[View]:
    """Views of a stored configuration: a serialised document or `{"raw": yaml}`."""
    try:
        data = json.loads(config)
    except ValueError as e:
        raise BaseError(f"configuration is no JSON: {e}") from e
    if isinstance(data, dict) and isinstance(data.get("raw"), str):
        return parse_base(data["raw"])
    if not isinstance(data, dict) or not isinstance(data.get("views"), list):
        raise BaseError("configuration holds no views")
    made = {"filters": Filter, "sorts": Sort, "columns": Column, "aggregates": Aggregate, "rollups": Rollup}
    out = []
    for v in data["views"]:
        v = {k: tuple(made[k](**x) for x in xs) if k in made else tuple(xs) if isinstance(xs, list) else xs for k, xs in v.items()}
        out.append(View(**v))
    return out


def find_view(views: list[View], name: str | None) -> View:
    """The view of a name, case ignored; the first if no name is given. Two views of one name are an error."""
    seen = set()
    for v in views:
        if v.name.lower() in seen:
            raise BaseError(f"duplicate view name '{v.name}'")
        seen.add(v.name.lower())
    if name is None and views:
        return views[0]
    for v in views:
        if name is not None and v.name.lower() == name.strip().lower():
            return v
    raise BaseError(f"view not found: {name}")


def required_keys(v: View) -> tuple[str, ...]:
    """Property keys that the view reads, in order, once each with ASCII case ignored."""
    every = [
        *(f.key for f in v.filters),
        *(s.key for s in v.sorts),
        *(c.key for c in v.columns),
        *v.group_by,
        *(a.key for a in v.aggregates if a.key),
        *v.relations,
        *(r.relation for r in v.rollups),
        *(r.target for r in v.rollups),
    ]
    return tuple({k.lower(): k for k in reversed(every)}[low] for low in dict.fromkeys(k.lower() for k in every))


#: A page size that stands for all rows: the plan has no limit.
ALL_ROWS = 2_000_000_000


def compile_view(v: View, page: int = 1, page_size: int = 50, summaries: bool = True) -> TablePlan:
    if page < 1 or page_size < 1:
        raise BaseError("page and page size start at 1")
    keys = required_keys(v)
    return TablePlan(v, keys, v.columns or tuple(Column(k) for k in keys), page_size, (page - 1) * page_size, summaries)


def with_columns(views: list[View], name: str, columns: list[Column]) -> list[View]:
    """The document with the columns of one view replaced."""
    target = find_view(views, name)
    return [replace(v, columns=tuple(columns)) if v is target else v for v in views]


def diagnose(config: str) -> list[Diagnostic]:
    """Problems of a stored configuration, errors first, then by code, field and message."""
    try:
        views = decode_config(config)
    except BaseError as e:
        return [Diagnostic(0, "bases.parse.invalid_schema", e.where or "", str(e))]
    out, seen = [], set()
    for i, v in enumerate(views):
        if v.name.lower() in seen:
            out.append(Diagnostic(0, "bases.view.duplicate_name", f"views[{i}].name", f"duplicate view name '{v.name}'"))
        seen.add(v.name.lower())
        if not v.columns:
            out.append(Diagnostic(1, "bases.table.missing_columns", f"views[{i}].columns", f"table view '{v.name}' has no configured columns"))
            continue
        keys = set()
        for j, c in enumerate(v.columns):
            if c.key.lower() in keys:
                out.append(Diagnostic(1, "bases.column.duplicate_key", f"views[{i}].columns[{j}].key", f"table view '{v.name}' has duplicate column key '{c.key}'"))
            keys.add(c.key.lower())
        if all(c.hidden for c in v.columns):
            out.append(Diagnostic(1, "bases.table.all_columns_hidden", f"views[{i}].columns", f"table view '{v.name}' hides all configured columns"))
    return sorted(out)
