"""Execution of table views: pivot, relations, rollups, filters, sorting, grouping, summaries and paging."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators.resolve import resolve
from quillspark.plans.bases import ALL_ROWS, Aggregate, BaseError, Filter, Rollup, TablePlan

VIRTUAL = {"path": "path", "file_path": "path", "folder": "folder", "file_folder": "folder", "ext": "ext", "file_ext": "ext", "title": "title"}


def virtual(key: str) -> Column | None:
    """Columns that are made of the path; they go before properties of the same name."""
    path = F.col("file_path")
    made = {"path": path, "folder": T.folder_of(path), "ext": T.extension_of(path), "title": T.title_of(path)}
    name = VIRTUAL.get(key.lower())
    return V.scalar_value(made[name], "string") if name else None


def source_filter(source: str | None, parity: bool = False) -> Column:
    """Whether a path is the source or lies in it. parity: `_` and `%` are wildcards and ASCII case is ignored."""
    if not source:
        return F.lit(True)
    p = source.strip().strip("/")
    path = F.col("normalized_path")
    return (path == p) | (F.ilike(path, F.lit(p + "/%")) if parity else F.startswith(path, F.lit(p + "/")))


def candidates(files: DataFrame, source: str | None, parity: bool = False) -> DataFrame:
    return files.filter(F.col("is_markdown") & source_filter(source, parity)).select("file_id", F.col("normalized_path").alias("file_path"))


def pivot(rows: DataFrame, properties: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Candidate files with a value column v0, v1, ... per key; keys are case-sensitive, missing ones have no value.

    One grouping of the properties of the wanted keys, joined to the files; a file without properties is kept.
    """
    wanted = [k for k in keys if virtual(k) is None]
    if wanted:
        p = properties.filter(F.col("key").isin(wanted)).select("file_id", "key", F.struct("updated_at", "property_id", "value_json").alias("c"))
        wide = p.groupBy("file_id").agg(*[F.max(F.when(F.col("key") == k, F.col("c"))).alias(f"c{i}") for i, k in enumerate(keys) if k in wanted])
        rows = rows.join(wide, "file_id", "left")
    cols = {}
    for i, k in enumerate(keys):
        made = virtual(k)
        cols[f"v{i}"] = made if made is not None else V.json_value(F.col(f"c{i}.value_json"))
    return rows.select("file_id", "file_path", *[c.alias(n) for n, c in cols.items()])


def tokens(v: Column) -> Column:
    """Targets that a relation value names: strings, elements of nested arrays, `path` of objects; brackets, alias,
    fragment and leading slash are taken off and `.md` put on, so only notes can be meant."""
    texts = F.when(v["rank"] == V.OBJECT, F.array(F.coalesce(F.get_json_object(v["s"], "$.path"), F.lit("")))).otherwise(V.scalar_texts(v))
    bare = F.transform(texts, lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"^\[\[|\]\]$", ""), r"[|#].*$", ""))
    bare = F.transform(bare, lambda t: F.regexp_replace(F.trim(t), r"^/+", ""))
    return F.transform(bare, lambda t: F.when(t == "", t).when(F.endswith(F.lower(t), F.lit(".md")), t).otherwise(F.concat(t, F.lit(".md"))))


def relate(rows: DataFrame, value: str, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of a relation column: (file_id, pos, target, to_id, to_path), and diagnostics (file_id, target, code).

    Every element keeps its place and repeats stay; notes are found as link targets are, from the file's folder.
    """
    each = rows.select("file_id", "file_path", F.posexplode(tokens(F.col(value))).alias("pos", "target"))
    each = each.withColumn("request_id", F.concat_ws("|", "file_id", "pos"))
    found = resolve(each.filter("target <> ''").select("request_id", "target", F.col("file_path").alias("source_path")), notes)
    out = each.join(found.select("request_id", F.col("file_id").alias("to_id"), F.col("path").alias("to_path")), "request_id", "left").drop("request_id")
    code = F.when(F.col("target") == "", "invalid_relation_token").otherwise("relation_target_not_found")
    return out, out.filter("to_id is null").select("file_id", "target", code.alias("code"))


def relation_column(links: DataFrame, name: str) -> DataFrame:
    """Relation values per file: JSON array of {file_id, path, resolved} or {target, resolved, reason}, in place."""
    hit = F.to_json(F.struct(F.col("to_id").alias("file_id"), F.col("to_path").alias("path"), F.lit(True).alias("resolved")))
    miss = F.to_json(F.struct("target", F.lit(False).alias("resolved"), F.when(F.col("target") == "", "invalid_relation_token").otherwise("relation_target_not_found").alias("reason")))
    item = F.struct("pos", F.when(F.col("to_id").isNotNull(), hit).otherwise(miss).alias("j"))
    # one list per file, as long as the property that holds it
    rows = links.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return rows.select("file_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda i: i["j"]), ","), F.lit("]")).alias(name))


def rollup(links: DataFrame, properties: DataFrame, r: Rollup) -> DataFrame:
    """file_id and the rollup as JSON text `x`: count of found targets with repeats, or sum, min, max of their property."""
    to = links.filter("to_id is not null").select("file_id", "to_id")
    if r.op == "count":
        return to.groupBy("file_id").agg(F.count(F.lit(1)).cast("string").alias("x"))
    p = properties.filter(F.col("key") == r.target).groupBy(F.col("file_id").alias("to_id")).agg(F.max(F.struct("updated_at", "property_id", "value_json")).alias("c"))
    v = to.join(p, "to_id").select("file_id", V.json_value(F.col("c.value_json")).alias("v"))
    return v.groupBy("file_id").agg(aggregate(r.op, F.col("v")).alias("x"))


def aggregate(op: str, v: Column | None) -> Column:
    """An aggregate as JSON text: sum of numbers (0.0 for none), min and max by type and value with JSON null lowest."""
    if op == "count":
        return F.count(F.lit(1)).cast("string")
    if op == "sum":
        return (F.coalesce(F.sum(v["n"]), F.lit(0.0)) if v is not None else F.first(F.lit(0.0))).cast("string")
    if v is None:
        return F.first(F.lit("null"))
    key = F.when(V.is_present(v), F.struct(F.coalesce(v["rank"], F.lit(0)).alias("r"), v["b"].alias("b"), v["n"].alias("n"), F.when(v["rank"] == V.STRING, v["s"]).alias("s"), v["len"].alias("l"), v["repr"].alias("repr")))
    return F.coalesce((F.min(key) if op == "min" else F.max(key))["repr"], F.lit("null"))


def _literal(x: object) -> Column:
    return V.json_value(F.lit(json.dumps(x, ensure_ascii=False)))


def _compare(v: Column, x: object, op: str) -> Column:
    a, b = V.length_key(v, null_rank=True), V.length_key(_literal(x), null_rank=True)
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def condition(f: Filter, v: Column | None) -> Column:
    """A view filter as a column. Values of different types are ordered by type; nothing is an error."""
    v = V.missing() if v is None else v
    here = V.is_present(v)
    scalar = F.coalesce(~v["rank"].isin(V.ARRAY, V.OBJECT), F.lit(True))
    text = F.when(here & v["rank"].isNull(), "null").otherwise(V.display(v))
    no = F.lit(False)
    same = here & F.coalesce(v["repr"] == _literal(f.value)["repr"], no)
    if f.op == "eq":
        out = same
    elif f.op == "not_eq":
        out = ~same
    elif f.op in ("gt", "gte", "lt", "lte"):
        out = here & F.coalesce(_compare(v, f.value, f.op), no)
    elif f.op == "contains":
        if isinstance(f.value, list | dict):
            return no
        needle = "null" if f.value is None else str(f.value).lower()
        whole = F.contains(F.lower(F.when(v["rank"] == V.OBJECT, v["s"]).otherwise(text)), F.lit(needle))
        out = here & F.when(v["rank"] == V.ARRAY, F.exists(V.scalar_texts(v), lambda x: F.contains(F.lower(x), F.lit(needle)))).otherwise(whole)
    elif f.op in ("in", "not_in"):
        if not isinstance(f.value, list):
            return F.lit(f.op == "not_in")
        hit = here & F.coalesce(reduce(lambda a, b: a | b, [v["repr"] == _literal(x)["repr"] for x in f.value], no), no)
        out = hit if f.op == "in" else ~hit
    elif f.op == "exists":
        out = here == F.lit(f.value if isinstance(f.value, bool) else True)
    elif f.op in ("starts_with", "ends_with", "not_starts_with"):
        if isinstance(f.value, list | dict):
            return no
        other = F.lit("null" if f.value is None else str(f.value).lower() if isinstance(f.value, bool) else str(f.value))
        test = (F.endswith if f.op == "ends_with" else F.startswith)(text, other)
        out = here & scalar & test
        out = ~out if f.op == "not_starts_with" else out
    else:
        raise BaseError(f"unknown filter {f.op}")
    return F.coalesce(out, no)


@dataclass
class ViewResult:
    rows: DataFrame  # the page
    total: DataFrame  # one row, column total
    summaries: DataFrame | None
    diagnostics: DataFrame | None
    filtered: DataFrame


def execute(plan: TablePlan, files: DataFrame, properties: DataFrame, parity: bool = False) -> ViewResult:
    """Run a view. Columns of the page are file_id, file_path and the view's columns as JSON text (`null` if missing).

    With group_by or aggregates the page holds groups, in order of the JSON text of their key: the keys, the aggregates,
    and file_id and file_path of the group's first row. Aggregates over no rows give no group.
    """
    view = plan.view
    rows = pivot(candidates(files, view.source, parity), properties, plan.keys)
    names = {k.lower(): f"v{i}" for i, k in enumerate(plan.keys)}
    notes = files.filter("is_markdown")
    problems, related = [], {}
    for key in view.relations:
        col = names[key.lower()]
        links, bad = relate(rows, col, notes)
        related[key.lower()] = links
        problems.append(bad.withColumn("key", F.lit(key)))
        rows = rows.withColumn("has", V.is_present(F.col(col))).drop(col).join(relation_column(links, "rel"), "file_id", "left")
        rows = rows.withColumn(col, V.json_value(F.coalesce("rel", F.when(F.col("has"), "[]")))).drop("rel", "has")
    for i, r in enumerate(view.rollups):
        links = related.get(r.relation.lower())
        empty = {"count": "0", "sum": "0.0"}.get(r.op, "null")
        x = rollup(links, properties, r) if links is not None else rows.select("file_id", F.lit(None).cast("string").alias("x"))
        rows = rows.join(x, "file_id", "left").withColumn(f"u{i}", V.json_value(F.coalesce("x", F.lit(empty)))).drop("x")
        names[r.alias.lower()] = f"u{i}"

    def value(key: str) -> Column | None:
        made = virtual(key)
        return made if made is not None else F.col(names[key.lower()]) if key.lower() in names else None

    for f in view.filters:
        rows = rows.filter(condition(f, value(f.key)))
    sorts = []
    for s in view.sorts:
        v = value(s.key)
        if v is not None:
            sorts.append((V.length_key(v), s))
    order = [V.order(k, s.desc, s.nulls_last) for k, s in sorts] + [F.col("file_path").asc(), F.col("file_id").asc()]
    shown = lambda k: F.coalesce(value(k)["repr"], F.lit("null")) if value(k) is not None else F.lit("null")
    problems_df = reduce(DataFrame.unionByName, problems) if problems else None
    if view.group_by or view.aggregates:
        page = groups(rows, view.group_by, view.aggregates, value, sorts)
        ordered = page.orderBy("group_key")
        out = _page(ordered, plan).drop("group_key")
        return ViewResult(out, page.agg(F.count(F.lit(1)).alias("total")), None, problems_df, rows)
    columns = list(dict.fromkeys(c.key for c in plan.columns))
    page = _page(rows.orderBy(*order), plan)
    page = page.select("file_id", "file_path", *[shown(k).alias(_free(k)) for k in columns])
    summary = summaries(rows, columns, value) if plan.summaries else None
    return ViewResult(page, rows.agg(F.count(F.lit(1)).alias("total")), summary, problems_df, rows)


def _free(key: str) -> str:
    """Name of a view column, apart from the columns that every page has."""
    return f"{key}_" if key in ("file_id", "file_path") else key


def _page(rows: DataFrame, plan: TablePlan) -> DataFrame:
    rows = rows.offset(plan.offset) if plan.offset else rows
    return rows if plan.limit == ALL_ROWS else rows.limit(plan.limit)


def groups(rows: DataFrame, keys: tuple[str, ...], aggregates: tuple[Aggregate, ...], value: object, sorts: list) -> DataFrame:
    """Groups by the JSON text of the keys; missing and null share a group, 5 and 5.0 do not."""
    by = [F.coalesce(value(k)["repr"], F.lit("null")).alias(f"g{i}") if value(k) is not None else F.lit("null").alias(f"g{i}") for i, k in enumerate(keys)]
    first = F.min_by(F.struct("file_id", "file_path"), F.struct("file_path", "file_id"))
    aggs = [aggregate(a.op, value(a.key) if a.key else None).alias(f"a{i}") for i, a in enumerate(aggregates)]
    out = rows.groupBy(*by).agg(first.alias("f"), F.count(F.lit(1)).alias("n"), *aggs).filter("n > 0")
    if sorts:
        # the first row in sort order stands for its group: first of each of 64 parts, then of these
        order = [V.order(k, s.desc, s.nulls_last) for k, s in sorts] + [F.col("file_path").asc(), F.col("file_id").asc()]
        parts = rows.select("*", *by).withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(64)))
        names = [f"g{i}" for i in range(len(keys))]
        parts = parts.withColumn("r", F.row_number().over(Window.partitionBy(*names, "salt").orderBy(*order))).filter("r = 1")
        heads = parts.withColumn("r", F.row_number().over(Window.partitionBy(*names or [F.lit(1)]).orderBy(*order))).filter("r = 1").select(*names, F.struct("file_id", "file_path").alias("f"))
        if names:
            out = out.drop("f").join(heads, names)
        else:  # one group, so one head
            top = heads.first()
            out = out.withColumn("f", F.struct(F.lit(top["f"]["file_id"] if top else None).alias("file_id"), F.lit(top["f"]["file_path"] if top else None).alias("file_path")))
    named = sorted((k, i) for i, k in enumerate(keys))
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), f"g{i}") for k, i in named]), F.lit("}")) if named else F.lit("{}")
    return out.select(
        F.col("f.file_id").alias("file_id"),
        F.col("f.file_path").alias("file_path"),
        *[F.col(f"g{i}").alias(_free(k)) for i, k in enumerate(keys)],
        *[F.col(f"a{i}").alias(_free(a.alias)) for i, a in enumerate(aggregates)],
        text.alias("group_key"),
    )


def summaries(rows: DataFrame, columns: list[str], value: object) -> DataFrame:
    """One row per column over all filtered rows: column, count, min, max (JSON text), avg of numbers; nulls skipped."""
    parts = []
    for k in columns:
        v = value(k)
        if v is None:
            parts.append(F.struct(F.lit(k).alias("column"), F.first(F.lit(0).cast("long")).alias("count"), F.first(F.lit(None).cast("string")).alias("min"), F.first(F.lit(None).cast("string")).alias("max"), F.first(F.lit(None).cast("double")).alias("avg")))
            continue
        key = F.when(v["rank"].isNotNull(), F.struct(v["rank"].alias("r"), v["b"].alias("b"), v["n"].alias("n"), F.when(v["rank"] == V.STRING, v["s"]).alias("s"), v["len"].alias("l"), v["repr"].alias("repr")))
        parts.append(F.struct(F.lit(k).alias("column"), F.count(v["rank"]).alias("count"), F.min(key)["repr"].alias("min"), F.max(key)["repr"].alias("max"), F.avg(v["n"]).alias("avg")))
    return rows.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def collect_view(plan: TablePlan, files: DataFrame, properties: DataFrame) -> dict:
    """A view's page with its total, as one value."""
    r = execute(plan, files, properties)
    rows = [{k: (json.loads(v) if k not in ("file_id", "file_path") and v is not None else v) for k, v in x.asDict().items()} for x in r.rows.collect()]
    return {"rows": rows, "total": r.total.first()[0], "summaries": [s.asDict() for s in r.summaries.collect()] if r.summaries is not None else []}
