"""The public interface: one `query` over all scopes, and the commands around it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Config, ConfigError
from quillspark.functions import values as V
from quillspark.operators import baseview, graph, index, meta, search, tasks
from quillspark.plans import bases as B
from quillspark.plans import where as W
from quillspark.sources import sinks, tables, vault
from quillspark.sources.events import EventLog, poll
from quillspark.sources.store import IndexStore

ADAPTERS = {"docs": "docs_fts", "base": "base_table", "graph": "graph_index", "meta": "meta_index", "task": "task_index"}

# the command catalogue: category -> names, fixed
COMMANDS = {
    "base": ("list", "schema", "validate", "view"),
    "doc": ("list", "read", "write"),
    "graph": ("backlinks", "components", "deadends", "floating", "inbound-scope", "neighbors", "orphans", "outgoing", "path", "unresolved", "walk"),
    "health": ("check",),
    "meta": ("aliases", "properties", "tags", "tasks"),
    "query": ("run",),
    "task": ("list", "set-state"),
    "vault": ("open", "preflight", "reconcile", "reindex", "stats"),
}
MAX_CACHED = 1000  # results that are kept; the oldest goes first
WRITES = {("doc", "write"), ("task", "set-state")}


class CommandError(Exception):
    """A failed command: exit code 1 failure or 2 blocked, and a stable code."""

    def __init__(self, code: str, message: str, exit_code: int = 1) -> None:
        super().__init__(message)
        self.code, self.exit_code = code, exit_code


def classify(e: Exception) -> CommandError:
    if isinstance(e, CommandError):
        return e
    if isinstance(e, sinks.WriteDisabledError):
        return CommandError("write_disabled", str(e), 2)
    if isinstance(e, W.QueryParseError):
        return CommandError("query_parse_error", str(e))
    if isinstance(e, ConfigError):
        return CommandError("blocked_prerequisite", str(e), 2)
    if isinstance(e, search.QueryError | vault.VaultPathError | B.BaseError):
        return CommandError("invalid_argument", str(e))
    return CommandError("command_failed", str(e))


def catalog() -> list[dict]:
    """All commands in order of category and name."""
    return [{"category": c, "name": f"{c}.{n}", "writes": (c, n) in WRITES} for c in sorted(COMMANDS) for n in sorted(COMMANDS[c])]


def envelope(tool: str, data: object, began: float, count: int | None = None, total: int | None = None, offset: int = 0, error: CommandError | None = None) -> dict:
    """The answer of a command. hasMore follows from offset, count and total."""
    meta_ = {"tool": tool, "elapsed": round((time.time() - began) * 1000)}
    if count is not None:
        meta_["count"] = count
    if total is not None:
        meta_["total"] = total
        meta_["hasMore"] = offset + (count or 0) < total
    out = {"ok": error is None, "data": data, "meta": meta_}
    return out | ({"error": {"code": error.code, "message": str(error)}} if error else {})


def stream_json(rows: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, fetched partition by partition."""
    for r in rows.toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)


def parse_scope(scope: str) -> tuple[str, str | None]:
    """docs, graph, task, meta:tags|aliases|properties or base:<id or path>; case is ignored but for `base:`."""
    if scope.startswith("base:"):
        return "base", scope[5:]
    low = scope.strip().lower()
    if low in ("docs", "graph", "task"):
        return low, None
    if low in ("meta:tags", "meta:aliases", "meta:properties"):
        return "meta", low[5:]
    raise CommandError("invalid_argument", f"unsupported query scope '{scope}'")


def explain(scope: str, query: str | None = None, where: str | None = None, sort: str | None = None, select: str | None = None, limit: int = 100, offset: int = 0, execute: bool = False) -> dict:
    """Logical and physical plan of a query."""
    kind, _ = parse_scope(scope)
    keys, tree = W.parse_sort(sort), W.parse_where(where)
    stages = [s for s, on in (("query_text", bool(query)), ("where_expr", tree is not None), ("sort", bool(keys))) if on]
    projection = search.parse_select(select) if kind == "docs" else [c.strip() for c in (select or "").split(",") if c.strip()]
    logical = {"scope": scope, "query": query, "has_where": tree is not None, "sort_keys": [{"field": k.field, "direction": "desc" if k.desc else "asc", "null_order": "last" if k.nulls_last else "first"} for k in keys], "projection": projection, "limit": max(1, limit), "offset": offset, "execute": execute}
    return {"logical_plan": logical, "physical_plan": {"adapter": ADAPTERS[kind], "stages": stages, "limit": max(1, limit), "offset": offset, "execute": execute}}


class Vault:
    """An opened vault: its index tables and the commands over them."""

    def __init__(self, spark: SparkSession, index_tables: dict[str, DataFrame] | None = None, config: Config | None = None, store: IndexStore | None = None) -> None:
        self.spark, self.config, self.store = spark, config, store
        self._tables = index_tables
        self._cache: dict[str, object] = {}
        self._digest: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, config: Config) -> Vault:
        return cls(spark, config=config, store=IndexStore(spark, config.index_path))

    @property
    def t(self) -> dict[str, DataFrame]:
        return self._tables if self._tables is not None else self.store.tables()

    # results by plan; a change of the metadata or of the version drops all of them
    def cached(self, key: str, make: Callable[[], object]) -> object:
        digest = self.store.version() if self.store else meta.digest(*(self.t[n] for n in ("files", "properties") if n in self.t))
        if digest != self._digest:
            self._cache, self._digest = {}, digest
        if key not in self._cache:
            while len(self._cache) >= MAX_CACHED:
                self._cache.pop(next(iter(self._cache)))
            self._cache[key] = make()
        return self._cache[key]

    def warm(self) -> Vault:
        """Keep the tables in memory, for many small reads of one version."""
        self._tables = {n: t.persist() for n, t in self.t.items()}
        return self

    def query(self, from_: str, query: str | None = None, path: str | None = None, view_name: str | None = None, select: str | None = None, where: str | None = None, sort: str | None = None, explain_only: bool = False, limit: int = 100, offset: int = 0) -> DataFrame | dict:
        """Rows of a scope. where, sort, select and explain hold for docs and base; the other scopes ignore them.

        Pages of an index on disk are kept until its version changes, so a query that is asked again runs no job.
        """
        kind, name = parse_scope(from_)
        if explain_only and kind in ("docs", "base"):
            return explain(from_, query, where, sort, select, limit, offset)
        if self.store is None or limit > search.MAX_PAGE or kind == "graph" and path is not None:
            return self._rows(kind, name, query, path, view_name, select, where, sort, limit, offset)

        def page() -> DataFrame:
            rows = self._rows(kind, name, query, path, view_name, select, where, sort, limit, offset)
            return self.spark.createDataFrame(rows.collect(), rows.schema)

        return self.cached(repr((from_, query, path, view_name, select, where, sort, limit, offset)), page)

    def _rows(self, kind: str, name: str | None, query: str | None, path: str | None, view_name: str | None, select: str | None, where: str | None, sort: str | None, limit: int, offset: int) -> DataFrame:
        if kind == "docs":
            return search.DocsQuery(query or "", where, sort, select, limit, offset).run(self.t["search_index"], self.t.get("postings"))
        if kind == "base":
            if view_name is None:
                raise CommandError("invalid_argument", "query over a base requires --view-name")
            return self.base_rows(name, view_name, where, sort, select, limit, offset)
        if kind == "graph":
            if path is not None:
                return graph.link_panels(self.t["links"], self.t["files"], path)
            rows = graph.unresolved(self.t["links"], self.t["files"])
            return (rows.offset(offset) if offset else rows).limit(max(1, limit))
        if kind == "task":
            return tasks.list_tasks(self.t["tasks"], max(1, limit), offset, query=query)
        rows = {"tags": meta.tags, "aliases": meta.aliases, "properties": meta.property_keys}[name](self.t["properties"])
        return (rows.offset(offset) if offset else rows).limit(max(1, limit))

    def _views(self, id_or_path: str) -> list[B.View]:
        row = tables.base_by(self.t["bases"], self.t["files"], id_or_path).first()
        if row is None:
            raise CommandError("invalid_argument", f"base must not be unknown: {id_or_path}")
        return B.decode_config(row["config_json"])

    def base_rows(self, id_or_path: str, view_name: str, where: str | None = None, sort: str | None = None, select: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows of a view as JSON text per column; where and sort see all rows of the view before paging."""
        plan = B.compile_view(B.find_view(self._views(id_or_path), view_name), 1, B.ALL_ROWS, summaries=False)
        rows = baseview.execute(plan, self.t["files"], self.t["properties"]).rows
        keys, tree = W.parse_sort(sort), W.parse_where(where)

        def value(name: str) -> object:
            if name in ("file_id", "file_path"):
                return V.scalar_value(F.col(name), "string")
            if name == "path":  # the built-in path goes before a column of that name
                return V.scalar_value(F.col("file_path"), "string")
            return V.json_value(F.col(f"`{name}`")) if name in rows.columns else None

        if tree is not None:
            rows = rows.filter(W.compile_where(tree, value))
        if keys:
            rows = rows.orderBy(*W.compile_sort(keys, value, F.col("file_path"), F.col("file_id")))
        if offset:
            rows = rows.offset(offset)
        rows = rows.limit(max(1, limit))
        if (tree is not None or keys) and "path" in rows.columns:
            rows = rows.drop("path")
        if select:
            want = [c.strip() for c in select.split(",") if c.strip()]
            unknown = [c for c in want if c not in rows.columns]
            if unknown:
                raise CommandError("invalid_argument", f"select must not name unknown columns: {unknown}")
            rows = rows.select(*[f"`{c}`" for c in want])
        return rows

    def base_view(self, id_or_path: str, view_name: str, page: int = 1, page_size: int = 50) -> dict:
        return baseview.collect_view(B.compile_view(B.find_view(self._views(id_or_path), view_name), page, page_size, summaries=False), self.t["files"], self.t["properties"])

    def base_list(self) -> dict:
        """Bases with the names of their views; those that can't be read apart, with what is wrong."""
        good, bad = [], []
        for r in tables.bases_with_paths(self.t["bases"], self.t["files"]).toLocalIterator():
            try:
                good.append({"base_id": r["base_id"], "path": r["path"], "views": [v.name for v in B.decode_config(r["config_json"])]})
            except B.BaseError:
                bad.append({"base_id": r["base_id"], "path": r["path"], "diagnostics": [asdict(d) for d in B.diagnose(r["config_json"])]})
        return {"items": good, "invalid": bad}

    def base_schema(self, id_or_path: str, view_name: str) -> list[dict]:
        plan = B.compile_view(B.find_view(self._views(id_or_path), view_name))
        return [{"key": c.key, "label": c.label or c.key, "hidden": c.hidden, "filterable": True, "sortable": True} for c in plan.columns]

    def base_validate(self, id_or_path: str) -> list[B.Diagnostic]:
        row = tables.base_by(self.t["bases"], self.t["files"], id_or_path).first()
        return B.diagnose(row["config_json"]) if row else []

    def events(self, log: EventLog, after_id: int = 0, limit: int = 1000) -> tuple[DataFrame, int]:
        return poll(log.read(self.spark), after_id, limit)

    # --- notes on disk ---

    def doc_read(self, path: str) -> dict:
        return vault.read_note(self.config.vault_root, path)

    def note_context(self, path: str) -> dict:
        return {"note": self.doc_read(path), "links": [r.asDict() for r in graph.link_panels(self.t["links"], self.t["files"], path).collect()]}

    def doc_write(self, path: str, content: str, allow_writes: bool = False, log: EventLog | None = None) -> dict:
        """Write a note, bring the index up to date, and log the change. Denied unless writes are allowed."""
        if self.config.read_only and not allow_writes:
            raise sinks.WriteDisabledError

        def after() -> None:
            index.apply_changes(self.store, self.config.vault_root, self.spark.createDataFrame([(path,)], "normalized_path string"))

        out = sinks.note_put(self.config.vault_root, path, content, True, after)
        if log:
            out["event_id"] = log.note_changed(tables.file_by_path(self.t["files"], path).first()["file_id"], path, out["action"])
        return out

    def task_set_state(self, path: str, line: int, state: str, allow_writes: bool = False) -> dict:
        if self.config.read_only and not allow_writes:
            raise sinks.WriteDisabledError
        return sinks.set_task_state(self.config.vault_root, path, line, state, True, lambda: index.apply_changes(self.store, self.config.vault_root, self.spark.createDataFrame([(path,)], "normalized_path string")))

    # --- upkeep ---

    def reindex(self) -> dict:
        return index.rebuild(self.store, self.config.vault_root, self.config.case_sensitive)

    def reconcile(self) -> dict:
        return index.refresh(self.store, self.config.vault_root)

    def preflight(self) -> dict:
        """State of the index without changing it: schema, version, whether it must be rebuilt."""
        s = self.store.state()
        return {"schema": s.get("schema"), "version": s.get("version"), "needs_rebuild": index.needs_rebuild(self.store, self.config.vault_root), **self.store.preflight()}

    def migrate(self) -> dict:
        """Bring the schema of the index up to date."""
        return self.store.migrate()

    def stats(self) -> DataFrame:
        """Numbers of files, notes, links, unresolved links, properties and tasks in one row."""
        return stats(self.t)

    def health(self) -> dict:
        checks = [{"name": "vault", "status": "pass"}]
        try:
            self.store.check_schema()
            checks.append({"name": "index_schema", "status": "pass"})
        except Exception as e:  # noqa: BLE001
            checks.append({"name": "index_schema", "status": "degraded", "message": str(e)})
        lag = index.staleness(self.store, self.config.vault_root)["drift_paths"]
        checks.append({"name": "index", "status": "pass" if lag == 0 else "degraded", "index_lag": lag})
        return {"status": "ready" if all(c["status"] == "pass" for c in checks) else "degraded", "checks": checks}


def stats(t: dict[str, DataFrame]) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    one = lambda df: df.withColumn("k", F.lit(1))
    out = one(t["files"].agg(F.count(F.lit(1)).alias("files"), n(F.col("is_markdown")).alias("notes")))
    out = out.join(one(t["links"].agg(F.count(F.lit(1)).alias("links"), n(F.col("is_unresolved")).alias("unresolved"))), "k")
    out = out.join(one(t["properties"].agg(F.count(F.lit(1)).alias("properties"))), "k")
    return out.drop("k")


def command(tool: str) -> Callable:
    """Wraps a command so that it answers with an envelope, also when it fails."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*a: object, **k: object) -> dict:
            began = time.time()
            try:
                data = f(*a, **k)
            except Exception as e:  # noqa: BLE001
                return envelope(tool, None, began, error=classify(e))
            if isinstance(data, DataFrame):
                data = [r.asDict(recursive=True) for r in data.collect()]
            return envelope(tool, data, began, count=len(data) if isinstance(data, list) else None)

        return run

    return wrap


__all__ = ["CommandError", "Vault", "catalog", "classify", "command", "envelope", "explain", "stats", "stream_json"]
