"""Building and maintaining the index: full rebuild, increments, drift, consistency, and healing."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions import text as T
from quillspark.ids import id_column
from quillspark.operators import postings
from quillspark.operators.resolve import resolve_links
from quillspark.operators.search import with_surfaces
from quillspark.runtime import cut, parallelism
from quillspark.sources import vault
from quillspark.sources.store import IndexStore

PENDING = "PENDING.json"
LINK_RULES = 2  # version of link resolution; an index made by another is rebuilt


class IndexError_(ValueError):
    pass


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def build_tables(prepared: DataFrame, stamp: str, all_files: DataFrame | None = None, all_headings: DataFrame | None = None, all_blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index tables of prepared entries. Links are resolved among all_files, by default the prepared ones."""
    t = F.lit(stamp)
    files = prepared.filter("hash_blake3 is not null").select("file_id", "normalized_path", "match_key", "absolute_path", "size_bytes", "modified_unix_ms", "hash_blake3", "is_markdown", t.alias("indexed_at"))
    notes = prepared.filter("is_markdown and hash_blake3 is not null")
    headings = notes.select("file_id", F.inline("headings")).select("file_id", "level", "text", "slug", "line_number")
    blocks = notes.select("file_id", F.explode("blocks").alias("block_id"))
    p = notes.select("file_id", F.inline("properties"))
    properties = p.select(id_column("prop", [F.col("file_id"), F.col("key")]).alias("property_id"), "file_id", "key", "value_type", "value_json", t.alias("updated_at"))
    k = notes.select("file_id", "normalized_path", F.inline("tasks"))
    tasks = k.select(
        id_column("task", [F.col("file_id"), F.col("line_number").cast("string")]).alias("task_id"), "file_id", F.col("normalized_path").alias("file_path"), F.lower("normalized_path").alias("file_path_lc"),
        F.col("line_number").cast("long").alias("line_number"), "state", "text", F.lower("text").alias("text_lc"), t.alias("updated_at"),
    )
    search = notes.select("file_id", F.lower("normalized_path").alias("normalized_path_lc"), "title_lc", "content_lc", t.alias("updated_at"), "normalized_path")
    search = with_surfaces(search)
    bases = prepared.filter("base_config is not null").select(id_column("base", [F.col("normalized_path")]).alias("base_id"), "file_id", F.col("base_config").alias("config_json"), t.alias("updated_at"))
    raw = notes.select("file_id", F.col("normalized_path").alias("source_path"), F.inline("links"))
    links = resolve_links(raw, all_files if all_files is not None else files, all_headings if all_headings is not None else headings, all_blocks if all_blocks is not None else blocks)
    links = links.select("link_id", F.col("file_id").alias("source_file_id"), "raw_target", "resolved_file_id", "heading_slug", "block_id", "is_unresolved", t.alias("created_at"), "unresolved_reason", "source_field")
    diagnostics = prepared.select("normalized_path", F.inline("diagnostics")).select("normalized_path", "code", "message")
    cache = prepared.select(F.lit("").alias("cache_key"), "file_id", F.lit("").alias("html"), F.lit("").alias("content_hash"), t.alias("updated_at")).filter(F.lit(False))
    return {"files": files, "links": links, "properties": properties, "bases": bases, "tasks": tasks, "search_index": search, "postings": postings.build(search), "headings": headings, "blocks": blocks, "render_cache": cache, "diagnostics": diagnostics}


def rebuild(store: IndexStore, root: str, case_sensitive: bool = True, strict: bool = False) -> dict:
    """Index the whole vault into a new version. Contents are read once: prepared rows are written, then spread over the
    tables."""
    stamp = now()
    prepared = cut(vault.prepare_entries(vault.scan(store.spark, root, case_sensitive).repartition(parallelism(store.spark)), strict))
    version = store.write(build_tables(prepared, stamp), link_rules=LINK_RULES, root=str(Path(root).resolve()), case_sensitive=case_sensitive, indexed_at=stamp)
    return {"version": version, **{n: store.table(n).count() for n in ("files", "links", "properties", "tasks", "bases")}}


# --- drift --------------------------------------------------------------------------------------------------------


def drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Differences between the vault and the index: normalized_path, change (insert, update, remove).

    Paths are paired by match key and path; an update differs in absolute path, size or time. Hashes are not compared.
    """
    have = files.select("match_key", "normalized_path", F.struct("absolute_path", "size_bytes", "modified_unix_ms").alias("old"))
    seen = manifest.select("match_key", "normalized_path", F.struct("absolute_path", "size_bytes", "modified_unix_ms").alias("new"))
    both = seen.join(have, ["match_key", "normalized_path"], "full_outer")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select("normalized_path", change.alias("change")).filter("change is not null")


def metadata_reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Numbers of files inserted, updated, removed and unchanged; manifest must hold hash_blake3, which counts here."""
    have = files.select("match_key", "normalized_path", F.struct("size_bytes", "modified_unix_ms", "hash_blake3").alias("old"))
    seen = manifest.select("match_key", "normalized_path", F.struct("size_bytes", "modified_unix_ms", "hash_blake3").alias("new"))
    both = seen.join(have, ["match_key", "normalized_path"], "full_outer")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def first_seen(paths: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(paths))


def chunks(paths: Iterable[str], size: int) -> list[list[str]]:
    """Distinct paths in order of first sight, in batches of at most `size`."""
    if size < 1:
        raise IndexError_("batch size must be at least 1")
    every = first_seen(paths)
    return [every[i : i + size] for i in range(0, len(every), size)]


# --- increments ---------------------------------------------------------------------------------------------------


def _without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col("file_id").alias(column)), column, "left_anti").select(*df.columns)


def apply_changes(store: IndexStore, root: str, paths: DataFrame, strict: bool = False) -> dict:
    """Bring the index up to date with changed paths (normalized_path); the result equals a full rebuild.

    Files whose size, time and hash are as indexed are skipped. Rows of changed and vanished files are replaced, ids of
    known files stay. Links are resolved again: all of them if files came or went, else those of changed notes and those
    that a change may touch. What is written follows the change: new rows, and tombstones for those they replace.
    """
    state = store.state()
    stamp = now()
    spark = store.spark
    old = store.tables()
    asked = paths.select("normalized_path").distinct()
    manifest = vault.scan(spark, root, state.get("case_sensitive", True)).join(asked, "normalized_path", "left_semi")
    known = old["files"].select("normalized_path", "file_id", F.col("size_bytes").alias("old_size"), F.col("modified_unix_ms").alias("old_time"), F.col("hash_blake3").alias("old_hash"))
    prepared = cut(vault.prepare_entries(manifest.join(known.select("normalized_path", "file_id"), "normalized_path", "left"), strict))
    merged = prepared.join(known.drop("file_id"), "normalized_path", "left")
    same = (F.col("old_hash") == F.col("hash_blake3")) & (F.col("old_size") == F.col("size_bytes")) & (F.col("old_time") == F.col("modified_unix_ms"))
    changed = cut(merged.filter(~F.coalesce(same, F.lit(False))).drop("old_size", "old_time", "old_hash"))
    gone = cut(old["files"].join(asked, "normalized_path", "left_semi").join(prepared.select("normalized_path"), "normalized_path", "left_anti").select("file_id"))
    n_new = changed.join(known, "normalized_path", "left_anti").count()
    n_changed, n_gone = changed.count(), gone.count()
    if not n_changed and not n_gone:
        return {"version": store.version(), "upserted": 0, "removed": 0, "links_moved": 0}
    touched = cut(changed.select("file_id").unionByName(gone))
    fresh = build_tables(changed, stamp)
    # the tables as they will be, for resolving links; only what is new is written
    after = {n: _without(old[n], touched, "file_id").unionByName(fresh[n].select(*old[n].columns)) for n in ("files", "headings", "blocks")}
    rest = _without(old["links"], touched, "source_file_id")
    if n_new or n_gone:
        again = rest
    else:
        hit = touched.select(F.col("file_id").alias("resolved_file_id")).withColumn("hit", F.lit(True))
        marked = rest.join(hit, "resolved_file_id", "left")
        fragment = F.col("heading_slug").isNotNull() | F.col("block_id").isNotNull()
        again = marked.filter(F.col("is_unresolved") | F.col("resolved_file_id").isNull() | (F.coalesce("hit", F.lit(False)) & fragment)).select(*rest.columns)
    source = after["files"].select(F.col("file_id").alias("source_file_id"), F.col("normalized_path").alias("source_path"))
    raw = again.join(source, "source_file_id").select("link_id", F.col("source_file_id").alias("file_id"), "source_path", "raw_target", "heading_slug", "block_id", "source_field", "created_at")
    new = changed.filter("is_markdown and hash_blake3 is not null").select("file_id", F.col("normalized_path").alias("source_path"), F.inline("links")).withColumn("created_at", F.lit(stamp))
    resolve = lambda rows: resolve_links(rows, after["files"], after["headings"], after["blocks"]).withColumnRenamed("file_id", "source_file_id").select(*old["links"].columns)
    # of the links that are checked again, only those that come out differently are written
    was = again.select("link_id", F.struct("resolved_file_id", "is_unresolved", "unresolved_reason").alias("was"))
    moved = resolve(raw).join(was, "link_id").filter(~F.struct("resolved_file_id", "is_unresolved", "unresolved_reason").eqNullSafe(F.col("was")))
    moved = cut(moved.select(*old["links"].columns))
    links = moved.unionByName(resolve(new.select(*raw.columns)))
    tombs = touched.select(F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(asked.select(F.lit("path").alias("kind"), F.col("normalized_path").alias("id"))).unionByName(moved.select(F.lit("link").alias("kind"), F.col("link_id").alias("id")))
    version = store.append({**fresh, "links": links}, tombs, indexed_at=stamp, link_rules=LINK_RULES)
    return {"version": version, "upserted": n_changed, "removed": n_gone, "links_moved": moved.count()}


def apply_batches(store: IndexStore, root: str, paths: Iterable[str], batch_size: int = 128) -> list[dict]:
    """Changes in batches of at most batch_size paths."""
    return [apply_changes(store, root, store.spark.createDataFrame([(p,) for p in part], "normalized_path string")) for part in chunks(paths, batch_size)]


def apply_checkpointed(store: IndexStore, root: str, paths: Iterable[str], batch_size: int = 128, max_batches: int | None = None) -> dict:
    """Changes in batches, with the paths that are left kept beside the index after each; no paths resumes what was left."""
    pending = json.loads(store.files.read(PENDING)) if store.files.exists(PENDING) else []
    todo = first_seen([*pending, *paths])
    done = 0
    for part in chunks(todo, batch_size) if todo else []:
        if max_batches is not None and done >= max_batches:
            break
        store.files.replace(PENDING, json.dumps(todo))
        apply_changes(store, root, store.spark.createDataFrame([(p,) for p in part], "normalized_path string"))
        todo = todo[len(part) :]
        done += 1
        store.files.replace(PENDING, json.dumps(todo))
    return {"batches": done, "pending": len(todo)}


def repair(store: IndexStore, root: str) -> dict:
    """Find drift and apply it."""
    found = drift(vault.scan(store.spark, root, store.state().get("case_sensitive", True)), store.table("files"))
    return apply_changes(store, root, cut(found.select("normalized_path")))


def needs_rebuild(store: IndexStore, root: str) -> bool:
    """Whether the index must be rebuilt: none there, other link rules, another root."""
    s = store.state()
    return not s.get("version") or s.get("link_rules") != LINK_RULES or s.get("root") != str(Path(root).resolve())


def refresh(store: IndexStore, root: str) -> dict:
    return rebuild(store, root) if needs_rebuild(store, root) else repair(store, root)


def stale_cleanup(tables: dict[str, DataFrame], manifest: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of vanished paths. Links stay as they are until they are reconciled."""
    gone = tables["files"].join(manifest.select("normalized_path").distinct(), "normalized_path", "left_anti").select("file_id")
    return {n: _without(tables[n], gone, "file_id") for n in ("files", "properties", "tasks", "search_index", "postings", "headings", "blocks", "bases", "render_cache") if n in tables}


# --- consistency --------------------------------------------------------------------------------------------------

# fixed values: kinds of issues
ISSUES = ("broken_link_target", "link_resolution_mismatch", "missing_on_disk", "orphan_base", "orphan_link_source", "orphan_property", "orphan_render_cache", "path_outside_root")


def consistency(tables: dict[str, DataFrame], root: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Issues of an index: kind, id, sorted by both. Paths are checked if root and manifest are given."""
    ids = tables["files"].select("file_id").distinct()
    issue = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    missing = lambda df, c: df.filter(F.col(c).isNotNull()).join(ids.withColumnRenamed("file_id", c), c, "left_anti")
    links = tables["links"]
    odd = (F.col("is_unresolved") & F.col("resolved_file_id").isNotNull()) | (~F.col("is_unresolved") & F.col("resolved_file_id").isNull())
    parts = [
        issue("orphan_property", missing(tables["properties"], "file_id"), "property_id"),
        issue("orphan_link_source", missing(links, "source_file_id"), "link_id"),
        issue("broken_link_target", missing(links, "resolved_file_id"), "link_id"),
        issue("link_resolution_mismatch", links.filter(odd), "link_id"),
    ]
    if "bases" in tables:
        parts.append(issue("orphan_base", missing(tables["bases"], "file_id"), "base_id"))
    if "render_cache" in tables:
        parts.append(issue("orphan_render_cache", missing(tables["render_cache"], "file_id"), "cache_key"))
    if root is not None:
        inside = F.startswith(F.col("absolute_path"), F.lit(root.rstrip("/") + "/"))
        parts.append(issue("path_outside_root", tables["files"].filter(~inside), "file_id"))
    if manifest is not None:
        parts.append(issue("missing_on_disk", tables["files"].join(manifest.select("normalized_path").distinct(), "normalized_path", "left_anti"), "file_id"))
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("kind", "id")


def heal(tables: dict[str, DataFrame], root: str | None = None, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables with the issues mended: orphans are dropped, broken and contradictory links become unresolved."""
    out = dict(tables)
    files = tables["files"]
    if root is not None:
        files = files.filter(F.startswith(F.col("absolute_path"), F.lit(root.rstrip("/") + "/")))
    if manifest is not None:
        files = files.join(manifest.select("normalized_path").distinct(), "normalized_path", "left_semi").select(*tables["files"].columns)
    ids = files.select("file_id").distinct()
    out["files"] = files
    for name in ("properties", "bases", "tasks", "search_index", "postings", "headings", "blocks"):
        if name in tables:
            out[name] = tables[name].join(ids, "file_id", "left_semi").select(*tables[name].columns)
    if "render_cache" in tables:
        cache = tables["render_cache"]
        out["render_cache"] = cache.filter("file_id is null").unionByName(cache.join(ids, "file_id", "left_semi").select(*cache.columns))
    links = tables["links"].join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_semi")
    hit = ids.select(F.col("file_id").alias("resolved_file_id")).withColumn("ok", F.lit(True))
    links = links.join(hit, "resolved_file_id", "left")
    ok = F.coalesce("ok", F.lit(False)) & ~F.col("is_unresolved")
    reason = F.when(~ok, F.coalesce("unresolved_reason", T.unresolved_reason(F.col("raw_target"), F.col("heading_slug"), F.col("block_id"))))
    links = links.withColumns({"resolved_file_id": F.when(ok, F.col("resolved_file_id")), "is_unresolved": ~ok, "unresolved_reason": reason})
    out["links"] = links.select(*tables["links"].columns)
    return out


def heal_store(store: IndexStore, root: str) -> dict:
    tables = store.tables()
    manifest = cut(vault.scan(store.spark, root, store.state().get("case_sensitive", True)))
    before = consistency(tables, str(Path(root).resolve()), manifest).count()
    store.write(heal(tables, str(Path(root).resolve()), manifest))
    return {"issues": before, "left": consistency(store.tables(), str(Path(root).resolve()), manifest).count()}


def empty_index(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in schema.TABLES.items()}


def staleness(store: IndexStore, root: str) -> dict:
    """Number of drifted paths and age of the index."""
    found = drift(vault.scan(store.spark, root, store.state().get("case_sensitive", True)), store.table("files"))
    return {"drift_paths": found.count(), "indexed_at": store.state().get("indexed_at"), "checked_at": int(time.time() * 1000)}
