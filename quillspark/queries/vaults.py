"""Queries over vaults on disk that are made of the test tables, and SQL that states the same result.

`big` holds the notes of vault_search, with front matter of two properties, and the view documents of vault_files. `small`
holds a note for each supplier and each nation; copies of it are changed, written to and copied. Vaults lie in the shared
folder, are made once per session and table folder, and are written by the executors.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import api, config, daemon
from quillspark.functions import values as V
from quillspark.operators import baseview, graph, index, meta, search, tasks
from quillspark.plans import bases as B
from quillspark.plans import where as W
from quillspark.runtime import cut, once, shared_path, table
from quillspark.sources import events, sinks, tables, vault
from quillspark.sources.store import IndexStore

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

BASE_DOC = """filters:
  and:
    - file.inFolder("notes/projects")
    - '!note.status.isEmpty()'
views:
  - type: table
    name: Open
    filters:
      - {key: status, op: not_eq, value: done}
      - {key: title, op: not_starts_with, value: project-m}
      - {key: path, op: ends_with, value: .md}
    sort:
      - {property: file.path, direction: DESC}
    order: [file.path, note.status]
  - table
"""


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _write(texts: DataFrame, root: str) -> str:
    """Write (path, text) as files below root."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, text in zip(pdf["path"], pdf["text"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    os.makedirs(root, exist_ok=True)
    texts.select("path", "text").repartition(8, "path").mapInPandas(run, "n long").count()
    return root


# --- the vaults ----------------------------------------------------------------------------------------------------


def _big_texts(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "vault_properties").filter("key in ('status', 'priority')").groupBy("file_id").pivot("key", ["status", "priority"]).agg(F.max(F.struct("updated_at", "property_id", "value_json")))
    st, pr = F.col("status.value_json"), F.col("priority.value_json")
    line = lambda name, v, rx: F.when(F.rlike(v, F.lit(rx)), F.concat(F.lit(name + ": "), v, F.lit("\n"))).otherwise("")
    notes = table(spark, d, "vault_search").select("file_id", "normalized_path", "content_lc").distinct().join(latest, "file_id", "left")
    text = F.concat(F.lit("---\n"), F.coalesce(line("status", st, '^"[a-z ]+"$'), F.lit("")), F.coalesce(line("priority", pr, "^[0-9]+$"), F.lit("")), F.lit("---\n"), F.coalesce("content_lc", F.lit("")))
    notes = notes.select(F.col("normalized_path").alias("path"), text.alias("text"))
    docs = table(spark, d, "vault_files").filter("normalized_path like '%.base'").select(F.col("normalized_path").alias("path"), F.lit(BASE_DOC).alias("text")).distinct()
    return notes.unionByName(docs)


def _small_texts(spark: SparkSession, d: str) -> DataFrame:
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    notes = n.select(F.format_string("nations/%s.md", "n_name").alias("path"), F.format_string("---\nregion: %s\n---\n# %s\n", "r_name", "n_name").alias("text"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(
        F.lit("---\nbalance: "), F.col("s_acctbal").cast("string"), F.lit("\nrank: "), F.col("s_suppkey").cast("string"), F.lit("\nTags: [supplier, '#n"), F.col("s_nationkey").cast("string"), F.lit("', Supplier]\n---\n# "), "s_name",
        F.lit("\n\n- [ ] call "), "s_name", F.lit("\n- [x] check\n[["), "n_name", F.lit("]] and [nation](../../nations/"), "n_name", F.lit(".md) and [[gone]]\nkept ^s-"), F.col("s_suppkey").cast("string"), F.lit("\n"),
    )
    return notes.unionByName(s.select(F.format_string("suppliers/%s/s%d.md", "n_name", "s_suppkey").alias("path"), text.alias("text")))


def _built(spark: SparkSession, d: str, kind: str) -> tuple[str, IndexStore]:
    def make() -> tuple[str, IndexStore]:
        base = _local(shared_path(spark, f"vault-{kind}"))
        root = _write({"big": _big_texts, "small": _small_texts}[kind](spark, d), base + "/files")
        store = IndexStore(spark, base + "/index")
        index.rebuild(store, root)
        return root, store

    return once(spark, (d, kind), make)


def _vault(spark: SparkSession, d: str, kind: str) -> api.Vault:
    root, store = _built(spark, d, kind)
    return api.Vault(spark, config=config.resolve({"vault_root": root, "index_path": str(store.path)}), store=store)


_CTE = r"""WITH
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC, normalized_path DESC, size_bytes DESC, hash_blake3 DESC) AS rn FROM vault_files) WHERE rn = 1),
la AS (SELECT file_id, key, arg_max(value_json, (updated_at, property_id, value_json)) AS j FROM vault_properties WHERE key IN ('status', 'priority') GROUP BY 1, 2),
nt AS (SELECT DISTINCT file_id, normalized_path AS path, coalesce(content_lc, '') AS body FROM vault_search),
vt AS (SELECT path, body, st.j AS st, pr.j AS pr, '---' || chr(10) || coalesce('status: ' || st.j || chr(10), '') || coalesce('priority: ' || pr.j || chr(10), '') || '---' || chr(10) || body AS text
  FROM nt LEFT JOIN (SELECT * FROM la WHERE key = 'status' AND regexp_full_match(j, '"[a-z ]+"')) st ON st.file_id = nt.file_id LEFT JOIN (SELECT * FROM la WHERE key = 'priority' AND regexp_full_match(j, '[0-9]+')) pr ON pr.file_id = nt.file_id),
bases AS (SELECT DISTINCT normalized_path AS path FROM vault_files WHERE ends_with(normalized_path, '.base')),
sv AS (SELECT 'suppliers/' || n_name || '/s' || s_suppkey || '.md' AS path, s_suppkey AS k, s_name AS name, n_name AS nation, s_acctbal AS bal, s_nationkey AS nk,
  '---' || chr(10) || 'balance: ' || s_acctbal || chr(10) || 'rank: ' || s_suppkey || chr(10) || 'Tags: [supplier, ''#n' || s_nationkey || ''', Supplier]' || chr(10) || '---' || chr(10) || '# ' || s_name || chr(10) || chr(10) || '- [ ] call ' || s_name || chr(10) || '- [x] check' || chr(10)
  || '[[' || n_name || ']] and [nation](../../nations/' || n_name || '.md) and [[gone]]' || chr(10) || 'kept ^s-' || s_suppkey || chr(10) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey),
nv AS (SELECT 'nations/' || n_name || '.md' AS path, n_nationkey AS nk, n_regionkey AS rk, n_name AS name, '---' || chr(10) || 'region: ' || r_name || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10) AS text FROM nation JOIN region ON r_regionkey = n_regionkey)
"""


def _q(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _CTE + sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    """Stated rows as SQL."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# --- sources -------------------------------------------------------------------------------------------------------


@_q(f", every AS (SELECT path, text FROM vt UNION ALL SELECT path, {_values([(BASE_DOC,)], 'x').split('(VALUES ')[1].split(') t(')[0]} FROM bases) SELECT path, strlen(text) AS size_bytes FROM every")
def s01_scan(spark: SparkSession, d: str) -> DataFrame:
    return vault.scan(spark, _built(spark, d, "big")[0]).select(F.col("normalized_path").alias("path"), "size_bytes")


@_q("SELECT DISTINCT raw_target AS path, trim(raw_target) <> '' AND NOT regexp_matches(raw_target, '^[/\\\\]|^[A-Za-z]:') AND NOT list_has_any(regexp_split_to_array(raw_target, '[/\\\\]'), ['.', '..']) AS valid FROM vault_links WHERE raw_target IS NOT NULL")
def s02_valid_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which link targets are paths within a vault."""

    def ok(path: str) -> bool:
        try:
            return bool(vault.validate_relative(path))
        except vault.VaultPathError:
            return False

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(valid=pdf["path"].map(ok))

    return table(spark, d, "vault_links").filter("raw_target is not null").select(F.col("raw_target").alias("path")).distinct().mapInPandas(run, "path string, valid boolean")


@_q("SELECT path, strlen(text) AS size_bytes, true AS is_markdown, count(*) OVER (PARTITION BY text) AS same FROM vt UNION ALL SELECT path, strlen(%s), false, (SELECT count(*) FROM bases) FROM bases" % _values([(BASE_DOC,)], "x").split("(VALUES (")[1].split(")) t(")[0])
def i01_s03_rebuilt_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a full rebuild, and how many share each fingerprint."""
    files = _built(spark, d, "big")[1].table("files")
    same = files.groupBy("hash_blake3").agg(F.count(F.lit(1)).alias("same"))
    return files.join(same, "hash_blake3").select(F.col("normalized_path").alias("path"), "size_bytes", "is_markdown", "same")


@_q("SELECT path, 'status' AS key, 'string' AS value_type, st AS value_json FROM vt WHERE st IS NOT NULL UNION ALL SELECT path, 'priority', 'number', pr || '.0' FROM vt WHERE pr IS NOT NULL")
def s05_front_matter(spark: SparkSession, d: str) -> DataFrame:
    t = _built(spark, d, "big")[1]
    return meta.properties_with_paths(t.table("properties"), t.table("files")).select("path", "key", "value_type", "value_json")


@_q("""SELECT path, 'balance' AS key, 'number' AS value_type, bal::VARCHAR AS value_json FROM sv UNION ALL SELECT path, 'rank', 'number', k || '.0' FROM sv UNION ALL SELECT path, 'tags', 'list', '["supplier","n' || nk || '"]' FROM sv
  UNION ALL SELECT nv.path, 'region', 'string', to_json(r_name)::VARCHAR FROM nv JOIN region ON r_regionkey = rk""")
def v11_projected_properties(spark: SparkSession, d: str) -> DataFrame:
    """Front matter as typed properties; words of tags are merged with case ignored."""
    t = _built(spark, d, "small")[1]
    return meta.properties_with_paths(t.table("properties"), t.table("files")).select("path", "key", "value_type", "value_json")


@_q("SELECT path FROM bases")
def s06_s11_bases(spark: SparkSession, d: str) -> DataFrame:
    t = _built(spark, d, "big")[1]
    return tables.bases_with_paths(t.table("bases"), t.table("files")).select("path")


@_q("SELECT path, 'Open,table-2' AS views, 0 AS n_invalid FROM bases")
def s07_q03_base_list(spark: SparkSession, d: str) -> DataFrame:
    """Decoded view documents with the names of their views."""
    found = _vault(spark, d, "big").base_list()
    return spark.createDataFrame([(i["path"], ",".join(i["views"]), len(found["invalid"])) for i in found["items"]], "path string, views string, n_invalid int")


@_q(_values([("path", "path", False), ("status", "status", False)], "key, label, hidden"))
def q03_base_schema(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d, "big")
    at = tables.bases_with_paths(v.t["bases"], v.t["files"]).first()["path"]
    return spark.createDataFrame([(c["key"], c["label"], c["hidden"]) for c in v.base_schema(at, "Open")], "key string, label string, hidden boolean")


@_q("""SELECT path, st AS status FROM vt WHERE path LIKE 'notes/projects/%' AND st IS NOT NULL AND st <> '"done"' AND NOT starts_with(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), 'project-m')""")
def b08_b09_b10_i15_i16_parsed_view(spark: SparkSession, d: str) -> DataFrame:
    """A view document as written, with root filters, aliases of fields and filters of its own, run over the vault."""
    v = _vault(spark, d, "big").t
    plan = B.compile_view(B.find_view(B.parse_base(BASE_DOC), "open"), 1, B.ALL_ROWS)
    return baseview.execute(plan, v["files"], v["properties"]).rows.select(F.col("file_path").alias("path"), "status")


@_q("""SELECT path, st AS status FROM vt WHERE path LIKE 'notes/projects/%' AND st IN ('"open"', '"active"') AND NOT starts_with(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), 'project-m') ORDER BY path DESC LIMIT 40""")
def q01_p04_base_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a view through the unified query, with a condition and a sort of the query."""
    v = _vault(spark, d, "big")
    at = tables.bases_with_paths(v.t["bases"], v.t["files"]).first()["path"]
    rows = v.query(f"base:{at}", view_name="Open", where="status == 'open' or status == 'active'", sort="file_path:desc", select="file_path,status", limit=40)
    return rows.select(F.col("file_path").alias("path"), "status")


@_q("""SELECT path, name AS title, 1 AS n_headings, 3 AS n_properties, 3 AS n_links FROM sv UNION ALL SELECT path, name, 1, 1, 0 FROM nv""")
def s04_q04_notes_read(spark: SparkSession, d: str) -> DataFrame:
    """Notes as they are read from disk, with the links of their index."""
    root, store = _built(spark, d, "small")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            notes = [vault.read_note(root, p) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"].tolist(), "title": [n["title"] for n in notes], "n_headings": [len(n["headings"]) for n in notes], "n_properties": [len(n["properties"]) for n in notes]})

    files, links = store.table("files"), store.table("links")
    read = files.select(F.col("normalized_path").alias("path")).mapInPandas(run, "path string, title string, n_headings int, n_properties int")
    n = graph.links_with_paths(links, files).groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    return read.join(n, "path", "left").fillna(0, ["n_links"])


@_q("SELECT 'supplier' AS token, (SELECT count(*) FROM sv) AS total UNION ALL SELECT 'n' || nk, count(*) FROM sv GROUP BY nk")
def q01_meta_tags(spark: SparkSession, d: str) -> DataFrame:
    return _vault(spark, d, "small").query("meta:tags", limit=1000)


# --- links ---------------------------------------------------------------------------------------------------------

_LINKED = r""", wl AS (SELECT path, unnest(regexp_extract_all(body, '(?s)\[\[(.*?)\]\]', 1)) AS x FROM vt),
wp AS (SELECT DISTINCT path, x, trim(regexp_extract(split_part(x, '|', 1), '^([^#]*)', 1)) AS target, CASE WHEN contains(split_part(x, '|', 1), '#') THEN trim(regexp_replace(split_part(x, '|', 1), '(?s)^[^#]*#', '')) ELSE '' END AS frag FROM wl)"""


@_q(_LINKED + " SELECT path, target AS raw_target, count(*) AS n, count(*) FILTER (starts_with(frag, '^')) AS n_blocks, count(*) FILTER (frag <> '' AND NOT starts_with(frag, '^')) AS n_headings FROM wp WHERE target <> '' GROUP BY 1, 2")
def i03_extracted_links(spark: SparkSession, d: str) -> DataFrame:
    """Wiki links of the notes' bodies, once each."""
    t = _built(spark, d, "big")[1]
    rows = graph.links_with_paths(t.table("links"), t.table("files")).filter("source_field = 'body'")
    return rows.groupBy(F.col("source_path").alias("path"), "raw_target").agg(F.count(F.lit(1)).alias("n"), F.count("block_id").alias("n_blocks"), F.count("heading_slug").alias("n_headings"))


_RANKED = r""", ks AS (SELECT DISTINCT t, home, unnest(CASE WHEN contains(t, '/') THEN list_concat([t], list_transform(range(1, len(string_split(home, '/')) + 1), lambda i: array_to_string(string_split(home, '/')[1:i], '/') || '/' || t)) ELSE ['//' || t] END) AS v FROM asks),
  kb AS (SELECT DISTINCT t, home, regexp_replace(v, '\.md$', '') AS k FROM ks),
  cand AS (SELECT path, regexp_replace(lower(path), '\.md$', '') AS k FROM targets UNION ALL SELECT path, '//' || regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\.md$', '') FROM targets),
  hits AS (SELECT DISTINCT t, home, path, lower(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END) AS there FROM kb JOIN cand USING (k)),
  parts AS (SELECT *, CASE WHEN home = '' THEN [] ELSE string_split(home, '/') END AS a, CASE WHEN there = '' THEN [] ELSE string_split(there, '/') END AS b FROM hits),
  dist AS (SELECT *, len(a) + len(b) - 2 * coalesce(list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), 0) AS steps FROM parts),
  best AS (SELECT t, home, arg_min(path, ((home <> there)::INT, steps, lower(path), path)) AS found, count(*) AS n_matches FROM dist GROUP BY 1, 2)"""
_HOME = "lower(CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END)"


@_q(_LINKED + f", targets AS (SELECT path FROM vt UNION ALL SELECT path FROM bases), asks AS (SELECT DISTINCT lower(target) AS t, {_HOME.format('path')} AS home FROM wp WHERE frag = '' AND target <> '')" + _RANKED + f" SELECT wp.path, target AS raw_target, found AS resolved_path FROM wp LEFT JOIN best ON best.t = lower(target) AND best.home = {_HOME.format('wp.path')} WHERE frag = '' AND target <> '' GROUP BY ALL")
def i04_resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Where the links of the notes lead, of those without a fragment."""
    t = _built(spark, d, "big")[1]
    rows = graph.links_with_paths(t.table("links"), t.table("files")).filter("source_field = 'body' and heading_slug is null and block_id is null")
    return rows.select(F.col("source_path").alias("path"), "raw_target", "resolved_path").distinct()


@_q("""SELECT path, 'body' AS source_field, nation AS raw_target, 'nations/' || nation || '.md' AS resolved_path, NULL AS reason FROM sv UNION ALL SELECT path, 'body', 'gone', NULL, 'missing-note' FROM sv
  UNION ALL SELECT path, 'body:markdown', '../../nations/' || nation || '.md', 'nations/' || nation || '.md', NULL FROM sv""")
def v07_i04_links_of_vault(spark: SparkSession, d: str) -> DataFrame:
    """Wiki and Markdown links of a vault and where they lead."""
    t = _built(spark, d, "small")[1]
    return graph.links_with_paths(t.table("links"), t.table("files")).select(F.col("source_path").alias("path"), "source_field", "raw_target", "resolved_path", F.col("unresolved_reason").alias("reason"))


@_q("SELECT path, 's-' || k AS block_id FROM sv")
def v08_blocks_of_vault(spark: SparkSession, d: str) -> DataFrame:
    t = _built(spark, d, "small")[1]
    return t.table("blocks").join(t.table("files").select("file_id", F.col("normalized_path").alias("path")), "file_id").select("path", "block_id")


# --- changes of the index --------------------------------------------------------------------------------------------


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "normalized_path string")


def _changed(spark: SparkSession, d: str, step: str) -> list[tuple]:
    """What the index of a vault that changes holds after a step; steps run when they are first asked for, in order."""

    def steps() -> Iterator[tuple[str, list[tuple]]]:
        base = _local(shared_path(spark, "vault-changed"))
        root = _write(_small_texts(spark, d), base + "/files")
        store = IndexStore(spark, base + "/index")
        index.rebuild(store, root)
        supplier = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        of = {r["s_suppkey"]: f"suppliers/{r['n_name']}/s{r['s_suppkey']}.md" for r in supplier.select("s_suppkey", "n_name").collect()}
        nations = {r["n_name"]: r["n_regionkey"] for r in table(spark, d, "nation").collect()}

        def add(path: str, text: str) -> None:
            full = os.path.join(root, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "a") as f:
                f.write(text)

        def state() -> list[tuple]:
            files = store.table("files")
            n = store.table("tasks").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
            ok = store.table("links").groupBy(F.col("source_file_id").alias("file_id")).agg(F.count("resolved_file_id").alias("ok"))
            rows = files.join(n, "file_id", "left").join(ok, "file_id", "left")
            return [tuple(r) for r in rows.select("normalized_path", "size_bytes", F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))).collect()]

        for k in (k for k in of if k % 2 == 0):
            add(of[k], "- [ ] new\n")
        for k in (k for k in of if k % 7 == 0):
            os.remove(os.path.join(root, of[k]))
        extra = [f"extra/{n}.md" for n, r in nations.items() if r == 0]
        for p in extra:
            add(p, "# x\n[[gone]]\n")
        index.apply_changes(store, root, _paths(spark, [*(p for k, p in of.items() if k % 2 == 0 or k % 7 == 0), *extra]))
        yield "i05", state()
        again = [p for k, p in of.items() if k % 5 == 0 and k % 7]
        for p in again:
            add(p, "again\n")
        index.apply_batches(store, root, again + again[:3], max(1, (len(again) + 1) // 2))
        yield "i06", state()
        for p in extra:
            os.remove(os.path.join(root, p))
        add("gone.md", "# here now\n")
        first = index.apply_checkpointed(store, root, [*extra, "gone.md"], 3, 1)
        rest = index.apply_checkpointed(store, root, [])
        yield "i07", state()
        yield "i07_left", [(first["pending"], rest["pending"])]
        for n in nations:
            add(f"nations/{n}.md", "more\n")
        stale = index.staleness(store, root)["drift_paths"]
        index.repair(store, root)
        yield "i08", state()
        yield "i13", [(stale, index.staleness(store, root)["drift_paths"], index.needs_rebuild(store, root), index.needs_rebuild(store, root + "/nations"))]

    done, rest = once(spark, (d, "changed"), lambda: ({}, steps()))
    while step not in done:
        name, rows = next(rest)
        done[name] = rows
    return done[step]


_FILE_ROWS = "path string, size_bytes long, n_tasks long, n_resolved long"
_STEP5 = """, s5 AS (SELECT path, k, strlen(text) + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END AS size_bytes, 2 + (k % 2 = 0)::INT AS n_tasks, 2 AS n_resolved FROM sv WHERE k % 7 <> 0),
  x5 AS (SELECT 'extra/' || name || '.md' AS path, 13 AS size_bytes FROM nv WHERE rk = 0), n5 AS (SELECT path, strlen(text) AS size_bytes FROM nv)"""
_STEP6 = _STEP5 + ", s6 AS (SELECT path, size_bytes + CASE WHEN k % 5 = 0 THEN 6 ELSE 0 END AS size_bytes, n_tasks, n_resolved FROM s5)"


@_q(_STEP5 + " SELECT path, size_bytes, n_tasks, n_resolved FROM s5 UNION ALL SELECT path, size_bytes, 0, 0 FROM x5 UNION ALL SELECT path, size_bytes, 0, 0 FROM n5")
def i05_increment(spark: SparkSession, d: str) -> DataFrame:
    """The index after notes were changed, deleted and added."""
    return spark.createDataFrame(_changed(spark, d, "i05"), _FILE_ROWS)


@_q(_STEP6 + " SELECT path, size_bytes, n_tasks, n_resolved FROM s6 UNION ALL SELECT path, size_bytes, 0, 0 FROM x5 UNION ALL SELECT path, size_bytes, 0, 0 FROM n5")
def i06_batches(spark: SparkSession, d: str) -> DataFrame:
    """The index after changes in batches, some paths named twice."""
    return spark.createDataFrame(_changed(spark, d, "i06"), _FILE_ROWS)


@_q(_STEP6 + " SELECT path, size_bytes, n_tasks, 3 AS n_resolved FROM s6 UNION ALL SELECT path, size_bytes, 0, 0 FROM n5 UNION ALL SELECT 'gone.md', 11, 0, 0")
def i07_checkpointed(spark: SparkSession, d: str) -> DataFrame:
    """The index after batches that were interrupted and resumed; a note that came resolves the links that named it."""
    return spark.createDataFrame(_changed(spark, d, "i07"), _FILE_ROWS)


@_q(" SELECT (SELECT count(*) FROM nv WHERE rk = 0) + 1 - 3 AS pending_first, 0 AS pending_last")
def i07_resumed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_changed(spark, d, "i07_left"), "pending_first long, pending_last long")


@_q(_STEP6 + " SELECT path, size_bytes, n_tasks, 3 AS n_resolved FROM s6 UNION ALL SELECT path, size_bytes + 5, 0, 0 FROM n5 UNION ALL SELECT 'gone.md', 11, 0, 0")
def i08_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The index after drift was found and repaired."""
    return spark.createDataFrame(_changed(spark, d, "i08"), _FILE_ROWS)


@_q(" SELECT (SELECT count(*) FROM nv) AS drift_before, 0 AS drift_after, false AS rebuild, true AS rebuild_other_root")
def i13_staleness(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_changed(spark, d, "i13"), "drift_before long, drift_after long, rebuild boolean, rebuild_other_root boolean")


@_q("""SELECT path, CASE WHEN old.path IS NULL THEN 'insert' WHEN new.path IS NULL THEN 'remove' ELSE 'update' END AS change FROM
  (SELECT file_id || '|' || normalized_path AS path, max((size_bytes, modified_unix_ms)) AS v FROM vault_files WHERE size_bytes % 3 <> 0 GROUP BY 1) old FULL JOIN (SELECT file_id || '|' || normalized_path AS path, max((size_bytes, modified_unix_ms)) AS v FROM vault_files WHERE size_bytes % 5 <> 0 GROUP BY 1) new USING (path) WHERE old.v IS DISTINCT FROM new.v""")
def j08_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift between two views of the file table that leave out different rows, paired by path."""
    rows = table(spark, d, "vault_files").select(F.concat_ws("|", "file_id", "normalized_path").alias("normalized_path"), F.lit("k").alias("match_key"), F.lit("a").alias("absolute_path"), "size_bytes", "modified_unix_ms")
    side = lambda m: rows.filter(f"size_bytes % {m} <> 0").groupBy("normalized_path", "match_key", "absolute_path").agg(F.max(F.struct("size_bytes", "modified_unix_ms")).alias("v")).select("normalized_path", "match_key", "absolute_path", "v.*")
    return index.drift(side(5), side(3)).withColumnRenamed("normalized_path", "path")


@_q("""SELECT 'orphan_property' AS kind, property_id AS id FROM vault_properties WHERE file_id NOT IN (SELECT file_id FROM f) UNION SELECT 'orphan_link_source', link_id FROM vault_links WHERE source_file_id NOT IN (SELECT file_id FROM f)
  UNION SELECT 'broken_link_target', link_id FROM vault_links WHERE resolved_file_id IS NOT NULL AND resolved_file_id NOT IN (SELECT file_id FROM f) UNION SELECT 'link_resolution_mismatch', link_id FROM vault_links WHERE is_unresolved = (resolved_file_id IS NOT NULL)
  UNION SELECT 'orphan_base', property_id FROM vault_properties WHERE key = 'status' AND file_id NOT IN (SELECT file_id FROM f) UNION SELECT 'orphan_render_cache', property_id FROM vault_properties WHERE key = 'due' AND file_id NOT IN (SELECT file_id FROM f)
  UNION SELECT 'path_outside_root', file_id FROM f WHERE NOT starts_with(absolute_path, '/srv/vault/notes/') UNION SELECT 'missing_on_disk', file_id FROM f WHERE normalized_path LIKE 'notes/daily/%'""")
def i11_all_issues(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of issues; properties of two keys stand for view documents and rendered pages."""
    files = tables.current_rows(table(spark, d, "vault_files"))
    props = table(spark, d, "vault_properties").distinct()
    t = {"files": files, "links": table(spark, d, "vault_links").distinct(), "properties": props, "bases": props.filter("key = 'status'").withColumnRenamed("property_id", "base_id"), "render_cache": props.filter("key = 'due'").withColumnRenamed("property_id", "cache_key")}
    return index.consistency(t, "/srv/vault/notes", files.filter("normalized_path not like 'notes/daily/%'"))


# --- writes ----------------------------------------------------------------------------------------------------------


@_q("""SELECT CASE WHEN nk % 2 = 1 THEN 'moved/' ELSE 'w/' END || name || '.md' AS path, CASE WHEN nk % 3 = 0 THEN 0 ELSE 1 END AS n_done, CASE WHEN nk % 3 = 0 THEN 0 ELSE 1 END AS n_open, CASE WHEN nk % 3 = 0 THEN NULL ELSE nk || '.0' END AS nation, nk % 3 = 0 AS updated FROM nv WHERE nk % 10 <> 0""")
def s14_s15_s16_s17_writes(spark: SparkSession, d: str) -> DataFrame:
    """A note for each nation is created, gets a property and a task done, and is updated, moved or deleted."""
    root = _local(shared_path(spark, "vault-written"))
    os.makedirs(root)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        k, path = r["n_nationkey"], f"w/{r['n_name']}.md"
        sinks.note_create(root, path, "---\na: 1\n---\n- [ ] one\n- [ ] two\n", True)
        sinks.set_property(root, path, "nation", k, True)
        with open(os.path.join(root, path)) as f:
            line = f.read().split("\n").index("- [ ] two") + 1
        sinks.set_task_state(root, path, line, "done", True)
        if k % 3 == 0:
            sinks.note_update(root, path, "# updated\n", True)
        if k % 2 == 1:
            sinks.note_move(root, path, f"moved/{r['n_name']}.md", True)
            path = f"moved/{r['n_name']}.md"
        sinks.note_put(root, path, open(os.path.join(root, path)).read() + "end\n", True)
        if k % 10 == 0:
            sinks.note_delete(root, path, True)
    rows = cut(vault.prepare_entries(vault.scan(spark, root)))
    n = lambda s: F.size(F.filter("tasks", lambda t: t["state"] == s)).alias(f"n_{s}")
    nation = F.get(F.filter("properties", lambda p: p["key"] == "nation"), 0)["value_json"]
    return rows.select(F.col("normalized_path").alias("path"), n("done"), n("open"), nation.alias("nation"), F.contains("content_lc", F.lit("# updated\n")).alias("updated"))


@_q(_values([("path", None, False), ("status", "State", True)], "key, label, hidden"))
def s18_kept_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a view, kept in its document and read back."""
    kept = sinks.persist_view_columns(B.to_config(B.parse_base(BASE_DOC)), "open", [B.Column("path"), B.Column("status", "State", None, True)])
    return spark.createDataFrame([(c.key, c.label, c.hidden) for c in B.find_view(B.decode_config(kept), "Open").columns], "key string, label string, hidden boolean")


@_q(", every AS (SELECT path, text FROM sv UNION ALL SELECT path, text FROM nv) SELECT pass, 'note' AS kind, status, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM every, (VALUES ('plan', 'skipped'), ('copy', 'copied'), ('again', 'skipped')) t(pass, status) GROUP BY ALL")
def s19_a13_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of a copy of a vault: planned, made, and made again."""
    root, _ = _built(spark, d, "small")
    to = _local(shared_path(spark, "vault-copied"))
    out = None
    for name, apply in (("plan", False), ("copy", True), ("again", True)):
        part = cut(sinks.transfer_summary(sinks.execute_transfer(sinks.plan_transfer(spark, root, to), apply))).select(F.lit(name).alias("pass"), "kind", "status", "files", "bytes")
        out = part if out is None else out.unionByName(part)
    return out


@_q("SELECT * FROM region")
def s20_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a stream of JSON lines, read back."""
    rows = [json.loads(line) for line in api.stream_json(table(spark, d, "region"))]
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in rows], "r_regionkey int, r_name string")


# --- commands ----------------------------------------------------------------------------------------------------------


@_q("""SELECT 'docs' AS scope, least(1000, (SELECT count(*) FROM sv WHERE contains(lower(text), 'call supplier'))) AS n UNION ALL SELECT 'graph', least(1000, (SELECT count(*) FROM sv)) UNION ALL SELECT 'task', least(1000, (SELECT count(*) FROM sv)) UNION ALL SELECT 'meta:properties', 4 UNION ALL SELECT 'meta:aliases', 0""")
def q01_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of rows that the unified query gives in each scope."""
    v = _vault(spark, d, "small")
    ask = {"docs": "call supplier", "graph": None, "task": "call", "meta:properties": None, "meta:aliases": None}
    return spark.createDataFrame([(s, v.query(s, q, limit=1000).count()) for s, q in ask.items()], "scope string, n long")


_EXPLAINED = [("docs", "docs_fts", "query_text,where_expr,sort", "path,title", 10), ("base:x", "base_table", "where_expr", "", 100), ("graph", "graph_index", "", "", 1), ("task", "task_index", "query_text", "", 100), ("meta:tags", "meta_index", "", "", 100)]


@_q(_values(_EXPLAINED, "scope, adapter, stages, projection, page"))
def q02_explained(spark: SparkSession, d: str) -> DataFrame:
    asks = [("docs", {"query": "x", "where": "path contains 'a'", "sort": "path", "select": "path,title", "limit": 10}), ("base:x", {"where": "a == 1"}), ("graph", {"limit": 0}), ("task", {"query": "x"}), ("meta:tags", {})]
    plans = [(s, api.explain(s, **k)) for s, k in asks]
    return spark.createDataFrame([(s, p["physical_plan"]["adapter"], ",".join(p["physical_plan"]["stages"]), ",".join(p["logical_plan"]["projection"]), p["physical_plan"]["limit"]) for s, p in plans], "scope string, adapter string, stages string, projection string, page int")


@_q(" SELECT false AS needs_rebuild, 'ready' AS status, 'index,index_schema,vault' AS checks, (SELECT count(*) FROM sv) + (SELECT count(*) FROM nv) AS files")
def q06_q07_health(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d, "small")
    h = v.health()
    return spark.createDataFrame([(v.preflight()["needs_rebuild"], h["status"], ",".join(sorted(c["name"] for c in h["checks"])), v.stats().first()["files"])], "needs_rebuild boolean, status string, checks string, files long")


_CATALOG = "base.list base.schema base.validate base.view doc.list doc.read doc.write graph.backlinks graph.components graph.deadends graph.floating graph.inbound-scope graph.neighbors graph.orphans graph.outgoing graph.path graph.unresolved graph.walk health.check meta.aliases meta.properties meta.tags meta.tasks query.run task.list task.set-state vault.open vault.preflight vault.reconcile vault.reindex vault.stats".split()


@_q(_values([(c.split(".")[0], c, c in ("doc.write", "task.set-state")) for c in _CATALOG], "category, name, writes"))
def q08_catalog(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c["category"], c["name"], c["writes"]) for c in api.catalog()], "category string, name string, writes boolean")


@_q(_values([("argument", "a", "c", True), ("environment", "b", "c", False), ("file", "c", "c", True)], "source, vault, index_of, read_only"))
def q10_configuration(spark: SparkSession, d: str) -> DataFrame:
    """Where the configuration comes from: an argument goes before the environment, and that before a file."""
    at = os.path.realpath(_local(shared_path(spark, "config")))
    for name in "abc":
        os.makedirs(os.path.join(at, name))
    with open(os.path.join(at, config.FILE), "w") as f:
        f.write(f'vault_root = "{at}/c"\nindex_path = "{at}/c/index"\n')
    env = {config.PREFIX + "VAULT_ROOT": f"{at}/b", config.PREFIX + "READ_ONLY": "off"}
    found = [("argument", config.resolve({"vault_root": f"{at}/a", "read_only": True}, env, at, at)), ("environment", config.resolve({}, env, at, at)), ("file", config.resolve({}, {}, at, at))]
    return spark.createDataFrame([(s, c.vault_root.rsplit("/", 1)[1], c.index_path.split("/")[-2], c.read_only) for s, c in found], "source string, vault string, index_of string, read_only boolean")


_ERRORS = [("denied", "write_disabled", 2), ("empty query", "invalid_argument", 1), ("bad condition", "query_parse_error", 1), ("bad scope", "invalid_argument", 1), ("bad column", "invalid_argument", 1), ("bad path", "invalid_argument", 1), ("no view", "invalid_argument", 1), ("page too large", "invalid_argument", 1), ("unknown", "command_failed", 1)]


@_q(_values(_ERRORS, "mistake, code, exit_code"))
def q11_t04_o07_errors(spark: SparkSession, d: str) -> DataFrame:
    """What commands that are asked for something wrong answer; a blank search text is an error."""
    v = _vault(spark, d, "small")
    tries = {
        "denied": lambda: sinks.note_put("/nowhere", "a.md", "x"),
        "empty query": lambda: v.query("docs", "  "),
        "bad condition": lambda: v.query("docs", "a", where="path =="),
        "bad scope": lambda: v.query("nothing"),
        "bad column": lambda: v.query("docs", "a", select="size"),
        "bad path": lambda: vault.validate_relative("../a"),
        "no view": lambda: B.find_view(B.parse_base(BASE_DOC), "closed"),
        "page too large": lambda: search.check_limit(1001),
        "unknown": lambda: {}["x"],
    }
    out = []
    for name, f in tries.items():
        try:
            f()
        except Exception as e:  # noqa: BLE001
            c = api.classify(e)
            out.append((name, c.code, c.exit_code))
    return spark.createDataFrame(out, "mistake string, code string, exit_code int")


_BAD = [
    ("views: 5", "error", "bases.parse.invalid_schema"),
    ("views: [{type: table, name: a, columns: [x]}, {type: table, name: A, columns: [x]}]", "error", "bases.view.duplicate_name"),
    ("views: [table]", "warning", "bases.table.missing_columns"),
    ("views: [{type: table, columns: [x, X]}]", "warning", "bases.column.duplicate_key"),
    ("views: [{type: table, columns: [{key: x, hidden: true}]}]", "warning", "bases.table.all_columns_hidden"),
    ("views: [{type: table, columns: [x]}]", None, None),
]


@_q(_values(_BAD, "document, severity, code"))
def i14_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with view documents."""
    rows = []
    for doc, _, _ in _BAD:
        found = B.diagnose(json.dumps({"raw": doc}))
        rows += [(doc, x.severity, x.code) for x in found] or [(doc, None, None)]
    return spark.createDataFrame(rows, "document string, severity string, code string")


@_q(" SELECT true AS same, false AS after_a_change")
def a14_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of metadata does not depend on the order of rows, and changes with any of them."""
    files, props = table(spark, d, "vault_files"), table(spark, d, "vault_properties")
    one = meta.digest(files, props)
    other = meta.digest(files, props.withColumn("value_json", F.when(F.col("property_id") == props.agg(F.min("property_id")).first()[0], "?").otherwise(F.col("value_json"))))
    return spark.createDataFrame([(one == meta.digest(files.orderBy("size_bytes"), props.repartition(5)), one == other)], "same boolean, after_a_change boolean")


@_q(_values([("1,2,3", "1,2,3", "", "")], "known, applied, pending, mismatched"))
def q07_migrations(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the schema of an index as it was built."""
    found = _built(spark, d, "small")[1].preflight()
    return spark.createDataFrame([tuple(",".join(map(str, found[k])) for k in ("known", "applied", "pending", "mismatched"))], "known string, applied string, pending string, mismatched string")


@_q(" SELECT (SELECT count(*) FROM sv WHERE contains(lower(text), 'check')) AS n, 1 AS n_kept, true AS same")
def q09_kept_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page that is asked for again is the one that was kept."""
    v = _vault(spark, d, "small")
    first = v.query("docs", "check", limit=1000)
    again = v.query("docs", "check", limit=1000)
    return spark.createDataFrame([(first.count(), len(v._cache), first is again)], "n long, n_kept int, same boolean")


@_q(" SELECT (SELECT count(*) FROM sv) AS n_tasks, (SELECT count(*) FROM sv) + (SELECT count(*) FROM nv) AS n_files, true AS served, true AS stopped, false AS served_after")
def q12_daemon(spark: SparkSession, d: str) -> DataFrame:
    """What a served vault answers, and that it stops."""
    v = _vault(spark, d, "small")
    with tempfile.TemporaryDirectory() as at:  # a socket has to be on this machine
        path = os.path.join(at, "s")
        server = threading.Thread(target=lambda: daemon.serve(v, path), daemon=True)
        server.start()
        while not daemon.status(path)["running"] and server.is_alive():
            time.sleep(0.02)
        served = daemon.status(path)["running"]
        n_tasks = daemon.ask(path, "query", **{"from": "task"}, query="call", limit=1000)["meta"]["count"]
        n_files = daemon.ask(path, "stats")["data"][0]["files"]
        stopped = daemon.stop(path)
        server.join(30)
        return spark.createDataFrame([(n_tasks, n_files, served, stopped, daemon.status(path)["running"])], "n_tasks long, n_files long, served boolean, stopped boolean, served_after boolean")
