"""Queries of the general data problems (p2 to p5) over the vault tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import incremental, orphans, skew, wide
from quillspark.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_ids(table(spark, d, "vault_links"), table(spark, d, "vault_files"))


def p2_per_file(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_file_links(table(spark, d, "vault_links"), table(spark, d, "vault_files"))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "vault_links"), table(spark, d, "vault_files")).select("link_id", "ref_field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "vault_links"), table(spark, d, "vault_files"))


def p3_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys and references to them by kind of key, from a state that was built early and advanced by batches of
    changes: links and files that came later, notes that were deleted, and their return."""
    links, files = table(spark, d, "vault_links").distinct(), table(spark, d, "vault_files").distinct()
    late_link, late_file = F.col("created_at") >= "2024-10", F.col("indexed_at") >= "2024-10"
    hidden = F.col("is_markdown") & F.col("normalized_path").startswith("notes/projects/")
    early = files.filter(~late_file)
    # a file is a pair of id and path; what an early row holds does not come again
    come = files.filter(late_file).join(early.select("file_id", "normalized_path"), ["file_id", "normalized_path"], "left_anti")
    state, _ = orphans.build(links.filter(~late_link), early)
    state = orphans.advance(state, files, links_added=links.filter(late_link), files_added=come)
    state = orphans.advance(state, files.filter(~hidden), files_removed=files.filter(hidden))
    state = orphans.advance(state, files, files_added=files.filter(hidden))
    keys = orphans.orphan_keys(state.keys)
    return keys.groupBy(F.substring("ref_key", 1, 1).alias("key_kind")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("refs").alias("n_refs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.bad_cells(table(spark, d, "vault_properties"), table(spark, d, "property_schema")).select("file_id", "prop_key")


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(table(spark, d, "vault_properties"), table(spark, d, "property_schema"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_plan(spark, d).select("file_id")


def p5_plan(spark: SparkSession, d: str) -> DataFrame:
    return incremental.to_process(table(spark, d, "vault_files"), table(spark, d, "index_ledger"), table(spark, d, "index_runs"))


def p5_reread(spark: SparkSession, d: str) -> DataFrame:
    """How many files the window makes a run read again in full, how many it need not read, and how many of these came late."""
    files = table(spark, d, "vault_files")
    runs = table(spark, d, "index_runs")
    inside, late = incremental.reread_and_late(files, incremental.processed_ledger(table(spark, d, "index_ledger"), runs), runs)
    counts = files.agg(F.countDistinct("file_id").alias("n_files")).first()[0], inside.count(), late.count()
    return spark.createDataFrame([counts], "n_files long, n_reread long, n_late long")


QUERIES = {f.__name__: f for f in (p2_found, p2_per_file, p3_found, p3_report, p3_after_changes, p4_found, p4_wide, p5_found, p5_plan, p5_reread)}

_ENDS = """ends AS (
  SELECT 'resolved_file_id' AS field_name, resolved_file_id AS file_id, source_file_id AS other_id, * EXCLUDE (resolved_file_id, source_file_id) FROM vault_links
  UNION ALL
  SELECT 'source_file_id', source_file_id, resolved_file_id, * EXCLUDE (resolved_file_id, source_file_id) FROM vault_links)"""

_REFS = r"""
f AS (SELECT DISTINCT file_id FROM vault_files),
home AS (SELECT file_id, arg_max(lower(CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END), (indexed_at, normalized_path)) AS base FROM vault_files GROUP BY 1),
paths AS (SELECT DISTINCT regexp_replace(lower(normalized_path), '\.md$', '') AS p FROM vault_files),
names AS (SELECT DISTINCT regexp_extract(p, '[^/]*$') AS n FROM paths),
l AS (SELECT DISTINCT link_id, source_file_id, resolved_file_id, raw_target, substr(created_at, 1, 7) AS month FROM vault_links),
raw AS (SELECT l.*, regexp_replace(lower(raw_target), '\.md$', '') AS t, coalesce(home.base, '') AS base FROM l LEFT JOIN home ON home.file_id = l.source_file_id WHERE resolved_file_id IS NULL AND raw_target IS NOT NULL),
variants AS (SELECT DISTINCT base, t, unnest(list_concat([t], list_transform(range(1, len(string_split(base, '/')) + 1), lambda i: array_to_string(string_split(base, '/')[1:i], '/') || '/' || t))) AS v FROM raw WHERE contains(t, '/')),
named AS (SELECT DISTINCT base, t FROM variants JOIN paths ON v = p),
found AS (
  SELECT link_id, 'source_file_id' AS ref_field, month, 'i:' || source_file_id AS ref_key FROM l WHERE source_file_id IS NOT NULL AND source_file_id NOT IN (SELECT file_id FROM f)
  UNION
  SELECT link_id, 'resolved_file_id', month, 'i:' || resolved_file_id FROM l WHERE resolved_file_id IS NOT NULL AND resolved_file_id NOT IN (SELECT file_id FROM f)
  UNION
  SELECT link_id, 'raw_target', month, CASE WHEN contains(t, '/') THEN 't:' || base || '|' || t ELSE 'n:' || t END FROM raw
  WHERE CASE WHEN contains(t, '/') THEN NOT EXISTS (SELECT 1 FROM named WHERE named.base = raw.base AND named.t = raw.t) ELSE t NOT IN (SELECT n FROM names) END)
"""

_NUM = r"^[ \t\r\n]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"
_CELLS = r"""
latest AS (
  SELECT p.file_id, s.prop_key, s.target_type, arg_max(p.value_json, (p.updated_at, p.property_id, p.value_json)) AS j
  FROM vault_properties p JOIN property_schema s ON lower(trim(p.key)) = lower(trim(s.prop_key)) GROUP BY ALL),
strict AS (SELECT *, json_valid(j) AND NOT regexp_matches(regexp_replace(j, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]') AS ok FROM latest),
cells AS (SELECT *, CASE WHEN json_valid(j) THEN json_type(j) END AS kind, CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END AS s FROM strict),
judged AS (SELECT *, CASE
  WHEN NOT ok THEN false
  WHEN kind = 'NULL' THEN true
  WHEN target_type = 'json' THEN true
  WHEN kind IN ('ARRAY', 'OBJECT') THEN false
  WHEN target_type = 'string' THEN true
  WHEN target_type = 'number' THEN kind <> 'VARCHAR' OR regexp_full_match(s, '%(num)s')
  WHEN target_type = 'bool' THEN CASE WHEN kind = 'BOOLEAN' THEN true WHEN kind = 'VARCHAR' THEN lower(trim(s)) IN ('true', 'false', 'yes', 'no', '1', '0') ELSE try_cast(j AS DOUBLE) IN (0, 1) END
  WHEN target_type = 'date' THEN kind = 'VARCHAR' AND regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)? ?(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)?)?') AND try_cast(substr(s, 1, 10) AS DATE) IS NOT NULL
  END AS readable FROM cells)
""" % {"num": _NUM.strip("^$")}

# fixed values: the columns of property_schema by type, for the SQL, which can't take them from the table
_WIDE = {
    "number": "budget duration_minutes estimate_hours headcount priority progress rating seed",
    "json": "aliases attendees contacts meeting_refs related tags",
    "bool": "archived billable pinned reviewed",
    "date": "closed created due last_contact started",
    "string": "category company location owner project sector stage status summary",
}
_AS_TYPE = {
    "number": "CASE kind WHEN 'BOOLEAN' THEN CASE WHEN j = 'true' THEN 1.0 ELSE 0.0 END WHEN 'VARCHAR' THEN try_cast(trim(s, chr(32) || chr(9) || chr(10) || chr(13)) AS DOUBLE) ELSE try_cast(j AS DOUBLE) END",
    "json": "trim(j, chr(32) || chr(9) || chr(10) || chr(13))",
    "bool": "CASE kind WHEN 'BOOLEAN' THEN trim(j) = 'true' WHEN 'VARCHAR' THEN lower(trim(s)) IN ('true', 'yes', '1') ELSE try_cast(j AS DOUBLE) = 1 END",
    "date": "try_cast(substr(s, 1, 10) AS DATE)",
    "string": "CASE kind WHEN 'VARCHAR' THEN s ELSE trim(j, chr(32) || chr(9) || chr(10) || chr(13)) END",
}
_WIDE_COLUMNS = ", ".join(f"max(CASE WHEN prop_key = '{k}' AND readable AND kind <> 'NULL' THEN {_AS_TYPE[t]} END) AS {k}" for t, keys in _WIDE.items() for k in keys.split())

SQL = {
    "p2_found": f"WITH {_ENDS} SELECT field_name, file_id FROM ends WHERE file_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM vault_links)",
    "p2_per_file": f"""WITH {_ENDS}, path AS (SELECT file_id, arg_max(normalized_path, (indexed_at, normalized_path)) AS path FROM vault_files GROUP BY 1)
        SELECT field_name, e.file_id, path, count(*) AS n_rows, count(DISTINCT link_id) AS n_links, count(DISTINCT other_id) AS n_others,
          count(DISTINCT CASE WHEN is_unresolved THEN link_id END) AS n_unresolved,
          min(CAST(replace(substr(created_at, 1, 7), '-', '') AS INT)) AS first_month, max(CAST(replace(substr(created_at, 1, 7), '-', '') AS INT)) AS last_month
        FROM ends e LEFT JOIN path ON path.file_id = e.file_id WHERE e.file_id IS NOT NULL GROUP BY ALL""",
    "p3_found": f"WITH {_REFS} SELECT link_id, ref_field FROM found",
    "p3_report": f"WITH {_REFS} SELECT 'vault_links' AS table_name, ref_field, month, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY ALL",
    "p3_after_changes": f"WITH {_REFS} SELECT substr(ref_key, 1, 1) AS key_kind, count(DISTINCT ref_key) AS n_keys, CAST(count(*) AS BIGINT) AS n_refs FROM found GROUP BY 1",
    "p4_found": f"WITH {_CELLS} SELECT file_id, prop_key FROM judged WHERE NOT readable",
    "p4_wide": f"WITH {_CELLS} SELECT file_id, {_WIDE_COLUMNS} FROM judged GROUP BY file_id",
    "p5_found": """WITH cur AS (SELECT file_id, arg_max((size_bytes, hash_blake3), (indexed_at, modified_unix_ms, size_bytes, hash_blake3)) AS v FROM vault_files GROUP BY 1),
        done AS (SELECT file_id, arg_max((size_bytes, hash_blake3), (r.started_unix_ms, l.run_id, recorded_at, size_bytes, hash_blake3)) AS v FROM index_ledger l JOIN index_runs r USING (run_id) WHERE r.status = 'succeeded' GROUP BY 1)
        SELECT file_id FROM cur LEFT JOIN done USING (file_id) WHERE cur.v IS DISTINCT FROM done.v""",
    "p5_plan": """WITH cur AS (SELECT file_id, max((indexed_at, modified_unix_ms, size_bytes, hash_blake3)) AS v FROM vault_files GROUP BY 1),
        done AS (SELECT file_id, arg_max((size_bytes, hash_blake3), (r.started_unix_ms, l.run_id, recorded_at, size_bytes, hash_blake3)) AS v FROM index_ledger l JOIN index_runs r USING (run_id) WHERE r.status = 'succeeded' GROUP BY 1),
        last AS (SELECT max(started_unix_ms) AS t FROM index_runs WHERE status = 'succeeded'),
        low AS (SELECT min(started_unix_ms) AS t FROM index_runs WHERE started_unix_ms <= (SELECT t FROM last) AND coalesce(finished_unix_ms, 9007199254740992) > (SELECT t FROM last))
        SELECT file_id, cur.v[1] AS indexed_at, cur.v[2] AS modified_unix_ms, cur.v[3] AS size_bytes, cur.v[4] AS hash_blake3, epoch_ms(CAST(cur.v[1] AS TIMESTAMPTZ)) >= (SELECT t FROM low) AS in_reread
        FROM cur LEFT JOIN done USING (file_id) WHERE (cur.v[3], cur.v[4]) IS DISTINCT FROM done.v""",
    "p5_reread": """WITH done AS (SELECT file_id, arg_max((size_bytes, hash_blake3), (r.started_unix_ms, l.run_id, recorded_at, size_bytes, hash_blake3)) AS v FROM index_ledger l JOIN index_runs r USING (run_id) WHERE r.status = 'succeeded' GROUP BY 1),
        cur AS (SELECT file_id, max((indexed_at, modified_unix_ms, size_bytes, hash_blake3)) AS v FROM vault_files GROUP BY 1),
        last AS (SELECT max(started_unix_ms) AS t FROM index_runs WHERE status = 'succeeded'),
        low AS (SELECT min(started_unix_ms) AS t FROM index_runs WHERE started_unix_ms <= (SELECT t FROM last) AND coalesce(finished_unix_ms, 9007199254740992) > (SELECT t FROM last)),
        w AS (SELECT file_id, v, epoch_ms(CAST(v[1] AS TIMESTAMPTZ)) >= (SELECT t FROM low) AS inside FROM cur)
        SELECT count(*) AS n_files, count(*) FILTER (inside) AS n_reread, count(*) FILTER (NOT inside AND (w.v[3], w.v[4]) IS DISTINCT FROM done.v) AS n_late FROM w LEFT JOIN done USING (file_id)""",
}
