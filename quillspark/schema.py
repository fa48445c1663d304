"""Schemas of the index tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType())}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


FILES = _struct("file_id string, normalized_path string, match_key string, absolute_path string, size_bytes long, modified_unix_ms long, hash_blake3 string, is_markdown boolean, indexed_at string")
LINKS = _struct("link_id string, source_file_id string, raw_target string, resolved_file_id string, heading_slug string, block_id string, is_unresolved boolean, created_at string, unresolved_reason string, source_field string")
PROPERTIES = _struct("property_id string, file_id string, key string, value_type string, value_json string, updated_at string")
BASES = _struct("base_id string, file_id string, config_json string, updated_at string")
TASKS = _struct("task_id string, file_id string, file_path string, file_path_lc string, line_number long, state string, text string, text_lc string, updated_at string")
SEARCH = _struct("file_id string, normalized_path_lc string, title_lc string, content_lc string, updated_at string, normalized_path string, fts_path string, fts_title string, fts_content string")
POSTINGS = _struct("token string, surface int, file_id string, positions ints")
RENDER_CACHE = _struct("cache_key string, file_id string, html string, content_hash string, updated_at string")
INDEX_STATE = _struct("key string, value_json string, updated_at string")
EVENTS = _struct("id long, event_type string, payload_json string, created_at string")
DIAGNOSTICS = _struct("normalized_path string, code string, message string")
HEADINGS = _struct("file_id string, level int, text string, slug string, line_number int")
BLOCKS = _struct("file_id string, block_id string")

TABLES = {
    "files": FILES,
    "links": LINKS,
    "properties": PROPERTIES,
    "bases": BASES,
    "tasks": TASKS,
    "search_index": SEARCH,
    "postings": POSTINGS,
    "headings": HEADINGS,
    "blocks": BLOCKS,
    "render_cache": RENDER_CACHE,
    "diagnostics": DIAGNOSTICS,
}
VERSION = 3
