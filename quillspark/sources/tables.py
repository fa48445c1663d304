"""Scans of the index tables in their orders, and keyset paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 1000


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("normalized_path")


def reconcile_files(files: DataFrame) -> DataFrame:
    """Files as they are paired with a manifest."""
    return files.select("file_id", "normalized_path", "match_key", "absolute_path", "size_bytes", "modified_unix_ms").orderBy("match_key", "normalized_path")


def file_by_id(files: DataFrame, file_id: str) -> DataFrame:
    return files.filter(F.col("file_id") == file_id)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("normalized_path") == path)


def bases_with_paths(bases: DataFrame, files: DataFrame) -> DataFrame:
    return bases.join(files.select("file_id", F.col("normalized_path").alias("path")), "file_id").orderBy("path")


def base_by(bases: DataFrame, files: DataFrame, id_or_path: str) -> DataFrame:
    rows = bases_with_paths(bases, files)
    return rows.filter((F.col("base_id") == id_or_path) | (F.col("path") == id_or_path))


def notes_page(files: DataFrame, after_path: str | None = None, limit: int = 100) -> tuple[DataFrame, str | None]:
    """Notes after a path in order of path, and the cursor of the next page if there is one."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    rows = files.filter("is_markdown")
    if after_path is not None:
        rows = rows.filter(F.col("normalized_path") > after_path)
    rows = rows.select("file_id", F.col("normalized_path").alias("path"), "indexed_at").orderBy("path").limit(limit + 1)
    got = rows.select("path").collect()
    more = len(got) > limit
    return rows.limit(limit), (got[limit - 1]["path"] if more else None)


def current_rows(files: DataFrame) -> DataFrame:
    """One row per file: of older rows and repeats the one indexed last."""
    cols = [c for c in files.columns if c != "file_id"]
    key = F.struct("indexed_at", *[c for c in cols if c != "indexed_at"])
    return files.groupBy("file_id").agg(F.max(key).alias("v")).select("file_id", *[F.col(f"v.{c}").alias(c) for c in cols]).select(*files.columns)
