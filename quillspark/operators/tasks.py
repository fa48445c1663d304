"""Checkbox tasks of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.runtime import spread

STATES = ("open", "done", "cancelled")


def tasks_of(notes: DataFrame, text_col: str) -> DataFrame:
    """Tasks in the text of notes (file_id, normalized_path): file_id, file_path, line_number, state, text.

    Lines are numbered from 1 within the text given; only `-` bullets count. Repeated rows of a note give repeats once.
    """
    lines = spread(notes, "file_id").select("file_id", F.col("normalized_path").alias("file_path"), F.inline(T.numbered_lines(F.coalesce(F.col(text_col), F.lit("")))))
    task = T.task_of(F.col("line"))
    return lines.withColumn("task", task).filter("task is not null").select("file_id", "file_path", "line_number", "task.state", "task.text").distinct()


def filter_tasks(tasks: DataFrame, state: str | None = None, query: str | None = None, path: str | None = None) -> DataFrame:
    """Tasks of a state whose text or path holds `query`, and whose path holds `path`, case ignored."""
    out = tasks
    if state:
        out = out.filter(F.col("state") == state.strip().lower())
    if query:
        q = F.lit(query.lower())
        out = out.filter(F.contains(F.lower("text"), q) | F.contains(F.lower("file_path"), q))
    if path:
        out = out.filter(F.contains(F.lower("file_path"), F.lit(path.lower())))
    return out


def list_tasks(tasks: DataFrame, limit: int | None = None, offset: int = 0, **filters: str | None) -> DataFrame:
    out = filter_tasks(tasks, **filters).orderBy("file_path", "line_number")
    if offset:
        out = out.offset(offset)
    return out.limit(max(1, limit)) if limit is not None else out
