"""Writes to the vault: notes, properties, task states, view columns, and copies in and out. All need allow_writes."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import bases as B
from quillspark.runtime import cut, parallelism
from quillspark.sources import vault
from quillspark.sources.yaml12 import dump, load


class WriteDisabledError(PermissionError):
    def __init__(self) -> None:
        super().__init__("writes are disabled; pass --allow-writes")


def _allowed(allow_writes: bool) -> None:
    if not allow_writes:
        raise WriteDisabledError


def _target(root: str, path: str) -> Path:
    vault.validate_relative(path)
    full = Path(os.path.realpath(root)) / path
    parent = os.path.realpath(full.parent)
    if parent != os.path.realpath(root) and not parent.startswith(os.path.realpath(root) + os.sep):
        raise vault.VaultPathError(f"path is outside of the vault: {path}")
    return full


def write_file(full: Path, text: str) -> None:
    """Write beside the target and rename, so that a reader sees the old or the new text."""
    full.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=full.parent, prefix=".write-")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, full)


def _with_rollback(full: Path, change: Callable[[], None], after: Callable[[], None] | None) -> None:
    """Change a file and then the index; if the index fails, the file is put back."""
    old = full.read_bytes() if full.exists() else None
    change()
    if after is None:
        return
    try:
        after()
    except Exception:
        if old is None:
            full.unlink(missing_ok=True)
        else:
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(old)
        raise


def note_put(root: str, path: str, content: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    """Create or replace a note."""
    _allowed(allow_writes)
    full = _target(root, path)
    action = "updated" if full.exists() else "created"
    _with_rollback(full, lambda: write_file(full, content), after)
    return {"path": path, "action": action}


def note_create(root: str, path: str, content: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    _allowed(allow_writes)
    if _target(root, path).exists():
        raise FileExistsError(path)
    return note_put(root, path, content, True, after)


def note_update(root: str, path: str, content: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    _allowed(allow_writes)
    if not _target(root, path).exists():
        raise FileNotFoundError(path)
    return note_put(root, path, content, True, after)


def note_delete(root: str, path: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    _allowed(allow_writes)
    full = _target(root, path)
    _with_rollback(full, full.unlink, after)
    return {"path": path, "action": "deleted"}


def note_move(root: str, path: str, new_path: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    """Rename or move a note; an existing target is an error."""
    _allowed(allow_writes)
    full, new = _target(root, path), _target(root, new_path)
    if new.exists():
        raise FileExistsError(new_path)
    new.parent.mkdir(parents=True, exist_ok=True)
    os.rename(full, new)
    try:
        if after:
            after()
    except Exception:
        os.rename(new, full)
        raise
    return {"path": new_path, "from": path, "action": "moved"}


def set_property(root: str, path: str, key: str, value: object, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    """Set a front-matter key; the body stays as it is. A note without front matter gets one."""
    _allowed(allow_writes)
    full = _target(root, path)
    raw, body, _ = vault.split_front_matter(full.read_text())
    data = load(raw) if raw and raw.strip() else {}
    if not isinstance(data, dict):
        raise vault.PropertyError("front matter must be a mapping")
    data[key] = value
    return note_put(root, path, f"---\n{dump(data)}---\n{body}", True, after) | {"property": key}


def set_task_state(root: str, path: str, line: int, state: str, allow_writes: bool = False, after: Callable[[], None] | None = None) -> dict:
    """Rewrite the marker of a checkbox line; indent and line ends stay."""
    _allowed(allow_writes)
    mark = {"open": " ", "done": "x", "cancelled": "-"}[state]
    full = _target(root, path)
    lines = full.read_bytes().decode().splitlines(keepends=True)
    if not 1 <= line <= len(lines) or not vault.TASK.match(lines[line - 1].rstrip("\r\n")):
        raise ValueError(f"line {line} of {path} is no task")
    lines[line - 1] = re.sub(r"^(\s*- \[)( |x|X|-)(\])", rf"\g<1>{mark}\g<3>", lines[line - 1])
    return note_put(root, path, "".join(lines), True, after) | {"line": line, "state": state}


def persist_view_columns(config: str, view: str, columns: list[B.Column]) -> str:
    """A stored configuration with the columns of a view replaced; raw YAML is not accepted."""
    import json

    if "raw" in json.loads(config):
        raise B.BaseError("columns can be kept only in a serialised document")
    return B.to_config(B.with_columns(B.decode_config(config), view, columns))


# --- copies in and out -------------------------------------------------------------------------------------------


TRANSFER = "source string, target string, path string, kind string, size_bytes long"


def plan_transfer(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Files of source with where they go (TRANSFER); the tree is read by the executors."""
    root, to = os.path.realpath(source), os.path.realpath(target)
    end = F.lower(F.regexp_extract("normalized_path", r"\.([^./]*)$", 1))
    kind = F.when(end == "md", "note").when(end == "base", "base").otherwise("asset")
    rows = vault.scan(spark, root)
    return rows.select(F.col("absolute_path").alias("source"), F.concat(F.lit(to + "/"), "normalized_path").alias("target"), F.col("normalized_path").alias("path"), kind.alias("kind"), "size_bytes")


def execute_transfer(plan: DataFrame, apply: bool = False, overwrite: bool = False) -> DataFrame:
    """Copy files, on the executors: the plan with status (copied, skipped, failed) and message. Without apply all are skipped;
    a file that fails does not stop the others. The result is kept in the shared folder, so files are copied once."""

    def copy(source: str, target: str) -> tuple[str, str]:
        if not apply or not overwrite and os.path.exists(target):
            return "skipped", ""
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copyfile(source, target)
        except OSError as e:
            return "failed", str(e)
        return "copied", ""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [copy(a, b) for a, b in zip(pdf["source"], pdf["target"])]
            yield pdf.assign(status=[x[0] for x in done], message=[x[1] for x in done])

    spread_ = plan.repartition(parallelism(plan.sparkSession), "path") if apply else plan
    return cut(spread_.mapInPandas(run, TRANSFER + ", status string, message string"))


def transfer_summary(results: DataFrame) -> DataFrame:
    """Files and bytes by kind and status."""
    return results.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
