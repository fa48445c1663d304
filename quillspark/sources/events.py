"""Append-only event log: a folder of JSON-line files, read by cursor or as a stream."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import Files
from quillspark.schema import EVENTS

MAX_POLL = 1000


class EventLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.files = str(path).rstrip("/"), Files(spark, path)
        self.files.make()

    def append(self, event_type: str, payload: dict) -> int:
        """Append one event and return its id. Ids are claimed by renaming to the file of that id, so two writers never
        share one."""
        last = max((int(n.removesuffix(".json")) for n in self.files.names("[0-9]*.json")), default=0)
        row = {"event_type": event_type, "payload_json": json.dumps(payload, ensure_ascii=False), "created_at": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
        while True:
            last += 1
            if self.files.claim(f"{last:012d}.json", json.dumps({"id": last, **row}, ensure_ascii=False) + "\n"):
                return last

    def note_changed(self, file_id: str, path: str, action: str) -> int:
        return self.append("note_changed", {"file_id": file_id, "path": path, "action": action})

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(EVENTS).json(self.path)

    def stream(self, spark: SparkSession, max_files: int = 1000) -> DataFrame:
        return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(self.path)


def parsed(events: DataFrame) -> DataFrame:
    """Events with file_id, path and action of their payload; a payload that is no JSON gives nulls."""
    get = lambda k: F.get_json_object("payload_json", f"$.{k}").alias(k)
    return events.select("id", F.col("event_type").alias("kind"), get("file_id"), get("path"), get("action"), "created_at")


def poll(events: DataFrame, after_id: int = 0, limit: int = MAX_POLL) -> tuple[DataFrame, int]:
    """Events after a cursor in order of id, and the next cursor: the greatest id of the page, else the same."""
    if not 1 <= limit <= MAX_POLL:
        raise ValueError(f"limit must be between 1 and {MAX_POLL}")
    page = parsed(events.filter(F.col("id") > after_id)).orderBy("id").limit(limit)
    return page, page.agg(F.max("id")).first()[0] or after_id
