"""Versioned index tables, as a log of segments.

A full build writes a base; an increment writes a segment with its new rows and with tombstones for the rows that they
replace, so its cost follows the change and not the index. A pointer file names the segments of the current version and
is replaced by one atomic rename, so a failed run leaves the last version as it was. Many segments are merged into a new
base.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.runtime import Files

TOMBS = "kind string, id string"
#: What a tombstone of each kind removes: column by table.
KEYS = {n: ("file", "file_id") for n in ("files", "properties", "bases", "tasks", "search_index", "postings", "headings", "blocks", "render_cache")} | {"links": ("file", "source_file_id"), "diagnostics": ("path", "normalized_path")}
#: Order of the rows in the files of a base, so that reads of a note, a key or a path skip most files. The second column
#: splits the rows of a hot key.
ORDER = {"files": ("normalized_path",), "links": ("source_file_id", "link_id"), "properties": ("key", "file_id"), "tasks": ("file_path", "line_number"), "search_index": ("file_id",), "postings": ("token", "file_id")}
MAX_SEGMENTS = 16
POINTER = "CURRENT.json"


class StoreError(RuntimeError):
    pass


@dataclass(frozen=True)
class Migration:
    """A step of the schema: the tables that it brought in. Its checksum follows their columns, so an index that was made by
    a step of the same number but other columns is noticed."""

    id: int
    name: str
    tables: tuple[str, ...]
    apply: Callable[[IndexStore], None] | None = None

    @property
    def checksum(self) -> str:
        columns = ";".join(f"{t}({schema.TABLES[t].simpleString()})" for t in self.tables)
        return hashlib.sha256(f"{self.id}:{self.name}:{columns}".encode()).hexdigest()


def _add_postings(store: IndexStore) -> None:
    from quillspark.operators import postings

    store.write({"postings": postings.build(store.table("search_index"))})


class IndexStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")
        self.files = Files(spark, self.path)
        self.files.make()

    def state(self) -> dict:
        """Pointer contents: version, segments, schema, steps of the schema, and what the last run left; empty at first."""
        return json.loads(self.files.read(POINTER)) if self.files.exists(POINTER) else {}

    def version(self) -> str | None:
        return self.state().get("version")

    def segments(self) -> list[str]:
        return self.state().get("segments", [])

    def preflight(self) -> dict:
        """Steps of the schema without changing anything: known, applied, pending, and mismatched (other checksum, or unknown
        here)."""
        state = self.state()
        known = {m.id: m.checksum for m in MIGRATIONS}
        applied = {a["id"]: a["checksum"] for a in state.get("migrations", [])} if state.get("version") else known
        return {"known": sorted(known), "applied": sorted(applied), "pending": sorted(known.keys() - applied.keys()), "mismatched": sorted(i for i, c in applied.items() if known.get(i) != c)}

    def migrate(self) -> dict:
        """Apply the steps that are pending, in order; a mismatch is an error and nothing is applied."""
        found = self.preflight()
        if found["mismatched"]:
            raise StoreError(f"steps {found['mismatched']} of the schema have another checksum")
        for m in MIGRATIONS:
            if m.id in found["pending"]:
                if m.apply:
                    m.apply(self)
                done = [*self.state().get("migrations", []), {"id": m.id, "checksum": m.checksum}]
                self._swap(self.segments(), migrations=done)
        return {"applied": found["pending"]}

    def check_schema(self) -> None:
        found = self.preflight()
        if found["mismatched"] or self.state().get("schema", schema.VERSION) > schema.VERSION:
            raise StoreError(f"index has schema {self.state().get('schema')}, expected {schema.VERSION}; steps {found['mismatched']} differ")

    def table(self, name: str) -> DataFrame:
        """A table of the current version: rows of all segments without those that a later segment replaced."""
        self.check_schema()
        want, segments = schema.TABLES[name], self.segments()
        if not segments:
            return self.spark.createDataFrame([], want)
        parts = [self.spark.read.schema(want).parquet(f"{self.path}/{s}/{name}") if self.files.exists(f"{s}/{name}") else self.spark.createDataFrame([], want) for s in segments]
        if len(parts) == 1:
            return parts[0]
        rows = reduce(DataFrame.unionByName, [p.withColumn("__seq", F.lit(i)) for i, p in enumerate(parts)])
        tombs = reduce(DataFrame.unionByName, [self.spark.read.schema(TOMBS).parquet(f"{self.path}/{s}/tombs").withColumn("seq", F.lit(i)) for i, s in enumerate(segments) if i])
        kinds = [KEYS[name]] + ([("link", "link_id")] if name == "links" else [])
        for kind, column in kinds:
            dead = tombs.filter(F.col("kind") == kind).groupBy(F.col("id").alias(column)).agg(F.max("seq").alias("__dead"))
            rows = rows.join(dead, column, "left").filter("__dead is null or __seq >= __dead").drop("__dead")
        return rows.select(*[f.name for f in want])

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in schema.TABLES}

    def _segment(self, tables: dict[str, DataFrame], order: bool) -> str:
        name = f"s{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for table, want in schema.TABLES.items():
            df = tables[table].select(*[tables[table][f.name].cast(f.dataType).alias(f.name) for f in want])
            if order and table in ORDER:
                df = df.repartitionByRange(*ORDER[table]).sortWithinPartitions(*ORDER[table])
            df.write.parquet(f"{self.path}/{name}/{table}")
        return name

    def write(self, tables: dict[str, DataFrame], **state: object) -> str:
        """Write a new base; tables that are not given are taken over from the current version."""
        current = self.tables()
        return self._swap([self._segment({n: tables.get(n, current[n]) for n in schema.TABLES}, True)], **state)

    def append(self, tables: dict[str, DataFrame], tombs: DataFrame, **state: object) -> str:
        """Write a segment: rows, and (kind, id) of what they replace. kind: file, path, or link by its id."""
        none = {n: self.spark.createDataFrame([], s) for n, s in schema.TABLES.items()}
        name = self._segment({**none, **tables}, False)
        tombs.select("kind", "id").distinct().write.parquet(f"{self.path}/{name}/tombs")
        version = self._swap([*self.segments(), name], **state)
        return self.write({}) if len(self.segments()) > MAX_SEGMENTS else version

    def _swap(self, segments: list[str], **state: object) -> str:
        version, old = segments[-1], self.state()
        steps = old.get("migrations") if old.get("version") else [{"id": m.id, "checksum": m.checksum} for m in MIGRATIONS]
        self.files.replace(POINTER, json.dumps({**old, "migrations": steps or [], **state, "schema": schema.VERSION, "version": version, "segments": segments}))
        return version


MIGRATIONS = (
    Migration(1, "tables", ("files", "links", "properties", "bases", "tasks", "render_cache", "diagnostics")),
    Migration(2, "search and fragments", ("search_index", "headings", "blocks")),
    Migration(3, "postings", ("postings",), _add_postings),
)
