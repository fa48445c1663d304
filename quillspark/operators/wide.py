"""Attribute-value rows into wide tables, as log-structured upserts.

Each batch becomes a sparse wide delta: one row per entity, one cell per column
with the version it was written at. Deltas are stored as sorted runs in parts by
entity; compaction merges the runs of the parts that have too many, keeping the
latest version of every cell, so late and repeated batches may come in any order.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.runtime import parallelism, shared_path

TYPES = ("number", "bool", "date", "string", "json")
_NUMBER = re.compile(r"[ \t\r\n]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\r\n]*")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?[ ]?(?:Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?")
_BOOL = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


class _Num(str):
    """A JSON number as written."""


def _no_constant(_: str) -> None:
    raise ValueError("not strict JSON")


_DECODER = json.JSONDecoder(parse_int=_Num, parse_float=_Num, parse_constant=_no_constant)


def _is_day(y: int, m: int, d: int) -> bool:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return y > 0 and 1 <= m <= 12 and 1 <= d <= _DAYS[m - 1] + (leap and m == 2)


def _read_date(s: str) -> str | None:
    m = _DATE.fullmatch(s)
    if not m or not _is_day(int(m[1]), int(m[2]), int(m[3])):
        return None
    if m[4] and not (int(m[4]) <= 24 and int(m[5]) <= 59 and int(m[6] or 0) <= 60):
        return None
    return s[:10]


def read_value(text: str | None, kind: str) -> tuple[bool, str | None]:
    """(readable, canonical text). JSON null, and no text at all, read as null of any type."""
    if text is None:
        return True, None
    try:
        v = _DECODER.decode(text.strip(" \t\r\n"))
    except (ValueError, RecursionError):
        return False, None
    if v is None:
        return True, None
    number, string = isinstance(v, _Num), isinstance(v, str) and not isinstance(v, _Num)
    if kind == "json":
        return True, text.strip(" \t\r\n")
    if kind == "string":
        return (True, str(v).lower() if isinstance(v, bool) else str(v)) if not isinstance(v, list | dict) else (False, None)
    if kind == "number":
        if isinstance(v, bool):
            return True, "1" if v else "0"
        return (True, v.strip()) if number or string and _NUMBER.fullmatch(v) else (False, None)
    if kind == "bool":
        if number:
            v = {0.0: "0", 1.0: "1"}.get(float(v), "")
        b = v if isinstance(v, bool) else _BOOL.get(v.strip().lower()) if isinstance(v, str) else None
        return (True, str(b).lower()) if b is not None else (False, None)
    if kind == "date":
        d = _read_date(v) if string else None
        return d is not None, d
    raise ValueError(f"unknown type {kind!r}")


def read_values(df: DataFrame) -> DataFrame:
    """Adds readable and canonical to rows with value_json and target_type."""
    schema = T.StructType([*df.schema.fields, T.StructField("readable", T.BooleanType()), T.StructField("canonical", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [read_value(v, k) for v, k in zip(b.column("value_json").to_pylist(), b.column("target_type").to_pylist())]
            cols = [*b.columns, pa.array([x[0] for x in both], pa.bool_()), pa.array([x[1] for x in both], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "readable", "canonical"])

    return df.mapInArrow(run, schema)


def wide_schema(property_schema: DataFrame) -> list[tuple[str, str]]:
    """Columns of the wide table, in order of name. A row per column reaches the driver, as the plan has one each."""
    rows = property_schema.select("prop_key", "target_type").filter("prop_key is not null").distinct().orderBy("prop_key", "target_type").collect()
    seen: dict[str, str] = {}
    for r in rows:
        if r["target_type"] not in TYPES:
            raise ValueError(f"unknown type {r['target_type']!r} of {r['prop_key']!r}")
        if seen.setdefault(r["prop_key"], r["target_type"]) != r["target_type"]:
            raise ValueError(f"two types for {r['prop_key']!r}")
    return sorted(seen.items())


def _same(key: Column) -> Column:
    return F.lower(F.trim(key))


def _cell() -> Column:
    return F.struct("updated_at", "property_id", "value_json")


def cell_versions(properties: DataFrame, columns: list[tuple[str, str]], batch: Column) -> DataFrame:
    """The latest version of each cell that a batch writes: batch, file_id, c (number of the column), cell.

    Keys match a column with case and surrounding blanks ignored. A version is (updated_at, property_id, value_json),
    so ties have one outcome whatever the order of the rows. Rows without file_id or key are ignored; records without
    updated_at lose to any with one. Versions combine on the map side, so an entity with very many rows is no burden.
    """
    by_name: dict[str, list[int]] = {}
    for i, (k, _) in enumerate(columns):
        by_name.setdefault(k.strip().lower(), []).append(i)
    k = _same(F.col("key"))
    rows = properties.filter("file_id is not null and key is not null").filter(k.isin(*by_name) if by_name else F.lit(False))
    number = F.create_map(*[x for n, i in by_name.items() for x in (F.lit(n), F.array(*map(F.lit, i)))]) if by_name else F.create_map(F.lit(""), F.array(F.lit(0)))
    rows = rows.select(
        batch.alias("batch"),
        "file_id",
        F.explode(number[k]).alias("c"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
        F.coalesce("property_id", F.lit("")).alias("property_id"),
        "value_json",
    )
    return rows.groupBy("batch", "file_id", "c").agg(F.max(_cell()).alias("cell"))


def sparse_deltas(properties: DataFrame, columns: list[tuple[str, str]], batch: Column | None = None, parts: int = 64) -> DataFrame:
    """Batches as sparse wide deltas, one row per batch and entity that it writes: batch, part (of the entity, by hash),
    file_id, cells.

    cells holds (c, cell) only for the columns written, in order of column, so at most one per column of the schema. The
    batch is the month of updated_at unless given.
    """
    batch = F.substring(F.coalesce("updated_at", F.lit("")), 1, 7) if batch is None else batch
    # versions are few per entity; they are sent to the part where their run is written, so nothing is sent again
    part = F.pmod(F.xxhash64("file_id"), F.lit(parts)).cast("int")
    versions = cell_versions(properties, columns, batch).withColumn("part", part).repartition(parts, "part")
    return versions.groupBy("batch", "part", "file_id").agg(F.array_sort(F.collect_list(F.struct("c", "cell"))).alias("cells"))


def compact(*runs: DataFrame) -> DataFrame:
    """Merge runs by the latest version of each cell: file_id, cells in order of column. The cells of an entity are at most
    one per run and column, and are merged where they are, without another shuffle."""
    union = runs[0].select("file_id", "cells")
    for r in runs[1:]:
        union = union.unionByName(r.select("file_id", "cells"))
    merged = union.groupBy("file_id").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("all"))
    # in order of column and version, the last of each column is its latest
    last = F.filter("all", lambda x, i: (i == F.size("all") - 1) | (F.get("all", i + 1)["c"] != x["c"]))
    return merged.select("file_id", last.alias("cells"))


class WideLog:
    """Runs of sparse deltas in a folder: run=<id>/part=<number>, sorted by entity within each file.

    Reading merges what there is by version, so it does not matter in which order batches came, whether one came twice,
    or whether a compaction was lost between writing its run and deleting the runs it replaces.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[tuple[str, str]], parts: int = 64) -> None:
        self.spark, self.path, self.columns, self.parts = spark, path, columns, parts
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def append(self, properties: DataFrame, run: str | None = None) -> None:
        """Write the batches of the rows as runs: one named `run`, or, by default, one per month of updated_at."""
        deltas = sparse_deltas(properties, self.columns, F.lit(run) if run is not None else None, self.parts)
        self._write(deltas.withColumnRenamed("batch", "run"))

    def _write(self, deltas: DataFrame) -> None:
        rows = deltas.select(F.concat(F.lit("r"), "run").alias("run"), "part", "file_id", "cells").sortWithinPartitions("run", "part", "file_id")
        rows.write.partitionBy("run", "part").mode("append").parquet(self.path)

    def runs(self) -> dict[int, list[str]]:
        """Folders of the runs by part."""
        found: dict[int, list[str]] = {}
        for s in self._fs.globStatus(self._fs_path(f"{self.path}/run=*/part=*")) or []:
            at = s.getPath().toString()
            found.setdefault(int(at.rsplit("=", 1)[1]), []).append(at)
        return found

    def _read(self, folders: list[str]) -> DataFrame:
        schema = "file_id string, cells array<struct<c: int, cell: struct<updated_at: string, property_id: string, value_json: string>>>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def cells(self) -> DataFrame:
        """The latest version of each cell: file_id, cells in order of column."""
        return compact(self._read([f for folders in self.runs().values() for f in folders]))

    def compact(self, most_runs: int = 4) -> int:
        """Merge the runs of those parts that have more than most_runs, and leave the other parts alone. Returns the number
        of parts that were merged."""
        many = {p: folders for p, folders in self.runs().items() if len(folders) > most_runs}
        old = [f for folders in many.values() for f in folders]
        if old:
            part = F.pmod(F.xxhash64("file_id"), F.lit(self.parts)).cast("int")
            merged = compact(self._read(old)).withColumn("part", part).repartition(self.parts, "part")
            self._write(merged.withColumn("run", F.lit(f"c{uuid.uuid4().hex}")))
            for f in old:
                self._fs.delete(self._fs_path(f), True)
        return len(many)


def log_of(properties: DataFrame, columns: list[tuple[str, str]]) -> WideLog:
    """A log of all rows in the shared folder; it is deleted when the driver ends."""
    spark = properties.sparkSession
    log = WideLog(spark, shared_path(spark, "wide"), columns, parallelism(spark))
    log.append(properties)
    return log


def wide_table(properties: DataFrame, property_schema: DataFrame) -> DataFrame:
    """One row per file_id that has any property of the schema, one typed column per prop_key.

    number -> double, bool -> boolean, date -> date, string and json -> string. A cell that can't be read is null
    (see bad_cells). An empty table gives no rows; an empty schema gives the column file_id alone, without rows. A
    prop_key `file_id` raises ValueError.
    """
    columns = wide_schema(property_schema)
    return typed(log_of(properties, columns).cells(), columns)


def typed(cells: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Cells of entities as a table with a typed column for each column of the schema."""
    if any(k.lower() == "file_id" for k, _ in columns):
        raise ValueError("file_id is the key of the wide table")
    kinds = [t for _, t in columns]
    schema = T.StructType([T.StructField("file_id", T.StringType())] + [T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[list[str | None]] = [[None] * b.num_rows for _ in kinds]
            for r, (cs, vs) in enumerate(zip(b.column("cs").to_pylist(), b.column("vs").to_pylist())):
                for c, v in zip(cs, vs):
                    rows[c][r] = read_value(v, kinds[c])[1]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), *[pa.array(x, pa.string()) for x in rows]], [f.name for f in schema.fields])

    text = cells.select("file_id", F.col("cells.c").alias("cs"), F.col("cells.cell.value_json").alias("vs")).mapInArrow(run, schema)
    cast = {"number": "double", "bool": "boolean", "date": "date", "string": "string", "json": "string"}
    return text.select("file_id", *[F.expr(f"try_cast(c{i} AS {cast[t]})").alias(k) for i, (k, t) in enumerate(columns)])


def bad_cells(properties: DataFrame, property_schema: DataFrame) -> DataFrame:
    """Latest cells that can't be read as the type of their column: file_id, prop_key, target_type, value_json."""
    columns = wide_schema(property_schema)
    names = F.array(*[F.struct(F.lit(k).alias("prop_key"), F.lit(t).alias("target_type")) for k, t in columns]) if columns else F.lit(None).cast("array<struct<prop_key:string,target_type:string>>")
    rows = log_of(properties, columns).cells().select("file_id", F.inline("cells"))
    rows = rows.select("file_id", F.element_at(names, F.col("c") + 1).alias("n"), F.col("cell.value_json").alias("value_json"))
    return read_values(rows.select("file_id", "n.prop_key", "n.target_type", "value_json")).filter("not readable").select("file_id", "prop_key", "target_type", "value_json")
