"""Per-key results over keys of very uneven size.

Fragment-replicate by estimated load: the number of rows of each key is counted
with map-side combine, heavy keys are cut into shards in proportion to their
load, shards and hash slots of light keys are packed onto tasks (longest first),
rows are sent straight to their task, and the matching side is copied only to
the tasks that hold a shard of its key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.runtime import parallelism

BIN, SHARD, KEY_ = "__qs_bin", "__qs_shard", "__qs_key"
_SIDES = "__qs_l", "__qs_r"


@dataclass(frozen=True)
class LoadPlan:
    """Where each key goes. heavy: key -> task of each shard; slots: task of each hash slot of light keys."""

    heavy: dict[tuple, tuple[int, ...]]
    slots: tuple[int, ...]
    tasks: int
    total: int
    loads: tuple[int, ...]


def pack(items: list[tuple[int, object]], tasks: int) -> tuple[dict[object, int], list[int]]:
    """Longest-processing-time bin packing of (load, item) onto tasks."""
    heap = [(0, t) for t in range(tasks)]
    place: dict[object, int] = {}
    for load, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        used, t = heapq.heappop(heap)
        place[item] = t
        heapq.heappush(heap, (used + load, t))
    loads = [0] * tasks
    for used, t in heap:
        loads[t] = used
    return place, loads


def _slot(keys: list[Column], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def plan_load(df: DataFrame, keys: list[str], tasks: int, shards_per_task: int = 2, slots_per_task: int = 8, counts: DataFrame | None = None) -> LoadPlan:
    """Count rows per key and place them. At most tasks * (shards_per_task + slots_per_task) rows reach the driver:
    a heavy key has more than total / (tasks * shards_per_task) rows, all other keys arrive summed by hash slot. counts:
    rows per key (keys and n), where they are known before."""
    slots = tasks * slots_per_task
    total = df.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // (tasks * shards_per_task))
    cols = [F.col(k) for k in keys]
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    heavy = F.col("n") > limit
    rows = (
        counts.groupBy(
            *[F.when(heavy, c).alias(k) for c, k in zip(cols, keys)],
            heavy.alias("heavy"),
            F.when(~heavy, _slot(cols, slots)).alias("slot"),
        )
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    items: list[tuple[int, object]] = []
    shards: dict[tuple, int] = {}
    for r in rows:
        if r["heavy"]:
            key = tuple(r[k] for k in keys)
            shards[key] = max(1, min(tasks, ceil(r["n"] / limit)))
            items += [(r["n"] // shards[key], ("key", key, s)) for s in range(shards[key])]
        else:
            items.append((r["n"], ("slot", r["slot"])))
    place, loads = pack(items, tasks)
    return LoadPlan(
        {k: tuple(place["key", k, s] for s in range(n)) for k, n in shards.items()},
        tuple(place.get(("slot", s), s % tasks) for s in range(slots)),
        tasks,
        total,
        tuple(loads),
    )


def _routing(df: DataFrame, keys: list[str], plan: LoadPlan) -> tuple[DataFrame, Column]:
    """df with the tasks of its heavy keys in __qs_bins (null for light keys), and the task of a light key."""
    slot = F.element_at(F.split(F.lit(" ".join(map(str, plan.slots))), " "), _slot([F.col(k) for k in keys], len(plan.slots)) + 1).cast("int")
    if not plan.heavy:
        return df.withColumn("__qs_bins", F.lit(None).cast("array<int>")), slot
    schema = T.StructType([T.StructField(f"__qs_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("__qs_bins", T.ArrayType(T.IntegerType()))])
    heavy = df.sparkSession.createDataFrame([(*k, list(b)) for k, b in plan.heavy.items()], schema)
    on = [F.col(k).eqNullSafe(F.col(f"__qs_k{i}")) for i, k in enumerate(keys)]
    # bounded by plan_load: at most tasks * shards_per_task heavy keys
    return df.join(F.broadcast(heavy), on, "left").drop(*[f"__qs_k{i}" for i in range(len(keys))]), slot


def fragment(df: DataFrame, keys: list[str], plan: LoadPlan, spread: list[str]) -> DataFrame:
    """Send each row to its task; rows of a heavy key are spread over its shards by a hash of `spread`."""
    routed, slot = _routing(df, keys, plan)
    shard = F.pmod(F.xxhash64(F.lit(17), *[F.col(c) for c in spread]), F.size("__qs_bins")).cast("int")
    routed = routed.withColumn(BIN, F.when(F.col("__qs_bins").isNull(), slot).otherwise(F.element_at("__qs_bins", shard + 1)))
    return routed.drop("__qs_bins").repartitionById(plan.tasks, BIN)


def replicate(df: DataFrame, keys: list[str], plan: LoadPlan) -> DataFrame:
    """Copy each row to every task that holds a shard of its key, once per task."""
    routed, slot = _routing(df, keys, plan)
    bins = F.when(F.col("__qs_bins").isNull(), F.array(slot)).otherwise(F.array_distinct("__qs_bins"))
    return routed.withColumn(BIN, F.explode(bins)).drop("__qs_bins").repartitionById(plan.tasks, BIN)


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left", plan: LoadPlan | None = None) -> DataFrame:
    """Join a side of uneven keys with its matching side without one task per key.

    how is `inner` or `left`. Null keys match nothing and are kept by `left`. `right` may hold several rows of a key.
    Columns of `right` that clash with columns of `left` raise ValueError; rename them before.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    plan = plan or plan_load(left, keys, parallelism(left.sparkSession))
    return fragment(left, keys, plan, spread).join(replicate(right, keys, plan), [BIN, *keys], how).drop(BIN)


def link_ends(links: DataFrame) -> DataFrame:
    """One row per stored link row and id column: field_name, file_id, other end, month of created_at as yyyymm (null if it can't be read)."""
    end = lambda name, other: F.struct(F.lit(name).alias("field_name"), F.col(name).alias("file_id"), F.col(other).alias("other_id"))
    return links.select(
        "link_id",
        "is_unresolved",
        F.expr("try_cast(replace(substr(created_at, 1, 7), '-', '') AS int)").alias("month"),
        F.inline(F.array(end("resolved_file_id", "source_file_id"), end("source_file_id", "resolved_file_id"))),
    )


def per_file_links(links: DataFrame, files: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """Per id and column of the links: rows stored, distinct links, distinct other ends, unresolved links, first and
    last month, path of the file. Returns the result and the number of stored link rows.

    Null ids give no row; ids without a file have a null path; exact repeats of a link count in n_rows but once in
    n_links; of several rows of a file the one indexed last gives the path; an empty table gives an empty result.
    """
    ends = link_ends(links)
    tasks = tasks or 2 * parallelism(links.sparkSession)
    plan = plan_load(ends, ["field_name", "file_id"], tasks)
    paths = files.groupBy("file_id").agg(F.max_by("normalized_path", F.struct("indexed_at", "normalized_path")).alias("path"))
    paths = paths.select(F.explode(F.array(F.lit("resolved_file_id"), F.lit("source_file_id"))).alias("field_name"), "file_id", "path")
    # a link's repeats share its shard, so they meet in one task; partial results of a task are merged per key
    here = fragment(ends.filter("file_id is not null"), ["field_name", "file_id"], plan, ["link_id"])
    # text stays in the grouping keys, so that all aggregates are numbers and hash aggregation applies
    months = [F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month")]
    once = here.groupBy(BIN, "field_name", "file_id", "other_id", "link_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("is_unresolved").cast("int")).alias("open"), F.min("month").alias("first_month"), F.max("month").alias("last_month")
    )
    pairs = once.groupBy(BIN, "field_name", "file_id", "other_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("links"), F.sum("open").alias("open"), *months)
    named = pairs.join(replicate(paths, ["field_name", "file_id"], plan), [BIN, "field_name", "file_id"], "left")
    by_pair = named.groupBy("field_name", "file_id", "path", "other_id").agg(F.sum("n").alias("n"), F.sum("links").alias("links"), F.sum("open").alias("open"), *months)
    result = by_pair.groupBy("field_name", "file_id", "path").agg(
        F.sum("n").alias("n_rows"), F.sum("links").alias("n_links"), F.count("other_id").alias("n_others"), F.sum("open").alias("n_unresolved"), *months
    )
    return result, plan.total // 2


def hot_ids(links: DataFrame, files: DataFrame, share: float = 0.02) -> DataFrame:
    """Ids that stand in a column of the links in at least `share` of all stored rows."""
    result, rows = per_file_links(links, files)
    return result.filter(F.col("n_rows") >= F.lit(share) * F.lit(rows)).select("field_name", "file_id")
