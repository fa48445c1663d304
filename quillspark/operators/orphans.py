"""References to records that do not exist.

Changes arrive as signed deltas per key: +1 / -1 for a reference, +1 / -1 for the
existence of a record. Summed per key they form the state; keys with positive
references and no existence are orphans. Sums combine on the map side, so a hot
key costs one row per task, and a batch of changes is added without rereading.

A record exists under several keys: `i:` its id, `p:` its bare path, `n:` the last
segment of it; several records may share a key, so existence is a count. A name
with a slash (`t:<source folder>|<name>`) may stand for several paths. It exists as
often as paths that it may stand for do; a table of these paths leads from a path
that comes or goes to the names it satisfies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.skew import fragment_replicate_join, plan_load
from quillspark.runtime import cut, cut_table, parallelism

STATE = ["ref_key", "refs", "exists"]
REFS = ["link_id", "ref_field", "month", "ref_key", "source_file_id", "name", "base"]
MAX_BROADCAST = 50_000


@dataclass(frozen=True)
class State:
    """keys: signed counts per key (STATE). paths: which paths a name may stand for (name_key, ref_key). deep: the references
    by such names (REFS), needed where a source moves to another folder."""

    keys: DataFrame
    paths: DataFrame
    deep: DataFrame


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    return refs.select("ref_key", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"))


def existence_deltas(records: DataFrame, sign: int | Column = 1) -> DataFrame:
    count = sign if isinstance(sign, Column) else F.lit(sign)
    return records.select("ref_key", F.lit(0).cast("long").alias("refs"), count.cast("long").alias("exists"))


def apply_deltas(*parts: DataFrame) -> DataFrame:
    """State after adding deltas (or older states): signed sums per key; keys that came to nothing are dropped."""
    union = parts[0].select(*STATE)
    for p in parts[1:]:
        union = union.unionByName(p.select(*STATE))
    sums = union.filter("ref_key is not null").groupBy("ref_key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
    return sums.filter("refs <> 0 or exists <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    return state.filter("refs > 0 and exists <= 0").select("ref_key", "refs")


def bare(path: Column) -> Column:
    """Lower case, without a final `.md`."""
    return F.regexp_replace(F.lower(path), r"\.md$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_keys(files: DataFrame) -> DataFrame:
    """Keys under which files can be referred to, once for each file that has them: a file is a pair of id and path, and
    repeated rows of it count once."""
    path = bare(F.col("normalized_path"))
    last = F.element_at(F.split(path, "/"), -1)
    keys = F.array(F.concat(F.lit("i:"), F.col("file_id")), F.concat(F.lit("p:"), path), F.concat(F.lit("n:"), last))
    return files.select("file_id", "normalized_path").distinct().select(F.explode(keys).alias("ref_key")).filter("ref_key is not null")


def homes(files: DataFrame) -> DataFrame:
    """The folder of each file, of several rows that of the one indexed last: source_file_id, base."""
    path = F.max_by("normalized_path", F.struct("indexed_at", "normalized_path"))
    return files.groupBy("file_id").agg(path.alias("p")).select(F.col("file_id").alias("source_file_id"), F.lower(folder(F.col("p"))).alias("base"))


def _placed(deep: DataFrame, files: DataFrame) -> DataFrame:
    """References by names with a slash, with the folder they are read from and their key. A source may hold a third of the
    links, so the folders are replicated to the shards of their key."""
    read = fragment_replicate_join(deep.drop("base", "ref_key"), homes(files), ["source_file_id"], ["link_id"]).withColumn("base", F.coalesce("base", F.lit("")))
    return read.withColumn("ref_key", F.concat(F.lit("t:"), "base", F.lit("|"), "name")).select(*REFS)


def link_references(links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of the links (REFS), those by id or plain name and those by names with a slash. Both are written to the
    shared folder, as they are read several times.

    source_file_id and resolved_file_id refer by id. raw_target refers by name, where resolved_file_id is null. Nulls
    refer to nothing; exact repeats of a link count once.
    """
    null = F.lit(None).cast("string")
    name = F.when(F.col("resolved_file_id").isNull(), bare(F.col("raw_target")))
    slash = name.contains("/")

    def ref(field: str, key: Column, source: Column = null, of: Column = null) -> Column:
        return F.struct(F.lit(field).alias("ref_field"), key.alias("ref_key"), source.alias("source_file_id"), of.alias("name"))

    by_id = [ref(c, F.concat(F.lit("i:"), F.col(c))) for c in ("source_file_id", "resolved_file_id")]
    by_name = F.when(slash, ref("raw_target", null, F.col("source_file_id"), name)).otherwise(ref("raw_target", F.concat(F.lit("n:"), name)))
    rows = links.select("link_id", F.substring("created_at", 1, 7).alias("month"), F.explode(F.array(*by_id, by_name)).alias("r")).select("link_id", "month", "r.*")
    rows = cut_table(rows.filter("ref_key is not null or name is not null").withColumn("base", null).select(*REFS).distinct())
    return rows.filter("name is null"), cut_table(_placed(rows.filter("name is not null"), files))


def path_variants(base: Column, name: Column) -> Column:
    """The name as it is, and behind the folder `base` and each of its parents."""
    parts = F.split(base, "/")
    behind = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"), name))
    return F.array_distinct(F.when(base == "", F.array(name)).otherwise(F.concat(F.array(name), behind)))


def name_paths(deep: DataFrame) -> DataFrame:
    """Paths that each name may stand for: name_key, ref_key (`p:`)."""
    names = deep.select(F.col("ref_key").alias("name_key"), "base", "name").distinct()
    return names.select("name_key", F.explode(path_variants(F.col("base"), F.col("name"))).alias("v")).select("name_key", F.concat(F.lit("p:"), "v").alias("ref_key"))


def _satisfied(paths: DataFrame, existing: DataFrame, sign: int | Column = 1) -> DataFrame:
    """Existence of names: one for each path they may stand for that is among `existing` (ref_key)."""
    hits = paths.join(existing, "ref_key").select(F.col("name_key").alias("ref_key"), *(["sign"] if isinstance(sign, Column) else []))
    return existence_deltas(hits, sign)


def _exist(keys: DataFrame) -> DataFrame:
    return keys.filter("exists > 0 and ref_key like 'p:%'").select("ref_key")


def build(links: DataFrame, files: DataFrame) -> tuple[State, DataFrame]:
    """State of all links and files, and the references it was made of (REFS)."""
    plain, deep = link_references(links, files)
    records = cut_table(file_keys(files).groupBy("ref_key").agg(F.count(F.lit(1)).alias("n")))
    paths = cut_table(name_paths(deep))
    exist = records.filter("ref_key like 'p:%'").select("ref_key")
    keys = cut_table(apply_deltas(reference_deltas(plain), reference_deltas(deep), existence_deltas(records, F.col("n")), _satisfied(paths, exist)))
    return State(keys, paths, deep), plain.unionByName(deep)


def _none(df: DataFrame | None, like: DataFrame) -> DataFrame:
    return df if df is not None else like.limit(0)


def advance(state: State, files: DataFrame, *, links_added: DataFrame | None = None, links_removed: DataFrame | None = None, files_added: DataFrame | None = None, files_removed: DataFrame | None = None) -> State:
    """State after a batch of changes, from the state and the changes alone; `files` is the file table after them, of which
    the rows of changed files and of sources of new links are read.

    Records are pairs of id and path. Links removed are given as they were added. A record added twice counts twice, so a
    batch is to be applied once.
    """
    some = links_added if links_added is not None else links_removed
    gone = _none(files_removed, files).select("file_id", "normalized_path")
    come = _none(files_added, files).select("file_id", "normalized_path")
    parts, deep = [], state.deep
    # sources that a change of files moves to another folder read their names from there
    touched = gone.select("file_id").unionByName(come.select("file_id")).distinct()
    moved = homes(files.join(touched, "file_id", "left_semi"))
    moved = touched.select(F.col("file_id").alias("source_file_id")).join(moved, "source_file_id", "left").select("source_file_id", F.coalesce("base", F.lit("")).alias("to"))
    old = cut(deep.join(moved, "source_file_id").filter("base <> to"))
    new = old.withColumn("base", F.col("to")).withColumn("ref_key", F.concat(F.lit("t:"), "to", F.lit("|"), "name"))
    parts += [reference_deltas(old, -1), reference_deltas(new)]
    deep = deep.join(old.select("link_id"), "link_id", "left_anti").unionByName(new.select(*REFS))
    fresh = new.select(*REFS)
    if some is not None:
        for rows, sign in ((links_removed, -1), (links_added, 1)):
            if rows is None:
                continue
            plain, named = link_references(rows, files)
            parts += [reference_deltas(plain, sign), reference_deltas(named, sign)]
            deep = deep.unionByName(named) if sign > 0 else deep.join(named.select("link_id"), "link_id", "left_anti")
            fresh = fresh.unionByName(named) if sign > 0 else fresh
    parts += [existence_deltas(file_keys(gone), -1), existence_deltas(file_keys(come))]
    keys = cut_table(apply_deltas(state.keys, *parts))
    # paths that came or went satisfy or fail the names known before; names that are new are looked up once
    changed = file_keys(gone).unionByName(file_keys(come)).filter("ref_key like 'p:%'").distinct()
    was, now = _exist(state.keys).withColumn("was", F.lit(1)), _exist(keys).withColumn("now", F.lit(1))
    flips = changed.join(was, "ref_key", "left").join(now, "ref_key", "left").select("ref_key", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("sign")).filter("sign <> 0")
    new_paths = cut_table(name_paths(fresh).join(state.paths.select("name_key").distinct(), "name_key", "left_anti"))
    keys = cut_table(apply_deltas(keys, _satisfied(state.paths, flips, F.col("sign")), _satisfied(new_paths, now.select("ref_key"))))
    return State(keys, cut_table(state.paths.unionByName(new_paths)), cut_table(deep))


def orphan_references(links: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan references, one row per link and field: link_id, ref_field, month, ref_key.

    Exact repeats of a link count once. When a file was indexed does not matter. The flags of the links are not used.
    With an empty file table every reference is an orphan; empty links give an empty result.
    """
    state, refs = build(links, files)
    orphans = cut_table(orphan_keys(state.keys))
    refs = refs.select("link_id", "ref_field", "month", "ref_key")
    if orphans.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return refs.join(F.broadcast(orphans.select("ref_key")), "ref_key", "left_semi").select("link_id", "ref_field", "month", "ref_key")
    # one key may hold a third of the references: their counts are known from the state
    plan = plan_load(refs, ["ref_key"], 2 * parallelism(links.sparkSession), counts=state.keys.filter("refs > 0").select("ref_key", F.col("refs").alias("n")))
    found = fragment_replicate_join(refs, orphans.select("ref_key", F.lit(True).alias("orphan")), ["ref_key"], ["link_id"], "inner", plan)
    return found.select("link_id", "ref_field", "month", "ref_key")


def orphan_report(links: DataFrame, files: DataFrame, table_name: str = "vault_links") -> DataFrame:
    """Orphan references and distinct orphan keys per table, field and month."""
    found = orphan_references(links, files)
    per_key = found.groupBy("ref_field", "month", "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(F.lit(table_name).alias("table_name"), "ref_field", "month").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
