"""Resolution of link targets to files, as equi-joins over path keys and a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def candidate_keys(files: DataFrame) -> DataFrame:
    """Keys of the files: k (`p:` whole path or `n:` last segment; case and final .md ignored), file_id, path."""
    bare = T.strip_md(F.lower("normalized_path"))
    keys = F.array(F.concat(F.lit("p:"), bare), F.concat(F.lit("n:"), T.strip_md(F.lower(T.last_segment(F.col("normalized_path"))))))
    return files.select("file_id", F.col("normalized_path").alias("path"), F.explode(F.array_distinct(keys)).alias("k"))


def target_keys(target: Column, source_folder: Column) -> Column:
    """Keys that a target may stand for: with a slash, itself and behind each folder of the source; else its name."""
    raw = F.lower(F.regexp_replace(target, r"^/+", ""))
    inside = F.transform(T.ancestors(F.lower(source_folder)), lambda d: F.concat(d, F.lit("/"), raw))
    paths = F.transform(F.concat(F.array(raw), inside), lambda p: F.concat(F.lit("p:"), T.strip_md(T.collapse_dots(p))))
    return F.array_distinct(F.when(F.contains(target, F.lit("/")), paths).otherwise(F.array(F.concat(F.lit("n:"), T.strip_md(raw)))))


def _folders(folder: Column) -> Column:
    """A folder in lower case, its parents, and the root."""
    return F.array_distinct(F.concat(T.ancestors(F.lower(folder)), F.array(F.lit(""))))


def _depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def _nearest(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Best file of each (target, home) that names a file without a slash, and how many bear the name.

    Namesakes are not paired with the folders that ask for them. For each name and folder the best of the files at any
    depth below is kept; a request looks at its own folder and the folders above it. The nearest file is the best below
    the lowest folder that it shares with the request, so it is among these few.
    """
    named = candidate_keys(files).filter("k like 'n:%'").withColumn("there", F.lower(T.folder_of(F.col("path"))))
    below = F.struct(_depth(F.col("there")).alias("deep"), F.lower("path").alias("p"), F.col("path").alias("path"), F.col("file_id").alias("file_id"))
    best = named.select("k", F.explode(_folders(F.col("there"))).alias("above"), below.alias("b")).groupBy("k", "above").agg(F.min("b").alias("b"))
    counts = named.groupBy("k").agg(F.count(F.lit(1)).alias("n_matches"))
    name = F.concat(F.lit("n:"), T.strip_md(F.lower("target")))
    asked = asks.select("target", "home", name.alias("k"), F.explode(_folders(F.col("home"))).alias("above"))
    steps = _depth(F.lower("home")) + F.col("b.deep") - 2 * _depth(F.col("above"))
    rank = F.struct(steps.alias("steps"), F.col("b.p").alias("p"), F.col("b.path").alias("path"), F.col("b.file_id").alias("file_id"))
    found = asked.join(best, ["k", "above"]).groupBy("target", "home", "k").agg(F.min(rank).alias("best"))
    return found.join(counts, "k").select("target", "home", "best.file_id", "best.path", "n_matches")


def _by_path(asks: DataFrame, files: DataFrame) -> DataFrame:
    """The same for targets with a slash: of the paths that a target may stand for few are files."""
    keyed = asks.select("target", "home", F.explode(target_keys(F.col("target"), F.col("home"))).alias("k"))
    hits = keyed.join(candidate_keys(files).filter("k like 'p:%'"), "k").select("target", "home", "file_id", "path").distinct()
    there = T.folder_of(F.col("path"))
    rank = F.struct(T.folder_distance(F.lower("home"), F.lower(there)).alias("steps"), F.lower("path").alias("p"), F.col("path").alias("path"), F.col("file_id").alias("file_id"))
    best = hits.groupBy("target", "home").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n_matches"))
    return best.select("target", "home", "best.file_id", "best.path", "n_matches")


def resolve(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Best file of each request (request_id, target, source_path): request_id, file_id, path, n_matches, ambiguous.

    Files of the source's own folder go first, then by steps between the folders, then by path with case ignored.
    Requests are reduced to distinct (target, source folder) before they are matched, so a target that a third of all
    links name is matched once per folder. Requests without a match, or with a null or empty target, give no row.
    """
    asked = requests.filter("target is not null and trim(target) <> ''").select("request_id", F.trim("target").alias("target"), T.folder_of(F.coalesce("source_path", F.lit(""))).alias("home"))
    asks = asked.select("target", "home").distinct()
    slash = F.contains("target", F.lit("/"))
    best = _nearest(asks.filter(~slash), files).unionByName(_by_path(asks.filter(slash), files))
    return asked.join(best, ["target", "home"]).select("request_id", "file_id", "path", "n_matches", (F.col("n_matches") > 1).alias("ambiguous"))


def resolve_links(links: DataFrame, files: DataFrame, headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds resolved_file_id, is_unresolved, unresolved_reason to links (link_id, source_path, raw_target, heading_slug,
    block_id).

    A fragment must exist in the file found: heading by slug, block by id. A link with a bad fragment is unresolved.
    """
    found = resolve(links.select(F.col("link_id").alias("request_id"), F.col("raw_target").alias("target"), "source_path"), files).select(F.col("request_id").alias("link_id"), F.col("file_id").alias("hit"))
    heads = headings.select(F.col("file_id").alias("hit"), F.col("slug").alias("heading_slug")).distinct().withColumn("has_heading", F.lit(True))
    ids = blocks.select(F.col("file_id").alias("hit"), "block_id").distinct().withColumn("has_block", F.lit(True))
    out = links.join(found, "link_id", "left").join(heads, ["hit", "heading_slug"], "left").join(ids, ["hit", "block_id"], "left")
    fragment_ok = F.when(F.col("block_id").isNotNull(), F.coalesce("has_block", F.lit(False))).when(F.col("heading_slug").isNotNull(), F.coalesce("has_heading", F.lit(False))).otherwise(True)
    ok = F.col("hit").isNotNull() & fragment_ok
    reason = F.when(~ok, T.unresolved_reason(F.col("raw_target"), F.col("heading_slug"), F.col("block_id")))
    return out.withColumns({"resolved_file_id": F.when(ok, F.col("hit")), "is_unresolved": ~ok, "unresolved_reason": reason}).drop("hit", "has_heading", "has_block")


def heading_exists(requests: DataFrame, headings: DataFrame) -> DataFrame:
    """Whether the file of each request (request_id, file_id, slug) has a heading of that slug."""
    have = headings.select("file_id", "slug").distinct().withColumn("found", F.lit(True))
    return requests.join(have, ["file_id", "slug"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ranked_candidates(requests: DataFrame, files: DataFrame) -> DataFrame:
    """All files that a request matches, best first: request_id, file_id, path, place."""
    asked = requests.select("request_id", F.trim("target").alias("target"), T.folder_of(F.coalesce("source_path", F.lit(""))).alias("home"))
    keyed = asked.select("request_id", "home", F.explode(target_keys(F.col("target"), F.col("home"))).alias("k"))
    hits = keyed.join(candidate_keys(files), "k").select("request_id", "home", "file_id", "path").distinct()
    there = T.folder_of(F.col("path"))
    order = [(F.lower(there) != F.lower("home")).cast("int"), T.folder_distance(F.lower("home"), F.lower(there)), F.lower("path"), F.col("path"), F.col("file_id")]
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).drop("home")
