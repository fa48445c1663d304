"""The link graph: files are vertices, resolved links are edges. Iterations write to the shared checkpoint folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.components import connected_components
from quillspark.runtime import cut

RESOLVED = "not is_unresolved and resolved_file_id is not null"


class GraphError(ValueError):
    pass


def links_with_paths(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links with source_path and resolved_path; links of unknown sources are dropped, unknown targets have no path."""
    src = files.select(F.col("file_id").alias("source_file_id"), F.col("normalized_path").alias("source_path"))
    dst = files.select(F.col("file_id").alias("resolved_file_id"), F.col("normalized_path").alias("resolved_path"))
    return links.join(src, "source_file_id").join(dst, "resolved_file_id", "left")


def edges(links: DataFrame) -> DataFrame:
    """Distinct resolved pairs: src, dst."""
    return links.filter(RESOLVED).select(F.col("source_file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()


def panel(links: DataFrame) -> DataFrame:
    """Links as they are shown: link_id, source_path, target_path, heading, block_id, display_text, kind, resolved."""
    return links.select(
        "link_id",
        "source_path",
        F.col("resolved_path").alias("target_path"),
        F.col("heading_slug").alias("heading"),
        "block_id",
        F.lit(None).cast("string").alias("display_text"),
        T.link_kind(F.col("block_id"), F.col("heading_slug"), F.col("source_field")).alias("kind"),
        F.coalesce(~F.col("is_unresolved") & F.col("resolved_file_id").isNotNull(), F.lit(False)).alias("resolved"),
    )


def _id_of(files: DataFrame, path: str, missing_ok: bool = False) -> str | None:
    row = files.filter(F.col("normalized_path") == path).select("file_id").first()
    if row is None and not missing_ok:
        raise GraphError(f"note not found: {path}")
    return row[0] if row else None


def outgoing(links: DataFrame, files: DataFrame, path: str, missing_ok: bool = False) -> DataFrame:
    """Links of a note, unresolved ones too, in order of link_id. An unknown path is an error unless missing_ok."""
    f = _id_of(files, path, missing_ok)
    rows = links.filter(F.col("source_file_id") == f) if f else links.filter(F.lit(False))
    return panel(links_with_paths(rows, files)).orderBy("link_id")


def backlinks(links: DataFrame, files: DataFrame, path: str, missing_ok: bool = False) -> DataFrame:
    """Links to a note, whatever their flag, in order of source path and link_id."""
    f = _id_of(files, path, missing_ok)
    rows = links.filter(F.col("resolved_file_id") == f) if f else links.filter(F.lit(False))
    return panel(links_with_paths(rows, files)).orderBy("source_path", "link_id")


def link_panels(links: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Outgoing links, then backlinks, with their direction. Paging does not apply to panels."""
    return outgoing(links, files, path).withColumn("direction", F.lit("outgoing")).unionByName(backlinks(links, files, path).withColumn("direction", F.lit("incoming")))


def unresolved(links: DataFrame, files: DataFrame, by_path: bool = False) -> DataFrame:
    """Unresolved links with paths; in order of link_id, or of source path and link_id."""
    rows = links_with_paths(links.filter("is_unresolved"), files)
    return rows.orderBy("source_path", "link_id") if by_path else rows.orderBy("link_id")


def degrees(links: DataFrame, files: DataFrame) -> DataFrame:
    """All files with n_in and n_out, the resolved links to and from them; each link counts."""
    real = links.filter(RESOLVED)
    n_in = real.groupBy(F.col("resolved_file_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = real.groupBy(F.col("source_file_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_out"))
    return files.select("file_id", "normalized_path", "is_markdown").join(n_in, "file_id", "left").join(n_out, "file_id", "left").fillna(0, ["n_in", "n_out"])


def deadends(links: DataFrame, files: DataFrame) -> DataFrame:
    return degrees(links, files).filter("is_markdown and n_in > 0 and n_out = 0").orderBy("normalized_path")


def orphans(links: DataFrame, files: DataFrame) -> DataFrame:
    return degrees(links, files).filter("is_markdown and n_in = 0 and n_out = 0").orderBy("normalized_path")


def floating(links: DataFrame, files: DataFrame) -> DataFrame:
    """Files of any kind without links, but for noise names."""
    return degrees(links, files).filter("n_in = 0 and n_out = 0").filter(~T.is_noise(F.col("normalized_path"))).orderBy("normalized_path")


def totals(rows: DataFrame) -> DataFrame:
    """Numbers of rows, notes and other files; zeros for none."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("total"), n(F.col("is_markdown")).alias("markdown"), n(~F.col("is_markdown")).alias("other"))


def in_scope(path: Column, is_markdown: Column, scope: str = "", markdown: bool = True, other: bool = True, excludes: tuple[str, ...] = ()) -> Column:
    """Whether a file lies in a folder (all if empty or `.`), is of a wanted kind and in none of the excluded paths."""
    if not markdown and not other:
        raise GraphError("at least one kind of file is required")
    scope = "" if scope.strip() in ("", ".") else scope.strip().strip("/")
    out = ((path == scope) | F.startswith(path, F.lit(scope + "/"))) if scope else F.lit(True)
    kinds = (is_markdown if markdown else F.lit(False)) | (~is_markdown if other else F.lit(False))
    out = out & kinds
    for x in sorted({e.strip().strip("/") for e in excludes if e.strip().strip("/")}):
        out = out & ~((path == x) | F.startswith(path, F.lit(x + "/")))
    return out


def inbound_scope(links: DataFrame, files: DataFrame, scope: str = "", markdown: bool = True, other: bool = True, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Files in scope with the number of resolved links to them."""
    rows = degrees(links, files).filter(in_scope(F.col("normalized_path"), F.col("is_markdown"), scope, markdown, other, excludes))
    return rows.select("file_id", "normalized_path", "is_markdown", F.col("n_in").alias("inbound")).orderBy("normalized_path")


def inbound_totals(rows: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("total"), n(F.col("inbound") > 0).alias("linked"), n(F.col("inbound") == 0).alias("unlinked"))


def affected_links(links: DataFrame, changed: DataFrame) -> DataFrame:
    """Links of unchanged sources that a change of the files in `changed` (file_id) may touch: unresolved ones, and those
    to a changed target with a fragment."""
    ids = changed.select("file_id").distinct()
    rest = links.join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti")
    hit = ids.select(F.col("file_id").alias("resolved_file_id")).withColumn("touched", F.lit(True))
    rows = rest.join(hit, "resolved_file_id", "left")
    fragment = F.col("heading_slug").isNotNull() | F.col("block_id").isNotNull()
    return rows.filter(F.col("is_unresolved") | F.col("resolved_file_id").isNull() | (F.coalesce("touched", F.lit(False)) & fragment)).drop("touched")


def neighbors(links: DataFrame, files: DataFrame, path: str, direction: str = "all") -> DataFrame:
    """Neighbours of a note: path, direction, link_id; once per path and direction, in order of these."""
    f = _id_of(files, path)
    rows = links_with_paths(links.filter(RESOLVED), files)
    out = rows.filter(F.col("source_file_id") == f).select(F.col("resolved_path").alias("path"), F.lit("outgoing").alias("direction"), "link_id", F.lit("").alias("rank"))
    inc = rows.filter(F.col("resolved_file_id") == f).select(F.col("source_path").alias("path"), F.lit("incoming").alias("direction"), "link_id", F.col("source_path").alias("rank"))
    both = {"all": out.unionByName(inc), "outgoing": out, "incoming": inc}[direction].filter("path is not null")
    return both.groupBy("path", "direction").agg(F.min_by("link_id", F.struct("rank", "link_id")).alias("link_id")).orderBy("path", "direction")


def _labels(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Least node that is joined to each node, edges taken both ways: node, component."""
    found = connected_components(edges_.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("component", "c")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def _component_rows(labels: DataFrame, files: DataFrame, sample_size: int | None) -> DataFrame:
    named = labels.join(files.select(F.col("file_id").alias("node"), "normalized_path", "is_markdown"), "node")
    note = F.when(F.col("is_markdown"), F.col("normalized_path"))
    rows = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count(note).alias("n_notes"), F.min(note).alias("first_path"))
    if sample_size is None:
        return rows
    top = Window.partitionBy("component").orderBy("normalized_path")
    # a component may be a third of all notes: only candidates that can be among the first are ranked
    pre = named.filter("is_markdown").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    part = pre.withColumn("r", F.row_number().over(Window.partitionBy("component", "salt").orderBy("normalized_path"))).filter(F.col("r") <= sample_size)
    sample = part.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= sample_size)
    paths = sample.groupBy("component").agg(F.array_sort(F.collect_list("normalized_path")).alias("paths"))
    return rows.join(paths, "component", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def weak_components(links: DataFrame, files: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Weak components that hold a note: component, size (attachments too), n_notes, first_path[, paths]; largest first."""
    e = edges(links)
    known = files.select(F.col("file_id").alias("node")).distinct()
    e = e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return _component_rows(_labels(e, known), files, sample_size).filter("n_notes > 0").orderBy(F.col("size").desc(), "first_path")


def strong_components(links: DataFrame, files: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Strong components of notes and of what they link to: as weak_components. Attachments are components of size 1
    without notes.

    Nodes without an edge in or out are components of their own and are trimmed again and again; then the least node
    that reaches each node is spread along the edges, and nodes that reach back to it within its colour are its
    component.
    """
    notes = files.filter("is_markdown").select(F.col("file_id").alias("node")).distinct()
    known = files.select(F.col("file_id").alias("node")).distinct()
    e = edges(links).filter("src <> dst")
    e = e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    reached = notes.unionByName(e.select(F.col("dst").alias("node"))).distinct()
    left, e = cut(reached), cut(e)
    done = left.select("node", F.col("node").alias("component")).filter(F.lit(False))
    while True:  # each round settles at least the component of the least node that is left
        while True:  # trim
            keep = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            keep = cut(keep)
            out = left.join(keep, "node", "left_anti")
            n = out.count()
            if n:
                done = cut(done.unionByName(out.select("node", F.col("node").alias("component"))))
                left = keep
                e = cut(e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            else:
                break
        if not left.head(1):
            break
        colour = cut(left.select("node", F.col("node").alias("c")))
        while True:  # at most as many rounds as the longest path; the labels only go down
            push = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(push, "node", "left").select("node", F.least("c", "m").alias("c")))
            same = new.join(colour.withColumnRenamed("c", "old"), "node").filter("c <> old").head(1)
            colour = new
            if not same:
                break
        inner = cut(
            e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        )
        found = cut(colour.filter("node = c"))
        while True:
            back = inner.join(found.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(found, ["node", "c"], "left_anti")
            back = cut(back)
            if not back.head(1):
                break
            found = cut(found.unionByName(back))
        done = cut(done.unionByName(found.select("node", F.col("c").alias("component"))))
        left = cut(left.join(found.select("node"), "node", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return _component_rows(done, files, sample_size).orderBy(F.col("size").desc(), "first_path")


@dataclass(frozen=True)
class PathResult:
    found: bool
    explored: int
    nodes: tuple[str, ...]
    paths: tuple[str, ...]

    @property
    def edge_count(self) -> int:
        return max(0, len(self.paths) - 1)


def shortest_path(links: DataFrame, files: DataFrame, start: str, goal: str, max_depth: int = 8, max_nodes: int = 10_000) -> PathResult:
    """Shortest path between two notes over links taken both ways, as a queue would find it.

    Neighbours are tried in order of file_id; a node's parent is the one found first. More than max_nodes explored nodes
    are an error, so what the loop holds is bounded by that parameter; the graph itself stays distributed. Attachments on
    the way are not printed.
    """
    a, b = _id_of(files, start, True), _id_of(files, goal, True)
    if a is None or b is None:
        return PathResult(False, 0, (), ())
    real = links.filter(RESOLVED).select("source_file_id", "resolved_file_id")
    spark = links.sparkSession
    parent: dict[str, str | None] = {a: None}
    level, depth, explored, found = [a], 0, 1, a == b
    while level and depth < max_depth and not found:
        frontier = spark.createDataFrame(list(enumerate(level)), "rank int, src string")
        # neighbours of the frontier, of at most max_nodes rows, are read from the links; the edges are never gathered
        ends = (("source_file_id", "resolved_file_id"), ("resolved_file_id", "source_file_id"))
        out, into = (real.join(F.broadcast(frontier), F.col(x) == F.col("src")).select("rank", "src", F.col(y).alias("dst")) for x, y in ends)
        rows = out.unionByName(into).filter("src <> dst")
        first = rows.groupBy("dst").agg(F.min(F.struct("rank", "src")).alias("f")).select("dst", "f.rank", "f.src")
        # nodes known before are at most max_nodes as well
        seen = spark.createDataFrame([(x,) for x in parent], "dst string")
        new = first.join(F.broadcast(seen), "dst", "left_anti").orderBy("rank", "dst").limit(max_nodes + 1).collect()
        level = []
        for r in new:
            parent[r["dst"]] = r["src"]
            level.append(r["dst"])
            explored += 1
            if r["dst"] == b:
                found = True
                break
            if explored > max_nodes:
                raise GraphError(f"explored more than {max_nodes} nodes")
        depth += 1
    if not found:
        return PathResult(False, explored, (), ())
    nodes = [b]
    while parent[nodes[-1]] is not None:
        nodes.append(parent[nodes[-1]])
    nodes.reverse()
    names = {r["file_id"]: r for r in files.filter(F.col("file_id").isin(nodes)).select("file_id", "normalized_path", "is_markdown").collect()}
    return PathResult(True, explored, tuple(nodes), tuple(names[n]["normalized_path"] for n in nodes if n in names and names[n]["is_markdown"]))


def folder_edges(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Folder overlay of the notes in sources (id): source_file_id, source_path, resolved_file_id, target_path, edge_type.

    folder-parent joins a note to the notes of the folder above; folder-sibling to the other notes of its own folder. A
    folder's notes are paired with the sources only, never all with all.
    """
    notes = files.filter("is_markdown").select("file_id", "normalized_path", T.folder_of(F.col("normalized_path")).alias("folder"))
    home = notes.join(sources, F.col("file_id") == F.col("id"), "left_semi").select(F.col("file_id").alias("source_file_id"), F.col("normalized_path").alias("source_path"), "folder")
    dst = notes.select(F.col("file_id").alias("resolved_file_id"), F.col("normalized_path").alias("target_path"), F.col("folder").alias("there"))
    up = home.filter("folder <> ''").join(dst, T.folder_of(F.col("folder")) == F.col("there")).withColumn("edge_type", F.lit("folder-parent"))
    beside = home.join(dst, F.col("folder") == F.col("there")).withColumn("edge_type", F.lit("folder-sibling"))
    return up.unionByName(beside).filter("source_file_id <> resolved_file_id").drop("folder", "there")


def walk(links: DataFrame, files: DataFrame, start: str, depth: int = 2, limit: int = 200, include_unresolved: bool = False, include_folders: bool = False) -> DataFrame:
    """Steps of a walk from a note, level by level: depth, direction, edge_type, link_id, source_path, target_path,
    raw_target, resolved, and step (their order).

    Of a level all outgoing links come in order of link_id, then all incoming ones, then the folder overlay of each node
    of the frontier. Edges may repeat on later levels. The walk ends after `limit` steps, also within a level.
    """
    schema = "step int, depth int, direction string, edge_type string, link_id string, source_path string, target_path string, raw_target string, resolved boolean"
    spark = links.sparkSession
    f = _id_of(files, start)
    steps: list[tuple] = []
    frontier, seen = [f], {f}
    named = links_with_paths(links if include_unresolved else links.filter(RESOLVED), files)
    for level in range(1, depth + 1):
        room = limit - len(steps)
        if room <= 0 or not frontier:
            break
        # the frontier comes from at most `limit` steps
        here = F.broadcast(spark.createDataFrame([(x,) for x in frontier], "id string"))
        ok = F.coalesce(~F.col("is_unresolved") & F.col("resolved_file_id").isNotNull(), F.lit(False))
        cols = ["link_id", "source_file_id", "resolved_file_id", "source_path", F.col("resolved_path").alias("target_path"), "raw_target", ok.alias("resolved")]
        out = named.join(here, F.col("source_file_id") == F.col("id"), "left_semi").select(F.lit(0).alias("phase"), F.lit("outgoing").alias("direction"), F.lit("wikilink").alias("edge_type"), *cols)
        inc = named.filter(RESOLVED).join(here, F.col("resolved_file_id") == F.col("id"), "left_semi").select(F.lit(1).alias("phase"), F.lit("incoming").alias("direction"), F.lit("wikilink").alias("edge_type"), *cols)
        rows = out.unionByName(inc).orderBy("phase", "link_id").limit(room).collect()
        if include_folders and len(rows) < room:
            both = folder_edges(files, here)
            link = F.concat_ws(":", F.lit("folder"), "source_file_id", "resolved_file_id", "edge_type")
            both = both.select(F.lit(2).alias("phase"), F.lit("outgoing").alias("direction"), "edge_type", link.alias("link_id"), "source_file_id", "resolved_file_id", "source_path", "target_path", F.col("target_path").alias("raw_target"), F.lit(True).alias("resolved"))
            rows += both.orderBy("source_file_id", F.col("edge_type"), "resolved_file_id").limit(room - len(rows)).collect()
        nxt = set()
        for r in rows:
            steps.append((len(steps), level, r["direction"], r["edge_type"], r["link_id"], r["source_path"], r["target_path"], r["raw_target"], r["resolved"]))
            other = r["source_file_id"] if r["direction"] == "incoming" else r["resolved_file_id"]
            if r["resolved"] and other is not None and other not in seen:
                nxt.add(other)
        seen |= nxt
        frontier = sorted(nxt)
    return spark.createDataFrame(steps, schema)
