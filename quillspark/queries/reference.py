"""Queries over the vault tables, one or more for each operator, and SQL that states the same result.

Names start with the operator's number in the survey. Files are taken in their current rows, links and properties once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import api
from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import baseview, graph, incremental, index, meta, postings, resolve, search, tasks
from quillspark.plans import bases as B
from quillspark.plans import where as W
from quillspark.runtime import once, shared_path, spread, table
from quillspark.sources import events as E
from quillspark.sources import tables as S
from quillspark.sources import vault

ALL = B.ALL_ROWS
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _CTE + sql
        return f

    return add


_CTE = r"""WITH RECURSIVE
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC, normalized_path DESC, size_bytes DESC, hash_blake3 DESC) AS rn FROM vault_files) WHERE rn = 1),
l AS (SELECT DISTINCT * FROM vault_links),
p AS (SELECT DISTINCT * FROM vault_properties),
s AS (SELECT DISTINCT * FROM vault_search),
r AS (SELECT * FROM l WHERE NOT is_unresolved AND resolved_file_id IS NOT NULL),
e AS (SELECT DISTINCT source_file_id AS src, resolved_file_id AS dst FROM r),
lp AS (SELECT l.*, a.normalized_path AS source_path, b.normalized_path AS resolved_path FROM l JOIN f a ON a.file_id = l.source_file_id LEFT JOIN f b ON b.file_id = l.resolved_file_id),
deg AS (SELECT f.file_id, f.normalized_path, f.is_markdown, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM f
  LEFT JOIN (SELECT resolved_file_id AS id, count(*) AS n FROM r GROUP BY 1) i ON i.id = f.file_id LEFT JOIN (SELECT source_file_id AS id, count(*) AS n FROM r GROUP BY 1) o ON o.id = f.file_id),
start AS (SELECT source_path AS path, source_file_id AS id FROM lp ORDER BY 1 LIMIT 1),
hub AS (SELECT file_id AS id, normalized_path AS path FROM deg WHERE is_markdown ORDER BY n_in DESC, normalized_path LIMIT 1)
"""
_SURFACE = r"' ' || trim(regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_FTS = ", fts AS (SELECT s.*, " + ", ".join(_SURFACE.format(c) + f" AS k{i}" for i, c in enumerate(("normalized_path", "title_lc", "content_lc"))) + r", regexp_replace(regexp_extract(normalized_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS title FROM s)"
_HIT = lambda p: f"(contains(k0, ' {p}') OR contains(k1, ' {p}') OR contains(k2, ' {p}'))"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return S.current_rows(table(spark, d, "vault_files"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_links").distinct()


def _props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_properties").distinct()


def _search(spark: SparkSession, d: str) -> DataFrame:
    """Notes with their texts, some repeated; queries drop repeats of what they found, not of the texts."""
    return table(spark, d, "vault_search")


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The search index of the notes and its postings, built once per session and stored as an index stores them."""

    def make() -> str:
        at = shared_path(spark, "index")
        notes = search.with_surfaces(spread(_search(spark, d), "file_id"))
        notes.repartitionByRange("file_id").sortWithinPartitions("file_id").write.option("parquet.bloom.filter.enabled#file_id", "true").parquet(f"{at}/search_index")
        rows = postings.build(spark.read.parquet(f"{at}/search_index").dropDuplicates(["file_id"]))
        rows.repartitionByRange("token", "file_id").sortWithinPartitions("token", "file_id").write.option("parquet.block.size", 8 << 20).parquet(f"{at}/postings")
        return at

    at = once(spark, (d, "index"), make)
    return spark.read.parquet(f"{at}/search_index"), spark.read.parquet(f"{at}/postings")


def _ask(spark: SparkSession, d: str, query: str) -> tuple[DataFrame, str, DataFrame]:
    index_, found = _indexed(spark, d)
    return index_, query, found


def _start(spark: SparkSession, d: str) -> str:
    """The note that graph queries ask about, chosen once per session."""
    return once(spark, (d, "start"), lambda: graph.links_with_paths(_links(spark, d), _files(spark, d)).agg(F.min("source_path")).first()[0])


def _hub(spark: SparkSession, d: str) -> str:
    """The note with the most links to it, chosen once per session."""
    return once(spark, (d, "hub"), lambda: graph.degrees(_links(spark, d), _files(spark, d)).filter("is_markdown").orderBy(F.col("n_in").desc(), "normalized_path").first()["normalized_path"])


# --- scans -------------------------------------------------------------------------------------------------------


@_q("SELECT file_id, normalized_path, size_bytes FROM f")
def s08_files(spark: SparkSession, d: str) -> DataFrame:
    return S.all_files(_files(spark, d)).select("file_id", "normalized_path", "size_bytes")


@_q("SELECT property_id, p.file_id, normalized_path AS path, key, value_type, value_json, updated_at FROM p JOIN f USING (file_id) WHERE key = 'status'")
def s09_properties_of_key(spark: SparkSession, d: str) -> DataFrame:
    return meta.properties_with_paths(_props(spark, d), _files(spark, d), key="status")


@_q("SELECT link_id, source_path, resolved_path, raw_target, is_unresolved FROM lp")
def s10_j01_links_with_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.links_with_paths(_links(spark, d), _files(spark, d)).select("link_id", "source_path", "resolved_path", "raw_target", "is_unresolved")


@_q("SELECT file_id, normalized_path AS path, indexed_at FROM f WHERE is_markdown AND normalized_path > 'notes/m' ORDER BY path LIMIT 200")
def s12_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return S.notes_page(_files(spark, d), "notes/m", 200)[0]


@_q("SELECT event_id AS id, event_type AS kind, props->>'$.file_id' AS file_id, props->>'$.path' AS path, props->>'$.action' AS action FROM events WHERE event_id > 100 ORDER BY 1 LIMIT 500")
def s13_events_poll(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.col("props").alias("payload_json"), F.col("ts").cast("string").alias("created_at"))
    return E.poll(e, 100, 500)[0].drop("created_at")


@_q("SELECT user_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def s13_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, read to its end; latest time and number per user of what was written."""
    from quillspark.streaming import ingest

    at = shared_path(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    ingest.event_sink(source, f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


# --- search ------------------------------------------------------------------------------------------------------

_DOCS = _FTS + f""", hits AS (SELECT file_id, normalized_path AS path, title, updated_at,
  concat_ws(',', CASE WHEN contains(title_lc, 'draft') THEN 'title' END, CASE WHEN contains(normalized_path_lc, 'draft') THEN 'path' END, CASE WHEN contains(content_lc, 'draft') THEN 'content' END) AS matched_in,
  3 * contains(title_lc, 'draft')::INT + 2 * contains(normalized_path_lc, 'draft')::INT + contains(content_lc, 'draft')::INT AS score FROM fts WHERE {_HIT("draft")})"""


@_q(_DOCS + " SELECT file_id, path, title, matched_in, score FROM hits")
def t01_t02_t03_search(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.search(*_ask(spark, d, "draft"))).select("file_id", "path", "title", F.array_join("matched_in", ",").alias("matched_in"), "score")


@_q(_DOCS + " SELECT file_id, path, score FROM hits")
def t01_scan_without_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same search over an index that has no postings."""
    return search.search(_search(spark, d), "draft").select("file_id", "path", "score")


@_q(_FTS + f" SELECT file_id, normalized_path AS path FROM fts WHERE {_HIT('project ma')} AND {_HIT('moved')}")
def t01_phrase_and_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.search(*_ask(spark, d, "project-ma móved")).select("file_id", "path")


@_q(_DOCS + " SELECT path, title, matched_in FROM hits WHERE (starts_with(path, 'notes/') AND NOT contains(lower(title), 'daily')) AND (',' || matched_in || ',') LIKE '%,content,%' ORDER BY title DESC, path, file_id LIMIT 50")
def w01_o01_p01_docs_query(spark: SparkSession, d: str) -> DataFrame:
    q = search.DocsQuery("draft", "path starts_with 'notes/' and not title contains 'DAILY' and (matched_in contains 'content')", "title:desc", "path,title,matched_in", 50)
    return q.run(*_indexed(spark, d)).withColumn("matched_in", F.array_join("matched_in", ","))


@_q(_DOCS + " SELECT file_id, path, title FROM hits WHERE updated_at >= '2023-01-15' OR title == 'reading-list' ORDER BY updated_at, path, file_id LIMIT 30 OFFSET 5")
def w04_o05_docs_page(spark: SparkSession, d: str) -> DataFrame:
    q = search.DocsQuery("draft", "indexed_at >= '2023-01-15' or title == 'reading-list'", "indexed_at:nulls_last:asc", "file_id,path,title", 30, 5)
    return q.run(*_indexed(spark, d))


@_q(_DOCS + " SELECT count(*) AS total FROM hits WHERE path <> 'x' AND NOT ends_with(path, '1.md')")
def w07_a11_total(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(search.DocsQuery("draft", "path != 'x' and not path ends_with '1.md'").total(*_indexed(spark, d)),)], "total long")


@_q("SELECT property_id, file_id, normalized_path AS path, value_json FROM p JOIN f USING (file_id) WHERE key = 'status' AND contains(lower(value_json), 'a') ORDER BY value_json DESC, path, property_id LIMIT 40 OFFSET 10")
def t05_o09_property_query(spark: SparkSession, d: str) -> DataFrame:
    return search.property_query(_props(spark, d), _files(spark, d), "status", "A", "value", True, 40, 10).select("property_id", "file_id", "path", "value_json")


@_q("SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 AND o_orderstatus == 'F') OR NOT (o_orderpriority LIKE '1%' OR o_totalprice <= 250000.5)")
def w02_where_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The condition language over a plain table with numbers and texts."""
    kinds = {"o_totalprice": "number", "o_orderstatus": "string", "o_orderpriority": "string"}
    tree = W.parse_where("o_totalprice > 200000 and o_orderstatus == 'F' or not (o_orderpriority starts_with '1' or o_totalprice <= 250000.5)")
    rows = table(spark, d, "orders")
    return rows.filter(W.compile_where(tree, lambda n: V.scalar_value(F.col(n), kinds[n]) if n in kinds else None)).select("o_orderkey")


@_q("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NULL OR (props->>'$.k')::DOUBLE <> 50 OR json_type(props, '$.k') <> 'DOUBLE'")
def w03_not_equal_keeps_missing(spark: SparkSession, d: str) -> DataFrame:
    """`!=` holds for a missing field; whole numbers in the data never equal a literal, which is a fraction."""
    rows = table(spark, d, "events").withColumn("k", V.json_value(F.get_json_object("props", "$.k")))
    return rows.filter(W.compile_where(W.parse_where("k != 50"), lambda n: F.col(n))).select("event_id")


@_q("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.05::DOUBLE AND NOT (l_tax = 0.02::DOUBLE) AND l_returnflag = 'R'")
def w03_equal_numbers_and_texts(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"l_discount": "number", "l_tax": "number", "l_returnflag": "string"}
    tree = W.parse_where("l_discount == 0.05 and l_tax != 0.02 and l_returnflag == 'R'")
    return table(spark, d, "lineitem").filter(W.compile_where(tree, lambda n: V.scalar_value(F.col(n), kinds[n]))).select("l_orderkey", "l_linenumber")


# --- views -------------------------------------------------------------------------------------------------------

#: The best of the targets for each of asks (t, home), both in lower case: own folder first, then fewest steps, then path.
_RANKED = r""", ks AS (SELECT DISTINCT t, home, unnest(CASE WHEN contains(t, '/') THEN list_concat([t], list_transform(range(1, len(string_split(home, '/')) + 1), lambda i: array_to_string(string_split(home, '/')[1:i], '/') || '/' || t)) ELSE ['//' || t] END) AS v FROM asks),
  kb AS (SELECT DISTINCT t, home, regexp_replace(v, '\.md$', '') AS k FROM ks),
  cand AS (SELECT file_id, path, regexp_replace(lower(path), '\.md$', '') AS k FROM targets UNION ALL SELECT file_id, path, '//' || regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\.md$', '') FROM targets),
  hits AS (SELECT DISTINCT t, home, file_id, path, lower(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END) AS there FROM kb JOIN cand USING (k)),
  parts AS (SELECT *, CASE WHEN home = '' THEN [] ELSE string_split(home, '/') END AS a, CASE WHEN there = '' THEN [] ELSE string_split(there, '/') END AS b FROM hits),
  dist AS (SELECT *, len(a) + len(b) - 2 * coalesce(list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), 0) AS steps FROM parts),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, home ORDER BY (home <> there)::INT, steps, lower(path), path, file_id) AS rn, count(*) OVER (PARTITION BY t, home) AS n_matches FROM dist) WHERE rn = 1)"""
_LATEST = ", q AS (SELECT file_id, key, arg_max(value_json, (updated_at, property_id, value_json)) AS j FROM p GROUP BY 1, 2)"
_VIEW = {
    "views": [
        {
            "type": "table",
            "name": "open",
            "source": "notes/projects",
            "filters": [{"key": "status", "op": "exists", "value": True}, {"key": "status", "op": "not_eq", "value": "done"}, {"key": "title", "op": "starts_with", "value": "project-"}],
            "sorts": [{"key": "status", "direction": "desc"}, {"key": "path", "direction": "asc"}],
            "columns": ["path", "title", "folder", "status", "owner"],
        },
        {"type": "table", "name": "groups", "group_by": ["status"], "aggregates": [{"alias": "n", "op": "count"}, {"alias": "total", "op": "sum", "key": "priority"}], "columns": ["status"]},
        {"type": "table", "name": "numbers", "filters": [{"key": "priority", "op": "gte", "value": 2}], "columns": ["priority"]},
        {"type": "table", "name": "related", "relations": ["related"], "rollups": [{"alias": "n_related", "relation": "related", "target": "priority", "op": "count"}, {"alias": "sum_related", "relation": "related", "target": "priority", "op": "sum"}], "columns": ["related", "n_related", "sum_related"], "filters": [{"key": "related", "op": "exists", "value": True}]},
    ]
}
_TEXT = lambda c: rf"CASE WHEN {c} IS NULL THEN 'null' WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'NULL' THEN 'null' ELSE {c} END ELSE to_json({c})::VARCHAR END"


def _view(name: str, page_size: int = ALL) -> B.TablePlan:
    return B.compile_view(B.find_view(B.views_of(_VIEW), name), 1, page_size)


def _run(spark: SparkSession, d: str, name: str, page_size: int = ALL) -> baseview.ViewResult:
    return baseview.execute(_view(name, page_size), _files(spark, d), _props(spark, d))


_OPEN = _LATEST + r""", w AS (SELECT f.file_id, normalized_path AS file_path, regexp_replace(regexp_extract(normalized_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS title, st.j AS st, ow.j AS ow,
  CASE WHEN json_valid(st.j) THEN CASE WHEN json_type(st.j) = 'VARCHAR' THEN st.j->>'$' END ELSE st.j END AS st_text, CASE WHEN json_valid(st.j) AND json_type(st.j) = 'NULL' THEN NULL ELSE st.j END AS st_val
  FROM f LEFT JOIN q st ON st.file_id = f.file_id AND st.key = 'status' LEFT JOIN q ow ON ow.file_id = f.file_id AND ow.key = 'owner'
  WHERE is_markdown AND normalized_path LIKE 'notes/projects/%'), v AS (SELECT * FROM w WHERE st IS NOT NULL AND st_text IS DISTINCT FROM 'done' AND starts_with(title, 'project-'))"""


@_q(_OPEN + " SELECT file_id, file_path, title FROM v")
def j02_b01_b05_b06_f01_view_rows(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "open").rows.select("file_id", "file_path", F.get_json_object(F.concat(F.lit('{"v":'), "title", F.lit("}")), "$.v").alias("title"))


_NUMBERS = {"views": [{"type": "table", "name": "numbers", "filters": [{"key": "progress", "op": "gte", "value": -1e300}, {"key": "progress", "op": "lte", "value": 1e300}], "columns": ["progress", "path", "none"]}]}


@_q(_LATEST + r""", n AS (SELECT normalized_path AS path, j::DOUBLE AS n FROM f JOIN q ON q.file_id = f.file_id AND key = 'progress' WHERE is_markdown AND regexp_full_match(trim(j), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?'))
  SELECT 'progress' AS column_name, count(*) AS n, min(n)::VARCHAR AS least, max(n)::VARCHAR AS most, round(avg(n), 6) AS mean FROM n
  UNION ALL SELECT 'path', count(*), '"' || min(path) || '"', '"' || max(path) || '"', NULL FROM n UNION ALL SELECT 'none', 0, NULL, NULL, NULL""")
def a06_summary_values(spark: SparkSession, d: str) -> DataFrame:
    """Count, least, greatest and mean of the columns of a view; a column of numbers, one of texts, and one without values."""
    rows = baseview.execute(B.compile_view(B.views_of(_NUMBERS)[0]), _files(spark, d), _props(spark, d)).summaries
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)").cast("string"), F.col(c))
    return rows.select(F.col("column").alias("column_name"), F.col("count").alias("n"), number("min").alias("least"), number("max").alias("most"), F.round("avg", 6).alias("mean"))


@_q(_LATEST + r""", v AS (SELECT f.file_id, normalized_path AS path, j, CASE WHEN NOT json_valid(j) THEN 3 WHEN j IN ('true', 'false') THEN 1 WHEN starts_with(j, '"') THEN 3 WHEN j = 'null' THEN NULL ELSE 2 END AS r,
    CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN j->>'$' ELSE j END AS s FROM f JOIN q ON q.file_id = f.file_id AND key = 'rating' WHERE is_markdown AND CASE WHEN json_valid(j) THEN json_type(j) NOT IN ('ARRAY', 'OBJECT') ELSE true END)
  SELECT file_id, path AS file_path FROM v ORDER BY r DESC NULLS LAST, CASE WHEN r = 1 THEN j = 'true' END DESC, CASE WHEN r = 2 THEN j::DOUBLE END DESC, CASE WHEN r = 3 THEN s END DESC, path, file_id LIMIT 50 OFFSET 50""")
def o03_o04_o08_v17_sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a view, sorted by values of mixed types, the greatest first."""
    doc = B.views_of({"views": [{"type": "table", "filters": [{"key": "rating", "op": "exists", "value": True}], "sorts": [{"key": "rating", "direction": "desc"}], "columns": ["rating"]}]})
    files, props = _files(spark, d), _props(spark, d)
    nested = F.col("v0")["rank"].isin(V.ARRAY, V.OBJECT)
    kept = baseview.pivot(baseview.candidates(files, None), props, ("rating",)).filter(~F.coalesce(nested, F.lit(False))).select("file_id")
    return baseview.execute(B.compile_view(doc[0], 2, 50), files.join(kept, "file_id", "left_semi"), props).rows.select("file_id", "file_path")


@_q(_OPEN + " SELECT 'status' AS column_name, count(st_val) AS n FROM v UNION ALL SELECT 'owner', count(*) FILTER (ow IS NOT NULL AND NOT (json_valid(ow) AND json_type(ow) = 'NULL')) FROM v UNION ALL SELECT c, (SELECT count(*) FROM v) FROM (VALUES ('path'), ('title'), ('folder')) t(c)")
def a06_view_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "open").summaries.select(F.col("column").alias("column_name"), F.col("count").alias("n"))


@_q(_LATEST + r""", g AS (SELECT coalesce(CASE WHEN json_valid(st.j) THEN CASE WHEN json_type(st.j) = 'VARCHAR' THEN st.j->>'$' ELSE json(st.j)::VARCHAR END ELSE st.j END, 'null') AS status, CASE WHEN regexp_full_match(trim(pr.j), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN pr.j::DOUBLE END AS n
  FROM f LEFT JOIN q st ON st.file_id = f.file_id AND st.key = 'status' LEFT JOIN q pr ON pr.file_id = f.file_id AND pr.key = 'priority' WHERE is_markdown)
  SELECT status, count(*) AS n, round(coalesce(sum(n), 0), 2) AS total FROM g GROUP BY 1""")
def a01_a02_a03_view_groups(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "status", F.lit("}")), "$.v"), F.col("status"))
    return _run(spark, d, "groups").rows.select(text.alias("status"), F.col("n").cast("long").alias("n"), F.round(F.col("total").cast("double"), 2).alias("total"))


@_q(_LATEST + r""" SELECT f.file_id FROM f JOIN q ON q.file_id = f.file_id AND q.key = 'priority' WHERE is_markdown
  AND CASE WHEN regexp_full_match(trim(j), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN j::DOUBLE >= 2 ELSE NOT (json_valid(j) AND json_type(j) IN ('NULL', 'BOOLEAN')) END""")
def b02_ordered_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Texts, arrays and objects are above any number, null and booleans below."""
    return _run(spark, d, "numbers").rows.select("file_id")


_RELATED = _LATEST + r""", x AS (SELECT q.file_id, normalized_path, j, unnest(CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN list_filter(j->>'$[*]', lambda y: y IS NOT NULL) WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN [coalesce(j->>'$.path', '')] WHEN json_valid(j) AND json_type(j) = 'NULL' THEN [] WHEN json_valid(j) THEN [j->>'$'] ELSE [j] END) AS tok
    FROM q JOIN f USING (file_id) WHERE key = '{key}' AND is_markdown),
  y AS (SELECT file_id, normalized_path, regexp_replace(trim(regexp_replace(regexp_replace(trim(tok), '^\[\[|\]\]$', '', 'g'), '[|#].*$', '')), '^/+', '') AS t FROM x),
  z AS (SELECT file_id, lower(CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END) AS home, lower(CASE WHEN ends_with(lower(t), '.md') THEN t ELSE t || '.md' END) AS t FROM y WHERE t <> ''),
  asks AS (SELECT DISTINCT t, home FROM z), targets AS (SELECT file_id, normalized_path AS path FROM f WHERE is_markdown)""" + _RANKED + r""",
  got AS (SELECT z.file_id, best.file_id AS to_id FROM z JOIN best ON best.t = z.t AND best.home = z.home),
  has AS (SELECT file_id FROM q JOIN f USING (file_id) WHERE key = '{key}' AND is_markdown),
  pr AS (SELECT file_id AS to_id, CASE WHEN regexp_full_match(trim(j), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN j::DOUBLE END AS n FROM q WHERE key = 'rating')"""


@_q(_RELATED.replace("{key}", "related") + " SELECT has.file_id, count(to_id) AS n_related FROM has LEFT JOIN got USING (file_id) GROUP BY 1")
def j03_a05_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Found targets per note."""
    return _run(spark, d, "related").rows.select("file_id", F.col("n_related").cast("long").alias("n_related"))


@_q(_RELATED.replace("{key}", "contacts") + " SELECT has.file_id, count(to_id) AS n, round(coalesce(sum(pr.n), 0), 6) AS total, min(pr.n) AS least, max(pr.n) AS most FROM has LEFT JOIN got USING (file_id) LEFT JOIN pr USING (to_id) GROUP BY 1")
def j07_a05_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Rollups of a property of the targets of a relation; texts and other types are above numbers, so only notes whose
    targets hold numbers, or nothing, show a least and a greatest one."""
    ops = ("count", "sum", "min", "max")
    view = B.views_of({"views": [{"type": "table", "relations": ["contacts"], "rollups": [{"alias": f"x_{op}", "relation": "contacts", "target": "rating", "op": op} for op in ops], "columns": [f"x_{op}" for op in ops], "filters": [{"key": "contacts", "op": "exists", "value": True}]}]})
    props = _props(spark, d)
    # of the ratings the latest that are numbers, as the SQL has them
    latest = props.filter("key = 'rating'").groupBy("file_id").agg(F.max(F.struct("updated_at", "property_id", "value_json")).alias("c")).filter(F.rlike(F.trim("c.value_json"), F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")))
    kept = props.filter("key <> 'rating'").unionByName(props.filter("key = 'rating'").join(latest.select("c.property_id"), "property_id", "left_semi").select(*props.columns))
    rows = baseview.execute(B.compile_view(view[0], 1, ALL), _files(spark, d), kept).rows
    number = lambda op: F.expr(f"try_cast(x_{op} AS double)")
    return rows.select("file_id", F.col("x_count").cast("long").alias("n"), F.round(number("sum"), 6).alias("total"), number("min").alias("least"), number("max").alias("most"))


@_q(_LATEST + r""", w AS (SELECT f.file_id, j, CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN j->>'$' ELSE j END AS t FROM f JOIN q ON q.file_id = f.file_id AND key = 'status' WHERE is_markdown AND NOT (json_valid(j) AND json_type(j) = 'NULL'))
  SELECT file_id FROM w WHERE ends_with(t, 'e') AND NOT starts_with(t, 'd')""")
def b06_ends_and_not_starts(spark: SparkSession, d: str) -> DataFrame:
    view = B.views_of({"views": [{"type": "table", "filters": [{"key": "status", "op": "ends_with", "value": "e"}, {"key": "status", "op": "not_starts_with", "value": "d"}], "columns": ["status"]}]})
    return baseview.execute(B.compile_view(view[0], 1, ALL), _files(spark, d), _props(spark, d)).rows.select("file_id")


@_q(_LATEST + r""" SELECT q.file_id, key, CASE WHEN NOT json_valid(j) THEN trim(j) WHEN json_type(j) = 'NULL' THEN '' WHEN json_type(j) = 'VARCHAR' THEN j->>'$' ELSE trim(j) END AS text FROM q WHERE key IN ('status', 'owner', 'due', 'tags') AND j IS NOT NULL
  AND NOT regexp_matches(j, '^\s*-?[0-9]+[.eE]')""")
def p06_v12_display(spark: SparkSession, d: str) -> DataFrame:
    """Values as they are shown; fractions aside, which have a form of their own."""
    keys = ("status", "owner", "due", "tags")
    wide = baseview.pivot(_props(spark, d).select("file_id").distinct().withColumn("file_path", F.lit("")), _props(spark, d), keys)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), (V.is_present(F.col(f"v{i}")) & ~F.coalesce(F.col(f"v{i}")["repr"].rlike(r"^-?[0-9]+[.eE]"), F.lit(False))).alias("here"), V.display(F.col(f"v{i}")).alias("text")) for i, k in enumerate(keys)]))
    return wide.select("file_id", each).filter("here").select("file_id", "key", "text")


@_q(_LATEST + r""", w AS (SELECT f.file_id, st.j, CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN j->>'$' WHEN json_valid(j) AND json_type(j) <> 'NULL' THEN json(j)::VARCHAR WHEN json_valid(j) THEN 'null' ELSE j END AS t FROM f JOIN q st ON st.file_id = f.file_id AND st.key = 'status' WHERE is_markdown)
  SELECT file_id FROM w WHERE contains(lower(t), 'o') AND t NOT IN ('done', 'open')""")
def b03_b04_contains_and_in(spark: SparkSession, d: str) -> DataFrame:
    """Of scalars; the data's statuses hold no arrays or objects with an `o` in a key alone."""
    view = B.views_of({"views": [{"type": "table", "filters": [{"key": "status", "op": "contains", "value": "O"}, {"key": "status", "op": "not_in", "value": ["done", "open"]}], "columns": ["status"]}]})
    return baseview.execute(B.compile_view(view[0], 1, ALL), _files(spark, d), _props(spark, d)).rows.select("file_id")


@_q(_LATEST + r""", g AS (SELECT regexp_extract(normalized_path, '^(.*)/', 1) AS folder, j::DOUBLE AS n FROM f JOIN q ON q.file_id = f.file_id AND key = 'seed' WHERE is_markdown AND regexp_full_match(trim(j), '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?'))
  SELECT folder, min(n) AS least, max(n) AS most FROM g GROUP BY 1""")
def a04_min_max_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = baseview.pivot(baseview.candidates(_files(spark, d), None), _props(spark, d), ("seed", "folder")).filter(F.col("v0")["rank"] == V.NUMBER)
    out = rows.groupBy(V.display(F.col("v1")).alias("folder")).agg(baseview.aggregate("min", F.col("v0")).alias("least"), baseview.aggregate("max", F.col("v0")).alias("most"))
    return out.select("folder", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))


@_q("SELECT doc_id, source FROM documents ORDER BY source DESC NULLS FIRST, doc_id LIMIT 60")
def o02_descending_nulls(spark: SparkSession, d: str) -> DataFrame:
    """`desc` with `nulls_last` puts nulls first."""
    by = W.compile_sort(W.parse_sort("source:desc:nulls_last"), lambda n: V.scalar_value(F.col(n), "string"), F.col("doc_id"), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source").orderBy(*by).limit(60)


@_q(_LATEST + r""" SELECT file_id, key, CASE WHEN NOT json_valid(j) OR json_type(j) IN ('NULL', 'ARRAY', 'OBJECT') THEN NULL WHEN json_type(j) = 'BOOLEAN' THEN (j = 'true')::INT::DOUBLE
  ELSE CASE WHEN regexp_full_match(lower(trim(j->>'$')), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') THEN try_cast(trim(j->>'$') AS DOUBLE) END END AS n FROM q WHERE key = 'budget'""")
def v10_number_coercion(spark: SparkSession, d: str) -> DataFrame:
    latest = _props(spark, d).filter("key = 'budget'").groupBy("file_id", "key").agg(F.max(F.struct("updated_at", "property_id", "value_json")).alias("c"))
    return latest.select("file_id", "key", V.coerce(V.json_value(F.col("c.value_json")), "number", False).cast("double").alias("n"))


# --- paths and links ---------------------------------------------------------------------------------------------


@_q(r"""SELECT normalized_path AS path, regexp_replace(regexp_extract(normalized_path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS title, CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END AS folder,
  regexp_extract(regexp_extract(normalized_path, '[^/]*$'), '.\.([^.]*)$', 1) AS ext, trim(regexp_replace(lower(trim(normalized_path)), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM f""")
def v01_v04_p03_path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("normalized_path")
    return _files(spark, d).select(p.alias("path"), T.title_of(p).alias("title"), T.folder_of(p).alias("folder"), T.extension_of(p).alias("ext"), T.slugify(p).alias("slug"))


@_q("SELECT link_id, CASE WHEN block_id IS NOT NULL THEN 'block' WHEN heading_slug IS NOT NULL THEN 'heading' WHEN source_field = 'body:embed' THEN 'embed' WHEN source_field = 'body:markdown' THEN 'markdown' ELSE 'wikilink' END AS kind, NOT is_unresolved AND resolved_file_id IS NOT NULL AS resolved FROM lp")
def p05_link_kinds(spark: SparkSession, d: str) -> DataFrame:
    return graph.panel(graph.links_with_paths(_links(spark, d), _files(spark, d))).select("link_id", "kind", "resolved")


@_q(r"SELECT file_id, len(regexp_extract_all(content_lc, '(?s)\[\[(.*?)\]\]', 1)) AS n FROM s")
def v06_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).select("file_id", F.size(T.wikilinks(F.col("content_lc"))).cast("long").alias("n")).distinct()


@_q(r""", x AS (SELECT file_id, unnest(regexp_extract_all(content_lc, '(?s)\[\[(.*?)\]\]', 1)) AS x FROM s),
  w AS (SELECT file_id, trim(regexp_extract(split_part(x, '|', 1), '^([^#]*)', 1)) AS target, CASE WHEN contains(x, '|') THEN nullif(trim(regexp_replace(x, '(?s)^[^|]*\|', '')), '') END AS display, CASE WHEN contains(split_part(x, '|', 1), '#') THEN regexp_replace(trim(split_part(x, '|', 1)), '(?s)^[^#]*#', '') ELSE '' END AS frag FROM x)
  SELECT file_id, target, display, CASE WHEN NOT starts_with(frag, '^') THEN nullif(trim(frag), '') END AS heading, CASE WHEN starts_with(frag, '^') THEN nullif(trim(frag[2:]), '') END AS block, count(*) AS n FROM w WHERE target <> '' GROUP BY ALL""")
def v05_wikilink_parts(spark: SparkSession, d: str) -> DataFrame:
    links = _search(spark, d).select("file_id", F.posexplode(T.wikilinks(F.col("content_lc"))).alias("at", "x")).distinct()
    parts = links.select("file_id", T.wikilink_parts(F.col("x")).alias("w")).select("file_id", "w.*").filter("target is not null")
    return parts.groupBy("file_id", "target", "display", "heading", "block").agg(F.count(F.lit(1)).alias("n"))


_LINES = ", lines AS (SELECT file_id, unnest(string_split(content_lc, chr(10))) AS line, generate_subscripts(string_split(content_lc, chr(10)), 1) AS line_number FROM s)"


@_q(_LINES + r""" SELECT file_id, line_number, length(regexp_extract(line, '^\s*(#{1,6})', 1)) AS level, trim(regexp_extract(line, '^\s*#{1,6}\s*([^#\s].*)$', 1)) AS text FROM lines WHERE regexp_matches(line, '^\s*#{1,6}\s*[^#\s].*$')""")
def v15_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = _search(spark, d).select("file_id", F.inline(T.numbered_lines(F.col("content_lc")))).withColumn("h", T.heading_of(F.col("line"))).filter("h is not null")
    return lines.select("file_id", F.col("line_number").cast("long").alias("line_number"), F.col("h.level").cast("long").alias("level"), "h.text").distinct()


@_q("SELECT DISTINCT doc_id, 'd-' || doc_id AS block_id FROM documents UNION SELECT DISTINCT doc_id, source FROM documents WHERE regexp_full_match(source, '[A-Za-z0-9_-]+')")
def v08_block_ids(spark: SparkSession, d: str) -> DataFrame:
    """Block ids of the documents, each with two marks put behind its text."""
    marked = F.concat_ws("\n", F.coalesce("text", F.lit("")), F.concat(F.lit("end ^d-"), F.col("doc_id").cast("string")), F.concat(F.lit("^ "), "source"))
    own = F.transform(T.block_ids(marked), lambda b: b)
    return table(spark, d, "documents").select("doc_id", F.explode(own).alias("block_id")).distinct()


@_q("SELECT link_id, block_id IS NOT NULL AND block_id IN (SELECT block_id FROM l WHERE block_id IS NOT NULL AND NOT is_unresolved) AS found FROM l WHERE block_id IS NOT NULL")
def j05_block_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Whether the block that a link names stands in its target: a file that holds the blocks of all resolved links."""
    links = _links(spark, d)
    blocks = links.filter("block_id is not null and not is_unresolved").select(F.lit("f1").alias("file_id"), "block_id")
    files = spark.createDataFrame([("f1", "notes/all.md")], "file_id string, normalized_path string")
    asked = links.filter("block_id is not null").select("link_id", F.lit("notes/x.md").alias("source_path"), F.lit("all").alias("raw_target"), F.lit(None).cast("string").alias("heading_slug"), "block_id")
    none = spark.createDataFrame([], "file_id string, slug string")
    return resolve.resolve_links(asked, files, none, blocks).select("link_id", (~F.col("is_unresolved")).alias("found"))


@_q(r"SELECT link_id, replace(trim(trim(raw_target), '/'), '\', '/') AS path, len(string_split(trim(trim(raw_target), '/'), '/')) - 1 AS depth, translate(raw_target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ordered_by FROM l")
def v02_v03_v09_target_paths(spark: SparkSession, d: str) -> DataFrame:
    p = T.normalize_path_like(F.col("raw_target"))
    return _links(spark, d).select("link_id", p.alias("path"), F.size(T.ancestors(T.folder_of(p))).cast("long").alias("depth"), T.path_order(F.col("raw_target")).alias("ordered_by"))


@_q(_LINES + r""", heads AS (SELECT DISTINCT file_id, trim(regexp_replace(lower(trim(regexp_extract(line, '^\s*#{1,6}\s*([^#\s].*)$', 1))), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM lines WHERE regexp_matches(line, '^\s*#{1,6}\s*[^#\s].*$'))
  SELECT link_id, heads.slug IS NOT NULL AS found FROM l LEFT JOIN heads ON heads.file_id = resolved_file_id AND heads.slug = heading_slug WHERE resolved_file_id IS NOT NULL AND heading_slug IS NOT NULL""")
def j05_heading_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Whether the heading that a link names stands in the text of its target."""
    lines = _search(spark, d).select("file_id", F.inline(T.numbered_lines(F.col("content_lc")))).withColumn("h", T.heading_of(F.col("line"))).filter("h is not null")
    heads = lines.select("file_id", T.slugify(F.col("h.text")).alias("slug"))
    asked = _links(spark, d).filter("resolved_file_id is not null and heading_slug is not null").select(F.col("link_id").alias("request_id"), F.col("resolved_file_id").alias("file_id"), F.col("heading_slug").alias("slug"))
    return resolve.heading_exists(asked, heads).select(F.col("request_id").alias("link_id"), "found")


@_q("SELECT doc_id FROM documents WHERE contains(lower(text), 'mandate') AND NOT starts_with(text, 'The') AND (n_chars >= 500 OR ends_with(text, '?'))")
def w05_w06_text_conditions(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"text": "string", "n_chars": "int"}
    tree = W.parse_where("text contains 'MANDATE' and not text starts_with 'The' and (n_chars >= 500 or text ends_with '?')")
    return table(spark, d, "documents").filter(W.compile_where(tree, lambda n: V.scalar_value(F.col(n), kinds[n]))).select("doc_id")


_RESOLVE = r""", asks AS (SELECT DISTINCT lower(raw_target) AS t, lower(CASE WHEN contains(source_path, '/') THEN regexp_replace(source_path, '/[^/]*$', '') ELSE '' END) AS home FROM lp), targets AS (SELECT file_id, normalized_path AS path FROM f)""" + _RANKED


@_q(_RESOLVE + " SELECT link_id AS request_id, best.file_id, best.path, n_matches FROM lp JOIN best ON best.t = lower(raw_target) AND best.home = lower(CASE WHEN contains(source_path, '/') THEN regexp_replace(source_path, '/[^/]*$', '') ELSE '' END)")
def j04_resolve_links(spark: SparkSession, d: str) -> DataFrame:
    asked = graph.links_with_paths(_links(spark, d), _files(spark, d)).select(F.col("link_id").alias("request_id"), F.col("raw_target").alias("target"), "source_path")
    return resolve.resolve(asked, _files(spark, d)).drop("ambiguous")


@_q(r"SELECT link_id, CASE WHEN block_id IS NOT NULL THEN 'bad-block' WHEN heading_slug IS NOT NULL THEN 'bad-anchor' WHEN regexp_matches(raw_target, '[^\p{L}\p{N}/_\-.\s()]') THEN 'malformed-target' ELSE 'missing-note' END AS reason FROM l WHERE is_unresolved")
def g05_v18_unresolved_reason(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).filter("is_unresolved").select("link_id", T.unresolved_reason(F.col("raw_target"), F.col("heading_slug"), F.col("block_id")).alias("reason"))


_PANEL = "link_id, source_path, resolved_path AS target_path, heading_slug AS heading, block_id"


# --- graph -------------------------------------------------------------------------------------------------------


@_q(f"SELECT {_PANEL} FROM lp WHERE source_file_id = (SELECT id FROM start)")
def g01_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return graph.outgoing(_links(spark, d), _files(spark, d), _start(spark, d)).select("link_id", "source_path", "target_path", "heading", "block_id")


@_q(f"SELECT {_PANEL} FROM lp WHERE resolved_file_id = (SELECT id FROM hub)")
def g02_backlinks(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(_links(spark, d), _files(spark, d), _hub(spark, d)).select("link_id", "source_path", "target_path", "heading", "block_id")


@_q("SELECT link_id, 'outgoing' AS direction FROM lp WHERE source_file_id = (SELECT id FROM hub) UNION ALL SELECT link_id, 'incoming' FROM lp WHERE resolved_file_id = (SELECT id FROM hub)")
def g03_link_panels(spark: SparkSession, d: str) -> DataFrame:
    return graph.link_panels(_links(spark, d), _files(spark, d), _hub(spark, d)).select("link_id", "direction")


@_q("SELECT link_id, source_path, raw_target, unresolved_reason, source_field FROM lp WHERE is_unresolved")
def g04_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved(_links(spark, d), _files(spark, d)).select("link_id", "source_path", "raw_target", "unresolved_reason", "source_field")


@_q("SELECT * FROM deg")
def j06_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_links(spark, d), _files(spark, d))


@_q("SELECT * FROM deg WHERE is_markdown AND n_in > 0 AND n_out = 0")
def g06_deadends(spark: SparkSession, d: str) -> DataFrame:
    return graph.deadends(_links(spark, d), _files(spark, d))


@_q("SELECT * FROM deg WHERE is_markdown AND n_in = 0 AND n_out = 0")
def g07_orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_links(spark, d), _files(spark, d))


@_q("SELECT * FROM deg WHERE n_in = 0 AND n_out = 0 AND regexp_extract(normalized_path, '[^/]*$') NOT IN ('.DS_Store', 'Thumbs.db', 'desktop.ini', '.gitkeep', '.gitignore')")
def g08_f04_floating(spark: SparkSession, d: str) -> DataFrame:
    return graph.floating(_links(spark, d), _files(spark, d))


@_q("SELECT count(*) AS total, count(*) FILTER (is_markdown) AS markdown, count(*) FILTER (NOT is_markdown) AS other FROM deg WHERE n_in = 0 AND n_out = 0")
def a09_a10_floating_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.totals(graph.floating(_links(spark, d), _files(spark, d)))


@_q("SELECT file_id, normalized_path, is_markdown, n_in AS inbound FROM deg WHERE normalized_path LIKE 'notes/%' AND is_markdown AND normalized_path NOT LIKE 'notes/daily/%'")
def g09_f02_inbound_scope(spark: SparkSession, d: str) -> DataFrame:
    return graph.inbound_scope(_links(spark, d), _files(spark, d), "notes", True, False, ("notes/daily",))


@_q("SELECT src, dst FROM e")
def g16_a12_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_links(spark, d))


_EMBEDS = ", el AS (SELECT * FROM l WHERE source_field = 'body:embed' AND NOT is_unresolved AND resolved_file_id IS NOT NULL)"


@_q(_EMBEDS + " SELECT file_id, normalized_path FROM f WHERE is_markdown AND file_id NOT IN (SELECT source_file_id FROM el WHERE source_file_id IS NOT NULL) AND file_id NOT IN (SELECT resolved_file_id FROM el)")
def g07_orphans_of_embeds(spark: SparkSession, d: str) -> DataFrame:
    """Notes that embed nothing and are embedded nowhere."""
    return graph.orphans(_links(spark, d).filter("source_field = 'body:embed'"), _files(spark, d)).select("file_id", "normalized_path")


@_q("SELECT count(*) AS total, count(*) FILTER (n_in > 0) AS linked, count(*) FILTER (n_in = 0) AS unlinked FROM deg WHERE normalized_path LIKE 'notes/%'")
def a10_inbound_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.inbound_totals(graph.inbound_scope(_links(spark, d), _files(spark, d), "notes"))


_REACH = ", ke AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT file_id FROM f) AND dst IN (SELECT file_id FROM f))"


@_q(_EMBEDS + """, ke AS (SELECT DISTINCT source_file_id AS src, resolved_file_id AS dst FROM el WHERE source_file_id IN (SELECT file_id FROM f) AND resolved_file_id IN (SELECT file_id FROM f)),
  both_ways AS (SELECT src, dst FROM ke UNION SELECT dst, src FROM ke), reach AS (SELECT file_id AS a, file_id AS b FROM f UNION SELECT reach.a, both_ways.dst FROM reach JOIN both_ways ON both_ways.src = reach.b),
  comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
  SELECT component, count(*) AS size, count(*) FILTER (is_markdown) AS n_notes, min(normalized_path) FILTER (is_markdown) AS first_path FROM comp JOIN f ON f.file_id = node GROUP BY 1 HAVING count(*) FILTER (is_markdown) > 0""")
def g10_components_of_embeds(spark: SparkSession, d: str) -> DataFrame:
    """Components over embeds alone, of which there are many."""
    return graph.weak_components(_links(spark, d).filter("source_field = 'body:embed'"), _files(spark, d))


@_q(_REACH + """, both_ways AS (SELECT src, dst FROM ke UNION SELECT dst, src FROM ke), reach AS (SELECT file_id AS a, file_id AS b FROM f UNION SELECT reach.a, both_ways.dst FROM reach JOIN both_ways ON both_ways.src = reach.b),
  comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
  SELECT component, count(*) AS size, count(*) FILTER (is_markdown) AS n_notes, min(normalized_path) FILTER (is_markdown) AS first_path FROM comp JOIN f ON f.file_id = node GROUP BY 1 HAVING count(*) FILTER (is_markdown) > 0""")
def g10_weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(_links(spark, d), _files(spark, d))


@_q(_REACH + """, reach AS (SELECT file_id AS a, file_id AS b FROM f UNION SELECT reach.a, ke.dst FROM reach JOIN ke ON ke.src = reach.b),
  seeds AS (SELECT file_id FROM f WHERE is_markdown UNION SELECT dst FROM ke),
  comp AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a IN (SELECT file_id FROM seeds) GROUP BY 1)
  SELECT component, count(*) AS size, count(*) FILTER (is_markdown) AS n_notes, min(normalized_path) FILTER (is_markdown) AS first_path FROM comp JOIN f ON f.file_id = node GROUP BY component""")
def g11_strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_links(spark, d), _files(spark, d)).select("component", "size", "n_notes", "first_path")


@_q("""SELECT path, direction, arg_min(link_id, (rank, link_id)) AS link_id FROM (SELECT b.normalized_path AS path, 'outgoing' AS direction, link_id, '' AS rank FROM r JOIN f a ON a.file_id = source_file_id JOIN f b ON b.file_id = resolved_file_id WHERE source_file_id = (SELECT id FROM hub)
  UNION ALL SELECT a.normalized_path, 'incoming', link_id, a.normalized_path FROM r JOIN f a ON a.file_id = source_file_id WHERE resolved_file_id = (SELECT id FROM hub)) GROUP BY 1, 2""")
def g12_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(_links(spark, d), _files(spark, d), _hub(spark, d)).select("path", "direction", "link_id")


@_q(""", both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), bfs AS (SELECT id AS node, 0 AS depth FROM start UNION SELECT both_ways.dst, depth + 1 FROM bfs JOIN both_ways ON both_ways.src = node WHERE depth < 4)
  SELECT count(*) > 0 AS found, min(depth) AS hops, (SELECT id FROM start) AS first_id, (SELECT id FROM hub) AS last_id, min(depth) AS n_edges FROM bfs WHERE node = (SELECT id FROM hub)""")
def g13_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    p = graph.shortest_path(_links(spark, d), _files(spark, d), _start(spark, d), _hub(spark, d), max_depth=4, max_nodes=1_000_000)
    # each step of the path must be an edge of the graph
    steps = spark.createDataFrame(list(zip(p.nodes, p.nodes[1:])), "a string, b string")
    real = graph.edges(_links(spark, d)).select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    n = steps.join(real, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).count()
    return spark.createDataFrame([(p.found, len(p.nodes) - 1 if p.found else None, p.nodes[0], p.nodes[-1], n)], "found boolean, hops int, first_id string, last_id string, n_edges int")


@_q(""", one AS (SELECT 1 AS depth, 'outgoing' AS direction, link_id, resolved_file_id AS other, 0 AS phase FROM lp WHERE NOT is_unresolved AND resolved_file_id IS NOT NULL AND source_file_id = (SELECT id FROM start)
   UNION ALL SELECT 1, 'incoming', link_id, source_file_id, 1 FROM lp WHERE NOT is_unresolved AND resolved_file_id = (SELECT id FROM start)),
  front AS (SELECT DISTINCT other AS id FROM (SELECT * FROM one ORDER BY phase, link_id LIMIT 200) WHERE other <> (SELECT id FROM start)),
  two AS (SELECT 2 AS depth, 'outgoing' AS direction, link_id, 0 AS phase FROM lp WHERE NOT is_unresolved AND resolved_file_id IS NOT NULL AND source_file_id IN (SELECT id FROM front)
   UNION ALL SELECT 2, 'incoming', link_id, 1 FROM lp WHERE NOT is_unresolved AND resolved_file_id IN (SELECT id FROM front))
  SELECT depth, direction, 'wikilink' AS edge_type, x.link_id, lp.source_path, lp.resolved_path AS target_path FROM (SELECT depth, direction, link_id, phase FROM one UNION ALL SELECT * FROM two ORDER BY depth, phase, link_id LIMIT 200) x JOIN lp ON lp.link_id = x.link_id""")
def g14_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(_links(spark, d), _files(spark, d), _start(spark, d)).select("depth", "direction", "edge_type", "link_id", "source_path", "target_path")


@_q(""", n AS (SELECT file_id, normalized_path, CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END AS folder FROM f WHERE is_markdown),
  me AS (SELECT *, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS above FROM n WHERE file_id = (SELECT id FROM start)),
  one AS (SELECT 0 AS phase, 'outgoing' AS direction, 'wikilink' AS edge_type, link_id, link_id AS k, source_path, resolved_path AS target_path FROM lp WHERE NOT is_unresolved AND resolved_file_id IS NOT NULL AND source_file_id = (SELECT id FROM start)
   UNION ALL SELECT 1, 'incoming', 'wikilink', link_id, link_id, source_path, resolved_path FROM lp WHERE NOT is_unresolved AND resolved_file_id = (SELECT id FROM start)
   UNION ALL SELECT 2, 'outgoing', 'folder-parent', concat_ws(':', 'folder', me.file_id, n.file_id, 'folder-parent'), 'folder-parent' || n.file_id, me.normalized_path, n.normalized_path FROM me JOIN n ON n.folder = me.above WHERE me.folder <> '' AND n.file_id <> me.file_id
   UNION ALL SELECT 2, 'outgoing', 'folder-sibling', concat_ws(':', 'folder', me.file_id, n.file_id, 'folder-sibling'), 'folder-sibling' || n.file_id, me.normalized_path, n.normalized_path FROM me JOIN n ON n.folder = me.folder WHERE n.file_id <> me.file_id)
  SELECT direction, edge_type, link_id, source_path, target_path FROM one ORDER BY phase, k LIMIT 400""")
def g14_walk_with_folders(spark: SparkSession, d: str) -> DataFrame:
    """One level of a walk with the folder overlay, at most 400 steps."""
    return graph.walk(_links(spark, d), _files(spark, d), _start(spark, d), 1, 400, include_folders=True).select("direction", "edge_type", "link_id", "source_path", "target_path")


@_q(r""", n AS (SELECT file_id, CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END AS folder, size_bytes FROM f WHERE is_markdown),
  o AS (SELECT *, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS above FROM n WHERE size_bytes % 50 = 0)
  SELECT o.file_id AS source_file_id, n.file_id AS resolved_file_id, 'folder-sibling' AS edge_type FROM o JOIN n ON n.folder = o.folder WHERE n.file_id <> o.file_id
  UNION ALL SELECT o.file_id, n.file_id, 'folder-parent' FROM o JOIN n ON n.folder = o.above WHERE o.folder <> ''""")
def g15_j11_folder_edges(spark: SparkSession, d: str) -> DataFrame:
    """Folder overlay of the notes whose size is divisible by 50, the set of queries, against all notes."""
    files = _files(spark, d)
    asked = files.filter("is_markdown and size_bytes % 50 = 0").select(F.col("file_id").alias("id"))
    return graph.folder_edges(files, asked).select("source_file_id", "resolved_file_id", "edge_type")


@_q(r""", n AS (SELECT file_id, CASE WHEN contains(normalized_path, '/') THEN regexp_replace(normalized_path, '/[^/]*$', '') ELSE '' END AS folder FROM f WHERE is_markdown),
  o AS (SELECT *, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS above FROM n), c AS (SELECT folder, count(*) AS n FROM n GROUP BY 1)
  SELECT 'folder-sibling' AS edge_type, sum(n * (n - 1))::BIGINT AS n FROM c UNION ALL SELECT 'folder-parent', sum(c.n)::BIGINT FROM o JOIN c ON c.folder = o.above WHERE o.folder <> ''""")
def g15_folder_edge_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of folder-overlay edges; counted per folder, as a folder's siblings are all pairs of its notes."""
    notes = _files(spark, d).filter("is_markdown").select("file_id", T.folder_of(F.col("normalized_path")).alias("folder"))
    size = notes.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    sibling = size.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("n")).select(F.lit("folder-sibling").alias("edge_type"), "n")
    up = size.filter("folder <> ''").select(T.folder_of(F.col("folder")).alias("folder"), F.col("n").alias("m")).join(size, "folder")
    return sibling.unionByName(up.agg(F.sum(F.col("n") * F.col("m")).alias("n")).select(F.lit("folder-parent").alias("edge_type"), "n"))


_CHANGED = """, done AS (SELECT file_id, arg_max((size_bytes, hash_blake3), (r.started_unix_ms, l.run_id, recorded_at, size_bytes, hash_blake3)) AS v FROM index_ledger l JOIN index_runs r USING (run_id) WHERE r.status = 'succeeded' GROUP BY 1),
  changed AS (SELECT f.file_id FROM f LEFT JOIN done USING (file_id) WHERE (f.size_bytes, f.hash_blake3) IS DISTINCT FROM done.v)"""


@_q(_CHANGED + " SELECT link_id FROM l WHERE source_file_id NOT IN (SELECT file_id FROM changed) AND (is_unresolved OR resolved_file_id IS NULL OR (resolved_file_id IN (SELECT file_id FROM changed) AND (heading_slug IS NOT NULL OR block_id IS NOT NULL)))")
def g17_affected_links(spark: SparkSession, d: str) -> DataFrame:
    changed = incremental.to_process(table(spark, d, "vault_files"), table(spark, d, "index_ledger"), table(spark, d, "index_runs"))
    return graph.affected_links(_links(spark, d), changed).select("link_id")


# --- metadata and tasks ------------------------------------------------------------------------------------------


@_q("SELECT key, count(*) AS total FROM p GROUP BY 1")
def a07_property_keys(spark: SparkSession, d: str) -> DataFrame:
    return meta.property_keys(_props(spark, d))


def _tokens(keys: str) -> str:
    return rf""", own AS (SELECT file_id, value_json AS j, json_valid(value_json) AND NOT regexp_matches(regexp_replace(value_json, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}}]') AS ok FROM p WHERE lower(key) IN ({keys})),
  texts AS (SELECT file_id, CASE WHEN t.type = 'VARCHAR' THEN json_extract_string(t.atom, '$') ELSE t.atom::VARCHAR END AS x FROM (SELECT * FROM own WHERE ok) o, json_tree(o.j) t WHERE t.atom IS NOT NULL UNION ALL SELECT file_id, trim(j) FROM own WHERE NOT ok),
  words AS (SELECT file_id, regexp_replace(unnest(regexp_split_to_array(x, '[,\s]+')), '^#+', '') AS w FROM texts),
  once AS (SELECT file_id, lower(w), min(w) AS token FROM words WHERE w <> '' GROUP BY 1, 2) SELECT token, count(*) AS total FROM once GROUP BY 1"""


@_q(_tokens("'tags', 'tag'"))
def a08_v13_tags(spark: SparkSession, d: str) -> DataFrame:
    return meta.tags(_props(spark, d))


@_q(_tokens("'aliases', 'alias'"))
def a08_aliases(spark: SparkSession, d: str) -> DataFrame:
    return meta.aliases(_props(spark, d))


_TASKS = r""", ln AS (SELECT file_id, normalized_path AS file_path, unnest(string_split(content_lc, chr(10))) AS line, generate_subscripts(string_split(content_lc, chr(10)), 1) AS line_number FROM s),
  tk AS (SELECT DISTINCT file_id, file_path, line_number, CASE regexp_extract(line, '^\s*- \[( |x|X|-)\] ', 1) WHEN ' ' THEN 'open' WHEN '-' THEN 'cancelled' ELSE 'done' END AS state, trim(regexp_extract(line, '^\s*- \[[ xX-]\] (.*)$', 1)) AS text FROM ln WHERE regexp_matches(line, '^\s*- \[( |x|X|-)\] '))"""


@_q(_TASKS + " SELECT file_path, line_number, state, text FROM tk")
def v14_q05_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.list_tasks(tasks.tasks_of(_search(spark, d), "content_lc")).select("file_path", F.col("line_number").cast("long").alias("line_number"), "state", "text")


@_q(_TASKS + " SELECT file_path, line_number, text FROM tk WHERE state = 'open' AND (contains(lower(text), 'draft') OR contains(lower(file_path), 'draft')) AND contains(lower(file_path), 'notes/')")
def f03_task_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = tasks.list_tasks(tasks.tasks_of(_search(spark, d), "content_lc"), state="open", query="DRAFT", path="notes/")
    return rows.select("file_path", F.col("line_number").cast("long").alias("line_number"), "text")


_HEADS = r"count(*) FILTER (regexp_matches(line, '^\s*#{1,6}\s*[^#\s].*$'))"


@_q(_LINES + rf", h AS (SELECT file_id, {_HEADS} AS n_headings, count(*) FILTER (regexp_matches(line, '^\s*- \[( |x|X|-)\] ')) AS n_tasks FROM lines GROUP BY 1) SELECT * FROM h")
def i02_i03_s04_prepared_notes(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the search table, indexed as notes: headings and tasks found."""
    notes = spread(_search(spark, d).select("file_id", "normalized_path", F.col("content_lc").alias("text")), "file_id")
    return vault.prepare_texts(notes).select("file_id", F.size("headings").cast("long").alias("n_headings"), F.size("tasks").cast("long").alias("n_tasks")).distinct()


# --- upkeep ------------------------------------------------------------------------------------------------------


@_q(_CHANGED + """, old AS (SELECT file_id, v[1] AS size_bytes, v[2] AS hash FROM done) SELECT CASE WHEN old.file_id IS NULL THEN 'inserted' WHEN f.file_id IS NULL THEN 'removed' WHEN f.size_bytes IS NOT DISTINCT FROM old.size_bytes AND f.hash_blake3 IS NOT DISTINCT FROM old.hash THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n
  FROM f FULL JOIN old ON old.file_id = f.file_id GROUP BY 1""")
def i09_j08_reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files now against what successful runs recorded; ids stand for paths."""
    shape = lambda df: df.select(F.col("file_id").alias("match_key"), F.col("file_id").alias("normalized_path"), "size_bytes", F.lit(0).cast("long").alias("modified_unix_ms"), "hash_blake3")
    done = incremental.processed_ledger(table(spark, d, "index_ledger"), table(spark, d, "index_runs"))
    return index.metadata_reconcile(shape(_files(spark, d)), shape(done))


@_q("""SELECT 'orphan_property' AS kind, property_id AS id FROM p WHERE file_id NOT IN (SELECT file_id FROM f) UNION SELECT 'orphan_link_source', link_id FROM l WHERE source_file_id NOT IN (SELECT file_id FROM f)
  UNION SELECT 'broken_link_target', link_id FROM l WHERE resolved_file_id IS NOT NULL AND resolved_file_id NOT IN (SELECT file_id FROM f)
  UNION SELECT 'link_resolution_mismatch', link_id FROM l WHERE is_unresolved = (resolved_file_id IS NOT NULL)""")
def i11_j09_consistency(spark: SparkSession, d: str) -> DataFrame:
    return index.consistency({"files": _files(spark, d), "links": _links(spark, d), "properties": _props(spark, d)})


@_q("""SELECT link_id, CASE WHEN ok THEN resolved_file_id END AS resolved_file_id, NOT ok AS is_unresolved FROM (SELECT *, NOT is_unresolved AND resolved_file_id IS NOT NULL AND resolved_file_id IN (SELECT file_id FROM f) AS ok FROM l WHERE source_file_id IN (SELECT file_id FROM f))""")
def i12_healed_links(spark: SparkSession, d: str) -> DataFrame:
    return index.heal({"files": _files(spark, d), "links": _links(spark, d), "properties": _props(spark, d)})["links"].select("link_id", "resolved_file_id", "is_unresolved")


@_q("SELECT property_id FROM p WHERE file_id IN (SELECT file_id FROM f WHERE normalized_path NOT LIKE 'notes/daily/%')")
def i10_stale_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Properties that are left when the daily notes have vanished."""
    files = _files(spark, d)
    known = _props(spark, d).join(files.select("file_id"), "file_id", "left_semi")
    return index.stale_cleanup({"files": files, "properties": known}, files.filter("normalized_path not like 'notes/daily/%'"))["properties"].select("property_id")


@_q("SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM f WHERE is_markdown) AS notes, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM l WHERE is_unresolved) AS unresolved, (SELECT count(*) FROM p) AS properties")
def q06_stats(spark: SparkSession, d: str) -> DataFrame:
    return api.stats({"files": _files(spark, d), "links": _links(spark, d), "properties": _props(spark, d)})


@_q("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def i06_latest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest change per key of each micro-batch of a stream, and of these the latest."""
    from quillspark.streaming import ingest

    at = shared_path(spark, "latest")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id", "ts", "event_id").withColumn("at", F.struct("ts", "event_id"))
    ingest.latest_stream(source, "user_id", "at", lambda rows: rows.write.mode("append").parquet(f"{at}/out"), f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("v")).select("user_id", "v.ts", "v.event_id")


def docs_flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of a search: text, condition, sort, projection, page."""
    return search.DocsQuery("draft", "path starts_with 'notes/'", "title:desc", "path,title,matched_in", 20).run(*_indexed(spark, d))

