"""Full-text search over notes, with ranking, conditions, sorting and projection."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import postings
from quillspark.plans import where as W
from quillspark.runtime import broadcast_if_small, cut, spread

COLUMNS = ("file_id", "path", "title", "matched_in")
MAX_PAGE = 1000


class QueryError(ValueError):
    pass


def phrases(query: str) -> list[str]:
    """Phrases of a search text: its words, each with the letters, digits and `_ - . /` that it holds, as they are split
    by the tokenizer. The last word of a phrase is a prefix. A word of separators alone gives an empty phrase."""
    out = []
    for word in query.split():
        kept = "".join(c for c in word if c.isalnum() or c in "_-./").lower()
        if kept:
            folded = "".join(c for c in unicodedata.normalize("NFD", kept) if not unicodedata.combining(c))
            out.append(" ".join(re.findall(r"[^\W_]+", folded)))
    return out


def match(query: str, surfaces: list[Column]) -> Column:
    """Whether every phrase stands in one of the normalised surfaces. No phrase, or an empty one, matches nothing."""
    found = phrases(query)
    if not found or not all(found):
        return F.lit(False)
    out = F.lit(True)
    for p in found:
        hit = F.lit(False)
        for s in surfaces:
            hit = hit | F.contains(s, F.lit(" " + p))
        out = out & hit
    return out


SURFACES = {"fts_path": "normalized_path", "fts_title": "title_lc", "fts_content": "content_lc"}


def with_surfaces(index: DataFrame) -> DataFrame:
    """The index with its normalised surfaces, as a built index keeps them; where they are missing they are made."""
    return index.withColumns({k: T.fts_normalize(F.coalesce(F.col(c), F.lit(""))) for k, c in SURFACES.items() if k not in index.columns})


#: Up to so many notes found in the postings are sent to the scan of the index as a list.
MAX_LISTED = 256
MAX_BROADCAST = 500_000


def found(index: DataFrame, query: str, postings_: DataFrame | None = None) -> DataFrame:
    """Rows of the index that match. With postings only those of the query's words are read, and of the index the row groups
    that may hold a note found; without, the surfaces of all notes are scanned."""
    if postings_ is None:
        return with_surfaces(spread(index, "file_id")).filter(match(query, [F.col(c) for c in SURFACES]))
    ids = cut(postings.matching(postings_, phrases(query)))
    some = [r["file_id"] for r in ids.limit(MAX_LISTED + 1).collect()]
    if len(some) <= MAX_LISTED:
        return index.filter(F.col("file_id").isin(some)) if some else index.limit(0)
    return index.join(broadcast_if_small(ids, MAX_BROADCAST), "file_id", "left_semi")


def search(index: DataFrame, query: str, postings_: DataFrame | None = None) -> DataFrame:
    """Matching notes: file_id, path, title, indexed_at, in_title, in_path, in_content, score, matched_in.

    Nulls count as empty text. Exact repeats of a note count once.
    """
    if not query.strip():
        raise QueryError("query must not be empty")
    needle = query.strip().lower()
    hits = found(index, query, postings_)
    flag = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(needle))
    hits = hits.select(
        "file_id",
        F.col("normalized_path").alias("path"),
        T.title_of(F.col("normalized_path")).alias("title"),
        F.col("updated_at").alias("indexed_at"),
        flag("title_lc").alias("in_title"),
        flag("normalized_path_lc").alias("in_path"),
        flag("content_lc").alias("in_content"),
    ).distinct()  # of the few columns that are left, not of the texts
    one = lambda c, n: F.when(F.col(c), n).otherwise(0)
    places = F.array(*[F.when(F.col(c), c[3:]) for c in ("in_title", "in_path", "in_content")])
    return hits.withColumn("score", one("in_title", 3) + one("in_path", 2) + one("in_content", 1)).withColumn("matched_in", F.filter(places, lambda x: x.isNotNull()))


def ranked(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), F.col("path"), F.col("file_id"))


def parse_select(text: str | None) -> list[str]:
    """Columns of a `select` clause, without repeats; all columns if there is none."""
    if text is None:
        return list(COLUMNS)
    out = list(dict.fromkeys(c.strip() for c in text.split(",") if c.strip()))
    if not out:
        raise QueryError("select names no column")
    for c in out:
        if c not in COLUMNS:
            raise QueryError(f"unknown column '{c}'")
    return out


def check_limit(limit: int, top: int | None = MAX_PAGE) -> int:
    if limit < 1 or top is not None and limit > top:
        raise QueryError(f"limit must be between 1 and {top}")
    return limit


def _value(name: str) -> Column | None:
    """Values that conditions and sorting of notes may use, whether they are selected or not."""
    if name in ("file_id", "path", "title", "indexed_at"):
        return V.scalar_value(F.col(name), "string")
    if name == "matched_in":
        return V.json_value(F.to_json(F.col(name)))
    return None


@dataclass(frozen=True)
class DocsQuery:
    query: str
    where: str | None = None
    sort: str | None = None
    select: str | None = None
    limit: int = 100
    offset: int = 0
    columns: list[str] = field(default_factory=list)

    def run(self, index: DataFrame, postings_: DataFrame | None = None) -> DataFrame:
        """A page of matching notes. Conditions see the whole match set, before offset and limit."""
        columns = parse_select(self.select)
        keys, tree = W.parse_sort(self.sort), W.parse_where(self.where)
        hits = search(index, self.query, postings_)
        if tree is not None:
            hits = hits.filter(W.compile_where(tree, _value))
        hits = hits.orderBy(*W.compile_sort(keys, _value, F.col("path"), F.col("file_id"))) if keys else ranked(hits)
        if self.offset:
            hits = hits.offset(self.offset)
        return hits.limit(max(1, self.limit)).select(*columns)

    def total(self, index: DataFrame, postings_: DataFrame | None = None) -> int:
        tree = W.parse_where(self.where)
        return search(index, self.query, postings_).filter(W.compile_where(tree, _value)).count()


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """A page with the number of all rows in each of its rows; counted apart, so that no task sees every row."""
    return page.withColumn("total", F.lit(rows.count()))


def total_over(rows: DataFrame, limit: int, offset: int) -> int:
    """Total as the page reports it: 0 where the offset lies beyond the end, as the count comes with the rows."""
    n = rows.count()
    return n if offset < n else 0


def property_query(properties: DataFrame, files: DataFrame, key: str, value_contains: str | None = None, sort: str = "path", desc: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Properties of a key with the paths of their files: by a case-insensitive part of their JSON text, sorted by path,
    updated_at or raw JSON text."""
    if not key.strip():
        raise QueryError("key must not be empty")
    if limit is not None:
        check_limit(limit, None)
    rows = properties.filter(F.col("key") == key.strip())
    if value_contains:
        rows = rows.filter(F.contains(F.lower("value_json"), F.lit(value_contains.lower())))
    rows = rows.join(files.select("file_id", F.col("normalized_path").alias("path")), "file_id").select("property_id", "file_id", "path", "key", "value_type", "value_json", "updated_at")
    by = F.col({"path": "path", "updated_at": "updated_at", "value": "value_json"}[sort])
    rows = rows.orderBy(by.desc() if desc else by.asc(), "path", "property_id")
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit is not None else rows


__all__ = ["DocsQuery", "match", "phrases", "property_query", "ranked", "search", "total_over", "with_total"]
