"""Queries p1 and p6 to p9 over the test tables, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import leakage, markup, mixing, neardup, residue
from quillspark.runtime import table


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_search").select(F.col("file_id").alias("id"), F.col("content_lc").alias("content"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_notes(table(spark, d, "vault_search"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(p1_clean(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_notes(spark, d), neardup.NOTES).select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Classes of notes, with the number of different content hashes of their files."""
    groups = neardup.near_duplicate_groups(_notes(spark, d), neardup.NOTES).withColumnRenamed("id", "file_id")
    files = table(spark, d, "vault_files").groupBy("file_id").agg(F.max_by("hash_blake3", F.struct("indexed_at", "hash_blake3")).alias("hash_blake3"))
    named = groups.join(files, "file_id", "left")
    kinds = named.groupBy("group_id", "hash_blake3").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(F.count("hash_blake3").alias("n_hashes"), F.sum("n").alias("n_notes"))
    return named.join(kinds, "group_id").select("file_id", "group_id", "n_links", "n_copies", "n_hashes", "n_notes")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).filter("kind = 'run'").select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    sized = mixing.sized_documents(table(spark, d, "documents"), targets, size=size)
    plan = mixing.budgets(sized, targets)
    return mixing.mixture(sized, plan), plan


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p8_shares_in_characters(spark: SparkSession, d: str) -> DataFrame:
    """The mixture made by characters instead of tokens, which SQL can count: what each source gives and whether it reaches
    its share."""
    return mixing.shares(*_mix(spark, d, F.length("text"))).select("source", "n_docs", "size", "most_copies", "reached", (F.col("mixed_size") > F.col("max_repeats") * F.col("size")).alias("over_cap"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that stay below their share in the mixture that was made: it fills every budget that can be filled."""
    return p8_shares(spark, d).filter("not reached").select("source")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_documents(spark, d).select("doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left."""
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "n_chars").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p6_found, p6_groups, p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p8_shares_in_characters, p9_found, p9_documents, p9_clean)}
SQL = {
    "p6_found": r"""WITH n AS (SELECT DISTINCT file_id, regexp_extract_all(content_lc, '[\p{L}\p{N}]+') AS w FROM vault_search WHERE content_lc IS NOT NULL),
        g AS (SELECT DISTINCT file_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM n WHERE len(w) >= 30),
        c AS (SELECT file_id, count(*) AS k FROM g GROUP BY 1),
        m AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.x = b.x AND a.file_id < b.file_id GROUP BY 1, 2)
        SELECT a AS file_id_a, b AS file_id_b FROM m JOIN c ca ON ca.file_id = a JOIN c cb ON cb.file_id = b WHERE both_ >= 0.6 * (ca.k + cb.k - both_)""",
    "p8_shares_in_characters": """WITH s AS (SELECT source, count(*) AS n_docs, sum(n) AS size FROM (SELECT doc_id, source, max(coalesce(length(text), 0)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT DISTINCT m.source, coalesce(target_weight, 0) AS w, coalesce(max_repeats, 0) AS cap, coalesce(n_docs, 0) AS n_docs, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN s ON s.source = m.source),
        b AS (SELECT *, w * (SELECT sum(size) FROM t) AS want FROM t)
        SELECT source, n_docs, CAST(size AS BIGINT) AS size, CAST(CASE WHEN size = 0 THEN 0 ELSE least(cap, ceil(want / size)) END AS INT) AS most_copies, cap * size >= want AS reached, false AS over_cap FROM b""",
    # sizes in characters: whether a source reaches its share does not depend on the unit here
    "p8_found": """WITH s AS (SELECT source, sum(n) AS size FROM (SELECT DISTINCT doc_id, source, length(text) AS n FROM documents) GROUP BY 1),
        t AS (SELECT DISTINCT m.source, target_weight, max_repeats, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN s ON s.source = m.source)
        SELECT source FROM t WHERE max_repeats * size < target_weight * (SELECT sum(size) FROM t)""",
}
