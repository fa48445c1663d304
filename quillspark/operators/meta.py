"""Aggregates over the properties of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import values as V


def property_keys(properties: DataFrame) -> DataFrame:
    """Keys with the number of their properties, in order of key."""
    return properties.groupBy("key").agg(F.count(F.lit(1)).alias("total")).orderBy("key")


def tokens(properties: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tokens of the properties with one of the keys, once per note with case ignored: file_id, token.

    Strings and arrays at any depth are split at commas and blanks, leading `#` are stripped. Of several spellings in a
    note the least is kept.
    """
    v = V.json_value(F.col("value_json"))
    rows = properties.filter(F.lower("key").isin(*keys)).select("file_id", F.explode(V.scalar_texts(v)).alias("text"))
    rows = rows.select("file_id", F.explode(F.split("text", r"[,\s]+")).alias("token")).select("file_id", F.regexp_replace("token", "^#+", "").alias("token")).filter("token <> ''")
    return rows.groupBy("file_id", F.lower("token").alias("low")).agg(F.min("token").alias("token")).select("file_id", "token")


def token_totals(properties: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tokens with the number of notes that have them, most frequent first."""
    return tokens(properties, keys).groupBy("token").agg(F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "token")


def tags(properties: DataFrame) -> DataFrame:
    return token_totals(properties, ("tags", "tag"))


def aliases(properties: DataFrame) -> DataFrame:
    return token_totals(properties, ("aliases", "alias"))


def properties_with_paths(properties: DataFrame, files: DataFrame, file_id: str | None = None, key: str | None = None) -> DataFrame:
    """Properties with the paths of their files; of a file in order of key, of a key in order of path."""
    rows = properties
    if file_id is not None:
        rows = rows.filter(F.col("file_id") == file_id)
    if key is not None:
        rows = rows.filter(F.col("key") == key)
    rows = rows.join(files.select("file_id", F.col("normalized_path").alias("path")), "file_id").select("property_id", "file_id", "path", "key", "value_type", "value_json", "updated_at")
    return rows.orderBy("path", "property_id") if key is not None else rows.orderBy("path", "key", "property_id")


def digest(*tables: DataFrame) -> str:
    """A digest that changes with any row of the tables, whatever their order; repeats count."""
    parts = []
    for t in tables:
        h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(t.columns)])
        parts.append(tuple(t.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()))
    return ":".join(",".join(map(str, p)) for p in parts)
