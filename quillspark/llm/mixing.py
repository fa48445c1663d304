"""Mixing sources to target weights by size in tokens.

Documents get hash-random keys; within each source they are sorted by key in
ranges, token counts are summed by range and prefixed, and each source is cut at
its budget. Sources that are too small are repeated up to their cap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import broadcast_if_small, cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of a rank file (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SMALL_SOURCES = 100_000  # up to so many sources a table of them is broadcast
ROWS_PER_RANGE = 50_000
_encoders: dict[str, object] = {}


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file; read once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, one row per stored row. A null text has 0 tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in it:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")


def target_rows(targets: DataFrame) -> DataFrame:
    """source, target_weight, max_repeats of each listed source. Null weights and caps, and caps below zero, count as 0; two
    different rows of a source raise ValueError. Stays a table, whatever the number of sources."""
    weight, cap = F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0))
    rows = targets.filter("source is not null").select("source", weight.alias("target_weight"), F.greatest(cap, F.lit(0)).alias("max_repeats")).distinct()
    twice = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two targets for {twice[0]['source']!r}")
    return rows


def sized_documents(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 11, size: Column | None = None) -> DataFrame:
    """Documents of the listed sources with tokens and key; repeated rows of a document count once, with the greater size.
    size: another measure than tokens, of the columns of docs. Written to the shared folder, as the texts are tokenized
    once only."""
    listed = broadcast_if_small(target_rows(targets).select("source"), SMALL_SOURCES)
    mine = docs.filter("doc_id is not null and source is not null").join(listed, "source", "left_semi")
    if size is None:
        sized = token_sizes(spread(mine.select("doc_id", "source", "text"), "doc_id"), tokenizer)
    else:
        sized = mine.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(size, F.lit(0)).cast("long").alias("tokens"))
    sized = sized.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))
    return cut(sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source")))


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """What each listed source shall give: source, target_weight, max_repeats, n_docs, size, target_size, budget, epochs
    (whole passes), rest (tokens of the last, partial pass).

    total is the size of the mixture, by default the size of all listed documents taken once. A source that can't reach
    weight * total gives all its documents max_repeats times.
    """
    size = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("size"))
    have = cut(target_rows(targets).join(size, "source", "left").fillna(0, ["n_docs", "size"]))  # a row per source
    if total is None:
        total = have.agg(F.sum("size")).first()[0] or 0
    have = have.withColumn("target_size", F.col("target_weight") * F.lit(total).cast("long"))
    have = have.withColumn("budget", F.least(F.ceil("target_size"), F.col("max_repeats") * F.col("size")).cast("long"))
    have = have.withColumn("epochs", F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(0).cast("int"))
    return have.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def mixture(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, source, tokens, copies: documents with the number of times they are taken (at least once).

    The last pass takes the documents in order of key until their sum fills the rest of the budget, so a source that can
    reach its share has it, and exceeds it by less than one document. Prefix sums are taken in ranges of the hash key:
    range sums first, then within each range, so no task holds a source.
    """
    rows = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    ranges = 1
    while ranges * ROWS_PER_RANGE < rows:
        ranges *= 2
    # the key is uniform, so its upper bits cut each source into ranges of about equal size
    part = F.shiftright(F.col("key"), 64 - (ranges - 1).bit_length()).cast("int") if ranges > 1 else F.lit(0)
    docs = sized.join(broadcast_if_small(plan.select("source", "epochs", "rest"), SMALL_SOURCES), "source").withColumn("part", part)
    sums = docs.groupBy("source", "part").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s")).drop("s")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("upto", F.sum("tokens").over(inside)).join(before, ["source", "part"])
    extra = F.col("before") + F.col("upto") - F.col("tokens") < F.col("rest")
    docs = docs.withColumn("copies", (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("int"))
    return docs.filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per listed source: size wanted and reached, share wanted and reached, and reached: whether the mixture holds at
    least the size wanted."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_size"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copies").alias("most_copies"))
    out = cut(plan.join(got, "source", "left").fillna(0, ["mixed_size", "mixed_docs", "most_copies"]))  # a row per source
    all_ = out.agg(F.sum("mixed_size")).first()[0] or 0
    share = F.col("mixed_size") / F.lit(float(all_)) if all_ else F.lit(0.0)
    return out.withColumn("actual_share", share).withColumn("reached", F.col("mixed_size") >= F.col("target_size")).drop("epochs", "rest")
