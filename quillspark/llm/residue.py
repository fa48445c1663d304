"""Template residue, filler, error messages and script notices in documents.

Documents are cut into segments in a masked normal form. Segments and the trusted examples of residue get a SimHash; those
that share blocks of it within the Hamming distance, or one of the word sequences of which two segments of the least
similarity share at least one, are compared by text. The links found make components, and a component that holds a
trusted example is residue. A document is residue if one of its segments is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.llm.neardup import WordHash
from quillspark.llm.segments import SEEDS, segments, sentences
from quillspark.runtime import broadcast_if_small, cut, cut_table, spread


@dataclass(frozen=True)
class Residue:
    """words, similarity: word sequences and their least Jaccard similarity; hamming: most bits that may differ, of 64 in
    `blocks` blocks; a table for each two blocks, so with hamming <= blocks - 2 some table holds both texts of a pair
    and none is lost. Texts at the least similarity differ in more bits; sequence_keys leads to these."""

    words: int = 5
    similarity: float = 0.8
    hamming: int = 3
    blocks: int = 5


MAX_BROADCAST = 500_000


def simhashes(texts: list[list[str]], cache: WordHash | None = None) -> np.ndarray:
    """64-bit SimHash over words and pairs of words of each text, as signed numbers."""
    cache = WordHash() if cache is None else cache
    out = np.zeros(len(texts), np.int64)
    step = 4096
    for at in range(0, len(texts), step):
        part = [w or [""] for w in texts[at : at + step]]
        n = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.cumsum(n) - n
        h = np.fromiter((cache[x] for w in part for x in w), np.uint64, int(n.sum()))
        with np.errstate(over="ignore"):
            pair = (h * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -1)) * np.uint64(0xC4CEB9FE1A85EC53)
        bits = [np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1) for x in (h, pair ^ (pair >> np.uint64(29)))]
        bits[1][starts + n - 1] = 0  # the last word of a text has no pair
        ones = sum(np.add.reduceat(b, starts, axis=0, dtype=np.int32) for b in bits)
        out[at : at + step] = np.packbits(2 * ones > (2 * n - 1)[:, None], axis=1).copy().view(np.int64).ravel()
    return out


def sequence_keys(texts: list[list[str]], p: Residue, cache: WordHash | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of different word sequences of each text, ends of its keys, keys). Of m sequences the keys are the
    m - ceil(similarity * m) + 1 of least hash: two texts that have `similarity` of their sequences in common share a key."""
    cache = WordHash() if cache is None else cache
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.fromiter((cache[x] for w in texts for x in w), np.uint64, int(n.sum()))
    size, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if len(h) < p.words:
        return size, count, np.empty(0, np.int64)
    mult = np.random.default_rng(9).integers(1, 2**63, p.words, np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        g = (np.lib.stride_tricks.sliding_window_view(h, p.words) * mult).sum(1)
    owner = np.repeat(np.arange(len(texts)), n)
    inside = owner[: len(g)] == owner[p.words - 1 :]
    g, owner = g[inside], owner[: len(g)][inside]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[first], owner[first]
    size = np.bincount(owner, minlength=len(texts))
    count = np.where(size > 0, size - np.ceil(p.similarity * size - 1e-9).astype(np.int64) + 1, 0)
    rank = np.arange(len(g)) - (np.cumsum(size) - size)[owner]
    return size, np.cumsum(count), g[rank < count[owner]].view(np.int64)


_COLUMNS = ["h", "seg", "sim", "m", "keys"]
_SCHEMA = "h long, seg string, sim long, m long, keys array<long>"


def _hashed(segs: list[str], p: Residue, cache: WordHash, salt: str = "") -> list[pa.Array]:
    """Columns of segments: h (hash of the normal form), seg, sim (SimHash), m and keys (sequence_keys)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(salt + x) for x in segs), np.uint64, len(segs)).view(np.int64)
    split = [x.split() for x in segs]
    m, ends, keys = sequence_keys(split, p, cache)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys))
    return [pa.array(h), pa.array(segs, pa.string()), pa.array(simhashes(split, cache)), pa.array(m), lists]


def parse(docs: DataFrame, p: Residue = Residue(), seeds: dict[str, str] | None = None) -> DataFrame:
    """A row per segment that may be near to residue: doc_id, h, seg, sim, m, keys. Segments of fewer than `words` words
    have no sequence and are near only to what equals them, so of these only the trusted ones are kept."""
    known = frozenset(SEEDS if seeds is None else seeds)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in it:
            ids, segs = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = dict.fromkeys(x for s in dict.fromkeys(sentences(t)) for x in segments(s))
                keep = [x for x in found if x.count(" ") >= p.words - 1 or x in known]
                segs += keep
                ids += [d] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_hashed(segs, p, cache)], ["doc_id", *_COLUMNS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + _SCHEMA)


def trusted(spark: SparkSession, p: Residue = Residue(), seeds: dict[str, str] | None = None) -> DataFrame:
    """The trusted examples as segments, with their kind. Their h differs from that of the same text in a document, so the
    two are linked like any others."""
    seeds = SEEDS if seeds is None else seeds
    cols = _hashed(list(seeds), p, WordHash(), "trusted:")
    return spark.createDataFrame(list(zip(*[c.to_pylist() for c in cols], seeds.values())), _SCHEMA + ", kind string")


def alike(a: str, b: str, p: Residue) -> bool:
    wa, wb = a.split(), b.split()
    if min(len(wa), len(wb)) < p.words:
        return wa == wb
    sa, sb = (set(zip(*[w[i:] for i in range(p.words)])) for w in (wa, wb))
    common = len(sa & sb)
    return common >= p.similarity * (len(sa) + len(sb) - common)


def tables(df: DataFrame, p: Residue) -> DataFrame:
    """A row per table: two blocks of the SimHash and the number of the table as one key."""
    cuts = [64 * i // p.blocks for i in range(p.blocks + 1)]
    block = [F.shiftrightunsigned("sim", a).bitwiseAND(F.lit((1 << z - a) - 1)) for a, z in zip(cuts, cuts[1:])]
    keys = [F.xxhash64(F.lit(i * p.blocks + j), block[i], block[j]) for i in range(p.blocks) for j in range(i)]
    return df.withColumn("key", F.explode(F.array(*keys)))


def _near(segs: DataFrame, front: DataFrame, p: Residue) -> DataFrame:
    """h, known_h: pairs of a segment and one of the front that are alike by text. The front is residue, so it is small beside
    the segments, which are read where they lie; where it is not, both sides are shuffled by key."""
    f = broadcast_if_small(tables(front, p).select("key", F.col("h").alias("known_h"), F.col("sim").alias("known_sim")), MAX_BROADCAST)
    by_hash = tables(segs.select("h", "sim"), p).join(f, "key").filter(F.bit_count(F.col("sim").bitwiseXOR(F.col("known_sim"))) <= p.hamming)
    k = broadcast_if_small(front.select(F.explode("keys").alias("key"), F.col("h").alias("known_h"), F.col("m").alias("known_m")), MAX_BROADCAST)
    # texts whose numbers of sequences differ by more than the similarity cannot reach it
    sized = F.least("m", "known_m") >= p.similarity * F.greatest("m", "known_m") - 1e-9
    by_keys = segs.select("h", "m", F.explode("keys").alias("key")).join(k, "key").filter(sized)
    pairs = cut(by_hash.select("h", "known_h").unionByName(by_keys.select("h", "known_h")).filter("h <> known_h").distinct())
    wanted = broadcast_if_small(pairs.select("h").distinct(), MAX_BROADCAST)
    texts = segs.select("h", "seg").join(wanted, "h", "left_semi").distinct()
    both = pairs.join(texts, "h").join(front.select(F.col("h").alias("known_h"), F.col("seg").alias("known")), "known_h")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = [alike(x, y, p) for x, y in zip(b.column("known").to_pylist(), b.column("seg").to_pylist())]
            yield b.select(["h", "known_h"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "h long, known_h long")


def residue_segments(docs: DataFrame, p: Residue = Residue(), seeds: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, seg, ...) of all segments, and (h, kind, component) of those that are residue.

    Links are sought from the trusted side outwards, round by round, until no segment is new: components without a trusted
    example are of no interest, and prose of one pattern would make very large ones. Each round reads hashes of all
    segments and finds every pair of the least similarity. A component with examples of several kinds has the least.
    """
    if p.hamming > p.blocks - 2:
        raise ValueError("more bits may differ than the tables can find")
    spark = docs.sparkSession
    docs = spread(docs.filter("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    segs = cut_table(parse(docs, p, seeds))
    known = cut(trusted(spark, p, seeds))
    front, links, seen = known.drop("kind"), None, []
    while front.head(1):
        found = cut(_near(segs, front, p))
        links = found if links is None else links.unionByName(found)
        new = found.select("h").distinct()
        for before in seen:
            new = new.join(before, "h", "left_anti")
        front = cut(segs.join(broadcast_if_small(new, MAX_BROADCAST), "h", "left_semi").select(*_COLUMNS).dropDuplicates(["h"]))
        seen.append(front.select("h"))
    if links is None:
        return segs, spark.createDataFrame([], "h long, kind string, component long")
    parts = connected_components(links.select(F.col("h").alias("u"), F.col("known_h").alias("v")))
    labels = parts.join(known.select(F.col("h").alias("node"), "kind"), "node").groupBy("component").agg(F.min("kind").alias("kind"))
    labelled = parts.join(labels, "component").select(F.col("node").alias("h"), "kind", "component")
    return segs, cut(labelled.join(known.select("h"), "h", "left_anti"))


def residue_documents(docs: DataFrame, p: Residue = Residue(), seeds: dict[str, str] | None = None) -> DataFrame:
    """doc_id, kinds (comma-separated), n_segments: documents that hold residue.

    docs has doc_id, text; seeds are normal forms of trusted examples with their kinds, by default those of the package.
    Repeated rows count once; null and empty texts hold none.
    """
    segs, labelled = residue_segments(docs, p, seeds)
    hits = segs.select("doc_id", "h").join(broadcast_if_small(labelled.select("h", "kind"), MAX_BROADCAST), "h").distinct()
    per_kind = hits.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per_kind.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.sum("n").alias("n_segments"))


def without_residue(docs: DataFrame, p: Residue = Residue()) -> DataFrame:
    """The documents without those that hold residue."""
    return docs.join(residue_documents(docs, p).select("doc_id"), "doc_id", "left_anti")
