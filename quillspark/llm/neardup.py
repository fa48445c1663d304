"""Near-duplicate texts: MinHash with banding, verification, and components.

Texts are represented by their 64-bit hash until verification, exact copies as
one text. Signatures are minima of universal (multiply-add-shift) hashes over the
distinct word sequences; texts that agree in a band are candidates; candidates
are verified on the texts themselves, so a hash never decides a link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.runtime import broadcast_if_small, cut, cut_table, spread

WORD = re.compile(r"[^\W_]+")
_CHUNK = 1 << 18
KEY_BYTES = 5
SIGMA = 3.7
FILTER_BITS = 24
LOAD_SLOTS = 1 << 16
SHARD_ROWS = 1_000_000
COPIES_PER_SHARD = 2_000
MAX_BROADCAST = 500_000


@dataclass(frozen=True)
class NearDup:
    """words: words in a sequence; threshold: least Jaccard similarity; min_words: shorter texts have no links.

    With rows = 4 and bands = 56, a pair at similarity 0.6 is missed with probability 4e-4, at 0.7 with 2e-7, at 0.8 with
    1e-13. Texts of one language share some sequences: of pairs at similarity 0.04 one in 7,000 agrees in a band, where
    three rows would let one in 350 through, and their number grows with the square of the corpus. Larger corpora take
    more rows, about ln(texts) / ln(1 / background similarity), and -ln(miss) / threshold ** rows bands."""

    words: int = 5
    threshold: float = 0.8
    min_words: int = 5
    bands: int = 56
    rows: int = 4
    seed: int = 1


NOTES = NearDup(words=3, threshold=0.6, min_words=30)


class WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(texts: list[str | None], p: NearDup, cache: WordHash | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that are long enough, and their minima (texts x hashes, uint32)."""
    cache = WordHash() if cache is None else cache
    keep, counts, hashes = [], [], []
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t)
            if len(w) >= max(p.min_words, p.words):
                keep.append(i)
                counts.append(len(w) - p.words + 1)
                hashes.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
    rng = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    out = np.empty((len(keep), n), np.uint32)
    mul = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, np.uint64)
    weights = rng.integers(0, 2**63, p.words, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = np.uint64(32)

    def minima(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sig = np.empty((len(starts), n), np.uint32)
        for k in range(n):
            sig[:, k] = np.minimum.reduceat(((x * mul[k] + add[k]) >> shift).astype(np.uint32), starts)
        return sig

    with np.errstate(over="ignore"):
        at = 0
        while at < len(keep):
            # as many texts as fit into a chunk; a text longer than a chunk is folded piece by piece
            end, size = at + 1, counts[at]
            while end < len(keep) and size + counts[end] <= _CHUNK:
                size += counts[end]
                end += 1
            shingles = []
            for h, c in zip(hashes[at:end], counts[at:end]):
                s = h[:c] * weights[0]
                for j in range(1, p.words):
                    s = s + h[j : j + c] * weights[j]
                shingles.append(s)
            x = _mix(np.concatenate(shingles))
            if end == at + 1 and size > _CHUNK:
                out[at] = np.minimum.reduce([minima(x[i : i + _CHUNK], np.array([0]))[0] for i in range(0, size, _CHUNK)])
            else:
                out[at:end] = minima(x, np.cumsum([0, *counts[at : end - 1]]))
            at = end
    return np.array(keep, np.int64), out


def pack(sig: np.ndarray, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the bands as KEY_BYTES each, and two bits of each minimum as planes of 64-bit words."""
    n = len(sig)
    key = np.zeros((n, p.bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(p.rows):
            key = _mix(key * np.uint64(31) + sig[:, r :: p.rows][:, : p.bands] + np.uint64(1))
    bands = np.ascontiguousarray(key).view(np.uint8).reshape(n, p.bands, 8)[:, :, :KEY_BYTES].reshape(n, -1)
    width = -(-sig.shape[1] // 64) * 64
    planes = np.zeros((n, 2, width), np.uint8)
    planes[:, 0, : sig.shape[1]] = sig & 1
    planes[:, 1, : sig.shape[1]] = sig >> 1 & 1
    return bands, np.packbits(planes.reshape(n, -1), axis=1).reshape(n, 2, width // 64, 8).copy().view(np.int64)[:, :, :, 0]


def similarity(a: str, b: str, p: NearDup) -> float:
    """Jaccard similarity of the distinct word sequences; -1 if a text is too short to have links."""
    wa = WORD.findall(a)
    if len(wa) < max(p.min_words, p.words):
        return -1.0
    if a == b:
        return 1.0
    wb = WORD.findall(b)
    if len(wb) < max(p.min_words, p.words):
        return -1.0
    sa, sb = (set(zip(*[w[i:] for i in range(p.words)])) for w in (wa, wb))
    common = len(sa & sb)
    return common / (len(sa) + len(sb) - common)


def _words_of(p: NearDup) -> int:
    return -(-p.bands * p.rows // 64)


def _signed(rows: DataFrame, p: NearDup) -> DataFrame:
    """t, h, bands, and the sketch s0, s1, ... of each long enough text; copies of a text give one row."""
    names = [f"s{i}" for i in range(2 * _words_of(p))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in it:
            t, h = b.column("t").to_numpy(), b.column("h").to_numpy()
            first = np.sort(np.unique(np.stack((t, h)), axis=1, return_index=True)[1])  # copies within a batch
            keep, sig = signatures(b.column("content").take(pa.array(first)).to_pylist(), p, cache)
            if len(keep):
                bands, sketch = pack(sig, p)
                keep = first[keep]
                cols = [pa.array(t[keep]), pa.array(h[keep]), pa.array([x.tobytes() for x in bands], pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in sketch.reshape(len(keep), -1).T]]
                yield pa.RecordBatch.from_arrays(cols, ["t", "h", "bands", *names])

    return rows.mapInArrow(run, "t long, h long, bands binary, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["t", "h"])


def _sharded(rows: DataFrame, key: str, spread_by: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join with a shard. Rows are counted by LOAD_SLOTS hashes of the key, which combines on the map side;
    in a slot of more than SHARD_ROWS the left rows are cut into shards, and the right rows go to all of them. Any key may be
    cut without changing the result, so a key that holds a third of the rows is many tasks' work."""
    slot = F.pmod(key, F.lit(LOAD_SLOTS)).cast("int").alias("slot")
    loads = rows.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_ROWS)
    heavy = cut(loads.select("slot", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards")))
    if not heavy.head(1):
        plain = rows.withColumn("shard", F.lit(0))
        return plain, plain
    both = rows.withColumn("slot", slot).join(F.broadcast(heavy), "slot", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).drop("slot")  # at most LOAD_SLOTS rows
    left = both.withColumn("shard", F.pmod(F.xxhash64(F.lit(23), spread_by), "shards").cast("int")).drop("shards")
    return left, both.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")


def _candidates(signed: DataFrame, p: NearDup) -> DataFrame:
    """ta, ha, tb, hb: pairs of texts that agree in a band and whose signatures do not rule the threshold out.

    Two bits of each minimum agree with probability s + (1 - s) / 4 at similarity s; pairs more than SIGMA standard
    deviations below what the threshold gives are dropped, which loses 1 in 10,000 of those exactly at the threshold.
    """
    n = p.bands * p.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * KEY_BYTES + 1, F.lit(KEY_BYTES))))
    banded = signed.select("t", F.explode(keys).alias("band_key"))
    left, right = _sharded(banded, "band_key", F.col("t"))
    same = (F.col("l.band_key") == F.col("r.band_key")) & (F.col("l.shard") == F.col("r.shard")) & (F.col("l.t") < F.col("r.t"))
    pairs = left.alias("l").join(right.alias("r"), same).select(F.col("l.t").alias("ta"), F.col("r.t").alias("tb")).distinct()
    w = _words_of(p)
    sketch = [f"s{i}" for i in range(2 * w)]
    side = lambda x: signed.select(F.col("t").alias(f"t{x}"), F.col("h").alias(f"h{x}"), *[F.col(c).alias(f"{x}{c}") for c in sketch])
    both = pairs.join(side("a"), "ta").join(side("b"), "tb")
    differ = sum((F.bit_count((F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))).bitwiseOR(F.col(f"as{w + i}").bitwiseXOR(F.col(f"bs{w + i}")))) for i in range(w)), F.lit(0))
    agree = p.threshold + (1 - p.threshold) / 4
    least = n * agree - SIGMA * (n * agree * (1 - agree)) ** 0.5
    return both.filter(F.lit(n) - differ >= F.lit(least)).select("ta", "ha", "tb", "hb")


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts that may be among ids (t): a filter of 2 ** FILTER_BITS bits, so what is broadcast has a fixed bound."""
    word, bit = F.pmod(F.shiftright("t", 6), F.lit(1 << (FILTER_BITS - 6))).alias("w"), F.expr("shiftleft(1L, CAST(t & 63 AS INT))")
    masks = ids.select(word, bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("mask"))  # at most 2 ** (FILTER_BITS - 6) rows
    return texts.withColumn("w", F.pmod(F.shiftright("t", 6), F.lit(1 << (FILTER_BITS - 6)))).join(F.broadcast(masks), "w").filter(F.col("mask").bitwiseAND(bit) != 0).drop("w", "mask")


def _verified(pairs: DataFrame, p: NearDup) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sims = [similarity(x, y, p) for x, y in zip(b.column("content_a").to_pylist(), b.column("content_b").to_pylist())]
            ok = np.array([s >= p.threshold for s in sims], bool)
            cols = [b.column(c).filter(pa.array(ok)) for c in ("ta", "ha", "tb", "hb")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(sims)[ok], pa.float64())], ["ta", "ha", "tb", "hb", "similarity"])

    return pairs.mapInArrow(run, "ta long, ha long, tb long, hb long, similarity double")


def members(docs: DataFrame) -> DataFrame:
    """id, t, h: the text of each document as two independent hashes; documents without text have none."""
    return docs.filter("content is not null and id is not null").select("id", F.xxhash64("content").alias("t"), F.xxhash64(F.lit("h"), "content").alias("h")).distinct()


def text_links(docs: DataFrame, p: NearDup, copies: bool) -> DataFrame:
    """Links between different texts, and with copies=True of each text with itself that several documents have:
    ta, ha, tb, hb, similarity, with ta <= tb.

    docs has columns id, content. Signatures are made where the texts are read, so only signatures cross the network,
    and later the texts of candidates. Texts of fewer than min_words words have no links. Repeated rows count once.
    """
    rows = docs.filter("content is not null and id is not null").select(F.xxhash64("content").alias("t"), F.xxhash64(F.lit("h"), "content").alias("h"), "content")
    signed = cut_table(_signed(spread(rows, "t"), p))
    found = _candidates(signed, p)
    if copies:
        several = members(docs).groupBy("t", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(several.select(F.col("t").alias("ta"), F.col("h").alias("ha"), F.col("t").alias("tb"), F.col("h").alias("hb")))
    found = cut_table(found)
    ids = found.select(F.col("ta").alias("t")).unionByName(found.select(F.col("tb").alias("t")))
    texts = _only(rows, ids).groupBy("t", "h").agg(F.first("content").alias("content"))
    a = texts.select(F.col("t").alias("ta"), F.col("h").alias("ha"), F.col("content").alias("content_a"))
    b = texts.select(F.col("t").alias("tb"), F.col("h").alias("hb"), F.col("content").alias("content_b"))
    return _verified(found.join(a, ["ta", "ha"]).join(b, ["tb", "hb"]).select("ta", "ha", "content_a", "tb", "hb", "content_b"), p)


def near_duplicate_pairs(docs: DataFrame, p: NearDup) -> DataFrame:
    """All pairs of documents with similarity of at least the threshold: id_a < id_b, similarity.

    The links of text_links between different texts, one pair for each, with members() say the same; here copies are
    expanded, so the result is as large as the pairs that exist.
    """
    links, m = text_links(docs, p, copies=True), members(docs)
    copies = m.groupBy("t", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COPIES_PER_SHARD).select(F.col("t").alias("tb"), F.col("h").alias("hb"), F.ceil(F.col("n") / COPIES_PER_SHARD).cast("int").alias("shards"))
    copies = broadcast_if_small(cut(copies), MAX_BROADCAST)
    ma = m.select(F.col("id").alias("ia"), F.col("t").alias("ta"), F.col("h").alias("ha"))
    mb = m.select(F.col("id").alias("ib"), F.col("t").alias("tb"), F.col("h").alias("hb"))
    # copies of a text that very many documents hold are paired in shards: one side is cut, the other goes to each
    cut_side = links.join(ma, ["ta", "ha"]).join(copies, ["tb", "hb"], "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("ia"), "shards").cast("int"), F.lit(0))).drop("shards")
    all_sides = mb.join(copies, ["tb", "hb"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards") - 1, F.lit(0))))).drop("shards")
    pairs = cut_side.join(all_sides, ["tb", "hb", "shard"]).filter("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity").distinct()


def near_duplicate_groups(docs: DataFrame, p: NearDup) -> DataFrame:
    """One row per document: id, group_id (the least id of its class), n_links (other texts that its text is linked to),
    n_copies (documents with the same text). Copies are in one class whatever their length; documents without text are
    their own class."""
    links = cut(text_links(docs, p, copies=False).select("ta", "ha", "tb", "hb"))
    node = lambda t, h: F.concat_ws(":", F.lpad(F.hex(t), 16, "0"), F.lpad(F.hex(h), 16, "0"))
    edges = links.select(node("ta", "ha").alias("u"), node("tb", "hb").alias("v"))
    parts = connected_components(edges)
    degree = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("u", "node")
    m = members(docs).select("id", node("t", "h").alias("node"))
    texts = m.groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("least"))
    texts = texts.join(parts, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = texts.groupBy("component").agg(F.min("least").alias("group_id"))
    texts = texts.join(least, "component").select("node", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    # a document that holds several texts belongs to the class with the least id
    out = m.join(texts, "node").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"), F.max("n_copies").alias("n_copies"))
    rest = docs.filter("id is not null").select("id").distinct().join(out.select("id"), "id", "left_anti")
    return out.unionByName(rest.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
