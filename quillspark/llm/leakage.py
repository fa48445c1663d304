"""Evaluation texts leaking into documents: latent semantic retrieval.

Documents are cut into overlapping passages, weighted by TF-IDF over the words of
the evaluation items. A distributed randomised SVD of the passages gives a latent
space; passages and item windows are compared there. The part of a vector outside
the space enters as its norm, so the latent score is an upper bound of the true
product and the candidate search loses no verbatim run. Candidates are checked
exactly; looser ones by longest common subsequence and by the item's own names,
which together set the least product of a window and a passage that holds a
paraphrase of it among other words, so that no paraphrase is lost either.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import cut, spread

WORD = re.compile(r"[^\W_]+")
_SLICE = 2048
_PAIRS = 65536
_CELLS = 32 << 20  # most cells of a table of passages and words


@dataclass(frozen=True)
class Leakage:
    """min_run: consecutive words that make a leak. rank, oversample, power: randomised SVD. lcs: a paraphrase's least share of the item window's words in a common subsequence; names: least share of the
    window's rarest words that must stand in the passage. block: item windows compared at a time."""

    min_run: int = 12
    rank: int = 128
    oversample: int = 16
    power: int = 1
    lcs: float = 0.75
    names: float = 0.6
    block: int = 4096
    seed: int = 3

    @property
    def passage(self) -> int:
        return 2 * self.min_run

    @property
    def stride(self) -> int:
        return self.min_run + 1


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def item_windows(items: list[tuple[int, list[str]]], vocab: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of n words of the items: word ids (windows x n), the item and the position of each."""
    rows, ids, at = [], [], []
    for item, w in items:
        k = [vocab[x] for x in w]
        for i in range(len(k) - n + 1):
            rows.append(k[i : i + n])
            ids.append(item)
            at.append(i)
    return np.array(rows, np.int32).reshape(-1, n), np.array(ids, np.int64), np.array(at, np.int32)


def encode(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """doc_id, ids: the words of each document as numbers of the items' vocabulary, -1 for any other word."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # grows with the items only, not with the documents

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in it:
            flat, ends = [], [0]
            for t in b.column("text").to_pylist():
                flat.append(np.fromiter((get(w, -1) for w in words(t)), np.int32))
                ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def passages(batch: pa.RecordBatch, p: Leakage, size: int = _SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (doc_id, word ids padded with -1). Every run of min_run words lies within some passage."""
    ends = batch.column("ids").offsets.to_numpy()
    flat = batch.column("ids").values.to_numpy(zero_copy_only=False)
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    starts, lasts, owner = [], [], []
    for d in range(len(doc)):
        a, z = int(ends[d]), int(ends[d + 1])
        if z > a:
            s = np.arange(a, max(a + 1, z - p.passage + p.stride), p.stride)
            starts.append(s)
            lasts.append(np.full(len(s), z))
            owner.append(np.full(len(s), doc[d]))
    if not starts:
        return
    starts, lasts, owner = map(np.concatenate, (starts, lasts, owner))
    step = np.arange(p.passage)
    for i in range(0, len(starts), size):
        at = starts[i : i + size, None] + step
        inside = at < lasts[i : i + size, None]
        yield owner[i : i + size], np.where(inside, flat[np.minimum(at, len(flat) - 1)], -1)


def project(ids: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Sums of the rows of `weighted` (words x width, with a last row of zeros) that the ids of each passage name."""
    return np.concatenate([weighted[ids[i : i + 256]].sum(1) for i in range(0, len(ids), 256)])


def padded(m: np.ndarray) -> np.ndarray:
    """m with a last row of zeros, which the id -1 of any other word names."""
    return np.concatenate([m, np.zeros((1, *m.shape[1:]), m.dtype)])


def repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each passage: how often it stands there, and whether it is its first place."""
    same = ids[:, :, None] == ids[:, None, :]
    return same.sum(2), ~np.tril(same, -1).any(2)


def norms(ids: np.ndarray, idf_padded: np.ndarray) -> np.ndarray:
    """Squared lengths of the TF-IDF vectors."""
    return (repeats(ids)[0] * idf_padded[ids] ** 2).sum(1)


def passage_idf(encoded: DataFrame, n_words: int, p: Leakage) -> np.ndarray:
    """log((1 + passages) / (1 + passages with the word)) over all documents; the sums are one row per word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_words, np.int64), 0
        for b in it:
            for _, ids in passages(b, p):
                n += len(ids)
                df += np.bincount(ids[repeats(ids)[1] & (ids >= 0)], minlength=n_words)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_words)), pa.array(np.concatenate(([n], df)))], ["w", "n"])

    sums = {r["w"]: r["n"] for r in encoded.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    df = np.array([sums.get(w, 0) for w in range(n_words)], float)
    return np.log((1.0 + sums.get(-1, 0)) / (1.0 + df)).astype(np.float32) + np.float32(1e-3)


def gram_times(encoded: DataFrame, idf: np.ndarray, m: np.ndarray, p: Leakage, rows_per_block: int = 256) -> np.ndarray:
    """A'(A m) for the passages A, summed over the partitions in blocks of rows; the result has the size of m."""
    n_words, width = m.shape
    shared = encoded.sparkSession.sparkContext.broadcast((idf, m.astype(np.float32)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, x = shared.value
        x = padded(w[:, None] * x)
        total = np.zeros((n_words, width), np.float64)
        for b in it:
            for _, ids in passages(b, p):
                y = project(ids, x)
                row, col = np.nonzero(ids >= 0)
                word = ids[row, col]
                order = np.argsort(word, kind="stable")
                word, first = np.unique(word[order], return_index=True)
                if len(word):
                    total[word] += np.add.reduceat(y[row[order]], first, axis=0)
        total *= w[:, None]
        blocks = range(0, n_words, rows_per_block)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([total[i : i + rows_per_block].tobytes() for i in blocks], pa.binary())], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["part"].iloc[0]) // 8)
        for part in pdf["part"]:
            total += np.frombuffer(part)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "part": [total.tobytes()]})

    parts = encoded.mapInArrow(run, "block long, part binary").select("block", F.pmod(F.spark_partition_id(), F.lit(64)).cast("long").alias("salt"), "part")
    schema = "block long, salt long, part binary"
    some = parts.groupBy("block", "salt").applyInPandas(add, schema)  # at most 64 parts of a block are left
    rows = some.groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((n_words, width))
    for r in rows:
        x = np.frombuffer(bytes(r["part"])).reshape(-1, width)
        out[r["block"] : r["block"] + len(x)] = x
    return out


def latent_space(encoded: DataFrame, idf: np.ndarray, p: Leakage) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix by randomised subspace iteration."""
    n_words = len(idf)
    width = min(n_words, p.rank + p.oversample)
    q = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((n_words, width)))[0]
    for _ in range(p.power):
        q = np.linalg.qr(gram_times(encoded, idf, q, p))[0]
    core = q.T @ gram_times(encoded, idf, q, p)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[: p.rank]]).astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def least_products(weights: np.ndarray, rare: np.ndarray, distinct: np.ndarray, p: Leakage) -> np.ndarray:
    """Least product of each window with a passage that holds `lcs` of its words and `names` of its rarest ones (their
    places in `rare`). weights: squared idf of the words; each word that stands in the passage adds at least its own."""
    n_lcs, n_names = int(np.ceil(p.lcs * weights.shape[1] - 1e-9)), int(np.ceil(p.names * rare.shape[1] - 1e-9))
    rows = np.arange(len(weights))[:, None]
    light = rare[rows, np.argsort(weights[rows, rare], axis=1, kind="stable")[:, :n_names]]
    rest = weights.astype(np.float64)
    rest[rows, light] = np.inf
    with_names = weights[rows, light].sum(1) + np.sort(rest, axis=1)[:, : max(0, n_lcs - n_names)].sum(1)
    # a name that stands twice among the rarest counts twice but may stand once in the passage
    return np.where(distinct, with_names, np.sort(weights, axis=1)[:, :n_lcs].sum(1))


def leaks(docs: DataFrame, items: DataFrame, p: Leakage = Leakage(), max_items: int = 100_000) -> DataFrame:
    """Documents that hold passages of items: doc_id, item_id, kind, n_windows, best.

    kind `run`: at least min_run consecutive words in common; n_windows counts the item's windows of min_run words that
    stand in the document, best is 1. kind `paraphrase`: no such run, but a passage that shares a window's order of words
    and its names; best is the share of the window in the common subsequence.

    docs has doc_id, text; items item_id, text. Repeated rows count once; items of fewer than min_run words, null and
    empty texts give no row. The items are the query set; about max_items of them are held in memory at a time, and with
    more the documents are read once for each such part of the items. All documents are compared with all items.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    parts = max(1, -(-rows.count() // max_items))
    if parts == 1:
        return _leaks(docs, rows, p)
    rows = cut(rows)
    found = [_leaks(docs, rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i), p) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _leaks(docs: DataFrame, items: DataFrame, p: Leakage) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()  # a part of the query set
    texts = sorted((r["item_id"], words(r["text"])) for r in rows)
    vocab: dict[str, int] = {}
    for _, w in texts:
        for x in w:
            vocab.setdefault(x, len(vocab))
    win, win_item, win_at = item_windows(texts, vocab, p.min_run)
    schema = "doc_id long, item_id long, kind string, n_windows long, best double"
    if not len(win):
        return spark.createDataFrame([], schema)
    encoded = cut(encode(spread(docs.filter("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id"), vocab))
    idf = passage_idf(encoded, len(vocab), p)
    space = latent_space(encoded, idf, p)

    order = np.lexsort(win.T[::-1])
    first = np.ones(len(win), bool)
    first[1:] = (win[order][1:] != win[order][:-1]).any(1)
    kind_of = np.empty(len(win), np.int64)
    kind_of[order] = np.cumsum(first) - 1
    uniq = win[order][first]  # distinct windows; several items may hold one
    holders: list[list[tuple[int, int]]] = [[] for _ in range(len(uniq))]
    for k, item, at in zip(kind_of, win_item, win_at):
        holders[k].append((int(item), int(at)))
    mult = np.random.default_rng(p.seed).integers(1, 2**63, p.min_run, np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        uniq_hash = ((uniq.astype(np.uint64) + np.uint64(1)) * mult).sum(1)

    idf_padded, space_padded = padded(idf), padded(idf[:, None] * space)
    qu, qn2 = project(uniq, space_padded), norms(uniq, idf_padded)
    rare = np.argsort(-idf[uniq], axis=1, kind="stable")[:, :3]
    distinct = (np.diff(np.sort(np.take_along_axis(uniq, rare, 1), axis=1), axis=1) > 0).all(1)
    least = least_products(idf[uniq] ** 2, rare, distinct, p)
    shared = spark.sparkContext.broadcast({"least": least, "v": space_padded, "idf": idf_padded, "u": qu, "n2": qn2, "win": uniq, "hash": uniq_hash, "held": holders, "rare": np.take_along_axis(uniq, rare, 1)})
    run_len = p.min_run
    # words that are among the rarest of some window: a paraphrase holds at least `names` of its window's three
    is_rare = np.zeros(len(vocab) + 1, bool)
    is_rare[np.take_along_axis(uniq, rare, 1)] = True
    three = np.sort(np.take_along_axis(uniq, rare, 1), axis=1)
    n_names = 1 if (three[:, 1:] == three[:, :-1]).any() else int(np.ceil(p.names * rare.shape[1] - 1e-9))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        res = np.sqrt(np.maximum(s["n2"] - np.einsum("ij,ij->i", s["u"], s["u"]), 0))
        left = np.hstack([s["u"], res[:, None]]).astype(np.float32)  # the residual norms bound what lies outside the space
        need = s["n2"] * np.float32(1 - 1e-3)
        loose_need = (s["least"] * (1 - 1e-3)).astype(np.float32)
        for b in it:
            exact: dict[tuple[int, int], set[int]] = {}
            loose: dict[tuple[int, int], float] = {}
            for doc, ids in passages(b, p, max(64, min(_SLICE, _CELLS // len(s["idf"])))):
                # what every run and every paraphrase needs: words of the items, all together or with names among them
                known = ids >= 0
                together = np.lib.stride_tricks.sliding_window_view(known, run_len, axis=1).all(2).any(1)
                enough = together | (known.sum(1) >= run_len * p.lcs) & (is_rare[ids].sum(1) >= n_names)
                if not enough.any():
                    continue
                doc, ids = doc[enough], ids[enough]
                u, n2 = project(ids, s["v"]), norms(ids, s["idf"])
                inner = np.einsum("ij,ij->i", u, u)
                right = np.hstack([u, np.sqrt(np.maximum(n2 - inner, 0))[:, None]]).astype(np.float32)
                view = np.lib.stride_tricks.sliding_window_view(ids, run_len, axis=1)
                holds = np.zeros((len(ids), len(s["idf"])), bool)  # which words each passage holds
                holds[np.arange(len(ids))[:, None], ids] = True
                holds[:, -1] = False
                with np.errstate(over="ignore"):
                    grams = ((view.astype(np.int64) + 1).astype(np.uint64) * mult).sum(2)
                for k in range(0, len(left), p.block):
                    score = right @ left[k : k + p.block].T
                    pi, qi = np.nonzero(score >= need[k : k + p.block])
                    qi = qi + k
                    hit = (grams[pi] == s["hash"][qi][:, None]).any(1)
                    for x, y in zip(pi[hit], qi[hit]):
                        if (view[x] == s["win"][y]).all(1).any():
                            for item, at in s["held"][y]:
                                exact.setdefault((int(doc[x]), item), set()).add(at)
                    pairs = np.flatnonzero(score >= loose_need[k : k + p.block])
                    for i in range(0, len(pairs), _PAIRS):
                        pi, qi = np.divmod(pairs[i : i + _PAIRS], score.shape[1])
                        qi = qi + k
                        named = holds[pi[:, None], s["rare"][qi]].mean(1) >= p.names
                        pi, qi = pi[named], qi[named]
                        held = holds[pi[:, None], s["win"][qi]].mean(1) >= p.lcs - 1e-9
                        for x, y in zip(pi[held], qi[held]):
                            w = s["win"][y].tolist()
                            share = lcs_length(w, ids[x].tolist()) / len(w)
                            if share >= p.lcs:
                                for item, _ in s["held"][y]:
                                    key = (int(doc[x]), item)
                                    loose[key] = max(loose.get(key, 0.0), share)
            out = [(d, i, "run", len(at), 1.0) for (d, i), at in exact.items()] + [(d, i, "paraphrase", 0, x) for (d, i), x in loose.items() if (d, i) not in exact]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "kind", "n_windows", "best"])

    found = encoded.mapInArrow(run, schema)
    # repeated rows of a document
    return found.groupBy("doc_id", "item_id").agg(F.max("kind").alias("kind"), F.max("n_windows").alias("n_windows"), F.max("best").alias("best"))
