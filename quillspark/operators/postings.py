"""An inverted index of notes: where each word stands in each surface.

Postings are sorted by word, so a query reads the row groups of its words only, whatever the number of notes. Phrases are
found by their words' positions; the last word of a phrase is a prefix, which is a range of the sorted words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURFACES = ("fts_path", "fts_title", "fts_content")


def _words(surface: Column, number: int) -> Column:
    return F.transform(F.split(F.trim(surface), " "), lambda w, i: F.struct(F.lit(number).alias("surface"), w.alias("token"), i.alias("at")))


def build(index: DataFrame) -> DataFrame:
    """token, surface (0 path, 1 title, 2 content), file_id, positions, of an index with normalised surfaces. A word's
    places in a note are one row, so a word that a third of all notes hold is spread over rows of many notes."""
    words = F.array(*[_words(F.col(c), s) for s, c in enumerate(SURFACES)])
    each = index.select("file_id", F.explode(F.flatten(words)).alias("w")).select("file_id", "w.*").filter("token <> ''")
    rows = each.groupBy("token", "surface", "file_id").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return rows.select("token", "surface", "file_id", "positions")


def _is(token: Column, words: list[str], i: int) -> Column:
    w = F.lit(words[i])
    return token == w if i < len(words) - 1 else (token >= w) & F.startswith(token, w)


def matching(postings: DataFrame, phrases: list[str]) -> DataFrame:
    """file_id of the notes that hold every phrase in one of their surfaces. A blank phrase, or none, matches nothing."""
    split = [p.split() for p in dict.fromkeys(phrases)]
    if not split or not all(split):
        return postings.select("file_id").limit(0)
    token = F.col("token")
    wanted = reduce(lambda a, b: a | b, [_is(token, words, i) for words in split for i in range(len(words))])
    hit = [F.when(_is(token, words, i), F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("i"), F.lit(len(words)).alias("n"))) for p, words in enumerate(split) for i in range(len(words))]
    rows = postings.filter(wanted).select("file_id", "surface", "positions", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("h")).select("file_id", "surface", "positions", "h.*")
    found = rows.filter("n = 1").select("file_id", "phrase")
    if any(len(words) > 1 for words in split):
        # a phrase stands where each of its words is at its distance from the same place
        placed = rows.filter("n > 1").select("file_id", "surface", "phrase", "i", "n", F.explode("positions").alias("at"))
        whole = placed.groupBy("file_id", "surface", "phrase", "n", (F.col("at") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("k")).filter("k = n")
        found = found.unionByName(whole.select("file_id", "phrase"))
    return found.distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(split)).select("file_id")
