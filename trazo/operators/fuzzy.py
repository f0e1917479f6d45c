"""Fuzzy lookup: the terms of a lexicon at the least edit distance from a word, up to three.

The distance is optimal string alignment: insertions, deletions, substitutions and swaps of
neighbours, no part edited twice. Candidates come from deletion keys of the first
characters; distances are tried in rising order, as only the least one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trazo.session import durable

MOST_DISTANCE, PREFIX, TOP = 3, 7, 3
#: A lexicon up to this many terms is indexed in every task; a larger one is joined by keys.
LOCAL_TERMS = 200_000
#: Keys of at most one character are shared by all short words; they are spread over so many salts.
SALTS = 32


def osa(a: str, b: str, most: int) -> int:
    """The distance, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) or len(b)
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def deletion_keys(word: str, most: int) -> set[str]:
    """The word's first characters without up to ``most`` of them."""
    head = word[:PREFIX]
    return {"".join(c) for k in range(min(most, len(head)) + 1) for c in combinations(head, len(head) - k)}


class Index:
    """Deletion keys of a lexicon [(term, freq)], one dictionary for each distance."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.freq = dict(terms)
        self.keys: list[dict[str, list[str]] | None] = [None] * (MOST_DISTANCE + 1)

    def _at(self, k: int) -> dict[str, list[str]]:
        if self.keys[k] is None:
            d: dict[str, list[str]] = {}
            for t in self.freq:
                for key in deletion_keys(t, k):
                    d.setdefault(key, []).append(t)
            self.keys[k] = d
        return self.keys[k]

    def closest(self, word: str, top: int = TOP) -> list[tuple[int, int, str]]:
        """(distance, -freq, term), the best first; empty if nothing is near enough."""
        if word in self.freq:
            return [(0, -self.freq[word], word)]
        for k in range(1, MOST_DISTANCE + 1):
            at = self._at(k)
            seen = {t for key in deletion_keys(word, k) for t in at.get(key, ())}
            hits = [(k, -self.freq[t], t) for t in seen if osa(word, t, k) == k]
            if hits:
                return sorted(hits)[:top]
        return []


def closest(words: DataFrame, lex: DataFrame, top: int = TOP) -> DataFrame:
    """(word, suggestions): for every distinct word its array of (distance, freq, term), at most ``top``.

    Order: distance, frequency falling, term. Words without a near term are left out; null
    words too.
    """
    distinct = words.select("word").where("word is not null").distinct()
    n = lex.limit(LOCAL_TERMS + 1).count()
    return _local(distinct, lex, top) if n <= LOCAL_TERMS else by_keys(distinct, lex, top)


def _local(distinct: DataFrame, lex: DataFrame, top: int) -> DataFrame:
    terms = [(r.term, r.freq) for r in lex.select("term", "freq").collect()]
    made: list[Index] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Index(terms))
        for b in batches:
            out = [[{"distance": d, "freq": -f, "term": t} for d, f, t in made[0].closest(w, top)] for w in b["word"]]
            out = pd.DataFrame({"word": b["word"], "suggestions": out})
            yield out[out["suggestions"].str.len() > 0]

    return distinct.mapInPandas(run, "word string, suggestions array<struct<distance:int,freq:bigint,term:string>>")


def by_keys(distinct: DataFrame, lex: DataFrame, top: int = TOP) -> DataFrame:
    """The same by equi-joins on deletion keys, for a lexicon of any size: only words without a term at a distance go on to the next.

    What is found and what is left at each distance is kept, so no distance repeats an
    earlier one. Pairs are held against the native edit distance, which is at most twice
    the alignment's, before they are aligned.
    """

    def keyed(df: DataFrame, k: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b.assign(key=[sorted(deletion_keys(w, k)) for w in b["w"]])
                yield b.explode("key")

        extra = ", freq long" if "freq" in df.columns else ""
        return df.mapInPandas(run, f"w string{extra}, key string")

    def verified(pairs: DataFrame, k: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [osa(x, y, k) == k for x, y in zip(b["word"], b["term"])]
                yield b[ok].assign(distance=k)

        return pairs.mapInPandas(run, "word string, term string, freq long, distance int")

    lex_w = lex.select(F.col("term").alias("w"), F.col("freq").cast("long").alias("freq"))
    rest = durable(distinct.select(F.col("word").alias("w")))
    found = durable(rest.join(lex_w, "w").select(F.col("w").alias("word"), F.col("w").alias("term"), "freq", F.lit(0).alias("distance")))
    hits, hot = found, F.length("key") <= 1
    for k in range(1, MOST_DISTANCE + 1):
        rest = durable(rest.join(hits.select(F.col("word").alias("w")).distinct(), "w", "left_anti"))
        words = keyed(rest, k).select(F.col("w").alias("word"), "key", F.when(hot, F.pmod(F.xxhash64("w"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        terms = keyed(lex_w, k).select(F.col("w").alias("term"), "freq", "key", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        near = (F.abs(F.length("word") - F.length("term")) <= k) & (F.levenshtein("word", "term") <= 2 * k)
        pairs = words.join(terms, ["key", "salt"]).where(near).select("word", "term", "freq").distinct()
        hits = durable(verified(pairs, k))
        found = found.unionByName(hits)
    w = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)
    listed = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", "distance", "freq", "term"))).alias("l"))
    return listed.select("word", F.transform("l", lambda x: F.struct(x["distance"].alias("distance"), x["freq"].alias("freq"), x["term"].alias("term"))).alias("suggestions"))
