"""Relevance: BM25 over trigram lengths, and a subsequence scorer for fuzzy matches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_LOW = -(1 << 60)


def _occurrences(content: Column, term: str) -> Column:
    low = F.lower(content)
    return (F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / float(len(term))


def bm25(lines: DataFrame, terms: list[str], hits: DataFrame | None = None) -> DataFrame:
    """hits (default: the lines that hold all terms) with rank (lower is better).

    A line's length is its number of trigrams. One pass over lines gathers the statistics (a single row, so its
    broadcast is bounded), a second one ranks the hits. A term that a hit lacks adds nothing to its rank.
    """
    length = F.greatest(F.length("content") - 2, F.lit(0))
    held = {f"df{i}": F.count(F.when(F.contains(F.lower("content"), F.lit(t.lower())), 1)) for i, t in enumerate(terms)}
    stats = lines.agg(F.count(F.lit(1)).alias("total"), F.avg(length).alias("mean_length"), *[c.alias(k) for k, c in held.items()])
    if hits is None:
        hits = lines.filter(reduce(lambda a, b: a & b, [F.contains(F.lower("content"), F.lit(t.lower())) for t in terms], F.lit(True)))
    scored = hits.crossJoin(F.broadcast(stats))
    relative = F.when(F.col("mean_length") > 0, length / F.col("mean_length")).otherwise(F.lit(0.0))
    rank = F.lit(0.0)
    for i, term in enumerate(terms):
        df, tf = F.col(f"df{i}"), _occurrences(F.col("content"), term)
        idf = F.greatest(F.log((F.col("total") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * relative))
    # Sums of logarithms differ in their last bits between machines; order and pages must not.
    return scored.withColumn("rank", F.round(rank, 9)).drop("total", "mean_length", *held)


def fuzzy_score(text: str, query: str, case_sensitive: bool = False) -> int | None:
    """Score of a text in which every blank-separated atom of query is a subsequence; None if one is not.

    Matched characters count, more so at starts of words and after other matched ones; gaps cost. The best alignment
    of each atom is found by dynamic programming.
    """
    if not case_sensitive:
        text, query = text.lower(), query.lower()
    scores = [_align(text, atom) for atom in query.split()]
    return None if None in scores else sum(scores)


def _align(text: str, atom: str) -> int | None:
    """Score of the best alignment of atom in text. One step per character of atom, over all places of text at once."""
    if not atom:
        return 0
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    if not n:
        return None
    starts = np.fromiter(("0" if c.isalnum() else "8" for c in text), "U1", n).astype(np.int64)
    bonus = np.append(10, starts[:-1])
    place = np.arange(n)
    # matched[j]: best with the atom so far ending at text[j]; carried[j]: best with it ending before j, gaps paid.
    matched, carried = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, c in enumerate(atom):
        here = chars == ord(c)
        new = np.where(here, carried + 16 + bonus, _LOW)
        if i:
            new[1:] = np.maximum(new[1:], np.where(here[1:], matched[:-1] + 16 + np.maximum(6, bonus[1:]), _LOW))
        new = np.where(new < _LOW // 2, _LOW, new)
        if new.max() == _LOW:
            return None
        # A gap costs 3 to open and 1 a character: the running maximum of new + place, less the place.
        reach = np.maximum.accumulate(np.where(new == _LOW, _LOW, new - 3 + place)) - place
        matched, carried = new, np.append(_LOW, np.where(reach < _LOW // 2, _LOW, reach)[:-1])
    return int(matched.max())


def fuzzy_score_column(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """fuzzy_score as a vectorised column; null where the text does not match."""

    @F.pandas_udf("int")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fuzzy_score(t, query, case_sensitive) for t in texts], dtype="Int32")

    return score(text)
