"""Word-level similarity: LCS, edit distance and word error rate, as plain functions and Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, with one bit per element of `a` and a step per element of `b`."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & places.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions that turn a into b."""
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y)))
        previous = current
    return previous[-1]


def match_share(a: Sequence, b: Sequence) -> float:
    """LCS over the longer length; 0 if either is empty."""
    return lcs(a, b) / max(len(a), len(b)) if len(a) and len(b) else 0.0


def error_rate(expected: Sequence, heard: Sequence) -> float:
    """edit distance over the expected length, at least 1; may exceed 1."""
    return edit_distance(expected, heard) / max(len(expected), 1)


@F.pandas_udf(T.DoubleType())
def match_share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else match_share(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def error_rate_udf(expected: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else error_rate(list(x), list(y)) for x, y in zip(expected, heard, strict=True)], dtype="float64")


def confidences(word_scores, avg_logprob, words):
    """F32: the scores of the words; without any, exp(avg_logprob) for each alphabetic word; without that, none."""
    given = F.filter(word_scores, lambda x: x.isNotNull())
    repeated = F.when(avg_logprob.isNotNull(), F.array_repeat(F.exp(avg_logprob), F.size(words))).otherwise(F.array().cast("array<double>"))
    return F.when(F.size(given) > 0, given).otherwise(repeated)
