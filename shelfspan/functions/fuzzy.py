"""Similarity of strings from 0 to 100, in Arrow batches. Indel similarity is 2 * LCS / (len(a) + len(b))."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of a."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, left, right = x & y, x - y, y - x
    if shared and (not left or not right):
        return 100.0
    s, p, q = (" ".join(sorted(w)) for w in (shared, left, right))
    gap = 1 if s else 0
    n, m = len(s) + gap + len(p), len(s) + gap + len(q)
    best = 100.0 * (1 - (len(p) + len(q) - 2 * lcs(p, q)) / (n + m))
    if s:
        best = max(best, 100.0 * (1 - (gap + len(p)) / (len(s) + n)), 100.0 * (1 - (gap + len(q)) / (len(s) + m)))
    return best


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter string with any stretch of the longer one of at most its length."""
    a, b = sorted((a or "", b or ""), key=len)
    if not a:
        return 100.0 if not b else 0.0

    def best(short: str, long: str) -> float:
        n, m = len(short), len(long)
        return max(ratio(short, long[max(0, k) : min(m, k + n)]) for k in range(1 - n, m))

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


@F.pandas_udf(T.DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
