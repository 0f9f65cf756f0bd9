"""Name similarity: Jaro-Winkler has no built-in here, so it and NFKC are Arrow functions; the rest are expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

SIMILAR = 0.85
# Words that don't count for an acronym.
ACRONYM_SKIPS = ("of", "the", "and", "for", "de", "la", "&")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def jaro_winkler_of(a: str, b: str) -> float:
    """Half transpositions are not rounded down, and the prefix bonus (4 characters, 0.1) always counts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps, m = sum(x != y for x, y in zip(left, right, strict=True)) / 2, len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def is_token_subset(a: Column, b: Column) -> Column:
    """a, b: token arrays. Fewer tokens, one of them longer than a character, all of them in b."""
    return (F.size(a) < F.size(b)) & F.exists(a, lambda t: F.length(t) > 1) & F.forall(a, lambda t: F.array_contains(b, t))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t.isin(*ACRONYM_SKIPS)), lambda t: F.substring(t, 1, 1)), "")


def is_acronym_of(a: Column, b_tokens: Column) -> Column:
    """a: a normalized name without spaces, of two letters or more; b has two tokens or more."""
    return (F.length(a) >= 2) & ~a.contains(" ") & (F.size(b_tokens) >= 2) & (a == initials(b_tokens))
