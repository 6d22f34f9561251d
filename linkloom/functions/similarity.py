"""Pair similarities: set measures as expressions, string distances of a pair, and as one Arrow UDF over columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import tokens


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def containment(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))))


def shares(x: Column, y: Column, common: Column) -> tuple[Column, Column]:
    """jaccard and containment of two arrays without repeats, of which the number of common elements is known."""
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(none, 0.0).otherwise(common / (F.size(x) + F.size(y) - common)), F.when(none, 0.0).otherwise(common / F.least(F.size(x), F.size(y)))


def jaro_winkler_one(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth per common leading character (four at most) from 0.7 on; two empties are 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and used[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            used[j] = True
            hits.append(c)
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def char_places(a: str) -> dict[str, int]:
    """A bit mask of the places of each character."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def lcs_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Longest common subsequence, bit-parallel on whole-number words; places are char_places(a), where they are known."""
    places = char_places(a) if places is None else places
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if c in places:
            match = row & places[c]
            row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def indel_one(a: str, b: str) -> float:
    """2 LCS / (len a + len b); two empties are 1."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_one(a: str, b: str) -> float:
    """Best indel similarity among the common tokens and each side's common plus own tokens; 0 if either side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 1.0
    u, v = f"{both} {p}".strip(), f"{both} {q}".strip()
    return max(indel_one(u, v), indel_one(both, u) if both else 0.0, indel_one(both, v) if both else 0.0)


def partial_one(a: str, b: str) -> float:
    """Best indel similarity of the shorter string with a window of the longer; two empties are 1.

    A window cannot do better than its characters, counted, have in common; windows are tried in falling order of that bound.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    if a in b:
        return 1.0
    n, left = len(a), dict(Counter(a))  # left: how often a character of a may still come, below 0 where it came too often
    common, bounds = 0, []
    for i in range(1 - n, len(b)):
        if i + n <= len(b):
            new = b[i + n - 1]
            if new in left:
                common += left[new] > 0
                left[new] -= 1
        if i > 0:
            old = b[i - 1]
            if old in left:
                left[old] += 1
                common -= left[old] > 0
        size = min(i + n, len(b)) - max(0, i)
        bounds.append((2 * common / (n + size), max(0, i), i + n))
    best, places = 0.0, char_places(a)
    for bound, x, y in sorted(bounds, key=lambda t: -t[0]):
        if bound <= best:
            break
        best = max(best, 2 * lcs_length(a, b[x:y], places) / (n + len(b[x:y])))
    return best


KERNELS = {"jaro_winkler": jaro_winkler_one, "indel": indel_one, "token_set": token_set_one, "partial": partial_one}


def fuzzy(kinds: Sequence[str], a: Column, b: Column) -> Column:
    """A struct of KERNELS over two string columns, worked out for many pairs at once by the kernels module."""
    schema = StructType([StructField(k, DoubleType()) for k in kinds])

    @F.pandas_udf(schema)
    def score(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        from . import kernels

        return pd.DataFrame(kernels.scores(kinds, x.fillna("").tolist(), y.fillna("").tolist()), columns=list(kinds))

    return score(a, b)
