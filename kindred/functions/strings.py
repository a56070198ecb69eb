"""String similarity: built-in expressions where Spark has them, Arrow UDFs where it has not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1, boost_above: float = 0.7) -> float:
    """0 to 1; two empty strings are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        j = next((k for k in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[k] and b[k] == ch), None)
        if j is not None:
            taken[j] = True
            mine.append(ch)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [b[k] for k, t in enumerate(taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    shared = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + shared * prefix_weight * (1 - jaro) if jaro > boost_above else jaro


def indel(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, 0 to 100; bit-parallel, linear in b."""
    if not a and not b:
        return 100.0
    place: dict[str, int] = {}
    for i, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & place.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of: shared words against each side, and the sides against each other; 100 where one side's words hold the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    only_x, only_y = sorted(x - y), sorted(y - x)
    left, right = " ".join(both + only_x), " ".join(both + only_y)
    scores = [indel(left, right)]
    if both:
        core = " ".join(both)
        scores += [indel(core, left), indel(core, right)]
    return max(scores)


def partial(a: str, b: str) -> float:
    """The shorter string against its best window in the longer one, windows cut off at the ends included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n = len(s)
    windows = {t[max(0, i) : i + n] for i in range(1 - n, len(t))}
    return max(indel(s, w) for w in windows)


_SCORERS = {"jaro_winkler": jaro_winkler, "token_sort": token_sort, "token_set": token_set, "partial": partial}


def scorer(name: str):
    """An Arrow UDF of two string columns; null where either is null.  Equal pairs of a batch are scored once."""
    f = _SCORERS[name]

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        done: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in done:
                done[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(done[pair])
        return pd.Series(out, dtype="float64")

    return score


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, 1 for two empty strings; inside whole-stage code."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def skeleton(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[aeiou]", ""), r"(.)\1+", "$1")


def unleet(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[a-z]") & ~token.rlike(r"^[0-9]+(st|nd|rd|th)$")
    return F.when(mixed, F.translate(token, "013457", "oleast")).otherwise(token)


def blank_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def equal_or_missing(a: Column, b: Column) -> Column:
    """1 equal, 0 different, null where either side is null or empty."""
    return (blank_as_null(a) == blank_as_null(b)).cast("double")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))
