"""Similarities of strings and of token arrays.

Set measures are Column expressions. The alignments that no built-in has
(longest common subsequence, Jaro-Winkler, best partial match, counts of
character runs) come from one Arrow UDF that returns them as a struct, so a
pair's strings cross to Python once.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def containment(a: Column, b: Column) -> Column:
    """The share of a's tokens that b has."""
    size = F.size(F.array_distinct(a))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def equal_or_unknown(a: Column, b: Column) -> Column:
    """1 or 0; -1 if either is empty."""
    return F.when((a == "") | (b == ""), F.lit(-1.0)).otherwise((a == b).cast("double"))


def share_any(a: Column, b: Column) -> Column:
    """1 if the arrays share a token; -1 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0)).otherwise(F.arrays_overlap(a, b).cast("double"))


def first_equal(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0)))).cast("double")


def log_distance(a: Column, b: Column) -> Column:
    """Of two numbers as texts, by their first nine digits."""
    value = lambda c: F.expr("bigint(0)") + F.substring(c, 1, 9).try_cast("bigint")
    return F.log1p(F.abs(value(a) - value(b)).cast("double"))


# ------------------------------------------------------------- alignments
def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = masks.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Insertions and deletions only: twice the common length over both lengths."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of what is shared against either side, and of the sides' own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 1.0
    shared = " ".join(sorted(both))
    gap = 1 if shared else 0
    with_x, with_y = len(shared) + gap + len(only_x), len(shared) + gap + len(only_y)
    best = 2 * (len(shared) + gap + common_length(only_x, only_y)) / (with_x + with_y)
    if shared:
        best = max(best, 2 * len(shared) / (len(shared) + with_x), 2 * len(shared) / (len(shared) + with_y))
    return best


def best_window(a: str, b: str) -> float:
    """The best ratio of a with a stretch of its length of b, stretches that the ends cut short included.

    From one stretch to the next the common length changes by one at most, so
    what two stretches have bounds all between them; only where the bound is
    over the best so far are more tried.
    """
    n, masks = len(a), {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full, best, lengths = (1 << n) - 1, 0.0, {}

    def size(start: int) -> int:
        return min(start + n, len(b)) - max(0, start)

    def common(start: int) -> int:
        nonlocal best
        row = full
        for c in b[max(0, start) : start + n]:
            u = row & masks.get(c, 0)
            row = ((row + u) | (row - u)) & full
        lengths[start] = out = n - row.bit_count()
        best = max(best, 2 * out / (n + size(start)))
        return out

    def bound(i: int, j: int) -> float:
        most = min(n, (lengths[i] + lengths[j] + j - i) // 2)
        return 2 * most / (n + max(most, min(size(i), size(j))))

    low, high = 1 - n, len(b) - 1
    common(low)
    common(high)
    heap = [(-bound(low, high), low, high)]
    while heap and best < 1:
        least, i, j = heapq.heappop(heap)
        if -least <= best:
            break
        if j - i > 1:
            mid = (i + j) // 2
            common(mid)
            heapq.heappush(heap, (-bound(i, mid), i, mid))
            heapq.heappush(heap, (-bound(mid, j), mid, j))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a stretch of the longer; of equally long ones either way."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a == b:
        return 1.0
    return max(best_window(a, b), best_window(b, a) if len(a) == len(b) else 0.0)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four where it is above 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, of_a = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                of_a.append(c)
                break
    if not of_a:
        return 0.0
    of_b = [c for c, u in zip(b, used, strict=True) if u]
    m, swapped = len(of_a), sum(x != y for x, y in zip(of_a, of_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@lru_cache(maxsize=4096)
def gram_counts(text: str, n: int) -> tuple[dict[str, int], int]:
    """How often the text has each run of n characters, between hash signs, and the sum of squares."""
    padded = f"#{text}#"
    counts = Counter(padded[k : k + n] for k in range(len(padded) - n + 1))
    return counts, sum(c * c for c in counts.values())


def gram_cosine(a: str, b: str, n: int) -> float:
    """Cosine of the texts' gram counts; -1 if either has none."""
    (x, xx), (y, yy) = gram_counts(a, n), gram_counts(b, n)
    if not xx or not yy:
        return -1.0
    if len(x) > len(y):
        x, y = y, x
    return sum(c * y.get(g, 0) for g, c in x.items()) / math.sqrt(xx * yy)


MEASURES = {"ratio": ratio, "tset": token_set_ratio, "tsort": token_sort_ratio, "partial": partial_ratio, "jw": jaro_winkler, "cos2": partial(gram_cosine, n=2), "cos3": partial(gram_cosine, n=3)}


def aligned(a: Column, b: Column, *measures: str) -> Column:
    """A struct of the named measures of two texts."""
    chosen = [MEASURES[m] for m in measures]

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, str], tuple[float, ...]] = {}
        rows = []
        for pair in zip(x, y, strict=True):
            if pair not in seen:
                seen[pair] = tuple(f(*pair) for f in chosen)
            rows.append(seen[pair])
        return pd.DataFrame(rows, columns=list(measures))

    return F.pandas_udf(run, ", ".join(f"{m} double" for m in measures))(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def f_beta(tp: Column, predicted: Column, true: Column, beta2: float = 0.25) -> Column:
    """F0.5 of one entity; with nothing to find, nothing found is right."""
    p, r = tp / predicted, tp / true
    return F.when(true == 0, (predicted == 0).cast("double")).when(tp > 0, (1 + beta2) * p * r / (beta2 * p + r)).otherwise(F.lit(0.0))
