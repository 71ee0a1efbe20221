"""String similarities: set kernels as built-in columns, sequence kernels as Arrow UDFs.

Sequence kernels are scored after candidates are cut to the best few, and once per distinct pair of strings
within a batch. Scores are 0 to 100 but for Jaro-Winkler, 0 to 1. An empty string beside another scores 0,
two empty ones 100 in ratio and 0 in the set kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import digit_tokens, tokens


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per character of a, one word operation per character of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = rows = (1 << len(a)) - 1
    for c in b:
        hit = rows & where.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; a substitution counts as two edits."""
    if a == b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    x, y = sorted(a.split()), sorted(b.split())
    return 100.0 if x == y else ratio(" ".join(x), " ".join(y))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and these with either side's others; 100 if a side has no others and words are shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of the longer: of its length, or cut off at an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, letters, best = len(short), set(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(start, 0) : start + n]
        if window[-1] in letters or window[0] in letters:
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, and a tenth of the rest for each of the first four characters that agree."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


KERNELS: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler}


def kernels(*names: str):
    """An Arrow UDF over two string columns that returns a struct with a field for each kernel; null counts as empty.

    The strings of a pair are sent to Python once for all kernels, and scored once per distinct pair in a batch.
    """
    score = [KERNELS[n] for n in names]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            place: dict[tuple[str, str], int] = {}
            at = [place.setdefault(pair, len(place)) for pair in zip(a.fillna(""), b.fillna(""))]
            yield pd.DataFrame([[f(x, y) for f in score] for x, y in place], columns=list(names), dtype="float64").iloc[at].reset_index(drop=True)

    return run


def kernel(name: str):
    """One kernel as a column: equal strings are settled in the JVM and not sent to Python, all others by kernels()."""
    run, same = kernels(name), 1.0 if name == "jaro_winkler" else 100.0

    def column(a: Column | str, b: Column | str) -> Column:
        x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
        equal = F.when(x.rlike(r"\S"), same).otherwise(0.0) if name == "token_set" else F.lit(same)
        return F.when(x == y, equal).otherwise(run(F.when(x != y, x), F.when(x != y, y))[name])

    return column


def jaccard(a: Column, b: Column) -> Column:
    """Common words over all words, the union counting one at least."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def containment(a: Column, b: Column) -> Column:
    """Common words over those of the smaller side; 0 if a side has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def digit_conflicts(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """Of words with digits: common ones, their Jaccard share, ones on one side only, and the share of these; null if a text is blank."""
    x, y = digit_tokens(a), digit_tokens(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    there = (a != "") & (b != "")
    apart, base = every - both, F.greatest(every, F.lit(1))
    return F.when(there, both), F.when(there, both / base), F.when(there, apart), F.when(there, apart / base)


def cosine(a: Column, b: Column, unit: bool = False) -> Column:
    """Of two arrays of numbers, in double precision; null if one is null. Of unit vectors it is the dot product."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    return dot(x, y) if unit else dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def blend(skeleton: Column, address: Column, block: Column, w_min: float = 0.35, w_block: float = 0.05) -> Column:
    """The larger of two similarities, part of the smaller, and a little of the block score: one field may be lost as long as the other is there."""
    return F.greatest(skeleton, address) + w_min * F.least(skeleton, address) + w_block * 100.0 * block


def weighted_overlap(pairs: DataFrame, left: str, right: str, idf: DataFrame, default: float, prefix: str) -> DataFrame:
    """Adds <prefix>_widf (idf of common words over that of all), and <prefix>_maxidf (largest idf of a common word).

    Pairs must be unique in (l, r). idf: (token, idf); words that it lacks weigh `default`.
    """
    x, y = F.array_distinct(tokens(F.col(left))), F.array_distinct(tokens(F.col(right)))
    words = pairs.select("l", "r", x.alias("_x"), y.alias("_y")).select("l", "r", F.explode(F.array_union("_x", "_y")).alias("token"), "_x", "_y")
    words = words.select("l", "r", "token", (F.array_contains("_x", F.col("token")) & F.array_contains("_y", F.col("token"))).alias("both"))
    w = F.coalesce("idf", F.lit(default))
    sums = words.join(idf, "token", "left").groupBy("l", "r").agg((F.sum(F.when(F.col("both"), w).otherwise(0.0)) / F.sum(w)).alias(f"{prefix}_widf"), F.coalesce(F.max(F.when(F.col("both"), w)), F.lit(0.0)).alias(f"{prefix}_maxidf"))
    return pairs.join(sums, ["l", "r"], "left").fillna(0.0, [f"{prefix}_widf", f"{prefix}_maxidf"])
