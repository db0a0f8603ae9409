"""Statistics as Column expressions."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def wilson_lower(failed: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the score interval of a failure rate; 0 without runs."""
    p = failed / total
    spread = F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * total)) / total)
    bound = (p + F.lit(z * z) / (2 * total) - z * spread) / (1 + F.lit(z * z) / total)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.greatest(bound, F.lit(0.0)))


def status_variance(rate: Column) -> Column:
    """1 at an even split, 0 where all runs agree."""
    return 4 * rate * (1 - rate)


def duration_cov(sd: Column, mean: Column) -> Column:
    return F.when(mean > 0, clip(sd / mean)).otherwise(0.0)


def shrink(score: Column, n: Column, smoothing: float) -> Column:
    return clip(score * n / (n + smoothing))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def odds_ratio_bound(a: Column, b: Column, c: Column, d: Column, z: float) -> Column:
    """The end of the interval at z standard errors (negative z: the lower one)."""
    se = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    return odds_ratio(a, b, c, d) * F.exp(z * se)


def log_factorial(n: Column) -> Column:
    """ln n!: exact to 20, then Stirling's series."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: all tables with the same margins that are no likelier.

    Probabilities fall on both sides of the mode, so bisection finds where each tail
    begins, and its terms are added outwards for ten standard deviations, beyond which
    nothing is left: work follows the root of the counts.
    """
    table = F.struct(*(x.cast("long").alias(n) for n, x in zip("abcd", (a, b, c, d), strict=True)))
    return F.get(F.transform(F.array(table), lambda t: _fisher(t["a"], t["b"], t["c"], t["d"])), F.lit(0))


def _fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    one, other, k = a + b, c + d, a + c
    n = F.greatest((one + other).cast("double"), F.lit(1.0))
    base = log_factorial(one) + log_factorial(other) + log_factorial(k) + log_factorial(b + d) - log_factorial(one + other)
    mode = F.floor((k + 1) * (one + 1).cast("double") / (n + 2))
    sd = F.sqrt(k / n * one * (other / n) * (b + d) / F.greatest(n - 1, F.lit(1.0)))
    known = F.struct(
        one.alias("one"), other.alias("other"), k.alias("k"), base.alias("base"), F.greatest(F.lit(0).cast("long"), k - other).alias("low"), F.least(one, k).alias("high"),
        mode.cast("long").alias("mode"), F.ceil(10 * sd + 50).cast("long").alias("reach"), a.alias("a"),
    )

    def log_p(t: Column, x: Column) -> Column:
        return t["base"] - log_factorial(x) - log_factorial(t["one"] - x) - log_factorial(t["k"] - x) - log_factorial(t["other"] - t["k"] + x)

    def tail(t: Column, outer: Column, sign: int) -> Column:
        """Sum of the terms from the first no likelier one on; `outer` is just beyond the last."""

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["out"] + s["in"]) / 2).cast("long")
            rare = log_p(t, mid) <= s["most"]
            open_ = F.abs(s["out"] - s["in"]) > 1
            return F.struct(F.when(open_ & rare, mid).otherwise(s["out"]).alias("out"), F.when(open_ & ~rare, mid).otherwise(s["in"]).alias("in"), s["most"].alias("most"))

        start = F.struct(outer.alias("out"), t["mode"].alias("in"), (log_p(t, t["a"]) + 1e-7).alias("most"))
        first = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve, lambda s: s["out"])

        def added(x: Column) -> Column:
            last = F.greatest(t["low"], x - t["reach"]) if sign < 0 else F.least(t["high"], x + t["reach"])
            terms = F.transform(F.sequence(F.least(x, last), F.greatest(x, last)), lambda y: F.exp(log_p(t, y)))
            return F.when(x == outer, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))

        return F.get(F.transform(F.array(first), added), F.lit(0))

    def both(t: Column) -> Column:
        even = log_p(t, t["mode"]) <= log_p(t, t["a"]) + 1e-7
        return F.when(even, F.lit(1.0)).otherwise(F.least(tail(t, t["low"] - 1, -1) + tail(t, t["high"] + 1, 1), F.lit(1.0)))

    return F.get(F.transform(F.array(known), both), F.lit(0))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: series below 2.5, continued fraction above."""
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(59)),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, n: F.struct((acc["sum"] + acc["term"] / (2 * n + 1)).alias("sum"), (acc["term"] * -(x * x) / (n + 1)).alias("term")),
        lambda acc: acc["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / (2 * acc))
    return F.when(x < 2.5, 1 - 2 / math.sqrt(math.pi) * x * series).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * F.greatest(fraction, F.lit(1e-300))))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees > x), df a positive integer."""
    h = x / 2
    steps = F.floor((df - 1) / 2)
    odd = df % 2 == 1
    # terms h^s / Gamma(s + 1) with s from 0 (even df) or 1/2 (odd df)
    first = F.when(odd, F.sqrt(h) / (math.sqrt(math.pi) / 2)).otherwise(F.lit(1.0))
    start = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    count = F.when(odd, steps).otherwise(F.floor(df / 2))
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1)).cast("long")),
        F.struct(F.lit(0.0).alias("sum"), first.alias("term")),
        lambda acc, n: F.struct((acc["sum"] + F.when(n <= count, acc["term"]).otherwise(0.0)).alias("sum"), (acc["term"] * h / (start + n)).alias("term")),
        lambda acc: acc["sum"],
    )
    return clip(F.when(odd, erfc(F.sqrt(h))).otherwise(0.0) + F.exp(-h) * tail)


def normal_two_sided(z: Column) -> Column:
    return F.least(erfc(F.abs(z) / math.sqrt(2)), F.lit(1.0))


@lru_cache(maxsize=32)
def _partition_numerator(parts: int) -> tuple[int, tuple[int, ...]]:
    """(L, c) with 1 / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^parts)) = sum c_k q^k / (1 - q^L)^(parts + 1)."""
    period = math.lcm(*range(1, parts + 1))
    out = [1]
    for step in (1, *range(1, parts + 1)):
        wide = [0] * (len(out) + period - step)
        for k in range(0, period, step):  # (1 - q^L) / (1 - q^step)
            for i, c in enumerate(out):
                wide[i + k] += c
        out = wide
    return period, tuple(out)


def partitions_up_to(x: int, parts: int) -> int:
    """How many partitions into at most `parts` parts have a sum of x or less."""
    if x < 0:
        return 0
    period, numerator = _partition_numerator(parts)
    whole, rest = divmod(x, period)
    return sum(numerator[k] * math.comb(whole - j + parts, parts) for j, k in enumerate(range(rest, len(numerator), period)) if j <= whole)


def mann_whitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties, from the exact distribution; the smaller size has to be small (8 and less in use).

    Rank sums of n among n + m are partitions into at most n parts of at most m.  Parts
    over m are counted out by inclusion and exclusion over n bounds, and each count
    is a polynomial in the sum, so the work doesn't depend on the larger size.
    """
    n, m = min(n, m), max(n, m)
    low = math.floor(min(u, n * m - u))
    shifts = Counter({0: 1})  # sums over sets of m + 1 ... m + n, signed by the size of the set
    for i in range(1, n + 1):
        for shift, sign in list(shifts.items()):
            shifts[shift + m + i] -= sign
    ways = sum(sign * partitions_up_to(low - shift, n) for shift, sign in shifts.items() if shift <= low)
    return min(1.0, 2 * ways / math.comb(n + m, n))
