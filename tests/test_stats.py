import math
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import stats


def value(spark, c):
    return spark.range(1).select(c.alias("x")).head()["x"]


def fisher(a, b, c, d):
    r1, r2, k = a + b, c + d, a + c
    p = {x: Fraction(math.comb(r1, x) * math.comb(r2, k - x), math.comb(r1 + r2, k)) for x in range(max(0, k - r2), min(r1, k) + 1)}
    return float(sum(v for v in p.values() if v <= p[a]))


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (40, 60, 900, 1000), (1, 99, 5, 4000), (7, 7, 7, 7), (0, 0, 3, 4), (200, 150, 1200, 1300)])
def test_fisher(spark, cells):
    got = value(spark, stats.fisher_exact(*(F.lit(x) for x in cells)))
    assert got == pytest.approx(fisher(*cells), rel=1e-8)


def test_fisher_of_large_tables_is_quick(spark):
    # a normal statistic of 2.828: the tables are so large that the limit holds
    got = value(spark, stats.fisher_exact(*(F.lit(x) for x in (500_000_000, 500_100_000, 500_000_000, 499_900_000))))
    z = abs(500_000_000 / 1_000_100_000 - 500_000_000 / 999_900_000) / (0.25 * (1 / 1_000_100_000 + 1 / 999_900_000)) ** 0.5
    assert got == pytest.approx(math.erfc(z / 2**0.5), rel=1e-2)


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 2.4, 2.6, 4.0, 6.0])
def test_erfc(spark, x):
    assert value(spark, stats.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize(("x", "df", "want"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (19.67513757268249, 11, 0.05), (0.0, 4, 1.0)])
def test_chi2_tail(spark, x, df, want):
    assert value(spark, stats.chi2_tail(F.lit(x), F.lit(df))) == pytest.approx(want, rel=1e-9)


def test_wilson(spark):
    assert value(spark, stats.wilson_lower(F.lit(1), F.lit(1))) == pytest.approx(0.2065, abs=1e-4)
    assert value(spark, stats.wilson_lower(F.lit(0), F.lit(0))) == 0
    assert value(spark, stats.wilson_lower(F.lit(5), F.lit(10))) > value(spark, stats.wilson_lower(F.lit(1), F.lit(1)))


def test_mann_whitney_exact():
    n, m = 5, 6
    us = [sum(r + 1 for r in c) - n * (n + 1) // 2 for c in combinations(range(n + m), n)]
    for u in range(n * m + 1):
        top = max(u, n * m - u)
        assert stats.mann_whitney_exact(u, n, m) == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))


def test_mann_whitney_exact_is_whole_at_any_size():
    """Against counts by the recurrence of the distribution, and at sizes where only closed counts are possible."""
    n, m = 6, 40
    ways = {(0, 0): 1}
    for k in range(1, n + m + 1):  # subsets of 1 ... n + m by size and sum
        for (size, total), c in list(ways.items()):
            if size < n:
                ways[size + 1, total + k] = ways.get((size + 1, total + k), 0) + c
    counts = [ways.get((n, u + n * (n + 1) // 2), 0) for u in range(n * m + 1)]
    assert sum(counts) == math.comb(n + m, n)
    for u in (0, 1, 7, 60, 119, 120, 121, 233, 240):
        low = min(u, n * m - u)
        assert stats.mann_whitney_exact(u, n, m) == min(1.0, 2 * sum(counts[: low + 1]) / math.comb(n + m, n)) == stats.mann_whitney_exact(u, m, n)
    for u in (2_600_000, 1_500_000):
        z = (8_000_000 - u - 4_000_000 - 0.5) / math.sqrt(8 * 1_000_000 * 1_000_009 / 12)
        assert stats.mann_whitney_exact(u, 8, 1_000_000) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.002)
    assert stats.mann_whitney_exact(3, 8, 10**9) == pytest.approx(2 * 7 / math.comb(10**9 + 8, 8))
