"""Statistics as columns and small DataFrame steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_half_even(x: Column) -> Column:
    return F.bround(x)


def ln0(x: Column) -> Column:
    """ln, null where it is not finite."""
    return F.when(x > 0, F.ln(x))


def xlogy(x: Column, y: Column) -> Column:
    """x ln y with 0 ln 0 = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(F.greatest(y, F.lit(1e-300))))


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square with ``df`` degrees > x).

    Even: a finite sum.  Odd: the complementary error function (Abramowitz and Stegun 7.1.26 would lose digits, so a
    continued fraction beyond 3 and a series below) and the recurrence in steps of two.
    """
    h = F.greatest(x, F.lit(0.0)) / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * h / i
            total = total + term
        return F.exp(-h) * total
    tail = erfc(F.sqrt(h))
    for k in range(1, df, 2):
        tail = tail + F.exp(-h) * F.pow(h, F.lit(k / 2)) / math.gamma(k / 2 + 1)
    return F.least(F.lit(1.0), tail)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0."""
    terms = 60
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(terms)),
        F.struct(z.alias("t"), F.lit(0.0).alias("s")),
        lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 3)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * a["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), F.lit(0.0), lambda f, n: (n / F.lit(2.0)) / (z + f))
    return F.when(z < 2.5, series).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / (z + fraction))


def bh_adjust(df: DataFrame, p: str = "pval", q: str = "qval", where: Column | None = None) -> DataFrame:
    """Benjamini-Hochberg over the rows that ``where`` selects (all by default); the others get 1.  One row per test, so windows stay small."""
    chosen = F.col(p).isNotNull() if where is None else where & F.col(p).isNotNull()
    df = df.withColumn("__in", F.coalesce(chosen, F.lit(False)))
    tests = F.count("*").over(W.partitionBy("__in"))
    rank = F.rank().over(W.partitionBy("__in").orderBy(p))
    ties = F.count("*").over(W.partitionBy("__in", p))
    df = df.withColumn("__s", F.col(p) * tests / (rank + ties - 1))
    low = F.min("__s").over(W.partitionBy("__in").orderBy(F.col(p).desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn(q, F.when(F.col("__in"), F.least(F.lit(1.0), low)).otherwise(1.0)).drop("__in", "__s")


def entropy10(p: Column) -> Column:
    """-p log10 p with 0 for p = 0; summed it is the entropy."""
    return F.when(p > 0, -p * F.log10(p)).otherwise(0.0)


def js_to_one_hot(p: Column, sum_h: Column) -> Column:
    """Jensen-Shannon distance (log 10) between a distribution with entropy ``sum_h`` and the one-hot one at the place with share ``p``."""
    mixed = sum_mixed(p, sum_h)
    return F.sqrt(F.greatest(F.lit(0.0), mixed - sum_h / 2))


def sum_mixed(p: Column, sum_h: Column) -> Column:
    """Entropy of (p + onehot) / 2: all places halve but one."""
    others = (sum_h - entropy10(p)) / 2 + (1 - p) / 2 * math.log10(2)
    return others + entropy10((p + 1) / 2)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
