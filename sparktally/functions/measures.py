"""Entropy-family measures over weighted contingency tables, in bits; empty cells add nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(cols: list[str]) -> Column:
    return F.sum("n").over(Window.partitionBy(*cols))


def entropy(t: DataFrame, by: list[str], x: list[str], name: str = "value") -> DataFrame:
    """H(x) within each ``by`` group of counts ``n``."""
    t = t.groupBy(*by, *x).agg(F.sum("n").alias("n")).where("n > 0")
    p = F.col("n") / _over(by)
    return t.select(*by, (-p * F.log2(p)).alias("_h")).groupBy(*by).agg(F.sum("_h").alias(name))


def information(t: DataFrame, by: list[str], x: list[str], y: list[str], given: tuple[str, ...] = (), name: str = "value") -> DataFrame:
    """I(x; y | given) within each ``by`` group: mutual information of any columns, conditional or not."""
    z = list(given)
    t = t.groupBy(*by, *x, *y, *z).agg(F.sum("n").alias("n")).where("n > 0")
    t = t.select("n", *by, _over(by).alias("all"), _over(by + z).alias("nz"), _over(by + x + z).alias("nxz"), _over(by + y + z).alias("nyz"))
    term = F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))
    return t.groupBy(*by).agg(F.sum(term).alias(name))


def conditional_entropy(t: DataFrame, by: list[str], x: list[str], given: list[str], name: str = "value") -> DataFrame:
    """H(x | given)."""
    t = t.groupBy(*by, *x, *given).agg(F.sum("n").alias("n")).where("n > 0")
    t = t.select("n", *by, _over(by).alias("all"), _over(by + given).alias("ng"))
    return t.groupBy(*by).agg(F.sum(-F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("ng"))).alias(name))


def symmetric_uncertainty(t: DataFrame, by: list[str], x: list[str], y: list[str], name: str = "value") -> DataFrame:
    """2 I / (H(x) + H(y)); null where both entropies are zero."""
    i, hx, hy = information(t, by, x, y, name="_i"), entropy(t, by, x, "_hx"), entropy(t, by, y, "_hy")
    h = F.col("_hx") + F.col("_hy")
    return i.join(hx, by).join(hy, by).select(*by, F.when(h > 0, 2 * F.col("_i") / h).alias(name))


def chi_square(t: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., chi2, df): Pearson's statistic over the full grid of seen values of x and y."""
    t = t.groupBy(*by, x, y).agg(F.sum("n").alias("n"))
    nx, ny = t.groupBy(*by, x).agg(F.sum("n").alias("nx")), t.groupBy(*by, y).agg(F.sum("n").alias("ny"))
    grid = nx.join(ny, by) if by else nx.crossJoin(ny)
    grid = grid.join(t, [*by, x, y], "left").withColumn("all", F.sum("nx").over(Window.partitionBy(*by, y)))
    e = F.col("nx") * F.col("ny") / F.col("all")
    d = F.coalesce("n", F.lit(0)) - e
    df = (F.count_distinct(x) - 1) * (F.count_distinct(y) - 1)
    return grid.groupBy(*by).agg(F.sum(d * d / e).alias("chi2"), df.cast("long").alias("df"))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function for half-whole ``a``, by recurrence."""
    from math import erfc, exp, lgamma, log, sqrt

    if x <= 0:
        return 1.0
    if a == int(a):
        q, b = exp(-x), 1.0
    else:
        q, b = erfc(sqrt(x)), 0.5
    while b < a - 1e-9:
        q += exp(b * log(x) - x - lgamma(b + 1))
        b += 1
    return min(1.0, q)


def chi_square_p(stats: DataFrame) -> DataFrame:
    """Adds ``p`` to rows of chi2 and df; df 0 gives 1. A row per table tested, evaluated a batch at a time."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([1.0 if d == 0 else gamma_tail(d / 2, v / 2) for v, d in zip(x, df, strict=True)], dtype=float)

    return stats.withColumn("p", tail("chi2", "df"))


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) of a binomial, for sign tests."""
    from math import exp, lgamma, log

    if k <= 0:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k, n + 1)))
