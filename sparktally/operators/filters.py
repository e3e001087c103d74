"""Row and column filters: fitted in one aggregate, applied as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_filter(df: DataFrame, positive: str, y: str = "y") -> DataFrame:
    """Binary class: ``positive`` against "Negative". A label that never occurs is an error."""
    if not df.where(F.col(y) == positive).limit(1).count():
        raise ValueError(f"no row has class {positive!r}")
    return df.withColumn(y, F.when(F.col(y) == positive, positive).otherwise("Negative"))


def fit_minmax(df: DataFrame, nums: list[str]) -> dict[str, tuple[float, float]]:
    """Least and largest value of each column, nulls ignored: one aggregate."""
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in nums for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in nums}


def normalise(df: DataFrame, limits: dict[str, tuple[float, float]], symmetric: bool = False) -> DataFrame:
    """To [0, 1], or [-1, 1]; a constant column gives 0, null stays null."""
    out = {}
    for c, (lo, hi) in limits.items():
        x = F.lit(0.0) if lo is None or hi == lo else (F.col(c) - lo) / (hi - lo)
        if symmetric and lo is not None and hi != lo:
            x = 2 * x - 1
        out[c] = F.when(F.col(c).isNotNull(), x)
    return df.withColumns(out)


def quadratic(df: DataFrame, nums: list[str], cats: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Pairwise products: numbers multiplied, categories one-hot times a number, category pairs as one category."""
    cols = [(F.col(b) * F.col(a)).alias(f"{b}*{a}") for a, b in combinations(nums, 2)]
    cols += [F.when(F.col(c) == v, F.col(x)).otherwise(F.when(F.col(x).isNotNull(), 0.0)).alias(f"{c}={v}*{x}") for c, vs in cats.items() for v in vs for x in nums]
    cols += [F.concat_ws("|", F.col(a), F.col(b)).alias(f"{a}*{b}") for a, b in combinations(cats, 2)]
    return df.select(*keep, *cols)


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each step is fitted on what the ones before it made."""
    for step in steps:
        df = step(df)
    return df


def three_way(value: Column, cut: Column | float) -> Column:
    """0 under the cut, 1 from it on, 2 unknown."""
    return F.when(value.isNull(), 2).when(value < cut, 0).otherwise(1)


def systematic_sample(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Every step-th row by id, step the least that leaves about ``limit``."""
    total = df.agg(F.greatest(F.ceil(F.count("*") / limit), F.lit(1)).alias("_step"))
    return df.crossJoin(F.broadcast(total)).where(F.col(id_col) % F.col("_step") == 0).drop("_step")


NAME = re.compile(r"[A-Za-z0-9_-]+")


def valid_job(spec: dict) -> bool:
    """Names of learners, data sets and filters of a job: letters, digits, _ and -; folds from 2 to 20."""
    names = [*spec.get("learners", []), *spec.get("datasets", []), *spec.get("filters", [])]
    return bool(spec.get("learners")) and all(NAME.fullmatch(n) for n in names) and 2 <= int(spec.get("folds", 10)) <= 20


def conjunction(literals: list[tuple[str, str, object, object]]) -> Column:
    """A feature of (column, "=", value, None) and (column, "in", low, high) tests, intervals open below and closed above."""
    out = F.lit(True)
    for col, op, a, b in literals:
        test = F.col(col) == a if op == "=" else (F.lit(a is None) | (F.col(col) > F.lit(a))) & (F.lit(b is None) | (F.col(col) <= F.lit(b)))
        out = out & F.coalesce(test, F.lit(False))
    return F.when(out, "t").otherwise("f")
