"""Count cubes: the sufficient statistics of nearly everything else.

All cubes start from the base cuboid, the counts of whole attribute tuples. Its aggregation
combines before the shuffle, and every smaller cube then reads cells instead of rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuboid(df: DataFrame, atts: list[str], y: str = "y", extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra..., atts..., y, n): one row per distinct tuple."""
    return df.groupBy(*extra, *atts, F.col(y).alias("y")).agg(F.count("*").alias("n"))


def cube(cells: DataFrame, atts: list[str], k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra..., a1, v1, ..., ak, vk, y, n) over all k-subsets of the attributes, earlier ones first.

    Symmetric cells are kept once. The subsets are dealt out inside the row; the only
    shuffle is the sum's, after partial sums.
    """
    entries = [F.struct(*(x for i, a in enumerate(s, 1) for x in (F.lit(a).alias(f"a{i}"), F.col(a).alias(f"v{i}")))) for s in combinations(atts, k)]
    names = [f"{c}{i}" for i in range(1, k + 1) for c in "av"]
    long = cells.select(*extra, "y", "n", F.explode(F.array(*entries)).alias("e")).select(*extra, *(f"e.{c}" for c in names), "y", "n")
    return long.groupBy(*extra, *names, "y").agg(F.sum("n").alias("n"))


def class_counts(cells: DataFrame, keys: list[str], classes: list[str], name: str) -> DataFrame:
    """(keys..., name): counts per class as an array in the order of ``classes``."""
    per = F.array(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) for c in classes))
    return cells.groupBy(*keys).agg(per.alias(name)) if keys else cells.agg(per.alias(name))


def labels(cells: DataFrame) -> list[str]:
    """Class labels in order; as many as the label's domain has."""
    return sorted(r[0] for r in cells.select("y").distinct().collect())


def domain_sizes(cells: DataFrame, atts: list[str]) -> dict[str, int]:
    """Distinct values of each attribute, in one pass over the cells."""
    row = cells.agg(*(F.countDistinct(a).alias(a) for a in atts)).first()
    return {a: int(row[a]) for a in atts}


#: Values of portable_hash: 52 bits, so that they are exact as doubles too.
HASH_SPACE = 1 << 52


def portable_hash(key: str | Column, seed: int | str | Column = 0) -> Column:
    """A whole number under 2 ** 52 that any engine with MD5 repeats; other seeds give independent numbers."""
    c = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(s.cast("string"), F.lit(":"), c.cast("string"))), 1, 13), 16, 10).cast("long")


def fold_of(id_col: str | Column, folds: int, exp: int = 0) -> Column:
    """Portable fold number of an id, drawn anew for each experiment."""
    return (portable_hash(id_col, exp) % folds).cast("int")
