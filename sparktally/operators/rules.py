"""Top-k conjunctive rules: branch and bound over itemsets, a level of longer ones at a time.

A level holds projected cells: for each itemset that is still open, the items that may yet
join it (those of later attributes), the class and the count; equal ones are merged. The next
level deals each item out and merges again, so an itemset's cover and class counts never
need the rows. An itemset stays open while its optimistic value, as if a longer itemset kept
all its rows of one class and lost all others, can still reach the k-th best rule. The driver
sees only the k best rules and their least value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import cuboid, labels
from .discretise import code, mdl, value_counts
from .filters import conjunction
from .session import shared_dir

#: Terms of a tail that are summed at once.
TERMS = 4096


def hypergeometric_tail(a: int, draws: int, hits: int, total: int) -> float:
    """P(X >= a) where ``draws`` of ``total`` are drawn without replacement and ``hits`` of them count: Fisher's exact test, one-sided."""
    low, high = max(0, draws + hits - total), min(draws, hits)
    if a <= low:
        return 1.0
    if a > high:
        return 0.0
    if a <= draws * hits / total:  # the shorter sum is below
        return max(0.0, 1.0 - _tail(a - 1, -1, draws, hits, total, low))
    return min(1.0, _tail(a, 1, draws, hits, total, high))


def _tail(a: int, step: int, draws: int, hits: int, total: int, end: int) -> float:
    """Sum of the terms from a to end, away from the mode, so that they fall; in blocks until they no longer count."""
    lf = lambda n: math.lgamma(n + 1)
    log = lf(hits) - lf(a) - lf(hits - a) + lf(total - hits) - lf(draws - a) - lf(total - hits - draws + a) - lf(total) + lf(draws) + lf(total - draws)
    out = 0.0
    while True:
        x = np.arange(a, a + step * min(TERMS, abs(end - a) + 1), step, dtype=float)
        if step > 0:
            ratio = (hits - x[:-1]) * (draws - x[:-1]) / ((x[:-1] + 1) * (total - hits - draws + x[:-1] + 1))
        else:
            ratio = x[:-1] * (total - hits - draws + x[:-1]) / ((hits - x[:-1] + 1) * (draws - x[:-1] + 1))
        logs = log + np.concatenate([[0.0], np.cumsum(np.log(ratio))])
        part = float(np.exp(logs).sum())
        out += part
        last = int(x[-1])
        if last == end or math.exp(logs[-1]) <= 1e-18 * out or out == 0.0 and logs[-1] < logs[0]:
            return out
        nxt = last + step
        r = (hits - last) * (draws - last) / ((last + 1) * (total - hits - draws + last + 1)) if step > 0 else last * (total - hits - draws + last) / ((hits - last + 1) * (draws - last + 1))
        a, log = nxt, float(logs[-1]) + math.log(r)


def fisher_p(support: Column, cover: Column, part_support: Column, part_cover: Column) -> Column:
    """p of a rule against one of its generalisations: as many rows of the class or more if its cover were any of the generalisation's rows."""

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([hypergeometric_tail(*map(int, row)) for row in zip(*b, strict=True)], dtype=float)

    return tail(support, cover, part_support, part_cover)


def find_rules(cells: DataFrame, atts: list[str], k: int = 100, measure: str = "leverage", alpha: float = 0.05, redundant: bool = False, longest: int | None = None) -> DataFrame:
    """(items, y, cover, support, value, p): the k best rules "items -> class", best first.

    ``measure`` is leverage, support - expected support as shares of all rows, or lift, their
    ratio. A rule must be productive: p, the largest of Fisher's exact tests against the rules
    with one item less, is at most ``alpha``. Without ``redundant`` no item may be implied by the others (equal
    covers). Equal values rank by items, then class. A null value of an attribute is no item.
    """
    classes = labels(cells)
    if not classes:
        return cells.sparkSession.createDataFrame([], "items array<string>, y string, cover long, support long, value double, p double")
    shared_dir(cells.sparkSession)
    ids = range(len(classes))
    counted = lambda df, *by: df.groupBy(*by).agg(F.array(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) for c in classes)).alias("c"))
    per_class = counted(cells).first().c
    total = sum(per_class)
    share = [n / total for n in per_class]

    def value(c: Column, cover: Column, i: int) -> Column:
        expected = cover * F.lit(share[i])
        return c[i] / F.lit(total) - expected / F.lit(total) if measure == "leverage" else c[i] / expected

    def optimistic(c: Column) -> Column:
        best = [c[i] / F.lit(total) * F.lit(1 - share[i]) if measure == "leverage" else F.when(c[i] > 0, 1 / share[i]).otherwise(0.0) for i in ids]
        return F.greatest(*best, F.lit(0.0))

    every = F.array(*(F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), F.col(a).cast("string"))) for a in atts))
    open_cells = cells.select(F.array().cast("array<string>").alias("items"), F.filter(every, lambda x: x.isNotNull()).alias("rest"), "y", "n")
    known = counted(open_cells, "items").withColumn("cover", F.lit(total))
    found: list[tuple] = []
    least = 0.0
    for size in range(1, min(longest or len(atts), len(atts)) + 1):
        dealt = open_cells.select("items", "rest", F.posexplode("rest").alias("at", "item"), "y", "n")
        longer = dealt.select(F.concat("items", F.array("item")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "y", "n")
        open_cells = longer.groupBy("items", "rest", "y").agg(F.sum("n").alias("n")).checkpoint()
        sums = counted(open_cells, "items")
        sums = sums.withColumn("cover", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)).where(optimistic(F.col("c")) >= least - 1e-12)
        # what is known of each itemset without one of its items
        one_less = sums.select("items", "c", "cover", F.posexplode("items").alias("at", "out"))
        one_less = one_less.withColumn("part", F.filter("items", lambda x: x != F.col("out")))
        parts = known.select(F.col("items").alias("part"), F.col("c").alias("part_c"), F.col("cover").alias("part_cover"))
        against = one_less.join(parts, "part").groupBy("items").agg(F.first("c").alias("c"), F.first("cover").alias("cover"), F.collect_list(F.struct("part_c", "part_cover")).alias("parts"))
        # fewer parts than items: one was closed, and with it everything longer
        against = against.where(F.size("parts") == size)
        if not redundant:
            against = against.where(~F.exists("parts", lambda p: p["part_cover"] == F.col("cover")))
        against = against.checkpoint()
        rules = against.select("items", "cover", "parts", "c", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("y"), value(F.col("c"), F.col("cover"), i).alias("value")) for i, c in enumerate(classes)))).alias("r"))
        rules = rules.where((F.col("r.value") >= least - 1e-12) & (F.col("r.value") > (0.0 if measure == "leverage" else 1.0)))
        rules = rules.select("items", "cover", F.col("r.y").alias("y"), F.col("r.value").alias("value"), F.get("c", F.col("r.i")).alias("support"), F.explode("parts").alias("part"), "r.i")
        tested = rules.withColumn("p", fisher_p(F.col("support"), F.col("cover"), F.get("part.part_c", F.col("i")), F.col("part.part_cover")))
        kept = tested.groupBy("items", "y", "cover", "support", "value").agg(F.max("p").alias("p")).where(F.col("p") <= alpha)
        order = [F.round("value", 9).desc(), F.array_join("items", "&"), F.col("y")]
        found += [(r["items"], r["y"], r["cover"], r["support"], r["value"], r["p"]) for r in kept.orderBy(*order).limit(k).collect()]
        found = sorted(found, key=lambda r: (-round(r[4], 9), "&".join(r[0]).encode(), r[1].encode()))[:k]
        least = found[-1][4] if len(found) == k else 0.0
        known = against.where(optimistic(F.col("c")) >= least - 1e-12).select("items", "c", "cover")
        if not known.limit(1).count():
            break
        open_cells = open_cells.join(known.select("items"), "items", "left_semi")
    return cells.sparkSession.createDataFrame(found, "items array<string>, y string, cover long, support long, value double, p double")


def mine_features(df: DataFrame, cats: list[str], nums: list[str], k: int = 10, alpha: float = 0.05) -> tuple[dict[str, Column], DataFrame]:
    """Features of the k best rules: (name -> t/f expression, rules). Numbers are cut by MDL for the search.

    An interval is open below and closed above in the search and in the expression alike; an
    unknown number is an item of its own.
    """
    classes = labels(df)
    cuts: dict[str, list[float]] = {c: [] for c in nums}
    if nums:
        for r in mdl(value_counts(df, nums), classes).collect():
            cuts[r["att"]].append(r["cut"])
    cuts = {c: sorted(x) for c, x in cuts.items()}
    coded = df.select("y", *cats, *(F.when(F.col(c).isNull(), "?").otherwise(code(F.col(c), cuts[c]).cast("string")).alias(c) for c in nums))
    rules = find_rules(cuboid(coded, [*cats, *nums]), [*cats, *nums], k, alpha=alpha)

    def literal(item: str) -> tuple | Column:
        att, v = item.split("=", 1)
        if att not in nums:
            return (att, "=", v, None)
        if v == "?" or not cuts[att]:
            return F.col(att).isNull() if v == "?" else F.col(att).isNotNull()
        edge = [None, *cuts[att], None]
        return (att, "in", edge[int(v)], edge[int(v) + 1])

    out: dict[str, Column] = {}
    for r in rules.collect():
        parts = [literal(i) for i in r["items"]]
        test = conjunction([p for p in parts if isinstance(p, tuple)])
        for known in [p for p in parts if not isinstance(p, tuple)]:
            test = F.when(known, test).otherwise("f")
        out["&".join(r["items"])] = test
    return out, rules
