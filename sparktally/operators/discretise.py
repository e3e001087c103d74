"""Discretisers: cut points are fitted per attribute, then numbers map to interval codes.

A value's code is the number of cuts below it (intervals are open below and closed above),
an unknown one has a code of its own after the last. Fitting works on (attribute, value,
class counts), which loses nothing, so no sample of rows is needed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import shared_dir, small_side


def value_counts(df: DataFrame, nums: list[str]) -> DataFrame:
    """(att, value, y, n) of the known values."""
    entries = F.array(*(F.struct(F.lit(c).alias("att"), F.col(c).cast("double").alias("value")) for c in nums))
    long = df.select("y", F.explode(entries).alias("e")).select("e.att", "e.value", "y").where("value is not null")
    return long.groupBy("att", "value", "y").agg(F.count("*").alias("n"))


def code(value: Column, cuts: list[float] | Column) -> Column:
    """Interval code: cuts strictly under the value; one past the last code where the value is null."""
    c = F.array(*(F.lit(float(x)) for x in cuts)) if isinstance(cuts, list) else cuts
    if isinstance(cuts, list) and not cuts:
        return F.when(value.isNull(), 1).otherwise(0)
    return F.when(value.isNull(), F.size(c) + 1).otherwise(F.size(F.filter(c, lambda x: x < value)))


def interval_labels(cuts: list[float], unknown: bool = False) -> list[str]:
    """Names of the codes."""
    if not cuts:
        names = ["known"]
    else:
        names = [f"<={cuts[0]:g}", *(f"({a:g},{b:g}]" for a, b in zip(cuts, cuts[1:], strict=False)), f">{cuts[-1]:g}"]
    return names + ["unknown"] * unknown


def equal_depth(counts: DataFrame, bins: int | None = 10, root: float | None = None, exact: bool = False) -> DataFrame:
    """(att, cut): equal-frequency cuts at sorted places floor(n * i / k); k = ``bins``, or the whole part of n ** (1 / root).

    Places come from running sums over distinct values, so rows are never ranked. Repeated
    cuts and the largest value are left out, or kept with ``exact``.
    """
    t = counts.groupBy("att", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("att").orderBy("value")
    t = t.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("att")
    t = t.withColumn("all", F.sum("n").over(whole)).withColumn("top", F.max("value").over(whole))
    k = F.lit(bins) if root is None else F.floor(F.pow("all", F.lit(1.0 / root)) + 1e-9).cast("int")
    # the i-th cut is the value at place floor(all * i / k)
    t = t.withColumn("k", k).withColumn("before", F.col("upto") - F.col("n"))
    first = F.floor(F.col("before") * F.col("k") / F.col("all")).cast("int")
    last = F.floor((F.col("upto") * F.col("k") + F.col("k") - 1) / F.col("all")).cast("int") + 1
    near = F.sequence(F.greatest(first, F.lit(1)), F.least(F.greatest(last, F.lit(1)), F.greatest(F.col("k") - 1, F.lit(1))))
    near = F.when((F.col("k") > 1) & (F.greatest(first, F.lit(1)) <= F.col("k") - 1), near).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("i", F.explode(near)).withColumn("place", F.floor(F.col("all") * F.col("i") / F.col("k")))
    t = t.where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("upto")) & (F.col("i") < F.col("k")))
    if exact:
        return t.select("att", F.col("value").alias("cut"), "i")
    return t.where("value < top").select("att", F.col("value").alias("cut")).distinct()


def _class_entropy(sums: list[Column], total: Column) -> Column:
    out = F.lit(0.0)
    for s in sums:
        out = out - F.when(s > 0, s / total * F.log2(s / total)).otherwise(0.0)
    return out


def binary_cut(counts: DataFrame, classes: list[str]) -> DataFrame:
    """(att, cut, entropy): the midpoint with the least class entropy; of equals the largest. Running sums only."""
    per = counts.groupBy("att", "value").agg(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)))
    w = Window.partitionBy("att").orderBy("value")
    run, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("att")
    ids = range(len(classes))
    t = per.withColumn("next", F.lead("value").over(w))
    for i in ids:
        t = t.withColumn(f"l{i}", F.sum(f"c{i}").over(run)).withColumn(f"r{i}", F.sum(f"c{i}").over(every) - F.sum(f"c{i}").over(run))
    left, right = [F.col(f"l{i}") for i in ids], [F.col(f"r{i}") for i in ids]
    nl, nr = sum(left[1:], left[0]), sum(right[1:], right[0])
    t = t.where("next is not null").withColumn("entropy", F.round((nl * _class_entropy(left, nl) + nr * _class_entropy(right, nr)) / (nl + nr), 9))
    best = t.groupBy("att").agg(F.min_by(F.struct(((F.col("value") + F.col("next")) / 2).alias("cut"), "entropy"), F.struct("entropy", -F.col("value"))).alias("b"))
    return best.select("att", "b.cut", "b.entropy")


def mdl_cuts(values: np.ndarray, table: np.ndarray) -> list[float]:
    """Recursive minimum-description-length cuts of sorted distinct values with class counts.

    A split is kept while its gain exceeds (log2(N - 1) + delta) / N; a side of one or two rows
    is not split again. Of equal splits the last wins. The loop keeps its own stack; sums come from one prefix table.
    """

    def entropies(counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=-1, keepdims=True)
        p = np.divide(counts, n, out=np.zeros_like(counts, dtype=float), where=n > 0)
        return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=-1)

    prefix = np.vstack([np.zeros(table.shape[1]), np.cumsum(table, axis=0)])
    cuts, todo = [], [(0, len(values), table.shape[1])]
    while todo:
        a, z, k = todo.pop()
        if z - a < 2:
            continue
        whole = prefix[z] - prefix[a]
        left, right = prefix[a + 1 : z] - prefix[a], prefix[z] - prefix[a + 1 : z]
        n, nl, nr = whole.sum(), left.sum(axis=1), right.sum(axis=1)
        el, er = entropies(left), entropies(right)
        split = np.round((nl * el + nr * er) / n, 9)
        at = len(split) - 1 - int(np.argmin(split[::-1]))
        e = entropies(whole)
        kl, kr = int((left[at] > 0).sum()), int((right[at] > 0).sum())
        delta = math.log2(3**k - 2) - (k * e - kl * el[at] - kr * er[at])
        if e - (nl[at] * el[at] + nr[at] * er[at]) / n <= (math.log2(n - 1) + delta) / n:
            continue
        mid = a + at + 1
        cuts.append(float((values[mid - 1] + values[mid]) / 2))
        todo += [(from_, to, k) for from_, to, k, n in ((a, mid, kl, nl[at]), (mid, z, kr, nr[at])) if n > 2]
    return sorted(cuts)


def _running(per: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by..., value, next, upto): counts of the ``n`` classes up to each distinct value and the value after it, per group.

    Values are dealt by ranges, so a group may lie in many of them. What a range adds to the
    next ones is known for the groups that cross ranges, fewer than two for each range.
    """
    shared_dir(per.sparkSession)
    d = per.repartitionByRange(*by, "value").withColumn("_part", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_part", *by).orderBy("value")
    sums = [F.sum(F.get("c", F.lit(i))) for i in range(n)]
    inside = d.withColumns({"_in": F.array(*(s.over(w.rowsBetween(Window.unboundedPreceding, 0)) for s in sums)), "_next": F.lead("value").over(w)})
    ends = d.groupBy("_part", *by).agg(F.min("value").alias("_first"), *(s.alias(f"_c{i}") for i, s in enumerate(sums)))
    over = Window.partitionBy(*by)
    crossing = ends.withColumn("_n", F.count("*").over(over)).where("_n > 1")
    along = over.orderBy("_part")
    before = F.array(*(F.coalesce(F.sum(f"_c{i}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for i in range(n)))
    carry = crossing.select("_part", *by, before.alias("_before"), F.lead("_first").over(along).alias("_after"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ["_part", *by]])
    carry = carry.select(*(F.col(c).alias(f"_r_{c}") for c in ["_part", *by]), "_before", "_after")
    joined = inside.join(F.broadcast(carry), same, "left")
    upto = F.when(F.col("_before").isNull(), F.col("_in")).otherwise(F.zip_with("_in", "_before", lambda x, y: x + y))
    return joined.select(*by, "value", F.coalesce("_next", "_after").alias("next"), upto.alias("upto"))


def _entropy(counts: Column, n: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))


def mdl(counts: DataFrame, classes: list[str], by: tuple[str, ...] = ("att",)) -> DataFrame:
    """(by..., cut): minimum-description-length cuts of every group, all open intervals of a level at once; see ``mdl_cuts`` for the rule.

    Class counts up to each value are summed once. A level then scores every boundary from
    them and keeps the best of each interval, an aggregate that combines before its
    shuffle. Intervals are broadcast: values stay in their ranges, so no task holds an
    attribute. An interval is known by the rows before it.
    """
    by = list(by)
    if not classes:
        return counts.select(*by, F.col("value").cast("double").alias("cut")).limit(0)
    per = counts.groupBy(*by, "value").agg(F.array(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) for c in classes)).alias("c"))
    work = _running(per, by, len(classes)).withColumn("seg", F.lit(0).cast("long")).checkpoint()
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    same = lambda p: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{p}{c}")) for c in [*by, "seg"]])
    named = lambda df, p, *rest: df.select(*(F.col(c).alias(f"{p}{c}") for c in [*by, "seg"]), *rest)
    zeros = F.array(*(F.lit(0).cast("long") for _ in classes))
    open_ = work.groupBy(*by, "seg").agg(F.max_by("upto", "value").alias("end")).select(*by, "seg", zeros.alias("start"), "end", F.lit(len(classes)).alias("k")).checkpoint()
    found = None
    while True:
        at = work.join(small_side(named(open_, "_o_", "start", "end", "k")), same("_o_")).where(total(F.col("upto")) < total(F.col("end")))
        at = at.withColumns({"left": F.zip_with("upto", "start", lambda x, y: x - y), "right": F.zip_with("end", "upto", lambda x, y: x - y)})
        at = at.withColumns({"nl": total(F.col("left")), "nr": total(F.col("right"))})
        at = at.withColumns({"el": _entropy(F.col("left"), F.col("nl")), "er": _entropy(F.col("right"), F.col("nr"))})
        score = F.round((F.col("nl") * F.col("el") + F.col("nr") * F.col("er")) / (F.col("nl") + F.col("nr")), 9)
        names = ["value", "next", "upto", "start", "end", "k", "left", "right", "nl", "nr", "el", "er"]
        best = at.groupBy(*by, "seg").agg(F.min_by(F.struct(*names), F.struct(score, -F.col("value"))).alias("b")).select(*by, "seg", "b.*")
        n = F.col("nl") + F.col("nr")
        whole = F.zip_with("left", "right", lambda x, y: x + y)
        kinds = lambda c: F.size(F.filter(c, lambda x: x > 0))
        best = best.withColumns({"n": n, "e": _entropy(whole, n), "kl": kinds("left"), "kr": kinds("right")})
        delta = F.log2(F.pow(F.lit(3.0), F.col("k")) - 2) - (F.col("k") * F.col("e") - F.col("kl") * F.col("el") - F.col("kr") * F.col("er"))
        gain = F.col("e") - (F.col("nl") * F.col("el") + F.col("nr") * F.col("er")) / F.col("n")
        splits = best.where(gain > (F.log2(F.col("n") - 1) + delta) / F.col("n")).checkpoint()
        cuts = splits.select(*by, ((F.col("value") + F.col("next")) / 2).alias("cut"))
        found = cuts if found is None else found.union(cuts)
        if not splits.limit(1).count():
            return found
        left = splits.where("nl > 2").select(*by, "seg", "start", F.col("upto").alias("end"), F.col("kl").alias("k"))
        right = splits.where("nr > 2").select(*by, total(F.col("upto")).alias("seg"), F.col("upto").alias("start"), "end", F.col("kr").alias("k"))
        open_ = left.union(right).checkpoint()
        moved = work.join(small_side(named(splits, "_s_", F.col("value").alias("_cut"), total(F.col("upto")).alias("_right"))), same("_s_"))
        work = moved.select(*by, "value", "next", "upto", F.when(F.col("value") > F.col("_cut"), F.col("_right")).otherwise(F.col("seg")).alias("seg")).checkpoint()


def apply_cuts(df: DataFrame, cuts: DataFrame, nums: list[str]) -> DataFrame:
    """Codes in place of the numbers. Cuts come to the driver: a few for each attribute."""
    found: dict[str, list[float]] = {c: [] for c in nums}
    for r in cuts.select("att", "cut").collect():
        found[r.att].append(r.cut)
    return df.withColumns({c: code(F.col(c), sorted(found[c])) for c in nums})
