"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is split into certain whole copies and a fraction.
The fraction is an inclusion probability p; documents of a source are ranked by random odds
over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first ones are taken until the
source's remaining words are used up (a fixed-size sample, the size being words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are first summed in so many bins of a source; only the bin where the target falls is sorted.
BINS = 1 << 14


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A repeatable uniform number in [0, 1): 52 bits of md5(seed:key)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return bits.cast("long").cast("double") / F.lit(float(1 << 52))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sources(source, source_size)`` with a weight each: by code point, null last, repeating. One row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def capped_targets(sources: DataFrame, share_num: int = 3, share_den: int = 2, cap: int = 2) -> DataFrame:
    """Adds ``target``: share of all sizes dealt by weight, at most ``cap`` times a source's size, excess dealt again.

    Dealing the excess again until nobody is above is filling to a common level: with the
    sources in order of cap / weight, those whose cap lies under the level of the rest get
    the cap. Whole-number sums, then one division, so any engine gives the same doubles.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # all sums are share_den times the words, to stay whole
    left = share_num * F.sum("source_size").over(every) - share_den * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = share_den * cap * F.col("source_size") * F.col("_rest") <= F.col("_left") * F.col("weight")
    s = sources.withColumn("_left", left).withColumn("_rest", rest).withColumn("_full", full)
    # the first source that is not full sets the level
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_left", "_rest"))).over(every)
    s = s.withColumn("_l", level)
    cut = F.col("weight") * (F.col("_l._left") / (share_den * F.col("_l._rest")).cast("double"))
    return s.select("source", "source_size", "weight", F.when(F.col("_full"), (cap * F.col("source_size")).cast("double")).otherwise(cut).alias("target"))


def mixing_plan(sizes: DataFrame, targets: DataFrame, seed: str = "mix", cap: int = 2) -> DataFrame:
    """One row per source: scale (expected copies of a document of weight 1) and the last rank that is taken.

    ``sizes`` has doc_id, source, size, weight; ``targets`` has source and target. With
    unequal document weights the scale is found by capping and dealing again.
    """
    with scratch() as tables:
        key = F.col("source").eqNullSafe(F.col("_s"))
        plan = sizes.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("mass"), F.max("weight").alias("top"))
        t = targets.select(F.col("source").alias("_s"), "target", "source_size")
        plan = plan.join(t, key).select("source", "source_size", "target", "top", F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0).alias("scale"))
        plan = materialise(plan, "mixplan")
        # every round caps more of the distinct weights, so this ends
        while plan.where(F.col("scale") * F.col("top") > cap + 1e-9).limit(1).count():
            p = plan.select(F.col("source").alias("_s"), "scale", "target")
            over = F.col("scale") * F.col("weight") >= cap
            again = sizes.join(p, key).groupBy("source").agg(
                F.sum(F.when(over, F.col("size")).otherwise(0)).alias("full"), F.sum(F.when(~over, F.col("weight") * F.col("size")).otherwise(0.0)).alias("mass"), F.max(F.when(~over, F.col("weight"))).alias("top")
            )
            t = plan.select(F.col("source").alias("_s"), "source_size", "target", F.col("scale").alias("_scale"))
            plan = materialise(
                again.join(t, key).select("source", "source_size", "target", F.coalesce("top", F.lit(0.0)).alias("top"), F.when(F.col("mass") > 0, (F.col("target") - cap * F.col("full")) / F.col("mass")).otherwise(F.col("_scale")).alias("scale")), "mixplan"
            )
        ranked = materialise(_ranked(sizes, plan, seed, cap), "mixrank")
        need = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
        need = need.join(plan.select(F.col("source").alias("_s"), "target"), key).select("source", (F.col("target") - F.col("sure")).alias("need"))
        bins = ranked.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("size"))
        w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("size").over(w))
        n = need.select(F.col("source").alias("_s"), "need")
        bins = bins.join(n, key).groupBy("source", "need").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("size")).alias("under")))).alias("at"))
        # bins under the crossing one are taken whole; the crossing one is sorted
        b = bins.select(F.col("source").alias("_s"), "need", F.coalesce(F.col("at.bin"), F.lit(BINS)).alias("at_bin"), F.col("at.under").alias("under"))
        inside = ranked.where("p > 0").join(b, key).where(F.col("bin") == F.col("at_bin"))
        inside = inside.groupBy("source", "q", F.col("doc_id"), "need", "under").agg(F.sum("size").alias("size"))
        w = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.withColumn("upto", F.col("under") + F.sum("size").over(w))
        # a document is in if the middle of its words lies before the target
        last = inside.where(2 * F.col("upto") - F.col("size") < 2 * F.col("need")).groupBy("source").agg(F.max(F.struct("q", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("last"))
        l = last.select(F.col("source").alias("_s"), "last")
        full = plan.join(b.select("_s", "at_bin"), key, "left").drop("_s").join(l, key, "left").drop("_s")
        done = materialise(full.select("source", "source_size", "target", "scale", "at_bin", "last"), "mixplan")
        tables.keep(done)
    return done


def _expected(scale: Column, weight: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), scale * weight)


def _with_rank(df: DataFrame, seed: str, cap: int) -> DataFrame:
    """whole, p, q and bin from scale, weight and doc_id."""
    u = F.col("_u")
    df = df.withColumn("_e", _expected(F.col("scale"), F.col("weight"), cap)).withColumn("whole", F.floor("_e")).withColumn("p", F.col("_e") - F.col("whole"))
    df = df.withColumn("_u", unit_hash(F.col("doc_id"), seed))
    df = df.withColumn("q", F.when(F.col("p") > 0, (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))))
    # q / (1 + q) grows with q and lies in [0, 1)
    return df.withColumn("bin", F.floor(F.col("q") / (1.0 + F.col("q")) * BINS)).drop("_e", "_u")


def _ranked(sizes: DataFrame, plan: DataFrame, seed: str, cap: int) -> DataFrame:
    p = plan.select(F.col("source").alias("_s"), "scale")
    return _with_rank(sizes.join(p, F.col("source").eqNullSafe(F.col("_s"))), seed, cap).select("doc_id", "source", "size", "whole", "p", "q", "bin")


def with_copies(docs: DataFrame, plan: DataFrame, seed: str = "mix", cap: int = 2) -> DataFrame:
    """``docs`` (doc_id, source, weight, ...) with ``copies``, source_size and target. Narrow but for the join with the plan."""
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "scale", "at_bin", "last")
    d = _with_rank(docs.join(p, F.col("source").eqNullSafe(F.col("_s")), "left"), seed, cap)
    rank = F.struct(F.col("q"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    taken = (F.col("p") > 0) & ((F.col("bin") < F.col("at_bin")) | ((F.col("bin") == F.col("at_bin")) & F.coalesce(rank <= F.col("last"), F.lit(False))))
    return d.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0)).drop("_s", "scale", "at_bin", "last", "whole", "p", "q", "bin")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sizes, plan) of a mix of ``docs``.

    ``sizes`` holds doc_id, source, size and weight of every row. A null text has size 0, a
    null source is a source of its own, last in order; null ids share one random number;
    rows repeated under an id stand or fall together. Without words every target is 0.
    """
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
    sizes = materialise(sizes, "mixsizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    with scratch():
        targets = materialise(capped_targets(cyclic_weights(sources, weights)), "mixtargets")
        return sizes, mixing_plan(sizes, targets, seed)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weight_col: str | None = None, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as the mix takes it, its columns as they are whatever their names.

    Null ids, null sources and texts, repeated rows and empty tables fare as in ``mix``; an
    empty table comes back empty, and so does one without words.
    """
    sizes, plan = mix(docs, id_col=id_col, source_col=source_col, weight_col=weight_col, seed=seed, **options)
    discard(sizes)
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), weight.alias("weight"), F.struct("*").alias("row"))
    d = with_copies(d, plan, seed).where("copies > 0")
    d = d.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return d.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
