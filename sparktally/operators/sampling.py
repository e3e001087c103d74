"""Samples and splits that any engine can repeat: order by a portable hash of the id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import HASH_SPACE, portable_hash

#: Rows that a window may rank at once when places are given.
BUCKET_ROWS = 50_000


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by least hash: what a reservoir would hold, but repeatable. A bounded top-n, no full sort."""
    return df.orderBy(portable_hash(id_col, seed), id_col).limit(n)


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Every row with its ``place`` in a shuffle, from 1; the hashes are even, so equal stretches of them are buckets by the rows counted."""
    h = portable_hash(id_col, seed)
    width = HASH_SPACE // (df.count() // BUCKET_ROWS + 1) + 1
    return placed(df, [F.floor(h / width).alias("_k0")], [h, F.col(id_col)])


def placed(df: DataFrame, buckets: list[Column], order: list[Column]) -> DataFrame:
    """Every row with its ``place`` in ``order``, from 1: the rows of the buckets before its own and its rank within.

    ``buckets`` are columns _k0, _k1, ... that rise with the order; no window spans more than one
    of them, but for one over their counts.
    """
    keys = [f"_k{i}" for i in range(len(buckets))]
    d = df.select("*", *buckets)
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    d = d.join(sizes, keys)
    return d.withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop(*keys, "_before")


def ranges(df: DataFrame, col: str, n: int | None = None) -> Column:
    """The number of the range, of ``n`` about equally full ones (by the rows counted where not given), in which ``col`` lies; the cuts are what reaches the driver."""
    n = n or df.count() // BUCKET_ROWS + 1
    cuts = sorted(set(df.approxQuantile(col, [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(col)))


def uniform(key: str | Column, seed: int | str | Column = 0) -> Column:
    """A number between 0 and 1, neither included."""
    return (portable_hash(key, seed) + 0.5) / float(HASH_SPACE)


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """Weighted sample without replacement: largest u ** (1 / w), as log(u) / w."""
    return df.where(F.col(weight) > 0).withColumn("_k", F.round(F.log(uniform(id_col, seed)) / F.col(weight), 12)).orderBy(F.desc("_k"), id_col).limit(n).drop("_k")


def poisson_steps() -> list[float]:
    """Where the distribution of Poisson(1) steps up, as far as doubles tell it from 1."""
    out, term, total = [], exp(-1), 0.0
    while total + term > total and total + term < 1.0:
        total += term
        out.append(total)
        term /= len(out)
    return out


def drawn(id_col: str, bags: Iterable[int], seed: int = 0) -> Column:
    """An array with the hash of a row in each bag, 13 hexadecimal digits, for ``copies``; to be exploded or transformed, so that MD5 is computed once."""
    return F.array(*(F.struct(F.lit(b).alias("bag"), F.substring(F.md5(F.concat(F.lit(f"{seed}.{b}:"), F.col(id_col).cast("string"))), 1, 13).alias("h")) for b in bags))


def copies(h: Column) -> Column:
    """Poisson(1) copies by a hash of ``drawn``: its number u, as ``uniform`` has it, against the steps, which are written as the least hash that reaches them."""
    out = None
    least = [ceil(Fraction(s) * HASH_SPACE - Fraction(1, 2)) for s in poisson_steps()]
    for times, x in enumerate(least):
        below = h < F.lit(f"{x:013x}")
        # no hash reaches a step past the last one
        if x < HASH_SPACE:
            out = F.when(below, times) if out is None else out.when(below, times)
    return out.otherwise(sum(x < HASH_SPACE for x in least))


def bootstrap_counts(df: DataFrame, id_col: str, bags: int | Iterable[int], seed: int = 0) -> DataFrame:
    """(bag, id..., times): Poisson(1) copies of every row in every bag (or in those named), by inversion of a hash of row and bag. Narrow."""
    d = df.withColumn("_d", F.explode(drawn(id_col, range(bags) if isinstance(bags, int) else bags, seed)))
    d = d.select(*df.columns, F.col("_d.bag").alias("bag"), copies(F.col("_d.h")).alias("times"))
    return d.where("times > 0")


def mersenne_draws(df: DataFrame, place: str, seed: int, name: str = "draw") -> DataFrame:
    """``df`` with the 32-bit draw of its row: the draw number ``place`` (from 1) of a Mersenne Twister seeded with ``seed``.

    Rows are dealt by ranges of places; each task runs its own generator up to its first row
    without keeping what it skips, so draws do not depend on how the rows are dealt. Skipping
    takes some 2 ns a row.
    """
    fields = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` long"
    at = [f.name for f in fields].index(place)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = np.random.RandomState(seed)._bit_generator, 0
        for b in batches:
            if b.num_rows:
                places = b.column(at).to_numpy()
                bits.random_raw(int(places[0]) - 1 - done, output=False)
                done = int(places[-1])
                drawn = bits.random_raw(done - int(places[0]) + 1)[places - places[0]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn.astype(np.int64))], names=[*b.schema.names, name])

    return df.select(*(f.name for f in fields)).repartitionByRange(place).sortWithinPartitions(place).mapInArrow(run, schema)


def drawn_folds(df: DataFrame, place: str, folds: int, exp: int = 0) -> DataFrame:
    """``df`` with ``fold``: the row's draw modulo ``folds``, the generator seeded with the experiment's number."""
    return mersenne_draws(df, place, exp, "_draw").withColumn("fold", (F.col("_draw") % folds).cast("int")).drop("_draw")


def systematic_resample(df: DataFrame, id_col: str, weight: str, n: int) -> DataFrame:
    """Rows as often as n equal steps fall into their stretch of the running weight.

    The running sum is two-level: by blocks of ids, then within each, so it has no global sort.
    """
    block = F.floor(F.col(id_col) / 4096)
    d = df.withColumn("_b", block)
    sums = d.groupBy("_b").agg(F.sum(weight).alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_all", F.sum("_s").over(Window.partitionBy()))
    d = d.join(sums, "_b").withColumn("_hi", F.col("_before") + F.sum(weight).over(Window.partitionBy("_b").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)))
    step = lambda x: F.floor(F.round(x * n / F.col("_all"), 6))
    return d.withColumn("times", (step(F.col("_hi")) - step(F.col("_hi") - F.col(weight))).cast("long")).where("times > 0").drop("_b", "_s", "_before", "_all", "_hi")


def bias_variance_split(df: DataFrame, id_col: str, n_train: int, n_test: int, exp: int = 0) -> DataFrame:
    """Adds ``part``: the same test rows in every experiment, training rows drawn anew from the rest."""
    test = hash_sample(df, id_col, n_test, 0).select(id_col).withColumn("part", F.lit("test"))
    rest = df.join(test, id_col, "left_anti")
    train = hash_sample(rest, id_col, n_train, exp + 1).select(id_col).withColumn("part", F.lit("train"))
    return df.join(test.union(train), id_col)


def attribute_subsets(atts: list[str], size: int, k: int, seed: int = 0) -> list[tuple[str, ...]]:
    """k different random subsets of attributes, on the driver."""
    import random
    from itertools import combinations

    every = list(combinations(atts, size))
    return sorted(random.Random(seed).sample(every, min(k, len(every))))
