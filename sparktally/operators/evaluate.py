"""Evaluation: cross-validation without rescans, hold-out, prequential, learning curves, bias and variance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bayes import LEARNERS, Lookup, log_factor, m_estimate, predicted
from .counts import cuboid, domain_sizes, fold_of, labels
from .elimination import log_factors
from .sampling import hash_sample


def score_cells(cells: DataFrame, atts: list[str], learner: str = "nb", train: DataFrame | None = None, **options) -> tuple[DataFrame, list[str]]:
    """Cells with posterior ``p`` and ``pred``; the model comes from ``train`` (the cells themselves by default)."""
    train = cells if train is None else train
    classes = labels(train)
    model = LEARNERS[learner](train, atts, **options)
    scored = model.score(cells, Lookup(train, classes), domain_sizes(train, atts))
    return scored.withColumn("pred", predicted(F.col("p"), classes)), classes


def cross_validate(df: DataFrame, atts: list[str], learner: str = "nb", folds: int = 10, exp: int = 0, id_col: str = "id", **options) -> tuple[DataFrame, list[str]]:
    """Cells by fold, scored by counts of all other folds. Counted once; training counts are total minus fold.

    Structure (of TAN, kDB and the like) is learnt on all rows; only counts are held out.
    """
    cells = cuboid(df.withColumn("fold", fold_of(id_col, folds, exp)), atts, extra=("fold",))
    whole = cells.groupBy(*atts, "y").agg(F.sum("n").alias("n"))
    classes = labels(whole)
    model = LEARNERS[learner](whole, atts, **options)
    scored = model.score(cells, Lookup(cells, classes, "fold"), domain_sizes(whole, atts))
    return scored.withColumn("pred", predicted(F.col("p"), classes)), classes


def train_test(train: DataFrame, test: DataFrame, atts: list[str], learner: str = "nb", **options) -> tuple[DataFrame, list[str]]:
    """Cells of the test rows scored by a model of the training rows."""
    return score_cells(cuboid(test, atts), atts, learner, cuboid(train, atts), **options)


def counts_before(df: DataFrame, subsets: list[list[str]], classes: list[str], seq: str = "id", block: int = 4096, within: str | None = None, own: bool = False) -> DataFrame:
    """(within, seq, y, counts): per class, how many rows before a row have its values of each subset of attributes.

    The counts before a row are those of all earlier blocks of ``block`` sequence numbers and
    a running sum inside its own block. Running sums over whole blocks see one row for each
    block and tuple of values; no window holds more rows than a block has. With ``within``
    only rows of the same group count; ``own`` counts the row itself as well.
    """
    scope = [within] if within else []
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    hit = {c: F.when(F.col("y") == c, 1).otherwise(0) for c in classes}
    each = F.posexplode(F.array(*(F.array(*(F.col(a).cast("string") for a in s)).cast("array<string>") for s in subsets)))
    long = df.select(*scope, seq, "y", F.call_function("div", F.col(seq), F.lit(block)).alias("_b"), each.alias("_s", "_v"))
    whole = long.groupBy(*scope, "_b", "_s", "_v").agg(*(F.sum(hit[c]).alias(f"_n{i}") for i, c in enumerate(classes)))
    earlier = F.array(*(F.coalesce(F.sum(f"_n{i}").over(before("_b", *scope, "_s", "_v")), F.lit(0)) for i in range(len(classes))))
    whole = whole.select(*(F.col(c).alias(f"_w{c}") for c in [*scope, "_b", "_s", "_v"]), earlier.alias("_e"))
    inside = F.array(*(F.coalesce(F.sum(hit[c]).over(upto(seq, *scope, "_b", "_s", "_v")), F.lit(0)) for c in classes))
    long = long.withColumn("_i", inside).join(whole, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w{c}")) for c in [*scope, "_b", "_s", "_v"]]))
    long = long.select(*scope, seq, "y", "_s", F.zip_with("_e", "_i", lambda x, y: (x + y).cast("double")).alias("_c"))
    return long.groupBy(*scope, seq, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_c"))), lambda x: x["_c"]).alias("counts"))


def prequential_nb(df: DataFrame, atts: list[str], classes: list[str], sizes: dict[str, int], seq: str = "id", block: int = 4096, m: float = 1.0) -> DataFrame:
    """Every row scored by naive Bayes over the rows before it: (seq, y, pred, error)."""
    rows = counts_before(df, [[], *([a] for a in atts)], classes, seq, block)
    counts = lambda i: F.get("counts", F.lit(i))
    ny = counts(0)
    total = F.aggregate(ny, F.lit(0.0), lambda a, b: a + b)
    lp = F.transform(ny, lambda n: F.log(m_estimate(n, total, F.lit(float(len(classes))), m)))
    for i, a in enumerate(atts, 1):
        lp = F.zip_with(lp, log_factor(counts(i), ny, sizes[a], m), lambda x, y: x + y)
    rows = rows.withColumn("pred", predicted(lp, classes))
    return rows.select(seq, "y", "pred", F.when(F.col("pred") != F.col("y"), 1).otherwise(0).alias("error"))


def prequential_members(df: DataFrame, atts: list[str], classes: list[str], sizes: dict[str, int], seq: str = "id", block: int = 4096, m: float = 1.0, within: str | None = None, own: bool = False) -> DataFrame:
    """(within, seq, at, logs): the log joints per class of every member of AODE by the rows before; class index ``at``.

    A member whose value was not seen has nulls. ``logs`` holds the members one after another.
    """
    subsets = [[], *([a] for a in atts), *(list(p) for p in combinations(atts, 2))]
    at = (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int")
    rows = counts_before(df, subsets, classes, seq, block, within, own)
    scope, nc, k = [within] if within else [], len(classes), [sizes[a] for a in atts]
    given = rows.select(*scope, F.col(seq).cast("long").alias(seq), at.alias("at"), "counts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            counts = b.column(b.num_columns - 1).flatten().flatten().to_numpy().reshape(b.num_rows, len(subsets), nc)
            factors, seen = log_factors(counts[:, 0], counts[:, 1:], k, m)
            logs = factors.sum(2)
            flat = pa.array(logs.ravel(), mask=np.repeat(~seen, nc, axis=1).ravel())
            ends = pa.array(np.arange(b.num_rows + 1) * len(k) * nc, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, flat)], names=[*b.schema.names[:-1], "logs"])

    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in given.columns[:-1]) + ", logs array<double>")


def smoothed(errors: DataFrame, seq: str = "id", width: int = 10, block: int = 1000) -> DataFrame:
    """Adds ``recent``: the mean of the last ``width`` errors. Blocks overlap by width, so no window spans the table."""
    d = errors.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor(F.col(seq) / block), F.floor((F.col(seq) + width) / block)))))
    w = Window.partitionBy("_r").orderBy(seq).rowsBetween(-(width - 1), 0)
    return d.withColumn("recent", F.avg("error").over(w)).where(F.col("_r") == F.floor(F.col(seq) / block)).drop("_r")


def interval_rates(errors: DataFrame, seq: str = "id", freq: int = 1000) -> DataFrame:
    """(block, n, error): error rate of every ``freq`` rows."""
    return errors.groupBy(F.floor(F.col(seq) / freq).alias("block")).agg(F.count("*").alias("n"), F.avg("error").alias("error"))


def learning_curve(df: DataFrame, atts: list[str], sizes: list[int], n_test: int, learner: str = "nb", trial: int = 0, id_col: str = "id") -> dict[int, tuple[DataFrame, list[str]]]:
    """Scored test cells for nested training prefixes of one shuffle."""
    test = hash_sample(df, id_col, n_test, 0)
    rest = df.join(test.select(id_col), id_col, "left_anti")
    return {s: train_test(hash_sample(rest, id_col, s, trial + 1), test, atts, learner) for s in sizes}


def bias_variance(predictions: DataFrame) -> DataFrame:
    """One row: bias, variance and loss over (id, y, exp, pred): variance is half the expected disagreement, bias the rest of the loss."""
    n = F.count("*")
    per = predictions.groupBy("id", "y", "pred").agg(n.alias("n"))
    w = Window.partitionBy("id")
    share = F.col("n") / F.sum("n").over(w)
    per = per.withColumn("s", share)
    rows = per.groupBy("id").agg(((1 - F.sum(F.col("s") * F.col("s"))) / 2).alias("var"), F.sum(F.when(F.col("pred") != F.col("y"), F.col("s")).otherwise(0.0)).alias("loss"))
    return rows.agg(F.avg("loss").alias("loss"), F.avg("var").alias("variance"), (F.avg("loss") - F.avg("var")).alias("bias"))


def data_stats(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """One row: rows, attributes, mean number of values, classes."""
    row = df.agg(F.count("*").alias("n_rows"), F.count_distinct("y").alias("n_classes"), *(F.count_distinct(a).alias(f"_{a}") for a in cats))
    values = F.lit(0)
    for a in cats:
        values = values + F.col(f"_{a}")
    return row.select("n_rows", F.lit(len(cats) + len(nums)).cast("long").alias("n_atts"), (values / max(1, len(cats))).alias("avg_values"), "n_classes")


