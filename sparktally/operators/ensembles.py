"""Ensembles over the count learners and trees: bagging, boosting, one model per attribute value, stacking."""

from __future__ import annotations

from itertools import combinations
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bayes import Lookup, array_sum, log_prior, naive_bayes, predicted, softmax
from .counts import cuboid, domain_sizes, labels
from .sampling import bootstrap_counts, copies, drawn
from .trees import fit_tree, score_tree


def _bag_weights(df: DataFrame, atts: list[str], bags: int, id_col: str, seed: int) -> DataFrame:
    """(bag, atts..., y, n): Poisson bootstrap counts of all bags in one pass."""
    # bags lie side by side in a row's sums: rows are not dealt out, only cells
    hashes = df.withColumn("_d", F.explode(F.array(drawn(id_col, range(bags), seed))))
    sums = hashes.groupBy(*atts, "y").agg(*(F.sum(copies(F.col("_d")[b]["h"])).alias(f"_{b}") for b in range(bags)))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bag"), F.col(f"_{b}").alias("n")) for b in range(bags)))).alias("e")
    return sums.select(*atts, "y", each).select("e.bag", *atts, "y", "e.n").where("n > 0")


def bagged_nb(df: DataFrame, atts: list[str], bags: int = 10, id_col: str = "id", seed: int = 0, average: bool = False) -> tuple[DataFrame, list[str]]:
    """Cells scored by naive Bayes of every bag, all bags in one join; majority vote, or mean posterior with ``average``."""
    cells, weights = cuboid(df, atts), _bag_weights(df, atts, bags, id_col, seed)
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    # a bag takes the place of a fold: look-ups by (bag, value)
    rows = cells.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    scored = naive_bayes(atts).score(rows, Lookup(weights, classes, within="bag"), sizes)
    best = predicted(F.col("p"), classes)
    vote = F.col("p") if average else F.transform(F.array(*map(F.lit, classes)), lambda c: F.when(c == best, 1.0).otherwise(0.0))
    sums = [F.sum(vote[i]) / bags for i in range(len(classes))]
    return scored.groupBy(*atts, "y", "n").agg(F.array(*sums).alias("p")), classes


def bagged_trees(df: DataFrame, cats: list[str], nums: list[str], bags: int = 5, id_col: str = "id", subset: int | None = None, seed: int = 0, **options) -> tuple[DataFrame, list[str]]:
    """Rows with the mean leaf posterior of trees on bootstrap bags; with ``subset`` a random forest."""
    classes = labels(df)
    out, votes = df, []
    for b in range(bags):
        bag = bootstrap_counts(df, id_col, [b], seed).withColumn("n", F.col("times"))
        tree = fit_tree(bag, cats, nums, classes, subset=subset, seed=seed + b, **options)
        out = score_tree(out, tree).withColumnRenamed("p", f"_p{b}")
        votes.append(F.col(f"_p{b}"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: sum((F.get(v, i) for v in votes[1:]), F.get(votes[0], i)) / bags)
    return out.withColumn("p", mean).drop(*(f"_p{b}" for b in range(bags))), classes


def adaboost_nb(df: DataFrame, atts: list[str], rounds: int = 10) -> tuple[DataFrame, list[str]]:
    """Boosted naive Bayes over weighted cells: each round multiplies the weights of missed cells by (1 - e) / e; votes are log odds."""
    cells = cuboid(df, atts)
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    total = cells.agg(F.sum("n")).first()[0] or 1
    state = cells.withColumn("w", F.lit(1.0) * F.col("n")).withColumn("votes", F.array(*(F.lit(0.0) for _ in classes)))
    for _ in range(rounds):
        train = state.select(*atts, "y", F.col("w").alias("n"))
        scored = naive_bayes(atts).score(state, Lookup(train, classes), sizes).withColumn("pred", predicted(F.col("p"), classes)).drop("p").checkpoint()
        missed, weight = scored.agg(F.sum(F.when(F.col("pred") != F.col("y"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
        miss = missed / weight
        if miss <= 0 or miss >= 1 - 1 / len(classes):
            break
        alpha = log((1 - miss) / miss) + log(len(classes) - 1)
        hit = F.transform(F.array(*map(F.lit, classes)), lambda c: F.when(c == F.col("pred"), F.lit(alpha)).otherwise(0.0))
        # weights are brought back to their sum: what the hits keep and what the missed grow to
        scale = total / (weight - missed + missed * exp(alpha))
        grown = F.col("w") * F.when(F.col("pred") != F.col("y"), F.lit(exp(alpha))).otherwise(1.0) * F.lit(scale)
        state = scored.withColumn("votes", F.zip_with("votes", hit, lambda a, b: a + b)).withColumn("w", grown).drop("pred")
    s = array_sum(F.col("votes"))
    p = F.when(s > 0, F.transform("votes", lambda v: v / s)).otherwise(F.transform("votes", lambda v: F.lit(1.0 / len(classes))))
    return state.withColumn("p", p).drop("w", "votes"), classes


def feating(df: DataFrame, atts: list[str], order: int = 1) -> tuple[DataFrame, list[str]]:
    """A naive Bayes model for each value (pair, triple) of attributes, voting by mean posterior: wider group-bys, no loop over values."""
    cells = cuboid(df, atts)
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    locals_ = [list(s) for s in combinations(atts, order)]
    need = [list(s) for s in dict.fromkeys(tuple(x) for s in locals_ for x in (s, *([*s, a] for a in atts if a not in s)))]
    at = {tuple(s): i for i, s in enumerate(need)}
    rows, ps = Lookup(cells, classes).add_all(cells, need, atts, "_all"), []
    counts = lambda s: F.get(F.col("_all"), F.lit(at[tuple(s)]))
    for i, s in enumerate(locals_):
        ny = counts(s)
        lp = log_prior(ny, array_sum(ny), len(classes), 1.0)
        for a in atts:
            if a not in s:
                lp = F.zip_with(lp, F.zip_with(counts([*s, a]), ny, _nb_factor(float(sizes[a]))), lambda x, y: x + y)
        rows = rows.withColumn("_lp", lp).withColumn(f"_p{i}", softmax(F.col("_lp"))).drop("_lp")
        ps.append(F.col(f"_p{i}"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda j: sum((F.get(v, j) for v in ps[1:]), F.get(ps[0], j)) / len(ps))
    return rows.withColumn("p", mean).drop("_all", *(f"_p{i}" for i in range(len(ps)))), classes


def _nb_factor(k: float):
    return lambda n, t: F.log((n + 1.0 / k) / (t + 1.0))


def stacked(df: DataFrame, atts: list[str], bases: tuple[str, ...] = ("nb", "aode"), folds: int = 5) -> tuple[DataFrame, list[str]]:
    """Two-stage stacking: out-of-fold base predictions become the attributes of a naive Bayes meta-learner."""
    from .evaluate import cross_validate

    table, classes = None, []
    for b in bases:
        scored, classes = cross_validate(df, atts, b, folds)
        one = scored.select("fold", *atts, "y", "n", F.concat(F.col("pred"), F.lit(":"), F.floor(F.array_max("p") * 10).cast("string")).alias(f"by_{b}"))
        table = one if table is None else table.join(one.drop("n"), ["fold", *atts, "y"])
    meta_atts = [f"by_{b}" for b in bases]
    cells = table.groupBy(*meta_atts, "y").agg(F.sum("n").alias("n"))
    return naive_bayes(meta_atts).score(cells, Lookup(cells, classes), domain_sizes(cells, meta_atts)), classes
