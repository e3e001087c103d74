"""Evaluation metrics over scored rows and over tidy result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loss_table(scored: DataFrame, classes: list[str], pred: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """n, zero_one, rmse, rmse_all, logloss of rows with y, p (array) and weight n; log loss is infinite where p is 0."""
    labels = F.array(*map(F.lit, classes))
    py = F.element_at("p", F.array_position(labels, F.col("y")).cast("int"))
    each = F.aggregate(F.zip_with(labels, "p", lambda c, p: F.pow(F.when(c == F.col("y"), 1.0).otherwise(0.0) - p, 2)), F.lit(0.0), lambda a, b: a + b)
    n = F.sum("n")
    return scored.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.when(pred != F.col("y"), F.col("n")).otherwise(0)) / n).alias("zero_one"),
        F.sqrt(F.sum(F.pow(1 - py, 2) * F.col("n")) / n).alias("rmse"),
        F.sqrt(F.sum(each * F.col("n")) / (n * len(classes))).alias("rmse_all"),
        (F.sum(F.when(py > 0, -F.log2(py)).otherwise(float("inf")) * F.col("n")) / n).alias("logloss"),
    )


def confusion(scored: DataFrame, pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., y, pred, n)."""
    return scored.groupBy(*by, "y", F.col(pred).alias("pred")).agg(F.sum("n").alias("n"))


def mcc(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Multiclass correlation from confusion counts (or summed probabilities): one closed form over the margins; 0 where undefined."""
    rows, cols = conf.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("r")), conf.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("k"))
    both = rows.join(cols, [*by, "c"], "full").select(*by, F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("k", F.lit(0.0)).alias("k"))
    margins = both.groupBy(*by).agg(F.sum(F.col("r") * F.col("k")).alias("rk"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    total = conf.groupBy(*by).agg(F.sum("n").cast("double").alias("all"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    t = total.join(margins, list(by)) if by else total.crossJoin(margins)
    under = F.sqrt((F.col("all") * F.col("all") - F.col("kk")) * (F.col("all") * F.col("all") - F.col("rr")))
    return t.select(*by, F.when(under > 0, (F.col("all") * F.col("hits") - F.col("rk")) / under).otherwise(0.0).alias("mcc"))


def mcc_binary(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Two classes: -1 with no hit, 1 with no miss, 0 on an empty margin."""
    under = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(tp + tn == 0, -1.0).when(fp + fn == 0, 1.0).when(under == 0, 0.0).otherwise((tp * tn - fp * fn) / under)


def _by_score(points: DataFrame, by: list[str]) -> DataFrame:
    """Rows of score, pos, neg (counts) summed per score, with running sums from the highest score down."""
    t = points.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))


def roc_auc(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auc) with tied scores half right; null where a class is absent."""
    t = _by_score(points, by)
    # negatives under a score count whole, tied ones half
    all_pos, all_neg = F.sum("pos"), F.sum("neg")
    won = F.sum(F.col("pos") * (F.col("_allneg") - F.col("fp") + F.col("neg") / 2))
    t = t.withColumn("_allneg", F.sum("neg").over(Window.partitionBy(*by)))
    return t.groupBy(*by).agg(F.when((all_pos > 0) & (all_neg > 0), won / (all_pos * all_neg)).alias("auc"))


def roc_points(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score, tpr, fpr, precision): a point per distinct score."""
    w = Window.partitionBy(*by)
    t = _by_score(points, by)
    p, n = F.sum("pos").over(w), F.sum("neg").over(w)
    return t.select(*by, "score", (F.col("tp") / p).alias("tpr"), (F.col("fp") / n).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auprc(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auprc): precision times the step in recall, scores descending."""
    t = _by_score(points, by).withColumn("_all", F.sum("pos").over(Window.partitionBy(*by)))
    step = F.when(F.col("_all") > 0, F.col("pos") / F.col("_all") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.groupBy(*by).agg(F.sum(step).alias("auprc"))


def hand_till(scored: DataFrame, classes: list[str]) -> DataFrame:
    """M measure: mean over class pairs of the mean of the two pairwise AUCs, tied ranks averaged; pairs with an absent class drop out."""
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    entries = F.array(*(F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(c).alias("side"), F.element_at("p", classes.index(c) + 1).alias("score"), F.when(F.col("y") == c, F.col("n")).otherwise(0).alias("pos"), F.when(F.col("y") == (b if c == a else a), F.col("n")).otherwise(0).alias("neg")) for a, b in pairs for c in (a, b)))
    t = scored.select("n", F.explode(entries).alias("e")).select("e.*").where("pos + neg > 0")
    each = roc_auc(t, ["pair", "side"]).groupBy("pair").agg(F.avg("auc").alias("auc"))
    return each.agg(F.avg("auc").alias("auc"))


# --- rank statistics over (dataset, learner, value)

#: Upper 5 % and 10 % points of the studentized range over sqrt 2 (k = 2 ... 10) and upper 5 % points of chi-square (df = 1 ... 10).
RANGE_POINTS = {
    0.05: {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164},
    0.10: {2: 1.645, 3: 2.052, 4: 2.291, 5: 2.459, 6: 2.589, 7: 2.693, 8: 2.780, 9: 2.855, 10: 2.920},
}
CHI_SQUARE_95 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919, 10: 18.307}


def average_ranks(matrix: DataFrame, higher_is_better: bool = False) -> DataFrame:
    """(dataset, learner, value, rank): ranks within each data set, tied ones averaged."""
    w = Window.partitionBy("dataset").orderBy(F.desc("value") if higher_is_better else F.asc("value"))
    ties = F.count("*").over(Window.partitionBy("dataset", "value"))
    return matrix.withColumn("rank", F.rank().over(w) + (ties - 1) / 2)


def complete_matrix(values: DataFrame) -> DataFrame:
    """(dataset, learner, value): repeated runs averaged, data sets kept that every learner has scored (relational division)."""
    m = values.groupBy("dataset", "learner").agg(F.avg("value").alias("value"))
    k = m.agg(F.count_distinct("learner").alias("k"))
    full = m.groupBy("dataset").agg(F.count_distinct("learner").alias("k")).join(F.broadcast(k), "k", "left_semi").select("dataset")
    return m.join(full, "dataset", "left_semi")


def mean_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("learner").agg(F.avg("rank").alias("avg_rank"))


def friedman(ranked: DataFrame) -> DataFrame:
    """One row: n, k, chi2, critical value and whether the ranks differ; null statistic under two data sets or learners."""
    means = mean_ranks(ranked).agg(F.count("*").alias("k"), F.sum(F.pow("avg_rank", 2)).alias("rr"))
    t = means.crossJoin(ranked.agg(F.count_distinct("dataset").alias("n")))
    k, n = F.col("k"), F.col("n")
    chi2 = F.when((n >= 2) & (k >= 2), 12 * n / (k * (k + 1)) * (F.col("rr") - k * (k + 1) * (k + 1) / 4))
    critical = F.create_map(*(F.lit(x) for d, c in CHI_SQUARE_95.items() for x in (d, c)))
    t = t.select("n", "k", chi2.alias("chi2"), F.try_element_at(critical, (k - 1).cast("int")).alias("critical"))
    return t.withColumn("significant", F.col("chi2") > F.col("critical"))


def critical_difference(ranked: DataFrame, level: float = 0.05) -> DataFrame:
    """One row: n, k and the Nemenyi critical difference at level 0.05 or 0.10 (null beyond ten learners)."""
    q = F.create_map(*(F.lit(x) for k, v in RANGE_POINTS[level].items() for x in (k, v)))
    t = ranked.agg(F.count_distinct("learner").alias("k"), F.count_distinct("dataset").alias("n"))
    return t.select("n", "k", (F.try_element_at(q, F.col("k").cast("int")) * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))


def cd_groups(ranked: DataFrame, level: float = 0.05) -> DataFrame:
    """(group, learner, avg_rank): runs of learners whose neighbours in rank are within the critical difference; two or more."""
    cd = critical_difference(ranked, level).select("cd")
    w = Window.orderBy("avg_rank", "learner")
    t = mean_ranks(ranked).crossJoin(F.broadcast(cd)).withColumn("gap", F.col("avg_rank") - F.lag("avg_rank").over(w))
    t = t.withColumn("group", F.sum(F.when(F.col("gap") > F.col("cd"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("_n", F.count("*").over(Window.partitionBy("group"))).where("_n > 1").select("group", "learner", "avg_rank")


def win_draw_loss(matrix: DataFrame, higher_is_better: bool = False) -> DataFrame:
    """(a, b, win, draw, loss) for every pair of learners over the shared data sets."""
    a, b = matrix.select("dataset", F.col("learner").alias("a"), F.col("value").alias("va")), matrix.select("dataset", F.col("learner").alias("b"), F.col("value").alias("vb"))
    better = F.col("va") > F.col("vb") if higher_is_better else F.col("va") < F.col("vb")
    t = a.join(b, "dataset").where("a < b")
    return t.groupBy("a", "b").agg(F.count_if(better).alias("win"), F.count_if(F.col("va") == F.col("vb")).alias("draw"), F.count_if(~better & (F.col("va") != F.col("vb"))).alias("loss"))


def pairwise_significance(ranked: DataFrame) -> DataFrame:
    """(a, b, gap, significant): rank gaps of pairs against the critical difference."""
    m, cd = mean_ranks(ranked), critical_difference(ranked).select("cd")
    a, b = m.select(F.col("learner").alias("a"), F.col("avg_rank").alias("ra")), m.select(F.col("learner").alias("b"), F.col("avg_rank").alias("rb"))
    t = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(cd))
    gap = F.abs(F.col("ra") - F.col("rb"))
    return t.select("a", "b", gap.alias("gap"), (gap > F.col("cd")).alias("significant"))
