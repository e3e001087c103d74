"""Decision trees grown level by level: one grouped count and one choice per level for all nodes at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import shared_dir, small_side

#: Ranges into which a number's values are dealt; cuts inside a range are bounded by trying this many classes at most.
BINS, VERTICES = 1024, 6


@dataclass
class Tree:
    """splits: node -> (attribute, None) for a branch per value, or (attribute, cut); leaves: node -> class counts.

    Nodes are paths: "" is the root, "/v" or "/<" and so on follow. The model holds one
    entry per node, not per row.
    """

    classes: list[str]
    splits: dict[str, tuple[str, float | None]] = field(default_factory=dict)
    leaves: dict[str, list[int]] = field(default_factory=dict)
    prior: list[float] = field(default_factory=list)
    m: float = 1.0


def _branch(att: str, cut: Column | None) -> Column:
    """The step from a node to a child."""
    if cut is None:
        return F.concat(F.lit("/"), F.coalesce(F.col(att).cast("string"), F.lit("?")))
    return F.when(F.col(att).isNull(), "/?").when(F.col(att) < cut, "/<").otherwise("/>=")


def _step(rows: DataFrame, splits: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Rows of split nodes move to their child, others stay: a join with the splits, one row for each node."""
    table = rows.sparkSession.createDataFrame([(v, a, c) for v, (a, c) in splits.items()], "node string, _att string, _cut double")
    rows = rows.join(F.broadcast(table), "node", "left")
    branch = F.lit(None).cast("string")
    for att, numeric in sorted({(a, c is not None) for a, c in splits.values()}):
        branch = F.when((F.col("_att") == att) & (F.col("_cut").isNotNull() == F.lit(numeric)), _branch(att, F.col("_cut") if numeric else None)).otherwise(branch)
    return rows.withColumn("node", F.concat("node", F.coalesce(branch, F.lit("")))).drop("_att", "_cut")


def _entropy(counts: list[Column], n: Column) -> Column:
    out = F.lit(0.0)
    for c in counts:
        out = out - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
    return out


def _with_bins(rows: DataFrame, nums: list[str]) -> DataFrame:
    """``rows`` with ``_bin_`` columns: the range, of BINS about equally full ones, in which each number lies."""
    for c in nums:
        cuts = sorted({float(x) for x in rows.select(F.col(c).cast("double").alias(c)).approxQuantile(c, [i / BINS for i in range(1, BINS)], 0.25 / BINS) if x == x})
        splits = [float("-inf"), *(x for x in cuts if abs(x) != float("inf")), float("inf")]
        rows = rows.withColumn("_value", F.col(c).cast("double"))
        rows = Bucketizer(splits=splits, inputCol="_value", outputCol=f"_bin_{c}", handleInvalid="keep").transform(rows).drop("_value").withColumn(f"_bin_{c}", F.col(f"_bin_{c}").cast("int"))
    return rows


def _numeric(rows: DataFrame, nums: list[str], y: list[Column]) -> DataFrame:
    """(node, att, cut, gain, info): the best cut of every number in every open node, of equals the least.

    Class counts of ranges of values come first, so cuts between ranges are scored from a small
    table. Left entropies are concave in the counts, so the best that a cut inside a range
    could do lies where each class is wholly left or right of it; only the values of ranges
    that could still win are sorted, each range for itself. No task holds a number's values.
    """
    ids = range(len(y))
    entry = lambda c: F.struct(F.lit(c).alias("att"), F.col(c).cast("double").alias("val"), F.col(f"_bin_{c}").alias("bin"))
    long = rows.select("node", "y", "n", F.explode(F.array(*map(entry, nums))).alias("e")).select("node", "y", "n", "e.*").where("val is not null")
    per = [c.alias(f"c{i}") for i, c in enumerate(y)]
    t = long.groupBy("node", "att", "bin").agg(*per, F.min("val").alias("low"), F.max("val").alias("val")).checkpoint()
    over = Window.partitionBy("node", "att")
    w = over.orderBy("bin")
    t = t.withColumn("next", F.lead("low").over(w)).withColumns({k: v for i in ids for k, v in ((f"l{i}", F.sum(f"c{i}").over(w.rowsBetween(Window.unboundedPreceding, 0))), (f"a{i}", F.sum(f"c{i}").over(over)))})
    left, whole = [F.col(f"l{i}") for i in ids], [F.col(f"a{i}") for i in ids]
    total = lambda x: sum(x[1:], x[0])

    def gain(left: list[Column]) -> Column:
        right = [a - b for a, b in zip(whole, left, strict=True)]
        nl, nn = total(left), total(whole)
        return _entropy(whole, nn) - (nl * _entropy(left, nl) + (nn - nl) * _entropy(right, nn - nl)) / nn

    def scored(t: DataFrame) -> DataFrame:
        nl, nn = total(left), total(whole)
        return t.where("next is not null").select("node", "att", ((F.col("val") + F.col("next")) / 2).alias("cut"), gain(left).alias("gain"), _entropy([nl, nn - nl], nn).alias("info"))

    # the cut with most gain stands for its attribute
    best = lambda t: t.groupBy("node", "att").agg(F.max_by(F.struct("cut", "gain", "info"), F.struct(F.round("gain", 9), -F.col("cut"))).alias("b")).select("node", "att", "b.*")
    between = best(scored(t))
    inside = t.where("low < val")
    if len(y) <= VERTICES:
        corners = F.explode(F.array(*(F.array(*map(F.lit, corner)) for corner in product((0, 1), repeat=len(y))))).alias("corner")
        ends = inside.select("node", "att", "bin", *whole, *(F.col(f"l{i}") - F.col(f"c{i}") for i in ids), *(f"c{i}" for i in ids), corners)
        ends = ends.toDF("node", "att", "bin", *(f"a{i}" for i in ids), *(f"b{i}" for i in ids), *(f"c{i}" for i in ids), "corner")
        # an empty side has an entropy of null: no gain
        most = ends.groupBy("node", "att", "bin").agg(F.max(gain([F.col(f"b{i}") + F.col(f"c{i}") * F.get("corner", F.lit(i)) for i in ids])).alias("most"))
        rival = most.join(F.broadcast(between.select("node", "att", F.col("gain").alias("known"))), ["node", "att"], "left")
        rival = rival.where(F.coalesce("most", F.lit(0.0)) >= F.coalesce("known", F.lit(-1.0)) - 1e-8).select("node", "att", "bin")
        inside = inside.join(rival, ["node", "att", "bin"], "left_semi")
    open_ = inside.select("node", "att", "bin", *(F.col(f"l{i}") - F.col(f"c{i}") for i in ids), *whole)
    open_ = open_.toDF("node", "att", "bin", *(f"b{i}" for i in ids), *(f"a{i}" for i in ids)).checkpoint()
    if not open_.limit(1).count():
        return between
    fine = long.join(small_side(open_.select("node", "att", "bin")), ["node", "att", "bin"], "left_semi")
    fine = fine.groupBy("node", "att", "bin", "val").agg(*per).join(small_side(open_), ["node", "att", "bin"])
    w = Window.partitionBy("node", "att", "bin").orderBy("val")
    fine = fine.withColumn("next", F.lead("val").over(w)).withColumns({f"l{i}": F.col(f"b{i}") + F.sum(f"c{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in ids})
    return best(between.unionByName(best(scored(fine))))


def _candidates(rows: DataFrame, cats: list[str], nums: list[str], classes: list[str]) -> DataFrame:
    """(node, att, cut, gain, split information) of every possible split of every open node; numbers come with their ranges, see ``_with_bins``."""
    y = [F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) for c in classes]
    ids = range(len(classes))
    out = None
    if cats:
        long = rows.select("node", "y", "n", F.explode(F.array(*(F.struct(F.lit(a).alias("att"), F.coalesce(F.col(a).cast("string"), F.lit("?")).alias("val")) for a in cats))).alias("e"))
        t = long.groupBy("node", "e.att", "e.val").agg(F.sum("n").alias("nv"), *(c.alias(f"c{i}") for i, c in enumerate(y)))
        t = t.withColumn("hv", _entropy([F.col(f"c{i}") for i in ids], F.col("nv")))
        t = t.groupBy("node", "att").agg(F.sum("nv").alias("nn"), F.sum(F.col("nv") * F.col("hv")).alias("rest"), F.sum(-F.col("nv") * F.log2("nv")).alias("iv"), F.count("*").alias("branches"), *(F.sum(f"c{i}").alias(f"c{i}") for i in ids)).where("branches > 1")
        n = F.col("nn")
        out = t.select("node", "att", F.lit(None).cast("double").alias("cut"), (_entropy([F.col(f"c{i}") for i in ids], n) - F.col("rest") / n).alias("gain"), (F.log2(n) + F.col("iv") / n).alias("info"))
    if nums:
        best = _numeric(rows, nums, y)
        out = best if out is None else out.unionByName(best)
    return out


def fit_tree(cells: DataFrame, cats: list[str], nums: list[str], classes: list[str], min_leaf: int = 10, m: float = 1.0, max_depth: int = 12, subset: int | None = None, seed: int = 0) -> Tree:
    """Gain-ratio tree over weighted rows (attributes, y, n): categorical nodes branch by value, numeric ones in <, >= and unknown.

    A node is a leaf under 2 * min_leaf rows, when pure, or without gain. With ``subset``
    each node sees that many attributes only, chosen by a hash of node and attribute.
    """
    shared_dir(cells.sparkSession)
    tree = Tree(classes, m=m)
    # read once: every level starts from a checkpoint
    rows = _with_bins(cells.select(*cats, *nums, "y", "n").checkpoint(), nums).withColumn("node", F.lit(""))
    per = F.array(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)) for c in classes))
    fresh: dict[str, tuple[str, float | None]] = {}
    for depth in range(max_depth + 1):
        if depth:
            live = list(fresh)
            rows = _step(rows.where(F.col("node").isin(live)), fresh).checkpoint()
        counts = {r.node: list(r.c) for r in rows.groupBy("node").agg(per.alias("c")).collect()}
        if depth == 0:
            total = sum(counts.get("", [])) or 1
            tree.prior = [c / total for c in counts.get("", [0] * len(classes))]
        tree.leaves |= counts
        grow = [v for v, c in counts.items() if sum(c) >= 2 * min_leaf and sum(x > 0 for x in c) > 1]
        if not grow or depth == max_depth:
            break
        found = _candidates(rows.where(F.col("node").isin(grow)), cats, nums, classes).where("gain > 1e-9 and info > 0")
        if subset:
            place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "att", F.lit(seed)), "att"))
            found = found.withColumn("_p", place).where(F.col("_p") <= subset)
        key = F.struct(F.round(F.col("gain") / F.col("info"), 9).alias("r"), F.xxhash64(F.lit(0)).alias("z"))
        best = found.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("_k"), "att"))).where("_r = 1")
        fresh = {r.node: (r.att, r.cut) for r in best.select("node", "att", "cut").collect()}
        tree.splits |= fresh
        if not fresh:
            break
    return tree


def leaf_of(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with ``node``: the deepest known node each reaches; a broadcast join per level with the splits of that level."""
    depth: dict[int, dict] = {}
    for node, s in tree.splits.items():
        depth.setdefault(node.count("/"), {})[node] = s
    known = F.array(*map(F.lit, sorted(tree.leaves)))
    rows = rows.withColumn("node", F.lit(""))
    for d in sorted(depth):
        rows = _step(rows.withColumn("_was", F.col("node")), depth[d])
        rows = rows.withColumn("node", F.when(F.array_contains(known, F.col("node")), F.col("node")).otherwise(F.col("_was"))).drop("_was")
    return rows


def score_tree(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with ``p`` per class: (n_y + m * prior) / (n + m) at the leaf."""
    spark = rows.sparkSession
    table = [(v, [(x + tree.m * q) / (sum(c) + tree.m) for x, q in zip(c, tree.prior, strict=True)]) for v, c in tree.leaves.items()]
    leaves = spark.createDataFrame(table, "node string, p array<double>")
    return leaf_of(rows, tree).join(F.broadcast(leaves), "node", "left").drop("node")
