"""How many attributes, and how many parents each, a kDB should keep: one leave-one-out pass for all choices.

Every cell is scored without its own row by each prefix of the attributes under each number of
parents ("links"); the logs of a prefix go on from the shorter one. What comes out is a
confusion matrix with errors per prefix and number of links, an aggregate that combines
before its shuffle; every way to choose reads that.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import binomial_tail
from .bayes import Lookup, Network, array_sum, fit_kdb, log_factor, log_prior, predicted, softmax
from .counts import domain_sizes, labels

#: Errors closer than this are a draw in the sign test.
DRAW = 0.00001


def prefix_confusion(cells: DataFrame, net: Network, links: list[int]) -> DataFrame:
    """(links, prefix, y, pred, n, sse, better, worse) by leave-one-out, for every prefix of ``net.atts`` and number of links.

    ``better`` and ``worse`` count rows on which the prefix errs less or more than all attributes with as many links.
    """
    classes, sizes = labels(cells), domain_sizes(cells, net.atts)
    own = F.array(*(F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in classes))
    less = lambda c: F.zip_with(c, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    lookup = Lookup(cells, classes)
    cut = lambda a, k: net.parents.get(a, [])[:k]
    need = [list(s) for s in dict.fromkeys(tuple(s) for a in net.atts for k in links for s in ([a, *cut(a, k)], cut(a, k)) if s)]
    rows = lookup.add(cells, [], "_ny").withColumn("_ny", less(F.col("_ny")))
    if need:
        rows = lookup.add_all(rows, need, net.atts, "_all").withColumn("_all", F.transform("_all", less))
    at = {tuple(s): i for i, s in enumerate(need)}
    counts = lambda s: F.get(F.col("_all"), F.lit(at[tuple(s)])) if s else F.col("_ny")
    true = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int")
    told = lambda k, i, lp: F.struct(F.lit(k).alias("links"), F.lit(i).alias("prefix"), predicted(softmax(lp), classes).alias("pred"), (1 - F.element_at(softmax(lp), true)).alias("error"))
    every = []
    for k in links:
        rows = rows.withColumn("_lp", log_prior(F.col("_ny"), array_sum(F.col("_ny")), len(classes), net.m))
        rows = rows.withColumn(f"_e{k}_0", told(k, 0, F.col("_lp")))
        for i, a in enumerate(net.atts, 1):
            f = log_factor(counts([a, *cut(a, k)]), counts(cut(a, k)), sizes[a], net.m)
            rows = rows.withColumn("_lp", F.zip_with("_lp", f, lambda x, y: x + y)).withColumn(f"_e{k}_{i}", told(k, i, F.col("_lp")))
        whole = F.col(f"_e{k}_{len(net.atts)}.error")
        every += [F.struct(F.col(f"_e{k}_{i}").alias("e"), whole.alias("whole")) for i in range(len(net.atts) + 1)]
    t = rows.select("y", "n", F.explode(F.array(*every)).alias("x")).select("y", "n", "x.e.*", "x.whole")
    ahead, behind = F.col("whole") - F.col("error") > DRAW, F.col("error") - F.col("whole") > DRAW
    return t.groupBy("links", "prefix", "y", "pred").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("error") * F.col("error")).alias("sse"), F.sum(F.when(ahead, F.col("n")).otherwise(0)).alias("better"), F.sum(F.when(behind, F.col("n")).otherwise(0)).alias("worse"))


def _matthews(conf: dict[tuple[str, str], int]) -> float:
    total, hits = sum(conf.values()), sum(n for (y, p), n in conf.items() if y == p)
    rows, cols = {}, {}
    for (y, p), n in conf.items():
        rows[y], cols[p] = rows.get(y, 0) + n, cols.get(p, 0) + n
    under = sqrt((total**2 - sum(x * x for x in rows.values())) * (total**2 - sum(x * x for x in cols.values())))
    return (total * hits - sum(rows.get(c, 0) * cols.get(c, 0) for c in rows | cols)) / under if under else 0.0


def prefix_losses(confusion: DataFrame, objective: str = "rmse") -> dict[tuple[int, int], tuple[float, int, int]]:
    """(links, prefix) -> (loss, better, worse). rmse; weighted: a class counts by one less its share; mcc: less Matthews' correlation.

    The driver reads a cell for each pair of classes, prefix and number of links.
    """
    cells = confusion.collect()
    out = {}
    for key in sorted({(r["links"], r["prefix"]) for r in cells}):
        mine = [r for r in cells if (r["links"], r["prefix"]) == key]
        total = sum(r["n"] for r in mine)
        share = {}
        for r in mine:
            share[r["y"]] = share.get(r["y"], 0) + r["n"] / total
        if objective == "mcc":
            loss = -_matthews({(r["y"], r["pred"]): r["n"] for r in mine})
        else:
            loss = sqrt(sum(r["sse"] * (1 - share[r["y"]] if objective == "weighted" else 1.0) for r in mine) / total)
        out[key] = (round(loss, 9), sum(r["better"] for r in mine), sum(r["worse"] for r in mine))
    return out


def fit_prefix(cells: DataFrame, atts: list[str], k: int = 1, objective: str = "rmse", links: str = "all", test: float | None = None, m: float = 1.0) -> Network:
    """kDB cut to the prefix of least leave-one-out loss, of equals the shortest, then the fewest links.

    ``links``: "all" parents; "best", one number for all attributes, chosen with the prefix; or
    "each", for every attribute the number that is best where the prefix ends with it. With
    ``test`` the cut must beat all attributes on more rows than it loses, by a sign test at that level.
    """
    net = fit_kdb(cells, atts, k, m)
    numbers = [k] if links == "all" else list(range(k + 1))
    losses = prefix_losses(prefix_confusion(cells, net, numbers), objective)
    best = min(losses, key=lambda c: (losses[c][0], c[1], c[0]))
    loss, better, worse = losses[best]
    if test is not None and best[1] < len(net.atts) and binomial_tail(better, better + worse) > test:
        best = (best[0], len(net.atts))
    keep = net.atts[: best[1]]
    if links == "each":
        many = {a: min(numbers, key=lambda j: (losses[j, i][0], j)) for i, a in enumerate(keep, 1)}
    else:
        many = dict.fromkeys(keep, best[0])
    return Network(keep, {a: net.parents[a][: many[a]] for a in keep}, m)
