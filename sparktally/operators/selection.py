"""Attribute rankings and selections over small measure tables, and learners that search with them."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import chi_square, chi_square_p, information, symmetric_uncertainty
from .bayes import AnDE, Lookup, Network, array_sum, fit_kdb, log_factor, log_prior, mi_order, softmax
from .counts import cube, cuboid, domain_sizes, labels
from .discretise import mdl
from .session import shared_dir, small_side


def _pairs(df: DataFrame) -> dict[frozenset, float]:
    return {frozenset((r.a1, r.a2)): round(r.value, 9) for r in df.collect()}


def _relevance(cells: DataFrame, atts: list[str]) -> dict[str, float]:
    return {r.a1: round(r.value, 9) for r in information(cube(cells, atts, 1), ["a1"], ["v1"], ["y"]).collect()}


def greedy_rank(atts: list[str], first: dict[str, float], gain) -> list[str]:
    """Attributes in the order of a greedy search; ties by place. ``gain(a, chosen)`` rates the next one."""
    out: list[str] = [max(atts, key=lambda a: (first[a], -atts.index(a)))]
    while len(out) < len(atts):
        out.append(max((a for a in atts if a not in out), key=lambda a: (round(gain(a, out), 9), -atts.index(a))))
    return out


def rank_attributes(cells: DataFrame, atts: list[str], how: str = "mrmr") -> list[str]:
    """mrmr: MI / (mean AMI + 0.01); diff: MI - mean AMI; mifs: MI - sum AMI; jmi: sum of PMI; mmcmi: least CMI(a; y | chosen)."""
    mi, two = _relevance(cells, atts), cube(cells, atts, 2)
    by = ["a1", "a2"]
    if how == "mi":
        return mi_order(cells, atts)
    if how == "jmi":
        pmi = _pairs(information(two, by, ["v1", "v2"], ["y"]))
        return greedy_rank(atts, mi, lambda a, s: sum(pmi[frozenset((a, b))] for b in s))
    if how == "mmcmi":
        c = {(r.a1, r.a2): r.value for r in information(two, by, ["v1"], ["y"], ("v2",)).collect()}
        c |= {(r.a2, r.a1): r.value for r in information(two, by, ["v2"], ["y"], ("v1",)).collect()}
        return greedy_rank(atts, mi, lambda a, s: min(c[a, b] for b in s))
    ami = _pairs(information(two, by, ["v1"], ["v2"]))
    rates = {
        "mrmr": lambda a, s: mi[a] / (sum(ami[frozenset((a, b))] for b in s) / len(s) + 0.01),
        "diff": lambda a, s: mi[a] - sum(ami[frozenset((a, b))] for b in s) / len(s),
        "mifs": lambda a, s: mi[a] - sum(ami[frozenset((a, b))] for b in s),
    }
    return greedy_rank(atts, mi, rates[how])


def chi_square_select(cells: DataFrame, atts: list[str], level: float = 0.05) -> list[str]:
    """Attributes whose dependence on the class passes ``level`` shared among all; the best one if none does."""
    p = {r.a1: r.p for r in chi_square_p(chi_square(cube(cells, atts, 1), ["a1"], "v1", "y")).collect()}
    return [a for a in atts if p[a] <= level / len(atts)] or [min(atts, key=lambda a: (p[a], atts.index(a)))]


def holm(p: dict, level: float = 0.05) -> set:
    """The hypotheses that Holm's step-down rejects: the least p against level / m, the next against level / (m - 1), up to the first that is not."""
    out = set()
    for i, key in enumerate(sorted(p, key=lambda k: (p[k], str(k)))):
        if p[key] > level / (len(p) - i):
            break
        out.add(key)
    return out


def dependent(p: dict, how: str | None, level: float = 0.05) -> set:
    """Keys whose p passes: each by itself, by Holm's step-down, or all where there is no test."""
    if how is None:
        return set(p)
    return holm(p, level) if how == "holm" else {k for k, v in p.items() if v <= level}


def _conditional_triples(cells: DataFrame, atts: list[str]) -> dict[tuple[str, str, str], float]:
    """(a, b, c) -> CMI(a; b | c, y), both ways for a and b."""
    three, by, out = cube(cells, atts, 3), ["a1", "a2", "a3"], {}
    for x, y, z in ((1, 2, 3), (1, 3, 2), (2, 3, 1)):
        for r in information(three, by, [f"v{x}"], [f"v{y}"], (f"v{z}", "y")).collect():
            a, b, c = r[f"a{x}"], r[f"a{y}"], r[f"a{z}"]
            out[a, b, c] = out[b, a, c] = round(r["value"], 9)
    return out


def fit_extended_kdb(cells: DataFrame, atts: list[str], k: int = 1, order: str = "mi", rank: str = "mi", parents: str = "cmi", tested: str | None = None, parents_tested: str | None = None, level: float = 0.05, backoff: int | None = None, seed: int = 0, m: float = 1.0) -> Network:
    """kDB with a choice of order, parents and tests; what the driver holds is one number for each pair (or triple) of attributes.

    order: "mi" by ``rank`` (mi or su) with the class; "value" by the sum of an attribute's CMI with
    all others; "cmi" by the least CMI(a; y | chosen), greedily; "random". parents, of the
    attributes before: "cmi" the k of most CMI(a; b | y); "mcmi" the first likewise, then by the
    least CMI(a; b | parent, y) over the parents so far, while that is above 0; "random". ``tested`` drops attributes
    that do not depend on the class by a chi-square test, ``parents_tested`` candidates that do
    not depend on the attribute: "each" at ``level``, or "holm" by step-down over the tests of
    one kind (for parents those of one attribute). ``backoff`` is the least count of a parent tuple.
    """
    rng = random.Random(seed)
    place = {a: i for i, a in enumerate(atts)}
    two = cube(cells, atts, 2) if len(atts) > 1 else None
    cmi = _pairs(information(two, ["a1", "a2"], ["v1"], ["v2"], ("y",))) if two else {}
    link = lambda a, b: cmi[frozenset((a, b))]
    if order == "mi":
        if rank == "su":
            value = {r.a1: round(r.value or 0.0, 9) for r in symmetric_uncertainty(cube(cells, atts, 1), ["a1"], ["v1"], ["y"]).collect()}
        else:
            value = _relevance(cells, atts)
        ranked = sorted(atts, key=lambda a: (-value[a], place[a]))
    elif order == "value":
        ranked = sorted(atts, key=lambda a: (-round(sum(link(a, b) for b in atts if b != a), 9), place[a]))
    elif order == "cmi":
        ranked = rank_attributes(cells, atts, "mmcmi")
    else:
        ranked = rng.sample(atts, len(atts))
    if tested:
        p = {r["a1"]: r["p"] for r in chi_square_p(chi_square(cube(cells, atts, 1), ["a1"], "v1", "y").where("df > 0")).collect()}
        good = dependent(p, tested, level)
        ranked = [a for a in ranked if a in good]
    p = {}
    if parents_tested and two:
        p = {frozenset((r["a1"], r["a2"])): r["p"] for r in chi_square_p(chi_square(two, ["a1", "a2"], "v1", "v2")).collect()}
    triples = _conditional_triples(cells, atts) if parents == "mcmi" and k > 1 and len(atts) > 2 else {}
    chosen: dict[str, list[str]] = {}
    for i, a in enumerate(ranked):
        able = dependent({b: p.get(frozenset((a, b)), 1.0) for b in ranked[:i]}, parents_tested, level)
        able = [b for b in ranked[:i] if b in able]
        if parents == "random":
            chosen[a] = rng.sample(able, min(k, len(able)))
            continue
        by_link = sorted(able, key=lambda b: (-link(a, b), ranked.index(b)))
        mine = by_link[: 1 if parents == "mcmi" else k]
        while parents == "mcmi" and 0 < len(mine) < k:
            rest = [b for b in able if b not in mine]
            least = {b: min(triples[a, b, c] for c in mine) for b in rest}
            best = max(rest, key=lambda b: (least[b], -ranked.index(b)), default=None)
            if best is None or least[best] <= 0:
                break
            mine.append(best)
        chosen[a] = mine
    return Network(ranked, chosen, m, backoff)


def correlation_filter(cells: DataFrame, atts: list[str]) -> list[str]:
    """Best first by SU with the class; an attribute goes when a better one is as close to it as the class is."""
    su = {r.a1: round(r.value or 0.0, 9) for r in symmetric_uncertainty(cube(cells, atts, 1), ["a1"], ["v1"], ["y"]).collect()}
    pair = {frozenset((r.a1, r.a2)): round(r.value or 0.0, 9) for r in symmetric_uncertainty(cube(cells, atts, 2), ["a1", "a2"], ["v1"], ["v2"]).collect()}
    keep: list[str] = []
    for a in sorted(atts, key=lambda a: (-su[a], atts.index(a))):
        if all(pair[frozenset((a, b))] < su[a] for b in keep):
            keep.append(a)
    return keep


def _loo_rows(cells: DataFrame, atts: list[str]):
    """(rows, classes, sizes, name): cells with the counts of every attribute and pair, their own row taken out."""
    classes, sizes = labels(cells), domain_sizes(cells, atts)
    lookup = Lookup(cells, classes)
    own = F.array(*(F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in classes))
    rows = lookup.add(cells, [], "_ny").withColumn("_ny", F.zip_with("_ny", own, lambda n, o: n - o))
    place = {a: i for i, a in enumerate(atts)}
    name = lambda *s: "_c_" + "_".join(sorted(s, key=place.get))
    subsets = [s for i, a in enumerate(atts) for s in [(a,)] + [(a, b) for b in atts[i + 1 :]]]
    rows = lookup.add_all(rows, [list(s) for s in subsets], atts, "_all")
    without = (F.zip_with(F.get(F.col("_all"), F.lit(i)), own, lambda n, o: F.greatest(n - o, F.lit(0.0))).alias(name(*s)) for i, s in enumerate(subsets))
    rows = rows.select("*", *without).drop("_all")
    return rows, classes, sizes, name


def spode_scores(cells: DataFrame, atts: list[str], order: list[str], m: float = 1.0) -> DataFrame:
    """(parents, children, n, sse): leave-one-out error of AODE for every prefix of parents and of children.

    Both prefixes run over ``order``; one pass over the cells, each cell once for all of the
    grid. The grid has len(atts) squared points.
    """
    rows, classes, sizes, name = _loo_rows(cells, atts)
    true = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int")
    zeros, errors = F.array(*(F.lit(0.0) for _ in classes)), []
    for nc in range(len(order) + 1):
        total = zeros
        for i, p in enumerate(order):
            lp = log_prior(F.col(name(p)), array_sum(F.col("_ny")), len(classes) * sizes[p], m)
            for c in order[:nc]:
                if c != p:
                    lp = F.zip_with(lp, log_factor(name(p, c), name(p), sizes[c], m), lambda x, y: x + y)
            vote = F.transform(lp, lambda x: F.exp(x))
            rows = rows.withColumn(f"_s{nc}_{i}", F.when(array_sum(F.col(name(p))) > 0, F.zip_with(total, vote, lambda x, y: x + y)).otherwise(total))
            total = F.col(f"_s{nc}_{i}")
            share = F.element_at(total, true) / F.nullif(array_sum(total), F.lit(0.0))
            errors.append((i + 1, nc, F.pow(1 - F.coalesce(share, F.lit(1.0 / len(classes))), 2) * F.col("n")))
    sums = rows.agg(F.sum("n").alias("n"), *(F.sum(e).alias(f"e{p}_{c}") for p, c, e in errors))
    grid = F.array(*(F.struct(F.lit(p).alias("parents"), F.lit(c).alias("children"), F.col(f"e{p}_{c}").alias("sse")) for p, c, _ in errors))
    return sums.select("n", F.explode(grid).alias("g")).select("g.parents", "g.children", "n", "g.sse")


def fit_aode_loo(cells: DataFrame, atts: list[str], how: str = "mi", m: float = 1.0) -> AnDE:
    """AODE with the parent and child prefixes of least leave-one-out error."""
    order = rank_attributes(cells, atts, how)
    best = min(spode_scores(cells, atts, order, m).collect(), key=lambda r: (round(r.sse, 9), r.parents, r.children))
    return AnDE(atts, 1, m, selected=order[: best.parents], children=order[: best.children])


def loo_weights(cells: DataFrame, atts: list[str], m: float = 1.0) -> dict[frozenset, float]:
    """Parent weights: one minus the leave-one-out RMSE of the parent's own model, normalised. One pass for all parents."""
    rows, classes, sizes, name = _loo_rows(cells, atts)
    true = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int")
    errors = []
    for i, p in enumerate(atts):
        lp = log_prior(F.col(name(p)), array_sum(F.col("_ny")), len(classes) * sizes[p], m)
        for c in atts:
            if c != p:
                lp = F.zip_with(lp, log_factor(name(p, c), name(p), sizes[c], m), lambda x, y: x + y)
        rows = rows.withColumn(f"_l{i}", lp).withColumn(f"_l{i}", softmax(F.col(f"_l{i}")))
        errors.append(F.sum(F.pow(1 - F.element_at(f"_l{i}", true), 2) * F.col("n")).alias(f"e{i}"))
    r = rows.agg(F.sum("n").alias("n"), *errors).first()
    out = {frozenset((a,)): 1 - (r[f"e{i}"] / r["n"]) ** 0.5 for i, a in enumerate(atts)}
    total = sum(out.values()) or 1.0
    return {k: v / total for k, v in out.items()}


@dataclass
class GaussianNetwork:
    """kDB whose structure is learnt on discretised numbers and whose numeric factors are normal per parent values and class."""

    net: Network
    cats: list[str]
    nums: dict[str, str]
    m: float = 1.0

    def score(self, rows: DataFrame, train: DataFrame, classes: list[str]) -> DataFrame:
        """``rows`` with ``p``; ``nums`` maps a discretised attribute to its number. Groups under two rows fall back to the class."""
        cells = cuboid(train, self.net.atts)
        sizes = domain_sizes(cells, self.net.atts)
        cat_only = [a for a in self.net.atts if a not in self.nums]
        rows = self.net.score(rows, Lookup(cells, classes), sizes, order=cat_only).withColumn("_lp", F.transform("p", lambda x: F.log(x)))
        for a, x in self.nums.items():
            ps = self.net.parents.get(a, [])
            for keys, tag in ((ps, "g"), ([], "c")):
                per = lambda f: F.array(*(f(F.when(F.col("y") == c, F.col(x))) for c in classes))
                t = train.groupBy(*keys).agg(per(F.avg).alias(f"_m{tag}"), per(F.stddev_samp).alias(f"_s{tag}"))
                rows = rows.join(t, keys, "left") if keys else rows.crossJoin(F.broadcast(t))
            one = lambda i, a: F.get(F.col(a), i)
            dens = []
            for i in range(len(classes)):
                ok = one(i, "_sg") > 0
                mu, sd = F.when(ok, one(i, "_mg")).otherwise(one(i, "_mc")), F.when(ok, one(i, "_sg")).otherwise(one(i, "_sc"))
                dens.append(F.coalesce(-F.log(sd) - F.pow((F.col(x) - mu) / sd, 2) / 2, F.lit(0.0)))
            rows = rows.withColumn("_lp", F.zip_with("_lp", F.array(*dens), lambda p, q: p + q)).drop("_mg", "_sg", "_mc", "_sc")
        return rows.withColumn("p", softmax(F.col("_lp"))).drop("_lp")


def fit_gaussian_kdb(train: DataFrame, cats: list[str], nums: dict[str, str], k: int = 1, m: float = 1.0) -> GaussianNetwork:
    """``nums``: discretised column -> number column."""
    return GaussianNetwork(fit_kdb(cuboid(train, [*cats, *nums]), [*cats, *nums], k, m), cats, nums, m)


def conditional_cuts(train: DataFrame, att: str, parents: list[str], classes: list[str], min_rows: int = 1, backoff: bool = False) -> DataFrame:
    """(parents..., cuts): MDL cuts of a number anew for each tuple of parent values, those of all tuples found level by level.

    A tuple with fewer than ``min_rows`` known values has no cuts of its own: none at all, or
    with ``backoff`` those of its longest prefix that has enough, in the end of the whole column.
    """
    shared_dir(train.sparkSession)
    depths = range(len(parents) + 1) if backoff else [len(parents)]
    known = train.where(F.col(att).isNotNull()).select("y", F.col(att).cast("double").alias("value"), *parents)
    entries = F.array(*(F.array(*(F.col(p).cast("string") for p in parents[:d])).cast("array<string>") for d in depths))
    long = known.select("y", "value", F.explode(entries).alias("group"))
    counts = long.groupBy("group", "value", "y").agg(F.count("*").alias("n"))
    enough = counts.groupBy("group").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_rows).select("group").checkpoint()
    # broadcast: the shortest prefix is a group of all rows, which no task should hold
    cuts = mdl(counts.join(small_side(enough), "group", "left_semi"), classes, ("group",)).groupBy("group").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    cuts = enough.join(cuts, "group", "left").select("group", F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))
    tuples = known.select(*parents).distinct()
    tries = tuples.select(*parents, F.posexplode(entries).alias("depth", "group")).join(cuts, "group", "left")
    best = tries.groupBy(*parents).agg(F.max_by("cuts", F.when(F.col("cuts").isNotNull(), F.col("depth"))).alias("cuts"))
    return best.select(*parents, F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))
