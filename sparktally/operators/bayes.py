"""Bayesian network and AnDE learners as count look-ups joined to the rows to score.

A model is a set of count tables keyed by attribute values, each with an array of counts per
class. Scoring joins them to the rows (broadcast where Spark finds them small) and combines
the arrays in place: no row is exploded and, with small tables, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import information
from .counts import class_counts, cube, cuboid, domain_sizes, labels


def m_estimate(n: Column, total: Column, k: Column | float, m: float = 1.0) -> Column:
    """(n + m / k) / (total + m)."""
    return (n + m / k) / (total + m)


def log_factor(n: str | Column, total: str | Column, k: float, m: float) -> Column:
    """Log m-estimates of an array of counts over an array of totals."""
    return F.zip_with(n, total, lambda a, b: F.log(m_estimate(a, b, F.lit(float(k)), m)))


def log_prior(n: Column, total: Column, k: float, m: float, plus: float = 0.0) -> Column:
    """Log m-estimates of an array of counts over one total."""
    return F.transform(n, lambda a: F.log(m_estimate(a, total, F.lit(float(k)), m)) + plus)


class Lookup:
    """Training counts of attribute tuples, looked up for rows to score.

    With ``fold_col`` the rows to score carry a fold and the counts are those of all other
    folds: total minus own fold, so cross-validation counts once and never rescans. With
    ``within`` both sides carry a group, such as a bag, and only the row's own group counts.
    """

    def __init__(self, cells: DataFrame, classes: list[str], fold_col: str | None = None, within: str | None = None) -> None:
        self.cells, self.classes, self.fold = cells, classes, fold_col
        self.scope = [within] if within else []

    def add(self, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """``rows`` with ``name``: counts per class as array<double>, zeros where nothing was seen."""
        zeros, keys = F.array(*(F.lit(0).cast("long") for _ in self.classes)), [*self.scope, *keys]
        total = class_counts(self.cells, keys, self.classes, "_t")
        rows = rows.join(total, keys, "left") if keys else rows.crossJoin(F.broadcast(total))
        out = F.coalesce("_t", zeros)
        if self.fold:
            own = class_counts(self.cells, [self.fold, *keys], self.classes, "_o")
            rows = rows.join(own, [self.fold, *keys], "left")
            out = F.zip_with(out, F.coalesce("_o", zeros), lambda t, o: t - o)
        return rows.withColumn(name, F.transform(out, lambda x: x.cast("double"))).drop("_t", "_o")

    def add_all(self, rows: DataFrame, subsets: list[list[str]], atts: list[str], name: str) -> DataFrame:
        """``rows`` with ``name``: the counts per class of each subset of attributes, as an array of arrays in the subsets' order.

        One long table of counts for all subsets and one join, however many there are.
        """
        zeros = F.array(*(F.lit(0).cast("long") for _ in self.classes))
        fold = [self.fold] if self.fold else []
        own_keys = [*self.scope, *fold]

        def entries(df: DataFrame, extra: list[str]) -> DataFrame:
            # an unknown value has no counts, so such a tuple is null and finds none
            values = lambda keys: F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)), F.array(*(F.col(k).cast("string") for k in keys)).cast("array<string>"))
            each = F.posexplode(F.array(*(values(keys) for keys in subsets)))
            return df.select(*extra, each.alias("_s", "_v"))

        def counted(by: list[str], name: str) -> DataFrame:
            own = entries(self.cells, [*by, "y", "n"]).where(F.col("_v").isNotNull()).groupBy(*by, "_s", "_v")
            sums = own.agg(*(F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"_n{i}") for i, c in enumerate(self.classes)))
            return sums.select(*by, "_s", "_v", F.array(*(f"_n{i}" for i in range(len(self.classes)))).alias(name))

        tuples = rows.select(*own_keys, *atts).distinct()
        found = entries(tuples, [*own_keys, *atts]).join(counted(self.scope, "_t"), [*self.scope, "_s", "_v"], "left")
        out = F.coalesce("_t", zeros)
        if fold:
            found = found.join(counted(own_keys, "_o"), [*own_keys, "_s", "_v"], "left")
            out = F.zip_with(out, F.coalesce("_o", zeros), lambda t, o: t - o)
        found = found.select(*own_keys, *atts, "_s", F.transform(out, lambda x: x.cast("double")).alias("_c"))
        found = found.groupBy(*own_keys, *atts).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_c"))), lambda x: x["_c"]).alias(name))
        found = found.select(name, *(F.col(c).alias(f"_k_{c}") for c in [*own_keys, *atts]))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*own_keys, *atts]])
        return rows.join(found, same).drop(*(f"_k_{c}" for c in [*own_keys, *atts]))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def softmax(logs: Column) -> Column:
    """Posterior from log scores, shifted by the largest."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    s = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / s)


@dataclass
class Network:
    """parents[a]: the attributes that condition ``a`` next to the class, closest first; naive Bayes has none.

    A tuple of parent values that was not seen leaves 1 / |a|. With ``backoff`` the last
    parents are left out instead, until at least so many rows have the values of the rest.
    """

    atts: list[str]
    parents: dict[str, list[str]] = field(default_factory=dict)
    m: float = 1.0
    backoff: int | None = None

    def prefixes(self, a: str) -> list[list[str]]:
        """The parents that may condition ``a``, most first: one list, or with back-off each shorter one as well."""
        ps = self.parents.get(a, [])
        return [ps[:d] for d in range(len(ps), -1 if self.backoff else len(ps) - 1, -1)]

    def subsets(self, atts: list[str]) -> list[list[str]]:
        """The attribute tuples whose counts the factors of ``atts`` need: one path of a prefix trie for each attribute."""
        need = [s for a in atts for ps in self.prefixes(a) for s in ([a, *ps], ps) if s]
        return [list(s) for s in dict.fromkeys(map(tuple, need))]

    def factor(self, a: str, counts: Callable[[list[str]], Column], size: int) -> Column:
        """Logs of P(a | parents, y) per class; ``counts`` gives the looked-up array of a tuple, that of the classes for none."""
        out = None
        for ps in reversed(self.prefixes(a)):
            f = log_factor(counts([a, *ps]), counts(ps), size, self.m)
            out = f if out is None else F.when(array_sum(counts(ps)) >= self.backoff, f).otherwise(out)
        return out

    def score(self, rows: DataFrame, lookup: Lookup, sizes: dict[str, int], order: list[str] | None = None) -> DataFrame:
        """``rows`` with ``p``: the posterior per class. All counts come by one join, however many attributes and parents there are."""
        nc, atts = len(lookup.classes), self.atts if order is None else order
        rows, need = lookup.add(rows, [], "_ny"), self.subsets(atts)
        if need:
            rows = lookup.add_all(rows, need, [a for a in self.atts if any(a in s for s in need)], "_all")
        at = {tuple(s): i for i, s in enumerate(need)}
        counts = lambda s: F.get(F.col("_all"), F.lit(at[tuple(s)])) if s else F.col("_ny")
        lp = F.transform(F.col("_ny"), lambda n: F.log(m_estimate(n, array_sum(F.col("_ny")), F.lit(float(nc)), self.m)))
        for a in atts:
            lp = F.zip_with(lp, self.factor(a, counts, sizes[a]), lambda x, y: x + y)
        return rows.withColumn("_lp", lp).withColumn("p", softmax(F.col("_lp"))).drop("_lp", "_ny", *(["_all"] if need else []))


def naive_bayes(atts: list[str], m: float = 1.0) -> Network:
    return Network(atts, {}, m)


def pair_cmi(cells: DataFrame, atts: list[str]) -> DataFrame:
    """(a1, a2, value): CMI(a1; a2 | y) of every pair."""
    return information(cube(cells, atts, 2), ["a1", "a2"], ["v1"], ["v2"], ("y",))


def class_mi(cells: DataFrame, atts: list[str]) -> DataFrame:
    """(a1, value): MI(a1; y) of every attribute."""
    return information(cube(cells, atts, 1), ["a1"], ["v1"], ["y"])


def _cmi_table(cells: DataFrame, atts: list[str]) -> dict[frozenset, float]:
    """On the driver: a number for every pair of attributes, rounded against ties in the last digits."""
    if len(atts) < 2:
        return {}
    return {frozenset((r.a1, r.a2)): round(r.value, 9) for r in pair_cmi(cells, atts).collect()}


def mi_order(cells: DataFrame, atts: list[str]) -> list[str]:
    """Attributes by MI with the class, largest first; ties by place."""
    mi = {r.a1: round(r.value, 9) for r in class_mi(cells, atts).collect()}
    return sorted(atts, key=lambda a: (-mi[a], atts.index(a)))


def fit_tan(cells: DataFrame, atts: list[str], m: float = 1.0) -> Network:
    """Tree-augmented naive Bayes: a maximum spanning tree of CMI, grown from the first attribute."""
    cmi, inside, parents = _cmi_table(cells, atts), atts[:1], {}
    while len(inside) < len(atts):
        child, parent = max(((c, p) for c in atts if c not in inside for p in inside), key=lambda e: (cmi[frozenset(e)], -atts.index(e[0]), -atts.index(e[1])))
        parents[child] = [parent]
        inside.append(child)
    return Network(atts, parents, m)


def fit_kdb(cells: DataFrame, atts: list[str], k: int = 1, m: float = 1.0, backoff: int | None = None) -> Network:
    """k-dependence Bayes: the k best by CMI among the attributes that rank before by MI, best first; k = 0 is naive Bayes."""
    order, cmi, parents = mi_order(cells, atts), _cmi_table(cells, atts), {}
    for i, a in enumerate(order):
        parents[a] = sorted(order[:i], key=lambda b: (-cmi[frozenset((a, b))], order.index(b)))[:k]
    return Network(order, parents, m, backoff)


def fit_cbn(cells: DataFrame, atts: list[str], dof: int, m: float = 1.0) -> Network:
    """Parents within a budget of degrees of freedom for each attribute, best CMI first."""
    order, cmi, sizes = mi_order(cells, atts), _cmi_table(cells, atts), domain_sizes(cells, atts)
    classes, parents = len(labels(cells)), {}
    for i, a in enumerate(order):
        used, mine = (sizes[a] - 1) * classes, []
        for b in sorted(order[:i], key=lambda b: (-cmi[frozenset((a, b))], order.index(b))):
            if used > dof / 2:
                break
            if used * sizes[b] <= dof:
                mine.append(b)
                used *= sizes[b]
        parents[a] = mine
    return Network(order, parents, m)


def prefix_errors(cells: DataFrame, net: Network, lookup: Lookup, sizes: dict[str, int], order: list[str]) -> DataFrame:
    """(prefix, n, sse): leave-one-out squared error of every attribute prefix of a network.

    The row's own cell is taken out of the counts of its true class; the log factors of a
    prefix are a running sum, so all prefixes come from one pass over the cells.
    """
    classes = lookup.classes
    own = F.array(*(F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in classes))
    less = lambda c: F.zip_with(c, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    rows, need = lookup.add(cells, [], "_ny").withColumn("_ny", less(F.col("_ny"))), net.subsets(order)
    if need:
        rows = lookup.add_all(rows, need, [a for a in net.atts if any(a in s for s in need)], "_all")
        rows = rows.withColumn("_all", F.transform("_all", less))
    at = {tuple(s): i for i, s in enumerate(need)}
    counts = lambda s: F.get(F.col("_all"), F.lit(at[tuple(s)])) if s else F.col("_ny")
    lp = F.transform(F.col("_ny"), lambda n: F.log(m_estimate(n, array_sum(F.col("_ny")), F.lit(float(len(classes))), net.m)))
    rows = rows.withColumn("_lp", lp)
    true = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int")
    err = lambda: F.pow(1 - F.element_at(softmax(F.col("_lp")), true), 2) * F.col("n")
    rows = rows.withColumn("_e0", err())
    for i, a in enumerate(order, 1):
        rows = rows.withColumn("_lp", F.zip_with("_lp", net.factor(a, counts, sizes[a]), lambda x, y: x + y)).withColumn(f"_e{i}", err())
    sums = rows.agg(F.sum("n").alias("n"), *(F.sum(f"_e{i}").alias(f"_e{i}") for i in range(len(order) + 1)))
    return sums.select("n", F.explode(F.array(*(F.struct(F.lit(i).alias("prefix"), F.col(f"_e{i}").alias("sse")) for i in range(len(order) + 1)))).alias("e")).select("e.prefix", "n", "e.sse")


def fit_selective_kdb(cells: DataFrame, atts: list[str], k: int = 1, m: float = 1.0) -> Network:
    """kDB cut to the attribute prefix with the least leave-one-out error; the earliest of equals."""
    net, classes = fit_kdb(cells, atts, k, m), labels(cells)
    best = min(prefix_errors(cells, net, Lookup(cells, classes), domain_sizes(cells, atts), net.atts).collect(), key=lambda r: (round(r.sse, 9), r.prefix))
    keep = net.atts[: best.prefix]
    return Network(keep, {a: net.parents[a] for a in keep}, m)


@dataclass
class AnDE:
    """Averaged n-dependence estimators: every n-subset of attributes takes its turn as parent.

    ``weights`` weigh parents (subset of names -> weight); ``selected`` restricts them;
    ``children`` restricts what they condition; rows without a seen parent fall back to the
    next smaller n, in the end to naive Bayes.
    """

    atts: list[str]
    n: int = 1
    m: float = 1.0
    weights: dict[frozenset, float] | None = None
    selected: list[str] | None = None
    children: list[str] | None = None
    #: Subsumption: an attribute value that another one implies (as often seen, this often at least) is left out.
    subsume: int | None = None
    min_count: int = 1

    def score(self, rows: DataFrame, lookup: Lookup, sizes: dict[str, int]) -> DataFrame:
        classes, nc = lookup.classes, len(lookup.classes)
        place = {a: i for i, a in enumerate(self.atts)}
        key = lambda s: sorted(s, key=place.get)
        parents = [frozenset(s) for s in combinations([a for a in self.atts if self.selected is None or a in self.selected], self.n)]
        kids = [a for a in self.atts if self.children is None or a in self.children]
        rows = lookup.add(rows, [], "_ny")
        need = {p for p in parents} | {p | {c} for p in parents for c in kids}
        if self.subsume:
            need |= {frozenset((a, b)) for a, b in combinations(self.atts, 2)} | {frozenset((a,)) for a in self.atts}
        order = sorted(need, key=lambda s: (len(s), key(s)))
        rows = lookup.add_all(rows, [key(s) for s in order], self.atts, "_all")
        counts = {s: F.get(F.col("_all"), F.lit(i)) for i, s in enumerate(order)}
        dropped = {}
        if self.subsume:
            total = lambda s: array_sum(counts[frozenset(s)])
            for a in self.atts:
                # a is implied by b; of two that imply each other the earlier stays
                tests = [
                    (total({b}) >= self.subsume) & (total({a, b}) == total({b})) & ((total({a}) != total({b})) | F.lit(place[b] < place[a]))
                    for b in self.atts
                    if b != a
                ]
                rows = rows.withColumn(f"_d_{a}", F.array_contains(F.array(*tests), True))
                dropped[a] = F.col(f"_d_{a}")
        zeros = F.array(*(F.lit(0.0) for _ in classes))
        votes = []
        for i, p in enumerate(parents):
            k = 1.0
            for a in p:
                k *= sizes[a]
            own = counts[p]
            w = 1.0 if self.weights is None else self.weights[p]
            lp = log_prior(own, array_sum(F.col("_ny")), nc * k, self.m, log(w) if w > 0 else 0.0)
            for c in kids:
                if c in p:
                    continue
                f = log_factor(counts[p | {c}], own, sizes[c], self.m)
                if c in dropped:
                    f = F.when(dropped[c], zeros).otherwise(f)
                lp = F.zip_with(lp, f, lambda x, y: x + y)
            active = array_sum(own) >= self.min_count
            for a in p:
                if a in dropped:
                    active = active & ~dropped[a]
            rows = rows.withColumn(f"_v{i}", F.when(active & F.lit(w > 0), lp))
            votes.append(F.col(f"_v{i}"))
        every = F.filter(F.array(*votes), lambda v: v.isNotNull())
        top = F.array_max(F.flatten(every))
        summed = F.aggregate(every, zeros, lambda acc, v: F.zip_with(acc, v, lambda s, x: s + F.exp(x - top)))
        whole = F.nullif(F.aggregate(summed, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
        rows = rows.withColumn(f"_votes{self.n}", F.size(every)).withColumn(f"_p{self.n}", F.transform(summed, lambda x: x / whole))
        rows = rows.drop(*(f"_v{i}" for i in range(len(parents))), "_all", *(f"_d_{a}" for a in dropped), "_ny")
        lower = AnDE(self.atts, self.n - 1, self.m) if self.n > 1 else naive_bayes(self.atts, self.m)
        rows = lower.score(rows, lookup, sizes)
        return rows.withColumn("p", F.when(F.col(f"_votes{self.n}") > 0, F.col(f"_p{self.n}")).otherwise(F.col("p"))).drop(f"_votes{self.n}", f"_p{self.n}")


@dataclass
class A2JE:
    """Joint pairs in log space: sum of log P(x1, x2 | y) over seen pairs / (n - 1) + log P(y)."""

    atts: list[str]
    m: float = 1.0

    def score(self, rows: DataFrame, lookup: Lookup, sizes: dict[str, int]) -> DataFrame:
        nc = float(len(lookup.classes))
        rows, pairs = lookup.add(rows, [], "_ny"), [list(p) for p in combinations(self.atts, 2)]
        lp = F.transform(F.col("_ny"), lambda n: F.log(m_estimate(n, array_sum(F.col("_ny")), F.lit(nc), self.m)))
        if pairs:
            rows = lookup.add_all(rows, pairs, self.atts, "_all")
        for i, (a, b) in enumerate(pairs):
            n = F.get(F.col("_all"), F.lit(i))
            f = F.transform(log_factor(n, "_ny", sizes[a] * sizes[b], self.m), lambda x: x / (len(self.atts) - 1))
            rows = rows.withColumn("_lp", lp).withColumn("_lp", F.when(array_sum(n) > 0, F.zip_with("_lp", f, lambda x, y: x + y)).otherwise(F.col("_lp")))
            lp = F.col("_lp")
        return rows.withColumn("_lp", lp).withColumn("p", softmax(F.col("_lp"))).drop("_lp", "_ny", *(["_all"] if pairs else []))


def _log_density(x: Column, means: str, sds: str) -> Column:
    return F.zip_with(means, sds, lambda mu, sd: -F.log(sd) - F.pow((x - mu) / sd, 2) / 2)


@dataclass
class Gaussian:
    """Gaussian naive Bayes: categorical factors by m-estimate, numeric ones by each class's normal density; nulls are skipped."""

    cats: list[str]
    nums: list[str]
    m: float = 1.0

    def score(self, rows: DataFrame, train: DataFrame, classes: list[str], sizes: dict[str, int]) -> DataFrame:
        cells = cuboid(train, self.cats)
        rows = naive_bayes(self.cats, self.m).score(rows, Lookup(cells, classes), sizes)
        stats = train.agg(*(F.array(*(f(F.when(F.col("y") == c, F.col(v))) for c in classes)).alias(f"_{n}_{v}") for v in self.nums for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
        rows = rows.crossJoin(F.broadcast(stats)).withColumn("_lp", F.transform("p", lambda x: F.log(x)))
        for v in self.nums:
            f = _log_density(F.col(v), f"_mean_{v}", f"_sd_{v}")
            rows = rows.withColumn("_lp", F.when(F.col(v).isNull(), F.col("_lp")).otherwise(F.zip_with("_lp", f, lambda a, b: a + F.coalesce(b, F.lit(0.0)))))
        return rows.withColumn("p", softmax(F.col("_lp"))).drop("_lp", *(f"_{n}_{v}" for v in self.nums for n in ("mean", "sd")))


def posterior(rows: DataFrame, classes: list[str], keep: list[str]) -> DataFrame:
    """Long form: (keep..., class, p)."""
    pairs = F.arrays_zip(F.array(*map(F.lit, classes)).alias("class"), F.col("p").alias("p"))
    return rows.select(*keep, F.explode(pairs).alias("e")).select(*keep, F.col("e.class").alias("class"), F.col("e.p").alias("p"))


def predicted(p: Column, classes: list[str]) -> Column:
    """The likeliest class; of equals (to nine digits) the first."""
    r = F.transform(p, lambda x: F.round(x, 9))
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(r, F.array_max(r)).cast("int"))


#: Learners by name: (cells, atts) -> a model with ``score``.
LEARNERS: dict[str, Callable] = {
    "nb": lambda cells, atts, **o: naive_bayes(atts, **o),
    "tan": fit_tan,
    "kdb": fit_kdb,
    "kdbEager": fit_kdb,
    "selective-kdb": fit_selective_kdb,
    "cbn": fit_cbn,
    "aode": lambda cells, atts, **o: AnDE(atts, 1, **o),
    "aodeExt": lambda cells, atts, **o: AnDE(atts, 1, **o),
    "aodeDist": lambda cells, atts, **o: AnDE(atts, 1, **({"subsume": 100} | o)),
    "a2de": lambda cells, atts, **o: AnDE(atts, 2, **o),
    "a3de": lambda cells, atts, **o: AnDE(atts, 3, **o),
    "a2je": lambda cells, atts, **o: A2JE(atts, **o),
}


def mi_weights(cells: DataFrame, atts: list[str], n: int = 1) -> dict[frozenset, float]:
    """Parent weights by mutual information of the whole parent tuple with the class."""
    c = cube(cells, atts, n)
    names, values = [f"a{i}" for i in range(1, n + 1)], [f"v{i}" for i in range(1, n + 1)]
    return {frozenset(r[a] for a in names): r.value for r in information(c, names, values, ["y"]).collect()}


def top_by_mi(cells: DataFrame, atts: list[str], share: float) -> list[str]:
    """The best floor(n * share) attributes, one at least."""
    return mi_order(cells, atts)[: max(1, int(len(atts) * share))]


