"""Attribute rankings and selections against loops over the rows."""

import math
import random
from collections import Counter

import pytest

from sparktally.functions import measures as M
from sparktally.operators import counts as C
from sparktally.operators import selection as S

ATTS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for _ in range(300):
        y = rng.choice("pq")
        a = y if rng.random() < 0.85 else rng.choice("pq")
        b = a if rng.random() < 0.9 else rng.choice("pq")  # nearly a copy of a
        c = y if rng.random() < 0.6 else rng.choice("pqr")
        out.append((y, a, b, c, rng.choice("uvw")))  # d is noise
    return out


@pytest.fixture(scope="module")
def cells(spark, rows):
    return C.cuboid(spark.createDataFrame(rows, "y string, a string, b string, c string, d string"), ATTS)


def entropy(values):
    n = Counter(values)
    return -sum(k / len(values) * math.log2(k / len(values)) for k in n.values())


def mi(x, y):
    return entropy(x) + entropy(y) - entropy(list(zip(x, y)))


def greedy(first, gain):
    out = [max(ATTS, key=lambda a: (first[a], -ATTS.index(a)))]
    while len(out) < len(ATTS):
        out.append(max((a for a in ATTS if a not in out), key=lambda a: gain(a, out)))
    return out


@pytest.mark.parametrize("how", ["mrmr", "diff", "mifs", "jmi", "mmcmi"])
def test_rankings(rows, cells, how):
    y, col = [r[0] for r in rows], {a: [r[1 + i] for r in rows] for i, a in enumerate(ATTS)}
    own = {a: mi(col[a], y) for a in ATTS}
    two = {(a, b): mi(col[a], col[b]) for a in ATTS for b in ATTS}
    pair = {(a, b): mi(list(zip(col[a], col[b])), y) for a in ATTS for b in ATTS}
    rates = {
        "mrmr": lambda a, s: own[a] / (sum(two[a, b] for b in s) / len(s) + 0.01),
        "diff": lambda a, s: own[a] - sum(two[a, b] for b in s) / len(s),
        "mifs": lambda a, s: own[a] - sum(two[a, b] for b in s),
        "jmi": lambda a, s: sum(pair[a, b] for b in s),
        "mmcmi": lambda a, s: min(pair[a, b] - own[b] for b in s),
    }
    assert S.rank_attributes(cells, ATTS, how) == greedy(own, rates[how])


def test_chi_square_keeps_what_depends(cells):
    assert S.chi_square_select(cells, ATTS) == ["a", "b", "c"]


def test_correlation_filter_drops_the_copy(cells):
    kept = S.correlation_filter(cells, ATTS)
    assert kept[0] == "a" and "b" not in kept


def cond(x, y, z):
    """CMI(x; y | z) of lists."""
    return entropy(list(zip(x, z))) + entropy(list(zip(y, z))) - entropy(z) - entropy(list(zip(x, y, z)))


def chi2(x, y):
    nx, ny, n = Counter(x), Counter(y), Counter(zip(x, y))
    stat = sum((n[a, b] - nx[a] * ny[b] / len(x)) ** 2 / (nx[a] * ny[b] / len(x)) for a in nx for b in ny)
    return M.gamma_tail((len(nx) - 1) * (len(ny) - 1) / 2, stat / 2) if len(nx) > 1 and len(ny) > 1 else 1.0


def passing(p, how):
    if how is None:
        return set(p)
    if how == "each":
        return {k for k, v in p.items() if v <= 0.05}
    out = set()
    for i, (v, k) in enumerate(sorted((v, k) for k, v in p.items())):
        if v > 0.05 / (len(p) - i):
            return out
        out.add(k)
    return out


def extended(rows, order, parents, tested, parents_tested, k=2):
    y, col = [r[0] for r in rows], {a: [r[1 + i] for r in rows] for i, a in enumerate(ATTS)}
    link = {(a, b): round(cond(col[a], col[b], y), 9) for a in ATTS for b in ATTS}
    if order == "mi":
        ranked = sorted(ATTS, key=lambda a: (-round(mi(col[a], y), 9), a))
    elif order == "value":
        ranked = sorted(ATTS, key=lambda a: (-round(sum(link[a, b] for b in ATTS if b != a), 9), a))
    else:
        ranked = greedy({a: mi(col[a], y) for a in ATTS}, lambda a, s: min(cond(col[a], y, col[b]) for b in s))
    good = passing({a: chi2(col[a], y) for a in ATTS}, tested)
    ranked, out = [a for a in ranked if a in good], {}
    for i, a in enumerate(ranked):
        good = passing({b: chi2(col[a], col[b]) for b in ranked[:i]}, parents_tested)
        able = [b for b in ranked[:i] if b in good]
        mine = sorted(able, key=lambda b: (-link[a, b], ranked.index(b)))[: 1 if parents == "mcmi" else k]
        while parents == "mcmi" and 0 < len(mine) < k:
            least = {b: round(min(cond(col[a], col[b], list(zip(col[c], y))) for c in mine), 9) for b in able if b not in mine}
            if not least or max(least.values()) <= 0:
                break
            mine.append(max(least, key=lambda b: (least[b], -ranked.index(b))))
        out[a] = mine
    return ranked, out


@pytest.mark.parametrize(("order", "parents", "tested", "parents_tested"), [("mi", "cmi", "holm", "holm"), ("mi", "cmi", "each", "each"), ("value", "cmi", None, "each"), ("cmi", "cmi", None, None), ("mi", "mcmi", None, None), ("value", "mcmi", "each", "holm")])
def test_extended_structures(rows, cells, order, parents, tested, parents_tested):
    net = S.fit_extended_kdb(cells, ATTS, 2, order, parents=parents, tested=tested, parents_tested=parents_tested)
    assert (net.atts, net.parents) == extended(rows, order, parents, tested, parents_tested)


def test_random_structures_repeat(cells):
    nets = [S.fit_extended_kdb(cells, ATTS, 2, "random", parents="random", seed=s) for s in (1, 1, 2, 5)]
    assert nets[0] == nets[1] and len({tuple(n.atts) for n in nets}) > 1
    for n in nets:
        assert all(set(n.parents[a]) < set(n.atts[:i]) | {None} and len(n.parents[a]) == min(2, i) for i, a in enumerate(n.atts))


def test_holm_by_hand():
    assert S.holm({"a": 0.01, "b": 0.02, "c": 0.03}) == {"a", "b", "c"}  # 0.05 / 3, / 2, / 1
    assert S.holm({"a": 0.01, "b": 0.03, "c": 0.04}) == {"a"}  # b misses 0.025, and c after it is not looked at
    assert S.holm({}) == set()
