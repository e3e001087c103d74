"""Selective kDB against leave-one-out loops over the rows."""

import math
import random
from collections import Counter

import pytest

from sparktally.operators import bayes as N
from sparktally.operators import counts as C
from sparktally.operators import prefixes as X

ATTS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = []
    for _ in range(140):
        y = rng.choices("pqr", [6, 3, 1])[0]
        a = y if rng.random() < 0.6 else rng.choice("pqr")
        out.append((y, a, a if rng.random() < 0.5 else rng.choice("pq"), rng.choice("uvw"), rng.choice("stxz")))
    return out


@pytest.fixture(scope="module")
def cells(spark, rows):
    return C.cuboid(spark.createDataFrame(rows, "y string, a string, b string, c string, d string"), ATTS)


def posterior(others, row, atts, parents, sizes, classes):
    out = []
    for y in classes:
        mine = [o for o in others if o[0] == y]
        p = (len(mine) + 1 / len(classes)) / (len(others) + 1)
        for a in atts:
            i, ps = 1 + ATTS.index(a), [1 + ATTS.index(x) for x in parents[a]]
            same = [o for o in mine if all(o[j] == row[j] for j in ps)]
            p *= (sum(o[i] == row[i] for o in same) + 1 / sizes[a]) / (len(same) + 1)
        out.append(p)
    return [p / sum(out) for p in out]


@pytest.fixture(scope="module")
def loop(rows, cells):
    """(links, prefix) -> [(y, pred, error)]."""
    net, sizes = N.fit_kdb(cells, ATTS, 2), C.domain_sizes(cells, ATTS)
    out = {}
    for k in (0, 1, 2):
        for i in range(5):
            parents = {a: net.parents[a][:k] for a in net.atts}
            out[k, i] = []
            for j, row in enumerate(rows):
                p = posterior(rows[:j] + rows[j + 1 :], row, net.atts[:i], parents, sizes, "pqr")
                r = [round(x, 9) for x in p]
                out[k, i].append((row[0], "pqr"[r.index(max(r))], 1 - p["pqr".index(row[0])]))
    return out


def test_confusion(cells, loop):
    got = {}
    for r in X.prefix_confusion(cells, N.fit_kdb(cells, ATTS, 2), [0, 1, 2]).collect():
        got.setdefault((r["links"], r["prefix"]), {})[r["y"], r["pred"]] = (r["n"], r["sse"], r["better"], r["worse"])
    for key, told in loop.items():
        whole = loop[key[0], 4]
        n = Counter((y, p) for y, p, _ in told)
        assert {k: v[0] for k, v in got[key].items()} == n
        for cell in n:
            pick = [(e, w[2]) for (y, p, e), w in zip(told, whole) if (y, p) == cell]
            assert got[key][cell][1] == pytest.approx(sum(e * e for e, _ in pick))
            assert got[key][cell][2:] == (sum(w - e > X.DRAW for e, w in pick), sum(e - w > X.DRAW for e, w in pick))


def mcc(told):
    s, c = len(told), sum(y == p for y, p, _ in told)
    t, k = Counter(y for y, _, _ in told), Counter(p for _, p, _ in told)
    under = math.sqrt((s * s - sum(x * x for x in t.values())) * (s * s - sum(x * x for x in k.values())))
    return (c * s - sum(t[x] * k[x] for x in "pqr")) / under if under else 0.0


def loss(told, objective):
    share = Counter(y for y, _, _ in told)
    if objective == "mcc":
        return round(-mcc(told), 9)
    return round(math.sqrt(sum((1 - share[y] / len(told) if objective == "weighted" else 1) * e * e for y, _, e in told) / len(told)), 9)


@pytest.mark.parametrize("objective", ["rmse", "weighted", "mcc"])
@pytest.mark.parametrize("links", ["all", "best", "each"])
def test_choices(cells, loop, objective, links):
    net = N.fit_kdb(cells, ATTS, 2)
    table = {k: loss(v, objective) for k, v in loop.items() if links != "all" or k[0] == 2}
    k, i = min(table, key=lambda c: (table[c], c[1], c[0]))
    many = [min((j for j in (0, 1, 2)), key=lambda j: (table[j, p], j)) if links == "each" else k for p in range(1, i + 1)]
    model = X.fit_prefix(cells, ATTS, 2, objective, links)
    assert model.atts == net.atts[:i] and [model.parents[a] for a in model.atts] == [net.parents[a][:n] for a, n in zip(net.atts, many)]


def test_sign_test_keeps_all_attributes_unless_the_cut_wins(cells, loop):
    table = {k: loss(v, "rmse") for k, v in loop.items() if k[0] == 2}
    _, i = min(table, key=lambda c: (table[c], c[1]))
    pairs = list(zip(loop[2, i], loop[2, 4]))
    better, worse = sum(w[2] - t[2] > X.DRAW for t, w in pairs), sum(t[2] - w[2] > X.DRAW for t, w in pairs)
    p = sum(math.comb(better + worse, j) for j in range(better, better + worse + 1)) / 2 ** (better + worse)
    for level in (p * 1.01, p * 0.99):
        assert len(X.fit_prefix(cells, ATTS, 2, test=level).atts) == (i if p <= level else 4)
