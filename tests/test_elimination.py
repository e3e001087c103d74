"""Backward elimination against a loop over the rows."""

import math
import random

import pytest

from sparktally.operators import counts as C
from sparktally.operators import elimination as V

ATTS = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for _ in range(160):
        y = rng.choice("pqr")
        a = y if rng.random() < 0.7 else rng.choice("pqr")
        b = a if rng.random() < 0.95 else "p"
        out.append((y, a, b, b if rng.random() < 0.9 else "q", rng.choice("uvwx"), rng.choice("st"), y if rng.random() < 0.4 else rng.choice("pq")))
    return [*out, ("p", "only", "once", "seen", "here", "too", "all")]


def loo_rmse(rows, parents, children, sizes, classes):
    total = 0.0
    for k, row in enumerate(rows):
        others = rows[:k] + rows[k + 1 :]
        votes = dict.fromkeys(classes, 0.0)
        for p in parents:
            same = [o for o in others if o[1 + p] == row[1 + p]]
            if not same:
                continue
            for y in classes:
                mine = [o for o in same if o[0] == y]
                v = (len(mine) + 1 / (len(classes) * sizes[p])) / (len(others) + 1)
                for c in children:
                    if c != p:
                        v *= (sum(o[1 + c] == row[1 + c] for o in mine) + 1 / sizes[c]) / (len(mine) + 1)
                votes[y] += v
        whole = sum(votes.values())
        total += (1 - (votes[row[0]] / whole if whole else 1 / len(classes))) ** 2
    return round(math.sqrt(total / len(rows)), 9)


def loop(rows, mode):
    kinds = V.MODES[mode]
    classes, sizes = sorted({r[0] for r in rows}), [len({r[1 + i] for r in rows}) for i in range(len(ATTS))]
    ps, cs = list(range(len(ATTS))), list(range(len(ATTS)))
    now = loo_rmse(rows, ps, cs, sizes, classes)
    steps = [(0, "", "", now)]
    while True:
        tries = {}
        for kind in kinds:
            for a in range(len(ATTS)):
                p2, c2 = [x for x in ps if x != a or kind == "child"], [x for x in cs if x != a or kind == "parent"]
                if p2 and c2 and (kind == "parent" or a in cs) and (kind == "child" or a in ps):
                    tries[kind, a] = (loo_rmse(rows, p2, c2, sizes, classes), p2, c2)
        best = min(tries, key=lambda k: (tries[k][0], kinds.index(k[0]), k[1]), default=None)
        if best is None or tries[best][0] >= now:
            return [ATTS[p] for p in ps], [ATTS[c] for c in cs], steps
        now, ps, cs = tries[best]
        steps.append((len(steps), best[0], ATTS[best[1]], now))


@pytest.mark.parametrize("mode", list(V.MODES))
def test_elimination(spark, rows, mode):
    cells = C.cuboid(spark.createDataFrame(rows, "y string, " + ", ".join(f"{a} string" for a in ATTS)), ATTS)
    model, steps = V.eliminate(cells, ATTS, mode)
    parents, children, want = loop(rows, mode)
    assert len(want) > 1
    assert (model.selected, model.children) == (parents, children)
    assert [s[:3] for s in steps] == [s[:3] for s in want]
    assert [s[3] for s in steps] == pytest.approx([s[3] for s in want], abs=2e-9)


def test_last_parent_and_child_stay(spark):
    cells = C.cuboid(spark.createDataFrame([("p", "x"), ("q", "x"), ("p", "z")], "y string, a string"), ["a"])
    model, steps = V.eliminate(cells, ["a"], "poce")
    assert (model.selected, model.children, len(steps)) == (["a"], ["a"], 1)
