"""Level-wise cuts against the recursion over one sorted array."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktally.operators import discretise as D
from sparktally.operators import selection as S


def one_by_one(rows, classes, least=1):
    """{group: cuts} of (group, value, y) rows by ``mdl_cuts``."""
    per = defaultdict(lambda: defaultdict(Counter))
    for g, v, y in rows:
        per[g][v][y] += 1
    out = {}
    for g, vs in per.items():
        values = sorted(vs)
        table = np.array([[vs[v][c] for c in classes] for v in values], dtype=float)
        out[g] = D.mdl_cuts(np.array(values), table) if table.sum() >= least else []
    return out


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g = rng.choice(["a", "b", "b", "b", "b", None])
        v = float(rng.choice([rng.randrange(200), rng.randrange(5), -3]))
        level = (v > 40) + (v > 90) + (v > 130) if g == "b" else (v > 100)
        out.append((g, v, "pqr"[level % 3] if rng.random() < 0.9 else rng.choice("pqr")))
    return out


@pytest.mark.parametrize("n", [60, 3000])
def test_cuts_of_all_groups(spark, n):
    rows = made(n, n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.createDataFrame(rows, "g string, value double, y string").groupBy("g", "value", "y").agg(F.count("*").alias("n"))
        got = defaultdict(list)
        for r in D.mdl(counts, list("pqr"), ("g",)).collect():
            got[r.g].append(r.cut)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {g: c for g, c in one_by_one(rows, "pqr").items() if c}
    assert {g: sorted(c) for g, c in got.items()} == want and (n < 100 or len(want["b"]) >= 3)


def test_two_rows_are_not_split_again():
    values, table = np.arange(6.0), np.array([[9, 0], [9, 0], [0, 9], [0, 9], [1, 0], [0, 1]], dtype=float)
    assert 4.5 not in D.mdl_cuts(values, table)
    assert D.mdl_cuts(np.array([0.0, 1.0]), np.array([[1.0, 0.0], [0.0, 1.0]])) == [0.5]  # but a whole of two is


@pytest.mark.parametrize("backoff", [False, True])
def test_conditional_cuts(spark, backoff):
    rng = random.Random(8)
    rows = []
    for _ in range(900):
        a, b = rng.choice("uv"), rng.choice(["x", "x", "x", "x", "x", "y", "z", None])
        v = rng.choice([None, *map(float, range(50))])
        rows.append(("hi" if v is not None and v > (20 if a == "u" else 35) else "lo", a, b, v))
    least = 60
    known = [r for r in rows if r[3] is not None]
    df = spark.createDataFrame(rows, "y string, a string, b string, v double")
    got = {(r.a, r.b): r.cuts for r in S.conditional_cuts(df, "v", ["a", "b"], ["hi", "lo"], least, backoff).collect()}
    by = lambda key: one_by_one([(key(r), r[3], r[0]) for r in known], ["hi", "lo"])
    size = Counter(x for r in known for x in {(), (r[1],), (r[1], r[2])})
    cuts = {0: by(lambda r: ()), 1: by(lambda r: (r[1],)), 2: by(lambda r: (r[1], r[2]))}
    want = {}
    for r in known:
        full = (r[1], r[2])
        tries = [full[:d] for d in ((2, 1, 0) if backoff else (2,)) if size[full[:d]] >= least]
        want[full] = cuts[len(tries[0])][tries[0]] if tries else []
    assert got == want and any(not c for c in want.values()) != backoff
