"""The rule search against an exhaustive one, and its test against exact fractions."""

import math
import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparktally.operators import counts as C
from sparktally.operators import rules as R

ATTS = ["a", "b", "c", "d"]


def exact(a, draws, hits, total):
    whole = math.comb(total, draws)
    return float(sum(Fraction(math.comb(hits, i) * math.comb(total - hits, draws - i), whole) for i in range(max(a, 0, draws + hits - total), min(draws, hits) + 1)))


def test_hypergeometric_tail(monkeypatch):
    rng = random.Random(1)
    for terms in (4096, 3):
        monkeypatch.setattr(R, "TERMS", terms)
        for _ in range(300):
            total = rng.randint(1, 300)
            draws, hits = rng.randint(0, total), rng.randint(0, total)
            a = rng.randint(-1, min(draws, hits) + 1)
            assert R.hypergeometric_tail(a, draws, hits, total) == pytest.approx(exact(a, draws, hits, total), rel=1e-8, abs=1e-12)
    assert R.hypergeometric_tail(600_000, 10**6, 10**9, 2 * 10**9) < 1e-300  # far out, no underflow error
    monkeypatch.setattr(R, "TERMS", 4096)
    assert R.hypergeometric_tail(500_100, 10**6, 10**9, 2 * 10**9) == pytest.approx(0.4213, abs=1e-3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for _ in range(500):
        a, b, c = rng.choice("xyz"), rng.choice("uv"), rng.choice("mn")
        # a class that takes three attributes to tell
        y = "p" if (a == "x" and b == "u" and c == "m" and rng.random() < 0.95) or rng.random() < 0.2 else rng.choice("qr")
        out.append((y, a, b, c, "k" if b == "u" else rng.choice(["k", "l", None])))  # b = u implies d = k
    return out


def exhaustive(rows, k, measure, redundant, alpha=0.05):
    n, out = len(rows), []
    hold = lambda items, r: all(r[1 + i] == v for i, v in items)
    cover = lambda items, y=None: sum(hold(items, r) and (y is None or r[0] == y) for r in rows)
    every = {(i, r[1 + i]) for r in rows for i in range(len(ATTS)) if r[1 + i] is not None}
    for size in range(1, len(ATTS) + 1):
        for s in combinations(sorted(every), size):
            if len({i for i, _ in s}) < size or not cover(s):
                continue
            less = [s[:j] + s[j + 1 :] for j in range(size)]
            if not redundant and any(cover(x) == cover(s) for x in less):
                continue
            for y in sorted({r[0] for r in rows}):
                sup, cov, ny = cover(s, y), cover(s), cover((), y)
                v = sup / n - cov / n * ny / n if measure == "leverage" else sup / (cov * ny / n)
                p = max(exact(sup, cov, cover(x, y), cover(x)) for x in less)
                if v > (0 if measure == "leverage" else 1) and p <= alpha:
                    out.append((tuple(f"{ATTS[i]}={w}" for i, w in s), y, cov, sup, v, p))
    return sorted(out, key=lambda r: (-round(r[4], 9), "&".join(r[0]), r[1]))[:k]


@pytest.mark.parametrize(("k", "measure", "redundant"), [(5, "leverage", False), (100, "leverage", False), (100, "leverage", True), (6, "lift", False)])
def test_find_rules(spark, rows, k, measure, redundant):
    cells = C.cuboid(spark.createDataFrame(rows, "y string, " + ", ".join(f"{a} string" for a in ATTS)), ATTS)
    got = R.find_rules(cells, ATTS, k, measure, redundant=redundant).collect()
    want = exhaustive(rows, k, measure, redundant)
    assert [(tuple(r["items"]), r.y, r.cover, r.support) for r in got] == [w[:4] for w in want]
    assert [r.value for r in got] == pytest.approx([w[4] for w in want]) and [r.p for r in got] == pytest.approx([w[5] for w in want], abs=1e-9)
    assert k < 100 or any(len(r["items"]) == 3 for r in got)


def test_longest_and_no_rows(spark, rows):
    cells = C.cuboid(spark.createDataFrame(rows, "y string, " + ", ".join(f"{a} string" for a in ATTS)), ATTS)
    assert all(len(r["items"]) == 1 for r in R.find_rules(cells, ATTS, 50, longest=1).collect())
    assert R.find_rules(cells.limit(0), ATTS).collect() == []


def test_mined_features_hold_where_the_rules_cover(spark):
    rng = random.Random(3)
    data = [("hi" if (x := rng.choice([None, *range(20)])) is None or x > 9 else "lo", rng.choice("st"), None if x is None else float(x)) for _ in range(400)]
    df = spark.createDataFrame(data, "y string, s string, x double")
    features, rules = R.mine_features(df, ["s"], ["x"], 6)
    covers = {"&".join(r["items"]): r.cover for r in rules.collect()}
    counts = df.agg(*(F.count_if(test == "t").alias(f"f{i}") for i, test in enumerate(features.values()))).first()
    assert list(counts) == list(covers.values()) and {"x=0", "x=1", "x=?"} & set(covers)
