"""Steps that must not gather an attribute, a bag or a part of a stream in one task."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from sparktally.operators import counts as C
from sparktally.operators import discretise as D
from sparktally.operators import sampling as P
from sparktally.operators import trees as R
from sparktally.streaming import online as O


@pytest.fixture
def plans(monkeypatch):
    """The plans of everything that is checkpointed or collected."""
    seen = []

    def noted(name):
        real = getattr(DataFrame, name)

        def call(self, *args, **options):
            seen.append(self._jdf.queryExecution().executedPlan().toString())
            return real(self, *args, **options)

        monkeypatch.setattr(DataFrame, name, call)

    for name in ("checkpoint", "collect"):
        noted(name)
    return seen


def numbers(spark, n=400):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), round(rng.uniform(0, 10), 2), round(rng.gauss(0, 1), 3)) for _ in range(n)]
    return spark.createDataFrame([("hi" if x > 4 and k == "a" or z > 1.5 else "lo", k, x, z) for k, x, z in rows], "y string, k string, x double, z double")


def test_mdl_leaves_values_in_their_ranges(spark, plans):
    # as tables are when they are too large for Spark to broadcast them by itself
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        D.mdl(D.value_counts(numbers(spark), ["x", "z"]), ["hi", "lo"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert not [p for p in plans if "SortMergeJoin" in p and "_o_seg" in p or "SortMergeJoin" in p and "_s_seg" in p]


@pytest.mark.parametrize("vertices", [6, 0])
@pytest.mark.parametrize("bins", [4, 1024])
def test_cuts_of_trees_are_the_best_of_all(spark, plans, monkeypatch, vertices, bins):
    monkeypatch.setattr(R, "VERTICES", vertices)
    monkeypatch.setattr(R, "BINS", bins)
    df = numbers(spark)
    cells = df.groupBy("k", "x", "z", "y").agg(F.count("*").alias("n"))
    rows = R._with_bins(cells, ["x", "z"]).withColumn("node", F.lit(""))
    got = {r.att: (r.cut, r.gain) for r in R._candidates(rows, [], ["x", "z"], ["hi", "lo"]).collect()}
    from math import log2

    data = df.collect()
    entropy = lambda part: -sum(q * log2(q) for q in (sum(r.y == c for r in part) / len(part) for c in ("hi", "lo")) if q)
    for att in ("x", "z"):
        values = sorted({r[att] for r in data})
        scored = []
        for low, high in zip(values, values[1:]):
            sides = [[r for r in data if r[att] <= low], [r for r in data if r[att] > low]]
            scored.append((round(entropy(data) - sum(len(s) * entropy(s) for s in sides) / len(data), 9), -(low + high) / 2))
        gain, cut = max(scored)
        assert got[att][0] == pytest.approx(-cut) and got[att][1] == pytest.approx(gain, abs=1e-8)
    # windows go over counted ranges or the values of one range
    assert not [p for p in plans if "Window" in p and "[node" in p and "[val" in p and "bin" not in p]


def test_copies_hash_once(spark):
    drawn = P.bootstrap_counts(spark.range(1000), "id", 3, 7)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 3
    u = P.uniform("id", F.concat(F.lit("7."), F.col("bag")))
    steps = F.array(*map(F.lit, P.poisson_steps()))
    every = spark.range(1000).withColumn("bag", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("u", u)
    want = every.withColumn("times", F.size(F.filter(steps, lambda s: F.col("u") >= s))).where("times > 0").select("bag", "id", "times")
    assert sorted(map(tuple, drawn.select("bag", "id", "times").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("own", [False, True])
def test_weights_go_on_from_stretch_to_stretch(spark, monkeypatch, own):
    monkeypatch.setattr(O, "STRETCH_ROWS", 100, raising=False)
    rng = random.Random(3)
    rows = [(i, rng.choice("pq"), rng.choice("uvw"), rng.choice("xy")) for i in range(450)]
    df = spark.createDataFrame([(i, "hi" if a == "p" and c == "x" else "lo", a, b, c) for i, a, b, c in rows], "id long, y string, a string, b string, c string")
    atts, cells = ["a", "b", "c"], C.cuboid(df, ["a", "b", "c"])
    read = []
    real = O._pass_on
    monkeypatch.setattr(O, "_pass_on", lambda stretch, *rest: (read.append(stretch.count()), real(stretch, *rest))[1])
    model = O.fit_weighted_aode(df, atts, start=20, own=own)
    whole = O.member_weights(df.select(F.lit(0).alias("part"), F.col("id").alias("seq"), "y", *atts), atts, C.labels(cells), C.domain_sizes(cells, atts), start=20, own=own)
    want = whole.agg(F.max_by("weights", "seq")).first()[0]
    assert [model.weights[frozenset((a,))] for a in atts] == pytest.approx(want, abs=1e-12)
    assert len(read) == 5 and sum(read) == 450 and max(read) < 200
