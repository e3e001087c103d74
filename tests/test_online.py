"""Learners over streams against loops over the rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from sparktally.operators import counts as C
from sparktally.streaming import online as O


def made(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.choice("pqr")
        a = y if rng.random() < 0.8 else rng.choice("pqr")
        out.append((i % 2, i, y, a, rng.choice("uv"), y if rng.random() < 0.3 else rng.choice("wx")))
    return out


SCHEMA = "part long, seq long, y string, a string, b string, c string"


def vote(past, row, w, sizes, classes):
    """(posterior of the weighted vote, each member's own posterior or None)."""
    joint = []
    for p in range(3):
        same = [t for t in past if t[3 + p] == row[3 + p]]
        if not same:
            joint.append(None)
            continue
        one = []
        for y in classes:
            mine = [t for t in same if t[2] == y]
            v = (len(mine) + 1 / (len(classes) * sizes[p])) / (len(past) + 1)
            for c in range(3):
                if c != p:
                    v *= (sum(t[3 + c] == row[3 + c] for t in mine) + 1 / sizes[c]) / (len(mine) + 1)
            one.append(v)
        joint.append(one)
    total = [sum(w[p] * j[i] for p, j in enumerate(joint) if j) for i in range(len(classes))]
    post = [t / sum(total) for t in total] if sum(total) else [1 / len(classes)] * len(classes)
    return post, [j and [x / sum(j) for x in j] for j in joint]


def loop(rows, own, start, sizes, classes):
    w, out = [1 / 3] * 3, []
    for k, row in enumerate(rows):
        post, each = vote(rows[: k + own], row, w, sizes, classes)
        best = max(range(len(classes)), key=lambda i: (round(post[i], 9), -i))
        at = classes.index(row[2])
        if k + own > start:
            w = [x if e is None else x * (1 + (1 - post[at]) * e[at] / 3) for x, e in zip(w, each)]
            w = [x / sum(w) for x in w]
        out.append((row[0], row[1], row[2], classes[best], int(best != at), w))
    return out


@pytest.mark.parametrize("own", [False, True])
def test_member_weights(spark, own):
    rows = made(240)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    classes, sizes = list("pqr"), C.domain_sizes(C.cuboid(df, ["a", "b", "c"]), ["a", "b", "c"])
    got = sorted(O.member_weights(df, ["a", "b", "c"], classes, sizes, start=20, own=own).collect(), key=lambda r: r.seq)
    want = sorted((x for p in (0, 1) for x in loop([r for r in rows if r[0] == p], own, 20, [sizes[a] for a in "abc"], classes)), key=lambda r: r[1])
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want):
        assert r.weights == pytest.approx(w[5], abs=1e-9)
    assert got[-1].weights[0] == max(got[-1].weights) > 0.34  # a tells most


def test_weighted_aode_takes_the_last_weights(spark):
    rows = [(0, *r[1:]) for r in made(200)]
    df = spark.createDataFrame([r[1:] for r in rows], "id long, y string, a string, b string, c string")
    model = O.fit_weighted_aode(df, ["a", "b", "c"], start=20)
    sizes = C.domain_sizes(C.cuboid(df, ["a", "b", "c"]), ["a", "b", "c"])
    want = loop(rows, False, 20, [sizes[a] for a in "abc"], list("pqr"))[-1][5]
    assert [model.weights[frozenset(a)] for a in "abc"] == pytest.approx(want)


def test_a_part_is_never_one_frame(spark):
    """A task gets one batch after another: what is seen at a time is bounded however long a part is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = spark.range(1000).select(F.lit(0).cast("long").alias("part"), F.col("id").alias("seq"))

        def make(_):
            state = {"last": -1}

            def step(r):
                assert r["seq"] == state["last"] + 1
                state["last"] = r["seq"]
                return r["part"], r["seq"]

            return step

        assert O.in_order(rows.repartition(7), make, "part long, seq long").count() == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_logistic_step_by_hand():
    m = O.OnlineLogistic(["p", "q"], rate=0.5, decay=0.1)
    assert m.step({"x": 1.0}, "p") == pytest.approx([0.5, 0.5])
    assert m.step({"z": 1.0}, "q") == pytest.approx([0.5, 0.5])
    w = 0.25 * 0.95**2  # learnt at step 1, shrunk for two steps
    assert m.step({"x": 1.0}, "p")[0] == pytest.approx(1 / (1 + math.exp(-w)))


def test_stream_out_of_order_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = made(120)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    timed = [(r[0], r[1], start + datetime.timedelta(seconds=r[1] // 2), *r[2:]) for r in rows]
    schema = "part long, seq long, ts timestamp, y string, a string, b string, c string"
    late = [timed[i] for i in sorted(range(len(timed)), key=lambda i: i + rng.randint(0, 12))]  # at most 12 places early
    end = [(p, 10_000 + p, start + datetime.timedelta(days=d), "p", "p", "u", "w") for d in (1, 2) for p in (0, 1)]
    for k, part in enumerate([late[:40], late[40:80], late[80:], end[:2], end[2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "20 seconds")
    q = O.stream_logistic(stream, ["a", "b", "c"], list("pqr")).writeStream.format("memory").queryName("learnt").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM learnt WHERE seq < 10000").collect()}
    want = {tuple(r) for r in O.prequential_logistic(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], list("pqr")).collect()}
    assert got == want and len(got) == 120
