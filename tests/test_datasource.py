"""The data source: ranges of bytes, declared schemas, writers with commit."""

import os
import random

import pytest

from sparktally.sources import datasource as S

META = ":class: y : no, yes\ncolour : red, grün, blue\nx : numeric, ?\n"


def test_every_line_is_in_one_range(tmp_path):
    rng = random.Random(1)
    for no, end in enumerate(["\n", "\r\n", ""]):
        lines = ["".join(rng.choice("aé日x ") for _ in range(rng.randint(0, 30))) for _ in range(200)]
        sep = end or "\n"
        data = (sep.join(lines) + end).encode()
        path = str(tmp_path / f"t{no}")
        with open(path, "wb") as f:
            f.write(data)
        want = data.decode().replace("\r", "").split("\n")
        want = want[:-1] if want[-1] == "" else want
        for step in (1, 7, 64, 1 << 20):
            got = [x for a in range(0, len(data), step) for x in S.lines_of(path, a, min(a + step, len(data)))]
            assert got == want, step


def test_write_and_read_back(spark, tmp_path):
    S.register(spark)
    path, rng = str(tmp_path / "table"), random.Random(2)
    rows = [(rng.choice(["no", "yes"]), rng.choice(["red", "grün", "blue"]), None if k % 9 == 0 else rng.random() * 1e6) for k in range(500)]
    df = spark.createDataFrame(rows, "y string, colour string, x double").repartition(4)
    df.write.format("declared").option("declaration", META).mode("append").save(path)
    assert not [x for x in os.listdir(path) if x.startswith("_")]
    for size in (100, 1 << 20):
        back = spark.read.format("declared").option("declaration", META).option("bytes", size).load(path)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
        assert back.columns == ["y", "colour", "x"] and (size > 100 or back.rdd.getNumPartitions() > 50)
    df.limit(3).write.format("declared").option("declaration", META).mode("overwrite").save(path)
    assert spark.read.format("declared").option("declaration", META).load(path).count() == 3


def test_sparse_and_fixed(spark, tmp_path):
    S.register(spark)
    sparse = spark.createDataFrame([("a", 0.0, 1.5), ("b", 2.0, 0.0)], "class string, a_1 double, a_2 double")
    sparse.write.format("declared").option("layout", "sparse").mode("append").save(str(tmp_path / "s"))
    assert sorted(spark.read.format("declared").option("layout", "sparse").option("n", 2).load(str(tmp_path / "s")).collect()) == sorted(sparse.collect())
    meta = str(tmp_path / "f.pmeta")
    with open(meta, "w") as f:
        f.write(":class: :width=3: y : no, yes\n:width=8: x : numeric\n")
    fixed = spark.createDataFrame([("yes", 1.25), ("no", -3.0)], "y string, x double")
    fixed.write.format("declared").option("layout", "fixed").option("meta", meta).mode("append").save(str(tmp_path / "f"))
    assert sorted(spark.read.format("declared").option("layout", "fixed").option("meta", meta).load(str(tmp_path / "f")).collect()) == sorted(fixed.collect())


@pytest.mark.parametrize("line", ["no,red", "no,pink,1", "no,red,abc", "maybe,red,1"])
def test_what_is_not_declared_is_an_error(spark, tmp_path, line):
    S.register(spark)
    (tmp_path / "t").write_text(f"yes,red,1\n{line}\n")
    with pytest.raises(Exception, match="expected 3 values|unknown value|no number"):
        spark.read.format("declared").option("declaration", META).load(str(tmp_path / "t")).collect()


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    S.register(spark)
    path = str(tmp_path / "t")
    bad = spark.range(100).repartition(3).select(F.lit("no").alias("y"), F.lit("red").alias("colour"), F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("double")).otherwise(1.0).alias("x"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("declared").option("declaration", META).mode("append").save(path)
    # a task that was still at work may have begun its waiting folder anew; no reader sees it
    assert not os.path.exists(path) or all(x.startswith("_waiting-") for x in os.listdir(path))
    os.makedirs(path, exist_ok=True)
    assert spark.read.format("declared").option("declaration", META).load(path).count() == 0


def test_an_empty_table(spark, tmp_path):
    S.register(spark)
    os.mkdir(tmp_path / "none")
    assert spark.read.format("declared").option("declaration", META).load(str(tmp_path / "none")).collect() == []
