"""Golden values, hand cases, invariants and brute force for the core library."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sparktally.functions import measures as M
from sparktally.functions import metrics as X
from sparktally.functions import scalars as S
from sparktally.operators import bayes as N
from sparktally.operators import counts as C
from sparktally.operators import discretise as D
from sparktally.operators import ensembles as G
from sparktally.operators import evaluate as E
from sparktally.operators import filters as L
from sparktally.operators import sampling as P
from sparktally.operators import trees as R
from sparktally.sources import exporters, pmeta, readers
from sparktally.streaming import online

#: Joint counts (no, yes) of a small weather table.
WEATHER = {("sunny", "f"): (15, 24), ("sunny", "t"): (6, 22), ("overcast", "f"): (2, 35), ("overcast", "t"): (2, 36), ("rainy", "f"): (5, 24), ("rainy", "t"): (7, 22)}


@pytest.fixture(scope="module")
def weather(spark):
    rows = [(o, w, y, n) for (o, w), c in WEATHER.items() for y, n in zip(("no", "yes"), c)]
    return spark.createDataFrame(rows, "outlook string, windy string, y string, n long")


ATTS = ["outlook", "windy"]


def values(df, key="a1"):
    return {r[key]: round(r["value"], 6) for r in df.collect()}


def test_golden_measures(weather):
    one, two = C.cube(weather, ATTS, 1), C.cube(weather, ATTS, 2)
    assert round(M.entropy(weather, [], ["y"]).first().value, 6) == 0.690894
    assert values(M.entropy(one, ["a1"], ["v1"])) == {"outlook": 1.577095, "windy": 0.998196}
    assert values(M.information(one, ["a1"], ["v1"], ["y"])) == {"outlook": 0.064422, "windy": 0.0032}
    assert values(M.symmetric_uncertainty(one, ["a1"], ["v1"], ["y"])) == {"outlook": 0.05681, "windy": 0.00379}
    pair = ["a1", "a2"]
    assert round(M.information(two, pair, ["v1"], ["v2"], ("y",)).first().value, 6) == 0.011254
    assert round(M.information(two, pair, ["v1"], ["v2"]).first().value, 6) == 0.004787
    assert round(M.information(two, pair, ["v1", "v2"], ["y"]).first().value, 6) == 0.074089


def test_measure_invariants(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(str(a), str(b), str(y), rng.randrange(6)) for a in range(3) for b in range(3) for y in range(2)], "a string, b string, y string, n long")
    ab, ba = C.cube(cells, ["a", "b"], 2), C.cube(cells, ["b", "a"], 2)
    cmi = [M.information(c, ["a1", "a2"], ["v1"], ["v2"], ("y",)).first().value for c in (ab, ba)]
    assert cmi[0] == pytest.approx(cmi[1]) and cmi[0] >= -1e-12
    su = M.symmetric_uncertainty(C.cube(cells, ["a", "b"], 1), ["a1"], ["v1"], ["y"]).collect()
    assert all(-1e-12 <= r.value <= 1 for r in su)


def test_chi_square_tail():
    # e^-x for two degrees, erfc for one
    assert M.gamma_tail(1.0, 2.0) == pytest.approx(math.exp(-2)) and M.gamma_tail(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2)))
    assert M.gamma_tail(0.5 * 4, 9.488 / 2) == pytest.approx(0.05, abs=1e-4) and M.gamma_tail(0.5 * 7, 14.067 / 2) == pytest.approx(0.05, abs=1e-4)
    assert M.binomial_tail(8, 10) == pytest.approx(56 / 1024) and M.binomial_tail(0, 5) == 1


def posterior_by_hand(rows, atts, parents, sizes, classes, m=1.0):
    """Naive loops over the training rows."""
    out = {}
    total = sum(n for *_, n in rows)
    count = lambda cond, y: sum(r[-1] for r in rows if r[-2] == y and all(r[atts.index(a)] == v for a, v in cond))
    for r in rows:
        scores = []
        for y in classes:
            s = (count([], y) + m / len(classes)) / (total + m)
            for a in atts:
                ps = [(p, r[atts.index(p)]) for p in parents.get(a, [])]
                s *= (count([(a, r[atts.index(a)]), *ps], y) + m / sizes[a]) / (count(ps, y) + m)
            scores.append(s)
        out[r[:-2]] = [s / sum(scores) for s in scores]
    return out


@pytest.mark.parametrize("parents", [{}, {"windy": ["outlook"]}])
def test_network_posteriors(weather, parents):
    rows = [(o, w, y, n) for (o, w), c in WEATHER.items() for y, n in zip(("no", "yes"), c)]
    want = posterior_by_hand(rows, ATTS, parents, {"outlook": 3, "windy": 2}, ["no", "yes"])
    got = N.Network(ATTS, parents).score(weather, N.Lookup(weather, ["no", "yes"]), C.domain_sizes(weather, ATTS)).collect()
    for r in got:
        assert r.p == pytest.approx(want[r.outlook, r.windy]) and sum(r.p) == pytest.approx(1)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(900):
        a, b = rng.randrange(3), rng.randrange(3)
        c = (a + b) % 3 if rng.random() < 0.8 else rng.randrange(3)
        d = rng.randrange(2)
        y = "p" if (c + d) % 2 else "q"
        rows[a, b, c, d, y] = rows.get((a, b, c, d, y), 0) + 1
    return spark.createDataFrame([(*map(str, k[:4]), k[4], n) for k, n in rows.items()], "a string, b string, c string, d string, y string, n long").cache()


ABCD = ["a", "b", "c", "d"]


def score(cells, model):
    classes = C.labels(cells)
    out = model.score(cells, N.Lookup(cells, classes), C.domain_sizes(cells, ABCD))
    return {tuple(r[a] for a in ABCD): r.p for r in out.collect()}


def test_learner_equivalences(cells):
    nb = score(cells, N.naive_bayes(ABCD))
    assert all(v == pytest.approx(nb[k]) for k, v in score(cells, N.fit_kdb(cells, ABCD, 0)).items())
    k1 = N.fit_kdb(cells, ABCD, 1)
    assert all(len(p) <= 1 for p in k1.parents.values()) and set(k1.parents) == set(ABCD)
    tan = N.fit_tan(cells, ABCD)
    assert len(tan.parents) == 3 and "a" not in tan.parents
    assert N.fit_cbn(cells, ABCD, 10**9).parents == {a: sorted(N.mi_order(cells, ABCD)[:i], key=k_best(cells, a)) for i, a in enumerate(N.mi_order(cells, ABCD))}
    for name in ("aode", "a2de", "a3de", "a2je", "aodeDist", "selective-kdb"):
        p = score(cells, N.LEARNERS[name](cells, ABCD))
        assert all(sum(v) == pytest.approx(1) for v in p.values())


def k_best(cells, a):
    cmi = {frozenset((r.a1, r.a2)): round(r.value, 9) for r in N.pair_cmi(cells, ABCD).collect()}
    order = N.mi_order(cells, ABCD)
    return lambda b: (-cmi[frozenset((a, b))], order.index(b))


def test_unseen_values_fall_back(spark, cells):
    odd = spark.createDataFrame([("9", "9", "9", "9", "p", 1)], cells.schema)
    classes, sizes = C.labels(cells), C.domain_sizes(cells, ABCD)
    for model in (N.naive_bayes(ABCD), N.AnDE(ABCD, 1), N.AnDE(ABCD, 2)):
        p = model.score(odd, N.Lookup(cells, classes), sizes).first().p
        assert sum(p) == pytest.approx(1)


def test_cross_validation_holds_out(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, str(rng.randrange(3)), str(rng.randrange(2)), rng.choice("pq")) for i in range(200)], "id long, a string, b string, y string")
    scored, classes = E.cross_validate(df, ["a", "b"], folds=4)
    got = {(r.fold, r.a, r.b, r.y): r.p for r in scored.collect()}
    cut = df.withColumn("fold", C.fold_of("id", 4))
    sizes = C.domain_sizes(C.cuboid(df, ["a", "b"]), ["a", "b"])
    for f in range(4):
        train = C.cuboid(cut.where(F.col("fold") != f), ["a", "b"])
        test = C.cuboid(cut.where(F.col("fold") == f), ["a", "b"])
        for r in N.naive_bayes(["a", "b"]).score(test, N.Lookup(train, classes), sizes).collect():
            assert r.p == pytest.approx(got[f, r.a, r.b, r.y])


def test_rank_statistics(spark):
    table = {"d1": (0.1, 0.2, 0.3), "d2": (0.15, 0.15, 0.4), "d3": (0.3, 0.2, 0.1), "d4": (0.05, 0.1, 0.2)}
    m = spark.createDataFrame([(d, x, v) for d, vs in table.items() for x, v in zip("ABC", vs)], "dataset string, learner string, value double")
    r = X.average_ranks(m)
    assert {x.learner: x.avg_rank for x in X.mean_ranks(r).collect()} == {"A": 1.625, "B": 1.875, "C": 2.5}
    f = X.friedman(r).first()
    assert (f.chi2, f.critical, f.significant) == (pytest.approx(1.625), 5.991, False)
    assert X.critical_difference(r).first().cd == pytest.approx(1.656751, abs=1e-6)
    assert {x.learner for x in X.cd_groups(r).collect()} == {"A", "B", "C"}
    assert {(x.a, x.b): (x.win, x.draw, x.loss) for x in X.win_draw_loss(m).collect()} == {("A", "B"): (2, 1, 1), ("A", "C"): (3, 0, 1), ("B", "C"): (3, 0, 1)}
    partial = m.union(spark.createDataFrame([("d5", "A", 0.1)], m.schema))
    assert X.complete_matrix(partial).select("dataset").distinct().count() == 4


def test_auc_and_mcc(spark):
    rng = random.Random(7)
    pts = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(60)]
    df = spark.createDataFrame([("k", s, int(y), int(not y)) for s, y in pts], "k string, score double, pos int, neg int")
    pairs = [(a, b) for a, y in pts for b, z in pts if y and not z]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert X.roc_auc(df, ["k"]).first().auc == pytest.approx(want)
    squashed = df.withColumn("score", F.pow("score", F.lit(3)))
    assert X.roc_auc(squashed, ["k"]).first().auc == pytest.approx(want)
    assert X.roc_auc(df.where("pos = 1"), ["k"]).first().auc is None
    conf = spark.createDataFrame([("a", "a", 5), ("b", "b", 5)], "y string, pred string, n long")
    assert X.mcc(conf).first().mcc == pytest.approx(1)
    one = spark.createDataFrame([("a", "a", 5)], "y string, pred string, n long")
    assert X.mcc(one).first().mcc == 0


def test_discretisers(spark):
    rng = random.Random(9)
    vals = [rng.randrange(40) for _ in range(200)]
    df = spark.createDataFrame([(float(v), "in" if 10 < v <= 25 else "out") for v in vals] + [(None, "in")], "x double, y string")
    counts = D.value_counts(df, ["x"])
    s = sorted(vals)
    for k in (2, 4, 10, 37):
        want = sorted({s[len(s) * i // k - 1] for i in range(1, k) if len(s) * i // k} - {s[-1]})
        assert sorted(r.cut for r in D.equal_depth(counts, k).collect()) == want
    cuts = sorted(r.cut for r in D.mdl(counts, ["in", "out"]).collect())
    assert len(cuts) == 2 and 10 <= cuts[0] <= 12 and 25 <= cuts[1] <= 27
    best = D.binary_cut(counts, ["in", "out"]).first()

    def entropy(part):
        return -sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part)) if part else 0

    ys = [("in" if 10 < v <= 25 else "out", v) for v in vals]
    grid = sorted(set(vals))
    costs = {}
    for a, b in zip(grid, grid[1:]):
        left, right = [y for y, v in ys if v <= a], [y for y, v in ys if v > a]
        costs[(a + b) / 2] = round((len(left) * entropy(left) + len(right) * entropy(right)) / len(ys), 9)
    assert best.cut == max(c for c in costs if costs[c] == min(costs.values()))
    codes = D.apply_cuts(df, D.mdl(counts, ["in", "out"]), ["x"])
    assert codes.where("y = 'in'").select("x").distinct().count() == 2  # the band and unknown
    assert D.interval_labels([1.0, 2.0], True) == ["<=1", "(1,2]", ">2", "unknown"] and D.interval_labels([]) == ["known"]
    flat = D.value_counts(spark.createDataFrame([(1.0, "a"), (1.0, "b")], "x double, y string"), ["x"])
    assert D.binary_cut(flat, ["a", "b"]).count() == 0 and D.mdl(flat, ["a", "b"]).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, -5.0, "u"), (2, -1.0, "v"), (3, None, "u")], "id long, x double, y string")
    t = L.normalise(df, L.fit_minmax(df, ["x"])).orderBy("id").collect()
    assert [r.x for r in t] == [0.0, 1.0, None]
    with pytest.raises(ValueError):
        L.class_filter(df, "w")
    assert L.normalise(df.where("id = 1"), {"x": (-5.0, -5.0)}).first().x == 0
    assert L.valid_job({"learners": ["selective-kdb"], "folds": 5}) and not L.valid_job({"learners": ["a b"]})


def test_trees(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("uvw"), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(i, c, x, "hi" if c == "u" and x > 0.5 else "lo") for i, c, x in rows], "id long, c string, x double, y string")
    cells = df.withColumn("n", F.lit(1))
    tree = R.fit_tree(cells, ["c"], ["x"], ["hi", "lo"])
    pred = N.predicted(F.col("p"), ["hi", "lo"])
    assert R.score_tree(cells, tree).where(pred != F.col("y")).count() <= 4
    new = spark.createDataFrame([(1, "zz", None, "lo", 1)], cells.schema)
    assert sum(R.score_tree(new, tree).first().p) == pytest.approx(1)
    scored, classes = G.bagged_trees(df, ["c"], ["x"], 3)
    assert scored.where(N.predicted(F.col("p"), classes) != F.col("y")).count() <= 12


def test_sampling(spark):
    df = spark.range(500).withColumn("w", F.lit(1.0) + F.col("id") % 3)
    s = P.bias_variance_split(df, "id", 100, 50, 1)
    assert {r.part: r["count"] for r in s.groupBy("part").count().collect()} == {"train": 100, "test": 50}
    other = P.bias_variance_split(df, "id", 100, 50, 2)
    same = s.where("part = 'test'").join(other.where("part = 'test'"), "id").count()
    assert same == 50
    drawn = P.bootstrap_counts(df, "id", 4).groupBy("bag").agg(F.sum("times").alias("n")).collect()
    assert len(drawn) == 4 and all(350 < r.n < 650 for r in drawn)
    assert P.systematic_resample(df, "id", "w", 200).agg(F.sum("times")).first()[0] == 200


def test_schema_grammar():
    s = pmeta.parse_pmeta(":: comment\n:class: class : a, b\nx1 : v0, v1, ?\nn1 : numeric, ?\n:index=1-3: pix : numeric\n:width=2: code : 01, 02\n")
    assert [f.name for f in s] == ["class", "x1", "n1", "pix_1", "pix_2", "pix_3", "code"]
    assert s["x1"].metadata["missing"] and s["n1"].metadata["missing"] and s["code"].metadata["width"] == 2
    assert pmeta.class_field(pmeta.parse_pmeta("x : a, b\nclass : c, d\n")).name == "class"
    again = pmeta.parse_pmeta(pmeta.format_pmeta(s))
    assert {f.name for f in again} == {f.name for f in s} and pmeta.class_field(again).name == "class"
    assert len(pmeta.parse_pmeta(":libsvm:4\n:class: y : a, b\n")) == 5
    for bad in ("x : a, b", ":class: y : a, b\n:class: z : c, d", ":class: y : a, a", ":class: :class: y : a, b", ":class: y : numeric", ":class: y : a, b\nnothing here"):
        with pytest.raises(pmeta.SchemaError):
            pmeta.parse_pmeta(bad)


def test_readers(spark):
    s = pmeta.parse_pmeta(":class: y : Yes, no\nn : numeric, ?\nm : numeric\n")
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = readers.parse_delimited(text("yes, 1.5e2 , -3", "NO,?,0", ""), s).collect()
    assert [tuple(r) for r in got] == [("Yes", 150.0, -3.0), ("no", None, 0.0)]
    for bad in ("maybe,1,2", "yes,1", "yes,1,2,3", "yes,1,?", "yes,1,x"):
        with pytest.raises(Exception, match="expected|unknown|no number"):
            readers.parse_delimited(text(bad), s).collect()
    sparse = readers.parse_sparse(text("a 1:2 3:0.5", "b"), 3).collect()
    assert [tuple(r) for r in sparse] == [("a", 2.0, 0.0, 0.5), ("b", 0.0, 0.0, 0.0)]
    fixed = readers.parse_fixed_width(text("yes 12", "no   7"), pmeta.parse_pmeta(":class: :width=3: y : yes, no\n:width=3: n : numeric\n")).collect()
    assert [tuple(r) for r in fixed] == [("yes", 12.0), ("no", 7.0)]


def test_files_round_trip(spark, tmp_path):
    s = pmeta.parse_pmeta(":class: y : a, b\nc : u, v\nn : numeric, ?\n")
    (tmp_path / "t.pdata").write_text("a,u,1\nb,v,?\n")
    df = readers.read_pdata(spark, str(tmp_path / "t.pdata"), s)
    assert sorted(map(str, df.collect())) == ["Row(y='a', c='u', n=1.0)", "Row(y='b', c='v', n=None)"]
    exporters.arff_rows(df, ["c"], ["n"]).write.text(str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"u,1.0000,a", "v,?,b"}
    (tmp_path / "t.svm").write_text("a 2:1.5\n")
    assert readers.read_sparse(spark, str(tmp_path / "t.svm"), 2).first().a_2 == 1.5


def test_result_documents(spark):
    m = spark.createDataFrame([(1, "nb", "rmse", 0, -1, 0.5), (1, "nb", "auc", 0, 0, float("nan"))], "run_id long, learner string, metric string, trial int, fold int, value double")
    doc = exporters.result_document(m)
    assert "NaN" not in doc.first().doc
    t = exporters.ingest(doc)["metrics"].orderBy("metric").collect()
    assert [(r.metric, r.value) for r in t] == [("auc", None), ("rmse", 0.5)]
    odd = spark.createDataFrame([(2, '{"dataset":"d","mode":"xval","learners":["nb"],"metrics":[{"learner":"nb","metric":"rmse","value":1.0}],"confusion":[{"learner":"nb","noClasses":2,"matrix":[1,2,3,4]}]}')], "run_id long, doc string")
    parts = exporters.ingest(odd)
    r = parts["metrics"].first()
    assert (r.trial, r.fold) == (0, -1)
    assert [(r.t, r.p, r.n) for r in parts["confusion"].collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]


def test_states_and_plans():
    assert S.next_state("running", "done") == "done"
    with pytest.raises(ValueError):
        S.next_state("done", "running")
    p = S.plan_from_text("learning curve of aode on iris, 1-fold", ["iris"], ["nb", "aode"])
    assert p == {"datasets": ["iris"], "learners": ["aode"], "metric": "0-1_loss", "mode": "curves", "folds": 2}


@pytest.mark.parametrize("block", [7, 4096])
def test_prequential_against_a_loop(spark, block):
    rng = random.Random(4)
    rows = [(i, rng.choice("pq"), rng.choice("uvw"), rng.choice("xy")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y string, a string, b string")
    got = {r.id: r.pred for r in E.prequential_nb(df, ["a", "b"], ["p", "q"], {"a": 3, "b": 2}, block=block).collect()}
    for i, _, a, b in rows:
        past, best = rows[:i], []
        for y in "pq":
            ny = sum(r[1] == y for r in past)
            s = (ny + 0.5) / (len(past) + 1)
            for at, v, k in ((2, a, 3), (3, b, 2)):
                s *= (sum(r[1] == y and r[at] == v for r in past) + 1 / k) / (ny + 1)
            best.append(s)
        assert got[i] == "pq"[best[1] > best[0] * (1 + 1e-8)]


def test_places_of_a_sort(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1.0, 2.0, rng.random() * 9])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, price double").repartition(5)
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((p, i) for i, p in rows))}
    assert {r.id: r.place for r in P.placed(df, [P.ranges(df, "price", 16).alias("_k0")], [F.col("price"), F.col("id")]).collect()} == want
    got = sorted((r.place, r.id) for r in P.shuffled(df, "id", 5).collect())
    assert [i for _, i in got] == sorted(range(400), key=lambda i: (int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:13], 16), i)) and [k for k, _ in got] == list(range(1, 401))


def test_aode_of_many_attributes(spark):
    """Against a loop over all parents and children, null values included."""
    rng = random.Random(3)
    atts = [f"x{i}" for i in range(12)]
    rows = [(rng.choice("pq"), *(rng.choice(["u", "v", None]) if i == 3 else rng.choice("uv") for i in range(12))) for _ in range(60)]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{a} string" for a in atts))
    cells = C.cuboid(df, atts)
    classes, sizes = C.labels(cells), dict.fromkeys(atts, 2)
    got = {tuple(r[a] for a in atts): r.p for r in N.AnDE(atts, 1).score(cells, N.Lookup(cells, classes), sizes).collect()}

    def count(y, **want):
        return sum(r[0] == y and all(v is not None and r[1 + atts.index(a)] == v for a, v in want.items()) for r in rows)

    for values, p in list(got.items())[:15]:
        v = dict(zip(atts, values))
        votes = {y: 0.0 for y in classes}
        for a in atts:
            if sum(count(y, **{a: v[a]}) for y in classes) < 1:
                continue
            for y in classes:
                own = count(y, **{a: v[a]})
                s = (own + 1 / 4) / (len(rows) + 1)
                for c in atts:
                    if c != a:
                        s *= (count(y, **{a: v[a], c: v[c]}) + 1 / 2) / (own + 1)
                votes[y] += s
        total = sum(votes.values())
        assert p == pytest.approx([votes[y] / total for y in classes], abs=1e-9)


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(str(i % 2), i, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "att string, seq long, value double")
    for k in range(4):
        df.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.stream_bins(stream, 5, 20).writeStream.format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.att, r.seq): r.code for r in spark.sql("SELECT * FROM bins").collect()}
    # files arrive in order of their writing, each holding a run of the sequence
    want = {(r.att, r.seq): r.code for r in online.batch_bins(df, "sliding", 5, 20).collect()}
    assert got == want
    counts = online.running_counts(df.select(F.col("att").alias("y"), F.lit("v").alias("a")), ["a"]).collect()
    assert sorted(r.n for r in counts) == [100, 100]


def test_online_bins_hold_their_bounds():
    rng = random.Random(1)
    for b in (online.SlidingBins(5, 50), online.SampledBins(5, 50), online.PartitionIncremental(0.0, 1.0)):
        codes = [b.step(rng.random()) for _ in range(3000)]
        assert all(0 <= c < 5 for c in codes) and b.step(None) is None
        share = [codes[500:].count(k) / 2500 for k in range(5)]
        assert all(0.12 < s < 0.28 for s in share)
    m = online.OnlineLogistic(["a", "b"])
    for _ in range(400):
        p = m.step({"": 1.0, "x": 1.0}, "a")
        m.step({"": 1.0, "y": 1.0}, "b")
    assert p[0] > 0.8


def test_every_twin_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


TWINS = ["agg_xxy", "ms_cmi", "ms_errordiff", "ln_nb", "ln_aode", "ln_a2de", "eval_xval_nb", "agg_auc_multi", "dsc_eqdepth", "dsc_mdl2", "smp_bootstrap", "agg_cd_groups", "st_prequential", "src_pdata", "top_k_parents", "ms_opus"]


@pytest.mark.parametrize("name", TWINS)
def test_twins(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    a, b = entry.queries()[name](spark, d).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    key = lambda df: sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].to_numpy().tolist())
    assert sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


def backed_off(train, row, parents, sizes, classes, least):
    """Posterior of a network whose last parents are left out until enough rows have the rest."""
    out = []
    for y in classes:
        mine = [t for t in train if t[0] == y]
        p = (len(mine) + 1 / len(classes)) / (len(train) + 1)
        for a, ps in parents.items():
            ps = list(ps)
            while ps and sum(all(t[x] == row[x] for x in ps) for t in train) < least:
                ps.pop()
            same = [t for t in mine if all(t[x] == row[x] for x in ps)]
            p *= (sum(t[a] == row[a] for t in same) + 1 / sizes[a]) / (len(same) + 1)
        out.append(p)
    return [p / sum(out) for p in out]


@pytest.mark.parametrize("least", [1, 6])
def test_backing_off_to_the_longest_seen_prefix(spark, least):
    rng = random.Random(5)
    names, places = ["a", "b", "c", "d", "e"], {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    train = [(rng.choice("pq"), *(rng.choice("uvwxyz"[:k]) for k in (2, 3, 4, 5, 6))) for _ in range(120)]
    rows = [(rng.choice("pq"), *(rng.choice("uvwxyz!"[: k + 1]) for k in (2, 3, 4, 5, 6))) for _ in range(60)]  # with unseen values
    schema = "y string, " + ", ".join(f"{a} string" for a in names)
    cells = C.cuboid(spark.createDataFrame(train, schema), names)
    net = N.Network(names, {"b": ["a"], "c": ["b", "a"], "d": ["c", "a", "b"], "e": ["d", "c", "b"]}, backoff=least)
    sizes = C.domain_sizes(cells, names)
    got = {tuple(r[x] for x in ["y", *names]): r.p for r in net.score(spark.createDataFrame(list(set(rows)), schema), N.Lookup(cells, ["p", "q"]), sizes).collect()}
    parents = {places[a]: [places[p] for p in net.parents.get(a, [])] for a in names}
    for r in set(rows):
        assert got[r] == pytest.approx(backed_off(train, r, parents, {places[a]: k for a, k in sizes.items()}, ["p", "q"], least), abs=1e-9)


def test_bags_look_up_their_own_counts(spark):
    cells = spark.createDataFrame([(0, "u", "p", 3), (0, "v", "q", 1), (1, "u", "q", 2)], "bag int, a string, y string, n long")
    rows = spark.createDataFrame([(b, v) for b in (0, 1) for v in ("u", "v")], "bag int, a string")
    got = N.naive_bayes(["a"]).score(rows, N.Lookup(cells, ["p", "q"], within="bag"), {"a": 2}).collect()
    for r in got:
        n = {"p": 3 if r.bag == 0 else 0, "q": 1 if r.bag == 0 else 2}
        hit = {"p": 3 * (r.bag == 0 and r.a == "u"), "q": (1 if r.a == "v" else 0) if r.bag == 0 else 2 * (r.a == "u")}
        raw = [(n[y] + 0.5) / (sum(n.values()) + 1) * (hit[y] + 0.5) / (n[y] + 1) for y in "pq"]
        assert r.p == pytest.approx([x / sum(raw) for x in raw])


def test_hashes_of_two_seeds_are_independent(spark):
    n = 20000
    h = spark.range(n).select(*(C.portable_hash("id", s).alias(f"h{s}") for s in (0, 1)), C.portable_hash(F.col("id") + 2 * 10**15).alias("far")).collect()
    a, b = [r.h0 / C.HASH_SPACE for r in h], [r.h1 / C.HASH_SPACE for r in h]
    corr = (sum(x * y for x, y in zip(a, b)) / n - sum(a) * sum(b) / n / n) * 12
    assert abs(corr) < 0.03 and abs(sum(a) / n - 0.5) < 0.01 and len({r.h0 for r in h}) == n
    # differences are no constant, and rows of one fold spread over the folds of another experiment
    assert len({round(x - y, 6) % 1 for x, y in zip(a[:100], b[:100])}) > 90
    both = spark.range(n).groupBy(C.fold_of("id", 5, 0).alias("f"), C.fold_of("id", 5, 1).alias("g")).count().collect()
    assert len(both) == 25 and all(abs(r["count"] - n / 25) < 150 for r in both)


def test_bootstrap_has_no_cap(spark):
    steps = P.poisson_steps()
    assert len(steps) > 14 and steps[:2] == pytest.approx([math.exp(-1), 2 * math.exp(-1)]) and steps == sorted(set(steps))
    t = P.bootstrap_counts(spark.range(100_000), "id", 2).agg(F.sum("times"), F.max("times"), F.sum(F.col("times") * F.col("times"))).first()
    assert abs(t[0] / 200_000 - 1) < 0.02 and t[1] >= 7 and abs(t[2] / 200_000 - 2) < 0.05


@pytest.mark.parametrize("parts", [1, 8])
def test_draws_by_place(spark, parts):
    """A million rows, or with gaps, whatever the number of partitions."""
    import numpy as np

    n = 1_000_000
    want = np.random.RandomState(7)._bit_generator.random_raw(n).astype(np.int64)
    assert np.random.RandomState(7).randint(0, 2**32, 5, dtype=np.uint32).astype(np.int64).tolist() == want[:5].tolist()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = P.mersenne_draws(spark.range(1, n + 1).withColumnRenamed("id", "place"), "place", 7).toPandas().sort_values("place")
        assert (got["draw"].to_numpy() == want).all()
        few = P.mersenne_draws(spark.range(3, n, 997).withColumnRenamed("id", "place"), "place", 7).collect()
        assert all(r.draw == want[r.place - 1] for r in few)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_drawn_folds(spark):
    import numpy as np

    want = np.random.RandomState(3)._bit_generator.random_raw(500) % 10
    got = P.drawn_folds(spark.range(1, 501).withColumnRenamed("id", "place"), "place", 10, 3).collect()
    assert {r.place: r.fold for r in got} == {i + 1: int(f) for i, f in enumerate(want)}
