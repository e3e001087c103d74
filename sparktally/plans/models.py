"""Queries: trees, ensembles, linear models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import ensembles as G
from ..operators import evaluate as E
from ..operators import linear as Z
from ..operators import trees as R
from ..operators.bayes import Lookup, naive_bayes, predicted
from ..sources import bindings as B
from ..streaming import online as O
from .cubes_and_measures import order_cells
from .learning import KEY, NB_SQL, OA, _losses
from .registry import query
from .sqltext import LOSSES, network_sql, with_inst

ORDERS, EVENTS = B.ORDERS_SQL, B.EVENTS_SQL
EA = B.EVENT_ATTS


def _scored_losses(scored, classes):
    if "n" not in scored.columns:
        scored = scored.withColumn("n", F.lit(1).cast("long"))
    return _losses(scored.withColumn("pred", predicted(F.col("p"), classes)), classes)


def _banded(spark, d):
    """A problem with structure: price bands crossed with segments decide the class."""
    o = B.orders_problem(spark, d)
    y = F.when((F.col("price") > 150000) & F.col("seg").isin("BUILDING", "MACHINERY"), "hi").when(F.col("bal") > 5000, "mid").otherwise("lo")
    return o.select("id", y.alias("y"), "seg", "region", "price", "bal")


@query("ln_dtree")
def ln_dtree(spark, d):
    df = _banded(spark, d)
    cells = df.groupBy("seg", "region", "price", "bal", "y").agg(F.count("*").alias("n"))
    classes = C.labels(cells)
    tree = R.fit_tree(cells, ["seg", "region"], ["price", "bal"], classes)
    return _scored_losses(R.score_tree(cells, tree), classes)


@query("ln_rfdt")
def ln_rfdt(spark, d):
    df = _banded(spark, d)
    cells = df.groupBy("seg", "region", "price", "bal", "y").agg(F.count("*").alias("n"))
    classes = C.labels(cells)
    tree = R.fit_tree(cells, ["seg", "region"], ["price", "bal"], classes, subset=2, seed=3)
    return _scored_losses(R.score_tree(cells, tree), classes)


# the root's choice is one grouped computation, so SQL can hold the tree's split measure
ROOT = with_inst(ORDERS) + """, c AS (SELECT 'prio' AS att, prio AS val, y, count(*) AS n FROM inst GROUP BY ALL UNION ALL SELECT 'seg', seg, y, count(*) FROM inst GROUP BY ALL UNION ALL SELECT 'region', region, y, count(*) FROM inst GROUP BY ALL),
v AS (SELECT *, sum(n) OVER (PARTITION BY att, val) AS nv, sum(n) OVER (PARTITION BY att) AS nn, sum(n) OVER (PARTITION BY att, y) AS ny FROM c)
SELECT att, round(sum(n / nn * log2(n * nn / (nv * ny))) / (SELECT sum(-nv2 / nn2 * log2(nv2 / nn2)) FROM (SELECT DISTINCT att AS a2, val, nv AS nv2, nn AS nn2 FROM v) WHERE a2 = att), 6) AS ratio FROM v GROUP BY att"""


@query("tree_gain_ratio", ROOT)
def tree_gain_ratio(spark, d):
    cells = order_cells(spark, d).withColumn("node", F.lit(""))
    t = R._candidates(cells, ["prio", "seg", "region"], [], C.labels(cells))
    return t.select("att", F.round(F.col("gain") / F.col("info"), 6).alias("ratio"))


@query("ln_bag")
def ln_bag(spark, d):
    return _scored_losses(*G.bagged_nb(B.orders_problem(spark, d), OA, 10, average=True))


@query("ln_bag_vote")
def ln_bag_vote(spark, d):
    scored, classes = G.bagged_nb(B.orders_problem(spark, d), OA, 10)
    t = scored.withColumn("pred", predicted(F.col("p"), classes))
    return t.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("pred") != F.col("y"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("zero_one"))


@query("ln_ens")
def ln_ens(spark, d):
    """A forest of bagged trees on attribute subsets."""
    scored, classes = G.bagged_trees(_banded(spark, d), ["seg", "region"], ["price", "bal"], 3, subset=3, max_depth=6)
    return _scored_losses(scored, classes)


@query("ln_ada")
def ln_ada(spark, d):
    from ..operators.session import shared_dir

    shared_dir(spark)
    scored, classes = G.adaboost_nb(B.orders_problem(spark, d), OA, 5)
    t = scored.withColumn("pred", predicted(F.col("p"), classes))
    return t.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("pred") != F.col("y"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("zero_one"))


def _feat_sql(order):
    """Feating with naive Bayes leaves: for each value tuple its own class prior and factors, posteriors averaged."""
    from itertools import combinations

    f = [f"cells AS (SELECT {KEY}, y, count(*) AS n FROM inst GROUP BY ALL)", "cls AS (SELECT DISTINCT y AS class FROM inst)"]
    f += [f"k_{a} AS (SELECT count(DISTINCT {a}) AS k FROM inst)" for a in OA]
    parts = []
    for i, s in enumerate(combinations(OA, order)):
        on = " AND ".join(f"b{i}.{a} = cells.{a}" for a in s)
        f.append(f"b{i} AS (SELECT {', '.join(s)}, y, count(*) AS n FROM inst GROUP BY ALL)")
        f.append(f"t{i} AS (SELECT {', '.join(s)}, count(*) AS n FROM inst GROUP BY ALL)")
        joins = f" JOIN t{i} ON {' AND '.join(f't{i}.{a} = cells.{a}' for a in s)} LEFT JOIN b{i} ON b{i}.y = class AND {on}"
        terms = [f"ln((coalesce(b{i}.n, 0) + 1.0::DOUBLE / 3) / (t{i}.n + 1.0))"]
        for a in OA:
            if a in s:
                continue
            f.append(f"c{i}_{a} AS (SELECT {', '.join(s)}, {a}, y, count(*) AS n FROM inst GROUP BY ALL)")
            joins += f" CROSS JOIN k_{a} LEFT JOIN c{i}_{a} ON c{i}_{a}.y = class AND c{i}_{a}.{a} = cells.{a} AND {' AND '.join(f'c{i}_{a}.{x} = cells.{x}' for x in s)}"
            terms.append(f"ln((coalesce(c{i}_{a}.n, 0) + 1.0::DOUBLE / k_{a}.k) / (coalesce(b{i}.n, 0) + 1.0))")
        cols = ", ".join(f"cells.{a}" for a in OA)
        f.append(f"l{i} AS (SELECT {cols}, cells.y, class, {' + '.join(terms)} AS lp FROM cells CROSS JOIN cls{joins})")
        f.append(f"p{i} AS (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY {KEY}, y) AS p FROM l{i})")
        parts.append(f"SELECT {KEY}, y, class, p FROM p{i}")
    f.append(f"post AS (SELECT {KEY}, y, class, avg(p) AS p FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)")
    return with_inst(ORDERS, *f) + f" SELECT {KEY}, y, class, round(p, 6) AS p FROM post"


for _i in (1, 2, 3):
    def _feat(spark, d, order=_i):
        from ..operators.bayes import posterior

        scored, classes = G.feating(B.orders_problem(spark, d), OA, order)
        return posterior(scored, classes, [*OA, "y"]).withColumn("p", F.round("p", 6))

    query(f"ln_feat{_i}", _feat_sql(_i))(_feat)


@query("ln_stack")
def ln_stack(spark, d):
    return _scored_losses(*G.stacked(B.orders_problem(spark, d), OA))


PAIRED = ["prio_seg", "prio_region", "seg_region"]
PAIRED_SQL = f"SELECT id, y, {', '.join(f'concat_ws(chr(124), {a}, {b}) AS {a}_{b}' for a, b in (('prio', 'seg'), ('prio', 'region'), ('seg', 'region')))} FROM ({ORDERS})"


@query("ln_filtered", with_inst(PAIRED_SQL, network_sql(PAIRED, {})) + " " + LOSSES.format(key=", ".join(PAIRED)))
def ln_filtered(spark, d):
    """Naive Bayes on pairs of attributes made by the quadratic filter."""
    from ..operators.filters import quadratic

    t = quadratic(B.orders_problem(spark, d), [], {"prio": [], "seg": [], "region": []}, ["id", "y"])
    atts = [c.replace("*", "_") for c in t.columns if "*" in c]
    t = t.toDF(*(c.replace("*", "_") for c in t.columns))
    scored, classes = E.score_cells(C.cuboid(t, atts), atts)
    return _losses(scored, classes)


def _lr_start_sql() -> str:
    """Gradient at naive Bayes: weights of 1 on the logs of its parameters."""
    out = [network_sql(OA, {}), "miss AS (SELECT *, n * (p - CASE WHEN class = y THEN 1 ELSE 0 END) AS g FROM post)"]
    parts = ["SELECT '' AS att, '' AS value, class, sum(g) * max(ln((ny + 1.0::DOUBLE / k) / (nn + 1))) AS g FROM miss JOIN cls USING (class) CROSS JOIN tot GROUP BY class"]
    for a in OA:
        parts.append(f"SELECT '{a}', m.{a}, m.class, sum(g) * max(ln((coalesce(f.n, 0) + 1.0::DOUBLE / k_{a}.k) / (ny + 1))) FROM miss m JOIN cls USING (class) CROSS JOIN k_{a} LEFT JOIN f_{a} f ON f.{a} = m.{a} AND f.y = m.class GROUP BY m.{a}, m.class")
    return with_inst(ORDERS, *out) + " SELECT att, value, class, round(g, 4) AS g FROM (" + " UNION ALL ".join(parts) + ")"


@query("ln_lr_gradient", _lr_start_sql())
def ln_lr_gradient(spark, d):
    """The first gradient of the scaled regression."""
    cells = C.cuboid(B.orders_problem(spark, d), OA)
    classes, domains = C.labels(cells), Z.domains_of(cells, OA)
    scale = Z.naive_bayes_scale(cells, OA, classes, domains)
    _, g = Z.loss_and_gradient(Z.code_cells(cells, OA, classes, domains), np.ones_like(scale), scale)
    names = [("", ""), *((a, v) for a, dom in zip(OA, domains, strict=True) for v in dom)]
    return spark.createDataFrame([(a, v, c, float(g[i, j])) for i, c in enumerate(classes) for j, (a, v) in enumerate(names)], "att string, value string, class string, g double").withColumn("g", F.round("g", 4))


@query("ln_lr")
def ln_lr(spark, d):
    """Logistic regression on the categories of the orders."""
    cells = C.cuboid(B.orders_problem(spark, d), OA)
    return _scored_losses(Z.fit_logistic(cells, OA).score(cells), C.labels(cells))


@query("ln_lr_w")
def ln_lr_w(spark, d):
    """The same on the logs of naive Bayes parameters, started there."""
    cells = C.cuboid(B.orders_problem(spark, d), OA)
    return _scored_losses(Z.fit_logistic(cells, OA, scaled=True).score(cells), C.labels(cells))


# --- streams: events in order of arrival


def _nb_errors(spark, d):
    df = B.events_problem(spark, d)
    cells = C.cuboid(df, EA)
    classes = C.labels(cells)
    return E.prequential_nb(df, EA, classes, C.domain_sizes(cells, EA))


def _preq_sql():
    lp = "ln((coalesce(ny, 0) + 1.0::DOUBLE / k) / (tot + 1.0))" + "".join(f" + ln((coalesce(n_{a}, 0) + 1.0::DOUBLE / (SELECT count(DISTINCT {a}) FROM inst)) / (coalesce(ny, 0) + 1.0))" for a in EA)
    counts = ", ".join(f"sum(CASE WHEN i.y = class THEN 1 ELSE 0 END) OVER (PARTITION BY class, {a} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_{a}" for a in EA)
    return with_inst(EVENTS, "cls AS (SELECT DISTINCT y AS class FROM inst)", f"w AS (SELECT i.id, i.y, class, (SELECT count(*) FROM cls) AS k, sum(CASE WHEN i.y = class THEN 1 ELSE 0 END) OVER (PARTITION BY class ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ny, row_number() OVER (PARTITION BY class ORDER BY id) - 1 AS tot, {counts} FROM inst i CROSS JOIN cls)", f"s AS (SELECT id, y, class, {lp} AS lp FROM w)", "q AS (SELECT id, y, class, round(exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY id), 9) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS mx FROM s))", "e AS (SELECT id, y, pred, CAST(pred <> y AS INT) AS error FROM (SELECT id, y, class AS pred, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rn FROM q) WHERE rn = 1)")


PREQ = _preq_sql()


@query("st_prequential", PREQ + " SELECT id // 500 AS block, count(*) AS n, round(avg(error), 6) AS error FROM e GROUP BY 1")
def st_prequential(spark, d):
    return E.interval_rates(_nb_errors(spark, d), "id", 500).withColumn("error", F.round("error", 6))


@query("win_interval_rate", "SELECT event_id // 1000 AS block, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error FROM events GROUP BY 1")
def win_interval_rate(spark, d):
    t = B.events_problem(spark, d).select("id", F.when(F.col("y") == "error", 1).otherwise(0).alias("error"))
    return E.interval_rates(t, "id", 1000).withColumn("error", F.round("error", 6))


@query("win_recent_errors", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS recent FROM events")
def win_recent_errors(spark, d):
    t = B.events_problem(spark, d).select("id", F.when(F.col("y") == "error", 1).otherwise(0).alias("error"))
    return E.smoothed(t, "id", 10, 1000).withColumn("recent", F.round("recent", 6))


@query("snk_plot", PREQ + " SELECT CAST((id // 500 + 1) * 500 AS VARCHAR) || chr(9) || printf('%.4f', round(avg(error), 4)) AS value FROM e GROUP BY id // 500")
def snk_plot(spark, d):
    t = E.interval_rates(_nb_errors(spark, d), "id", 500)
    return t.select(F.concat_ws("\t", ((F.col("block") + 1) * 500).cast("string"), F.format_string("%.4f", F.round("error", 4))).alias("value"))


@query("st_incremental", with_inst(EVENTS) + " SELECT att, val, y, count(*) AS n FROM (SELECT 'u8' AS att, u8 AS val, y FROM inst UNION ALL SELECT 'k4', k4, y FROM inst) GROUP BY ALL")
def st_incremental(spark, d):
    return O.running_counts(B.events_problem(spark, d), ["u8", "k4"])


def _values(spark, d):
    e = B.table(spark, d, "events")
    return e.select((F.col("user_id") % 16).cast("string").alias("att"), F.col("event_id").alias("seq"), F.col("value"))


@query("dsc_dynamic")
def dsc_dynamic(spark, d):
    return O.batch_bins(_values(spark, d), "sampled")


@query("st_dyn_disc")
def st_dyn_disc(spark, d):
    return O.batch_bins(_values(spark, d), "sliding")


@query("dsc_dynamic_drift", "SELECT CAST(user_id % 16 AS VARCHAR) AS att, event_id AS seq, value, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high, count(*) OVER w AS held FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def dsc_dynamic_drift(spark, d):
    """What a sliding window of 50 holds when each value arrives."""
    w = Window.partitionBy("att").orderBy("seq").rowsBetween(-50, -1)
    return _values(spark, d).select("att", "seq", "value", F.round(F.min("value").over(w), 6).alias("low"), F.round(F.max("value").over(w), 6).alias("high"), F.count("*").over(w).alias("held"))


@query("dsc_pid")
def dsc_pid(spark, d):
    v = _values(spark, d)
    lo, hi = v.agg(F.min("value"), F.max("value")).first()
    return O.batch_bins(v, "pid", low=lo, high=hi)


def _parts(spark, d):
    return B.events_problem(spark, d).withColumn("part", F.col("u8").cast("long")).withColumnRenamed("id", "seq").select("part", "seq", "y", *EA)


@query("st_sgd")
def st_sgd(spark, d):
    df = _parts(spark, d)
    return O.prequential_logistic(df, ["hour", "wday", "k4"], C.labels(df)).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query("ln_lrsgd")
def ln_lrsgd(spark, d):
    df = _parts(spark, d)
    return O.prequential_logistic(df, ["k4"], C.labels(df), rate=0.01).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query("ln_sslrsgd")
def ln_sslrsgd(spark, d):
    """A weight vector per attribute value: features crossed with the value of one attribute."""
    df = _parts(spark, d).withColumn("k4_wday", F.concat_ws("|", "k4", "wday"))
    return O.prequential_logistic(df, ["k4", "wday", "k4_wday"], C.labels(df)).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query("st_sgd_weights")
def st_sgd_weights(spark, d):
    """AODE over each part's events, its members weighted as they come."""
    df, atts = _parts(spark, d), ["hour", "wday", "k4"]
    cells = C.cuboid(df, atts)
    t = O.member_weights(df, atts, C.labels(cells), C.domain_sizes(cells, atts))
    return t.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"), F.transform(F.max_by("weights", "seq"), lambda w: F.round(w, 6)).cast("string").alias("weights"))


def _weighted(own):
    def score(spark, d):
        df = B.events_problem(spark, d)
        cells = C.cuboid(df, EA)
        classes = C.labels(cells)
        return _scored_losses(O.fit_weighted_aode(df, EA, own=own).score(cells, Lookup(cells, classes), C.domain_sizes(cells, EA)), classes)

    return score


query("ln_aode_wsgd")(_weighted(True))
query("ln_aode_wsgdh")(_weighted(False))


@query("st_stack")
def st_stack(spark, d):
    """Online stacking: the prequential base prediction is a feature of an online meta-learner."""
    e = _nb_errors(spark, d).select(F.col("id").alias("seq"), F.col("pred").alias("base"))
    df = _parts(spark, d).join(e, "seq")
    return O.prequential_logistic(df, ["base", "k4"], C.labels(df)).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


@query("src_stacked", with_inst(ORDERS, NB_SQL) + f" SELECT {KEY}, y, " + ", ".join(f"max(CASE WHEN class = '{c}' THEN round(p, 6) END) AS \"nb_{c}\"" for c in "FOP") + f" FROM post GROUP BY {KEY}, y")
def src_stacked(spark, d):
    """A base learner's outputs as numeric attributes: one per class."""
    cells = order_cells(spark, d)
    classes = C.labels(cells)
    scored = naive_bayes(OA).score(cells, Lookup(cells, classes), C.domain_sizes(cells, OA))
    return scored.select(*OA, "y", *(F.round(F.col("p")[i], 6).alias(f"nb_{c}") for i, c in enumerate(classes)))


