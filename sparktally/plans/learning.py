"""Queries: learners, cross-validation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import bayes as N
from ..operators import counts as C
from ..operators import evaluate as E
from ..sources import bindings as B
from .cubes_and_measures import order_cells
from .registry import query
from .sqltext import LOSSES, POSTERIOR, ande_sql, cube_sql, hash_sql, network_sql, with_inst

OA = B.ORDER_ATTS
ORDERS = B.ORDERS_SQL
KEY = ", ".join(OA)
POST = " " + POSTERIOR.format(key=KEY + ", y")
LOSS = " " + LOSSES.format(key=KEY)


def _posterior(scored, classes):
    return N.posterior(scored, classes, [*OA, "y"]).withColumn("p", F.round("p", 6))


def _losses(scored, classes):
    t = X.loss_table(scored, classes, F.col("pred"))
    return t.select(F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("zero_one", "rmse", "rmse_all", "logloss")))


def _score(spark, d, model):
    cells = order_cells(spark, d)
    classes, sizes = C.labels(cells), C.domain_sizes(cells, OA)
    return model(cells).score(cells, N.Lookup(cells, classes), sizes), classes


def learner(name, model, sql=None):
    """A query of the posterior of every distinct order tuple under ``model(cells)``."""
    query(name, sql and with_inst(ORDERS, sql) + POST)(lambda spark, d: _posterior(*_score(spark, d, model)))


NB_SQL = network_sql(OA, {})
learner("ln_nb", lambda c: N.naive_bayes(OA), NB_SQL)
CHAIN = {"seg": ["prio"], "region": ["seg"], "month": ["region"]}
learner("ln_bayes_net", lambda c: N.Network(OA, CHAIN), network_sql(OA, CHAIN))
TWO = {"seg": ["prio"], "region": ["seg", "prio"], "month": ["region", "seg"]}
learner("ln_bayes_net_k2", lambda c: N.Network(OA, TWO), network_sql(OA, TWO))
# structure is learnt by loops over small measure tables, beyond SQL: rows are checked by the tests
learner("ln_tan", lambda c: N.fit_tan(c, OA))
learner("ln_kdb", lambda c: N.fit_kdb(c, OA, 2))
learner("ln_kdb_k0", lambda c: N.fit_kdb(c, OA, 0), NB_SQL)
learner("ln_kdb_eager", lambda c: N.LEARNERS["kdbEager"](c, OA, k=1))
learner("ln_kdb_sel", lambda c: N.fit_selective_kdb(c, OA, 1))
learner("ln_cbn", lambda c: N.fit_cbn(c, OA, 200))
learner("ln_aode", lambda c: N.AnDE(OA, 1), ande_sql(OA, 1))
learner("ln_aode_eager", lambda c: N.AnDE(OA, 1), ande_sql(OA, 1))
learner("ln_aode_ext", lambda c: N.AnDE(OA, 1, weights=N.mi_weights(c, OA, 1), subsume=100))
learner("ln_aode_dist", lambda c: N.LEARNERS["aodeDist"](c, OA))
learner("ln_aode_selected", lambda c: N.AnDE(OA, 1, selected=OA[:2]), ande_sql(OA, 1, selected=OA[:2]))
learner("ln_a2de", lambda c: N.AnDE(OA, 2), ande_sql(OA, 2))
learner("ln_a2de2", lambda c: N.AnDE(OA, 2, selected=N.top_by_mi(c, OA, 0.75)))
learner("ln_a2de_ms", lambda c: N.AnDE(OA, 2, selected=N.top_by_mi(c, OA, 0.75), weights=N.mi_weights(c, OA, 2)))
learner("ln_disa2de", lambda c: (lambda s: N.AnDE(OA, 2, selected=s, children=s))(N.top_by_mi(c, OA, 0.75)))
learner("ln_a2de_discard", lambda c: N.AnDE(OA, 2, selected=OA[:3], children=OA[:3]), ande_sql(OA, 2, selected=OA[:3], children=OA[:3]))
learner("ln_a3de", lambda c: N.AnDE(OA, 3), ande_sql(OA, 3))
learner("ln_a3de_ms", lambda c: N.AnDE(OA, 3, selected=N.top_by_mi(c, OA, 1.0), weights=N.mi_weights(c, OA, 3)))


def _a2je_sql():
    from itertools import combinations

    f = [f"cells AS (SELECT {KEY}, y, count(*) AS n FROM inst GROUP BY ALL)", "cls AS (SELECT y AS class, count(*) AS ny FROM inst GROUP BY y)", "tot AS (SELECT sum(ny) AS nn, count(*) AS k FROM cls)"]
    f += [f"k_{a} AS (SELECT count(DISTINCT {a}) AS k FROM inst)" for a in OA]
    joins, terms = "".join(f" CROSS JOIN k_{a}" for a in OA), ["ln((ny + 1.0::DOUBLE / tot.k) / (nn + 1.0))"]
    for a, b in combinations(OA, 2):
        t = f"c_{a}_{b}"
        f.append(f"{t} AS (SELECT {a}, {b}, y, count(*) AS n FROM inst GROUP BY ALL)")
        joins += f" LEFT JOIN {t} ON {t}.y = class AND {t}.{a} = cells.{a} AND {t}.{b} = cells.{b}"
        terms.append(f"ln((coalesce({t}.n, 0) + 1.0::DOUBLE / (k_{a}.k * k_{b}.k)) / (ny + 1.0)) / {len(OA) - 1}")
    cells = ", ".join(f"cells.{a}" for a in OA)
    f.append(f"lp AS (SELECT {cells}, cells.y, cells.n, class, {' + '.join(terms)} AS lp FROM cells CROSS JOIN cls CROSS JOIN tot{joins})")
    f.append(f"post AS (SELECT {KEY}, y, n, class, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY {KEY}, y) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY {KEY}, y) AS mx FROM lp))")
    return ", ".join(f)


learner("ln_a2je", lambda c: N.A2JE(OA), _a2je_sql())


@query("ln_random", None)
def ln_random(spark, d):
    cells = order_cells(spark, d)
    classes = C.labels(cells)
    pick = F.pmod(F.xxhash64(*OA), F.lit(len(classes)))
    return _posterior(cells.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: (i == pick).cast("double"))), classes)


GNB = f""", stats AS (SELECT y AS class, avg(price) AS mp, stddev_samp(price) AS sp, avg(bal) AS mb, stddev_samp(bal) AS sb FROM inst GROUP BY y),
g AS (SELECT i.id, i.y, post.class, ln(p) - ln(sp) - ((price - mp) / sp) ** 2 / 2 - ln(sb) - ((bal - mb) / sb) ** 2 / 2 AS lp
  FROM inst i JOIN post ON post.y = i.y AND {' AND '.join(f'post.{a} = i.{a}' for a in OA)} JOIN stats ON stats.class = post.class WHERE i.id % 10 = 0)
SELECT id, class, round(exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY id), 6) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS mx FROM g)"""


@query("ln_gnb", with_inst(ORDERS, NB_SQL) + GNB.replace(" WHERE i.id % 10 = 0", ""))
def ln_gnb(spark, d):
    df = B.orders_problem(spark, d)
    cells = C.cuboid(df, OA)
    classes = C.labels(cells)
    scored = N.Gaussian(OA, ["price", "bal"]).score(df, df, classes, C.domain_sizes(cells, OA))
    return N.posterior(scored, classes, ["id"]).withColumn("p", F.round("p", 6))


# --- losses of the training fit


def fit_losses(name, model, sql=None):
    def f(spark, d):
        scored, classes = _score(spark, d, model)
        return _losses(scored.withColumn("pred", N.predicted(F.col("p"), classes)), classes)

    query(name, sql and with_inst(ORDERS, sql) + LOSS)(f)


fit_losses("eval_nb", lambda c: N.naive_bayes(OA), NB_SQL)
fit_losses("eval_aode", lambda c: N.AnDE(OA, 1), ande_sql(OA, 1))
fit_losses("eval_a2de", lambda c: N.AnDE(OA, 2), ande_sql(OA, 2))

# single metrics of the naive Bayes fit
ONE = {"agg_zero_one": "zero_one", "agg_rmse": "rmse", "agg_rmse_all": "rmse_all", "agg_logloss": "logloss"}
for _name, _col in ONE.items():
    query(_name, with_inst(ORDERS, NB_SQL) + f" SELECT n, {_col} FROM ({LOSS})")(lambda spark, d, c=_col: _nb_losses(spark, d).select("n", c))


def _nb(spark, d):
    scored, classes = _score(spark, d, lambda c: N.naive_bayes(OA))
    return scored.withColumn("pred", N.predicted(F.col("p"), classes)), classes


def _nb_losses(spark, d):
    return _losses(*_nb(spark, d))


CONF = f"conf AS (SELECT y, pred, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {KEY}, y, max(n) AS n, arg_max(class, (round(p, 9), -ord(class))) AS pred FROM post GROUP BY {KEY}, y) GROUP BY y, pred)"


@query("agg_confusion", with_inst(ORDERS, NB_SQL, CONF) + " SELECT * FROM conf")
def agg_confusion(spark, d):
    return X.confusion(_nb(spark, d)[0])


MCC = """ SELECT round(CASE WHEN (tot * tot - kk) * (tot * tot - rr) > 0 THEN (tot * hits - rk) / sqrt((tot * tot - kk) * (tot * tot - rr)) ELSE 0 END, 6) AS mcc
FROM (SELECT CAST(sum(n) AS DOUBLE) AS tot, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS hits FROM {t}),
(SELECT sum(r * k) AS rk, sum(r * r) AS rr, sum(k * k) AS kk FROM (SELECT c, sum(r) AS r, sum(k) AS k FROM (SELECT y AS c, CAST(n AS DOUBLE) AS r, 0.0 AS k FROM {t} UNION ALL SELECT pred, 0.0, CAST(n AS DOUBLE) FROM {t}) GROUP BY c))"""


@query("agg_mcc", with_inst(ORDERS, NB_SQL, CONF) + MCC.format(t="conf"))
def agg_mcc(spark, d):
    return X.mcc(X.confusion(_nb(spark, d)[0])).withColumn("mcc", F.round("mcc", 6))


@query("agg_mcc_soft", with_inst(ORDERS, NB_SQL, "soft AS (SELECT y, class AS pred, sum(n * p) AS n FROM post GROUP BY y, class)") + MCC.format(t="soft"))
def agg_mcc_soft(spark, d):
    scored, classes = _nb(spark, d)
    soft = N.posterior(scored, classes, ["y", "n"]).groupBy("y", F.col("class").alias("pred")).agg(F.sum(F.col("n") * F.col("p")).alias("n"))
    return X.mcc(soft).withColumn("mcc", F.round("mcc", 6))


BINARY = """ SELECT c AS class, round(CASE WHEN tp + tn = 0 THEN -1 WHEN fp + fn = 0 THEN 1 WHEN (tp + fp) = 0 OR (tp + fn) = 0 OR (tn + fp) = 0 OR (tn + fn) = 0 THEN 0
  ELSE (tp * tn - fp * fn) / (sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))) END, 6) AS mcc
FROM (SELECT c, CAST(sum(CASE WHEN y = c AND pred = c THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN y <> c AND pred <> c THEN n ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y <> c AND pred = c THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN y = c AND pred <> c THEN n ELSE 0 END) AS BIGINT) AS fn
  FROM conf, (SELECT DISTINCT y AS c FROM inst) GROUP BY c)"""


@query("agg_mcc_binary", with_inst(ORDERS, NB_SQL, CONF) + BINARY)
def agg_mcc_binary(spark, d):
    scored, classes = _nb(spark, d)
    conf = X.confusion(scored).withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    y, p = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    t = conf.groupBy("class").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("tp", y & p), ("tn", ~y & ~p), ("fp", ~y & p), ("fn", y & ~p))))
    return t.select("class", F.round(X.mcc_binary(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")), 6).alias("mcc"))


POINTS = "pts AS (SELECT class, round(p, 9) AS score, sum(CASE WHEN y = class THEN n ELSE 0 END) AS pos, sum(CASE WHEN y <> class THEN n ELSE 0 END) AS neg FROM post GROUP BY class, round(p, 9))"


def _points(spark, d):
    scored, classes = _nb(spark, d)
    t = N.posterior(scored, classes, ["y", "n"])
    return t.select("class", F.round("p", 9).alias("score"), F.when(F.col("y") == F.col("class"), F.col("n")).otherwise(0).alias("pos"), F.when(F.col("y") != F.col("class"), F.col("n")).otherwise(0).alias("neg"))


RUNNING = "run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC))"


@query("agg_auc_binary", with_inst(ORDERS, NB_SQL, POINTS, RUNNING) + " SELECT class, round(sum(pos * (an - fp + neg / 2)) / (max(ap) * max(an)), 6) AS auc FROM run GROUP BY class")
def agg_auc_binary(spark, d):
    return X.roc_auc(_points(spark, d), ["class"]).withColumn("auc", F.round("auc", 6))


@query("agg_auprc", with_inst(ORDERS, NB_SQL, POINTS, RUNNING) + " SELECT class, round(sum(pos / ap * tp / (tp + fp)), 6) AS auprc FROM run GROUP BY class")
def agg_auprc(spark, d):
    return X.auprc(_points(spark, d), ["class"]).withColumn("auprc", F.round("auprc", 6))


@query("agg_roc_pr", with_inst(ORDERS, NB_SQL, POINTS, RUNNING) + " SELECT class, round(score, 6) AS score, round(tp / ap, 6) AS tpr, round(fp / an, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM run")
def agg_roc_pr(spark, d):
    t = X.roc_points(_points(spark, d), ["class"])
    return t.select("class", *(F.round(c, 6).alias(c) for c in ("score", "tpr", "fpr", "precision")))


@query("win_running_auc", with_inst(ORDERS, NB_SQL, POINTS, RUNNING) + " SELECT class, CAST(max(tp) AS BIGINT) AS pos, CAST(max(fp) AS BIGINT) AS neg, count(*) AS points FROM run GROUP BY class")
def win_running_auc(spark, d):
    t = X._by_score(_points(spark, d), ["class"])
    return t.groupBy("class").agg(F.max("tp").cast("long").alias("pos"), F.max("fp").cast("long").alias("neg"), F.count("*").alias("points"))


MULTI = """ SELECT round(avg(auc), 6) AS auc FROM (SELECT a, b, avg(auc) AS auc FROM (
  SELECT a, b, side, sum(pos * (an - fp + neg / 2)) / nullif(max(ap) * max(an), 0) AS auc FROM (
    SELECT *, sum(neg) OVER (PARTITION BY a, b, side ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY a, b, side) AS ap, sum(neg) OVER (PARTITION BY a, b, side) AS an FROM (
      SELECT a, b, side, p AS score, sum(CASE WHEN y = side THEN n ELSE 0 END) AS pos, sum(CASE WHEN y <> side THEN n ELSE 0 END) AS neg
      FROM (SELECT y, n, class, round(p, 9) AS p FROM post) t, (SELECT c1.y AS a, c2.y AS b FROM (SELECT DISTINCT y FROM inst) c1, (SELECT DISTINCT y FROM inst) c2 WHERE c1.y < c2.y) pr, (SELECT DISTINCT y AS side FROM inst) s
      WHERE t.class = side AND side IN (a, b) AND t.y IN (a, b) GROUP BY ALL)) GROUP BY a, b, side) GROUP BY a, b)"""


@query("agg_auc_multi", with_inst(ORDERS, NB_SQL) + MULTI)
def agg_auc_multi(spark, d):
    scored, classes = _nb(spark, d)
    return X.hand_till(scored.withColumn("p", F.transform("p", lambda x: F.round(x, 9))), classes).withColumn("auc", F.round("auc", 6))


# --- cross-validation, hold-out, bias and variance

FOLD = f"({hash_sql(0)} % 10)"


def _xval_sql(folds=10):
    """Naive Bayes cross-validation: total minus fold counts."""
    f = ["fi AS (SELECT *, " + FOLD.replace("% 10)", f"% {folds})") + " AS fold FROM inst)", f"cells AS (SELECT fold, {KEY}, y, count(*) AS n FROM fi GROUP BY ALL)", "cls AS (SELECT DISTINCT y AS class FROM inst)", "fy AS (SELECT fold, y, count(*) AS n FROM fi GROUP BY ALL)", "ty AS (SELECT y, count(*) AS n FROM inst GROUP BY y)", "fo AS (SELECT DISTINCT fold FROM fi)", "ny AS (SELECT fo.fold, class, ty.n - coalesce(fy.n, 0) AS n FROM fo CROSS JOIN cls JOIN ty ON ty.y = class LEFT JOIN fy ON fy.y = class AND fy.fold = fo.fold)", "nn AS (SELECT fold, sum(n) AS n, count(*) AS k FROM ny GROUP BY fold)"]
    joins, terms = " JOIN ny ON ny.fold = cells.fold JOIN nn ON nn.fold = cells.fold", ["ln((ny.n + 1.0::DOUBLE / nn.k) / (nn.n + 1.0))"]
    for a in OA:
        f += [f"k_{a} AS (SELECT count(DISTINCT {a}) AS k FROM inst)", f"t_{a} AS (SELECT {a}, y, count(*) AS n FROM inst GROUP BY ALL)", f"f_{a} AS (SELECT fold, {a}, y, count(*) AS n FROM fi GROUP BY ALL)"]
        joins += f" CROSS JOIN k_{a} LEFT JOIN t_{a} ON t_{a}.{a} = cells.{a} AND t_{a}.y = ny.class LEFT JOIN f_{a} ON f_{a}.{a} = cells.{a} AND f_{a}.y = ny.class AND f_{a}.fold = cells.fold"
        terms.append(f"ln((coalesce(t_{a}.n, 0) - coalesce(f_{a}.n, 0) + 1.0::DOUBLE / k_{a}.k) / (ny.n + 1.0))")
    cols = ", ".join(f"cells.{a}" for a in OA)
    f.append(f"lp AS (SELECT cells.fold, {cols}, cells.y, cells.n, class, {' + '.join(terms)} AS lp FROM cells{joins})")
    k = f"fold, {KEY}, y"
    f.append(f"post AS (SELECT {k}, n, class, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY {k}) AS p FROM (SELECT *, max(lp) OVER (PARTITION BY {k}) AS mx FROM lp))")
    return ", ".join(f)


XV = _xval_sql()


@query("eval_xval_nb", with_inst(ORDERS, XV) + " " + LOSSES.format(key="fold, " + KEY))
def eval_xval_nb(spark, d):
    return _losses(*E.cross_validate(B.orders_problem(spark, d), OA, "nb"))


@query("eval_xval_by_fold", with_inst(ORDERS, XV) + " SELECT CAST(fold AS INT) AS fold, " + LOSSES.format(key="fold, " + KEY).replace("SELECT CAST(sum(n)", "CAST(sum(n)", 1) + " GROUP BY fold")
def eval_xval_by_fold(spark, d):
    scored, classes = E.cross_validate(B.orders_problem(spark, d), OA, "nb")
    t = X.loss_table(scored, classes, F.col("pred"), ("fold",))
    return t.select("fold", F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("zero_one", "rmse", "rmse_all", "logloss")))


@query("eval_xval_aode")
def eval_xval_aode(spark, d):
    return _losses(*E.cross_validate(B.orders_problem(spark, d), OA, "aode"))


@query("eval_xval_tan")
def eval_xval_tan(spark, d):
    return _losses(*E.cross_validate(B.orders_problem(spark, d), OA, "tan"))


TT = network_sql(OA, {}, "tst", "trn")


@query("eval_train_test", with_inst(ORDERS, "trn AS (SELECT * FROM inst WHERE id % 3 <> 0)", "tst AS (SELECT * FROM inst WHERE id % 3 = 0)", TT) + LOSS)
def eval_train_test(spark, d):
    df = B.orders_problem(spark, d)
    return _losses(*E.train_test(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), OA, "nb"))


@query("snk_scores", with_inst(ORDERS, "trn AS (SELECT * FROM inst WHERE id % 3 <> 0)", "tst AS (SELECT * FROM inst WHERE id % 3 = 0)", TT) + f" SELECT i.id, i.y, string_agg(printf('%.4f', round(p, 4)), ',' ORDER BY class) AS scores FROM tst i JOIN post ON post.y = i.y AND {' AND '.join(f'post.{a} = i.{a}' for a in OA)} GROUP BY i.id, i.y")
def snk_scores(spark, d):
    df = B.orders_problem(spark, d)
    scored, _ = E.train_test(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), OA, "nb")
    line = F.array_join(F.transform("p", lambda x: F.format_string("%.4f", F.round(x, 4))), ",")
    return df.where("id % 3 = 0").join(scored.select(*OA, "y", line.alias("scores")), [*OA, "y"]).select("id", "y", "scores")


def _bv_sql(e: int) -> str:
    parts = with_inst(ORDERS, f"trn AS (SELECT * FROM inst WHERE id % 4 = {e} AND id % 5 <> 0)", "tst AS (SELECT * FROM inst WHERE id % 5 = 0)", TT)
    top = f"SELECT {KEY}, y, arg_max(class, (round(p, 9), -ord(class))) AS pred FROM post GROUP BY {KEY}, y"
    return f"SELECT i.id, i.y, t.pred FROM ({parts} SELECT i.id, i.y, t.pred FROM tst i JOIN ({top}) t ON t.y = i.y AND {' AND '.join(f't.{a} = i.{a}' for a in OA)}) i, (SELECT 1) z"


BV = [_bv_sql(e).replace("i.y, t.pred FROM (", "i.y, i.pred FROM (", 1) for e in range(4)]


@query("agg_bias_variance", "WITH pr AS (SELECT id, y, pred, count(*) * 1.0 / 4 AS s FROM (" + " UNION ALL ".join(BV) + ") GROUP BY ALL) SELECT round(avg(l), 6) AS loss, round(avg(v), 6) AS variance, round(avg(l) - avg(v), 6) AS bias FROM (SELECT id, (1 - sum(s * s)) / 2 AS v, sum(CASE WHEN pred <> y THEN s ELSE 0 END) AS l FROM pr GROUP BY id)")
def agg_bias_variance(spark, d):
    """Naive Bayes of four training sets over the same test rows."""
    df = B.orders_problem(spark, d)
    test, parts = df.where("id % 5 = 0"), None
    for e in range(4):
        scored, _ = E.train_test(df.where((F.col("id") % 4 == e) & (F.col("id") % 5 != 0)), test, OA, "nb")
        one = test.select("id", "y", *OA).join(scored.select(*OA, "y", "pred"), [*OA, "y"]).select("id", "y", "pred")
        parts = one if parts is None else parts.union(one)
    return E.bias_variance(parts).select(*(F.round(c, 6).alias(c) for c in ("loss", "variance", "bias")))


def _curve_sql(size: int) -> str:
    test = f"SELECT * FROM inst ORDER BY {hash_sql(0)}, id LIMIT 1000"
    train = f"SELECT * FROM inst WHERE id NOT IN (SELECT id FROM tst) ORDER BY {hash_sql(1)}, id LIMIT {size}"
    return f"SELECT *, {size} AS train_size FROM ({with_inst(ORDERS, f'tst AS ({test})', f'trn AS ({train})', TT)}{LOSS})"


@query("eval_learning_curve", " UNION ALL ".join(map(_curve_sql, (100, 200, 400, 800))))
def eval_learning_curve(spark, d):
    df, out = B.orders_problem(spark, d), None
    for size, (scored, classes) in E.learning_curve(df, OA, [100, 200, 400, 800], 1000).items():
        one = _losses(scored, classes).withColumn("train_size", F.lit(size))
        out = one if out is None else out.union(one)
    return out


@query("win_prefix_loo")
def win_prefix_loo(spark, d):
    cells = order_cells(spark, d)
    net = N.fit_kdb(cells, OA, 1)
    t = N.prefix_errors(cells, net, N.Lookup(cells, C.labels(cells)), C.domain_sizes(cells, OA), net.atts)
    return t.select("prefix", F.col("n").cast("long").alias("n"), F.round("sse", 6).alias("sse"))


SUB = """ SELECT x.a1 AS att, x.v1 AS val, y2.a2 AS by_att, y2.v2 AS by_val, CAST(y2.n AS BIGINT) AS n FROM
 (SELECT a1, v1, a2, v2, sum(n) AS n FROM (SELECT a1, v1, a2, v2, n FROM c2 UNION ALL SELECT a2, v2, a1, v1, n FROM c2) GROUP BY ALL) y2
 JOIN (SELECT a1, v1, sum(n) AS n FROM c1 GROUP BY ALL) x ON x.a1 = y2.a1 AND x.v1 = y2.v1 JOIN (SELECT a1, v1, sum(n) AS n FROM c1 GROUP BY ALL) z ON z.a1 = y2.a2 AND z.v1 = y2.v2
 WHERE z.n >= 10 AND y2.n = z.n"""


@query("sub_subsumption", with_inst("SELECT l_returnflag AS y, l_linestatus AS ls, CAST(l_quantity > 25 AS VARCHAR) AS q25, CAST(l_quantity > 40 AS VARCHAR) AS q40 FROM lineitem", f"c1 AS ({cube_sql(['ls', 'q25', 'q40'], 1)})", f"c2 AS ({cube_sql(['ls', 'q25', 'q40'], 2)})") + SUB)
def sub_subsumption(spark, d):
    """Attribute values that another value implies: as often seen together as that one alone."""
    li = B.lines_problem(spark, d)
    atts = ["ls", "q25", "q40"]
    cells = C.cuboid(li.select("y", "ls", (F.col("qty") > 25).cast("string").alias("q25"), (F.col("qty") > 40).cast("string").alias("q40")), atts)
    one = C.cube(cells, atts, 1).groupBy("a1", "v1").agg(F.sum("n").alias("n1"))
    two = C.cube(cells, atts, 2)
    both = two.select("a1", "v1", "a2", "v2", "n").union(two.select("a2", "v2", "a1", "v1", "n")).groupBy("a1", "v1", "a2", "v2").agg(F.sum("n").alias("n"))
    z = one.select(F.col("a1").alias("a2"), F.col("v1").alias("v2"), F.col("n1").alias("n2"))
    t = both.join(one, ["a1", "v1"]).join(z, ["a2", "v2"]).where("n2 >= 10 and n = n2")
    return t.select(F.col("a1").alias("att"), F.col("v1").alias("val"), F.col("a2").alias("by_att"), F.col("v2").alias("by_val"), "n")


