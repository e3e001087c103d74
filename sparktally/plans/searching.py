"""Queries: attribute rankings, selections and learners that search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes as N
from ..operators import counts as C
from ..operators import elimination as V
from ..operators import prefixes as X
from ..operators import selection as S
from ..sources import bindings as B
from .cubes_and_measures import LA, LINES, line_cells, order_cells
from .learning import OA, ORDERS, learner
from .models import _scored_losses
from .registry import query
from .sqltext import cube_sql, info_sql, with_inst

P = ["a1", "a2"]


def ranking(name, how, sql=None):
    query(name, sql)(lambda spark, d: spark.createDataFrame([(i, a) for i, a in enumerate(S.rank_attributes(line_cells(spark, d), LA, how), 1)], "place int, att string"))


# the first two places of each greedy ranking, and the table of rates that the second is chosen by, are plain SQL
for _how in ("mrmr", "diff", "mifs", "jmi", "mmcmi"):
    ranking(f"sub_rank_{_how}", _how)
ranking("sub_rank_mi", "mi", with_inst(LINES, f"c AS ({cube_sql(LA, 1)})") + f" SELECT CAST(row_number() OVER (ORDER BY round(value, 9) DESC, list_position({LA!r}, a1)) AS INT) AS place, a1 AS att FROM ({info_sql('c', ['a1'], ['v1'], ['y'])})")


@query("sub_mrmr_rates", with_inst(LINES, f"c1 AS ({cube_sql(LA, 1)})", f"c2 AS ({cube_sql(LA, 2)})", f"mi AS ({info_sql('c1', ['a1'], ['v1'], ['y'])})", f"am AS ({info_sql('c2', P, ['v1'], ['v2'])})", "sym AS (SELECT a1 AS a, a2 AS b, value FROM am UNION ALL SELECT a2, a1, value FROM am)", "top AS (SELECT a1 FROM mi ORDER BY round(value, 9) DESC, a1 LIMIT 1)") + " SELECT a, b AS chosen, round(mi.value / (sym.value + 0.01), 6) AS rate FROM sym JOIN mi ON mi.a1 = a JOIN top ON top.a1 = b")
def sub_mrmr_rates(spark, d):
    """How mRMR rates the candidates for the second place."""
    cells = line_cells(spark, d)
    mi = {r.a1: r.value for r in N.class_mi(cells, LA).collect()}
    first = min(mi, key=lambda a: (-round(mi[a], 9), a))
    am = S.information(C.cube(cells, LA, 2), P, ["v1"], ["v2"])
    sym = am.select(F.col("a1").alias("a"), F.col("a2").alias("chosen"), "value").union(am.select("a2", "a1", "value")).where(F.col("chosen") == first)
    table = F.create_map(*(F.lit(x) for k, v in mi.items() for x in (k, v)))
    return sym.select("a", "chosen", F.round(table[F.col("a")] / (F.col("value") + 0.01), 6).alias("rate"))


def names(name, pick):
    query(name)(lambda spark, d: spark.createDataFrame([(a,) for a in pick(line_cells(spark, d), LA)], "att string"))


names("sub_chisq_select", S.chi_square_select)
names("sub_fcbf", S.correlation_filter)


@query("sub_loo_grid")
def sub_loo_grid(spark, d):
    cells = order_cells(spark, d)
    return S.spode_scores(cells, OA, N.mi_order(cells, OA)).select("parents", "children", F.col("n").cast("long").alias("n"), F.round("sse", 6).alias("sse"))


@query("sub_loo_weight")
def sub_loo_weight(spark, d):
    w = S.loo_weights(order_cells(spark, d), OA)
    return spark.createDataFrame([(next(iter(k)), round(v, 6)) for k, v in w.items()], "att string, weight double")


learner("ln_aode_loo", lambda c: S.fit_aode_loo(c, OA))
learner("ln_aode_bse", lambda c: V.eliminate(c, OA, "poce")[0])
learner("ln_aode_bse_ce", lambda c: V.eliminate(c, OA, "ce")[0])
learner("ln_aode_bse_pe", lambda c: V.eliminate(c, OA, "pe")[0])
learner("ln_aode_bse_pace", lambda c: V.eliminate(c, OA, "pace")[0])


def _bse_sql() -> str:
    """Leave-one-out errors of AODE and of its first removals: factors in long form, an attribute's taken out by a filter."""
    cells = f"cells AS (SELECT row_number() OVER () AS id, * FROM (SELECT {', '.join(OA)}, y, count(*) AS n FROM inst GROUP BY ALL))"
    atts = "atts AS (" + " UNION ALL ".join(f"SELECT {i} AS att, count(DISTINCT {a}) AS k FROM inst" for i, a in enumerate(OA)) + ")"
    cls = "cls AS (SELECT y AS class, count(*) AS ny FROM inst GROUP BY y), tot AS (SELECT CAST(sum(ny) AS DOUBLE) - 1 AS nn, count(*) AS nc FROM cls)"
    lng = "lng AS (" + " UNION ALL ".join(f"SELECT id, y, n, {i} AS att, {a} AS v FROM cells" for i, a in enumerate(OA)) + ")"
    one = "one AS (SELECT att, v, y, sum(n) AS c FROM lng GROUP BY ALL)"
    two = "two AS (SELECT a.att AS p, a.v AS pv, b.att AS q, b.v AS qv, a.y, sum(a.n) AS c FROM lng a JOIN lng b ON a.id = b.id AND a.att <> b.att GROUP BY ALL)"
    own = lambda t: f"greatest(coalesce({t}.c, 0) - CASE WHEN l.y = class THEN 1 ELSE 0 END, 0)"
    prior = f"prior AS (SELECT l.id, l.y, l.n, l.att AS p, class, {own('one')} AS c, ln(({own('one')} + 1.0::DOUBLE / (nc * k)) / (nn + 1)) AS f FROM lng l JOIN atts USING (att) CROSS JOIN cls CROSS JOIN tot LEFT JOIN one ON one.att = l.att AND one.v = l.v AND one.y = class)"
    factor = f"factor AS (SELECT l.id, l.p, q.att AS q, l.class, ln(({own('two')} + 1.0::DOUBLE / k) / (l.c + 1)) AS f FROM prior l JOIN lng w ON w.id = l.id AND w.att = l.p JOIN lng q ON q.id = l.id AND q.att <> l.p JOIN atts ON atts.att = q.att LEFT JOIN two ON two.p = l.p AND two.pv = w.v AND two.q = q.att AND two.qv = q.v AND two.y = l.class)"
    tries = "tries AS (SELECT '' AS kind, -1 AS att UNION ALL SELECT kind, att FROM atts, (VALUES ('child'), ('parent'), ('both')) AS x(kind))"
    logs = "logs AS (SELECT kind, tries.att, r.id, r.y, r.n, r.p, r.class, max(r.f) + coalesce(sum(factor.f) FILTER (NOT (kind IN ('child', 'both') AND factor.q = tries.att)), 0) AS s FROM tries CROSS JOIN prior r JOIN factor ON factor.id = r.id AND factor.p = r.p AND factor.class = r.class WHERE NOT (kind IN ('parent', 'both') AND r.p = tries.att) AND (SELECT sum(c) FROM prior z WHERE z.id = r.id AND z.p = r.p) > 0 GROUP BY ALL)"
    votes = "votes AS (SELECT kind, att, id, y, n, class, sum(exp(s)) AS v FROM logs GROUP BY ALL)"
    shares = "shares AS (SELECT kind, att, id, max(n) AS n, sum(CASE WHEN class = y THEN v END) / sum(v) AS share FROM votes GROUP BY ALL)"
    ctes = [cells, atts, cls, lng, one, two, prior, factor, tries, logs, votes, shares]
    return with_inst(ORDERS, *ctes) + " SELECT kind, CAST(att AS INT) AS att, CAST((SELECT sum(n) FROM cells) AS BIGINT) AS n, round(sqrt((coalesce(sum(n * (1 - share) ** 2), 0) + ((SELECT sum(n) FROM cells) - sum(n)) * (1 - 1.0::DOUBLE / (SELECT nc FROM tot)) ** 2) / (SELECT sum(n) FROM cells)), 6) AS rmse FROM shares GROUP BY kind, att"


@query("sub_bse_errors", _bse_sql())
def sub_bse_errors(spark, d):
    """Errors of the whole model and of every single removal, by which the first round of the elimination decides."""
    cells = order_cells(spark, d)
    classes, sizes = C.labels(cells), C.domain_sizes(cells, OA)
    every = list(range(len(OA)))
    rows = V.leave_one_out_cells(cells, OA, classes)
    return V.round_errors(rows, [sizes[a] for a in OA], len(classes), every, every, V.MODES["poce"], 1.0).select("kind", "att", F.col("n").cast("long").alias("n"), F.round("rmse", 6).alias("rmse"))


learner("ln_aode_pw", lambda c: N.AnDE(OA, 1, weights=N.mi_weights(c, OA, 1)))
EXTENDED = {
    "ln_kdb_ext": {"tested": "holm", "parents_tested": "holm", "backoff": 5},
    "ln_kdb_ext_su": {"rank": "su", "tested": "each"},
    "ln_kdb_ext_value": {"order": "value", "parents_tested": "each"},
    "ln_kdb_ext_cmi": {"order": "cmi", "backoff": 20},
    "ln_kdb_ext_mcmi": {"parents": "mcmi"},
    "ln_kdb_ext_random": {"order": "random", "parents": "random", "seed": 3},
}
for _name, _options in EXTENDED.items():
    learner(_name, lambda c, o=_options: S.fit_extended_kdb(c, OA, 2, **o))
learner("ln_kdb_backoff", lambda c: N.fit_kdb(c, OA, 3, backoff=1))
learner("ln_kdb_fcbf", lambda c: (lambda keep: N.fit_kdb(c, keep, 1))(S.correlation_filter(c, OA)))


for _name, _options in {"mcc": {"objective": "mcc"}, "weighted": {"objective": "weighted"}, "test": {"test": 0.05}, "k": {"links": "best"}, "links": {"links": "each", "objective": "mcc"}}.items():
    learner(f"ln_kdb_sel2_{_name}", lambda c, o=_options: X.fit_prefix(c, OA, 2, **o))


@query("ln_kdb_sel2")
def ln_kdb_sel2(spark, d):
    """Leave-one-out confusion of every attribute prefix under every number of links, with the rows on which it beats the full model."""
    cells = order_cells(spark, d)
    t = X.prefix_confusion(cells, N.fit_kdb(cells, OA, 2), [0, 1, 2])
    return t.select("links", "prefix", "y", "pred", F.col("n").cast("long").alias("n"), F.round("sse", 6).alias("sse"), "better", "worse")


def _binned(spark, d):
    o = B.orders_problem(spark, d)
    return o.withColumn("price_bin", F.least(F.floor(F.col("price") / 50000), F.lit(5)).cast("string")).withColumn("bal_bin", F.floor((F.col("bal") + 1000) / 2500).cast("string"))


@query("ln_kdb_gauss")
def ln_kdb_gauss(spark, d):
    df = _binned(spark, d)
    model = S.fit_gaussian_kdb(df, ["prio", "seg"], {"price_bin": "price", "bal_bin": "bal"}, 1)
    classes = C.labels(df)
    return _scored_losses(model.score(df, df, classes), classes)


@query("ln_kdb_cddisc")
def ln_kdb_cddisc(spark, d):
    """Cuts of the price anew for each segment, for a class that depends on both."""
    o = B.orders_problem(spark, d)
    y = F.when(F.col("price") > F.when(F.col("seg") == "BUILDING", 100000).otherwise(200000), "hi").otherwise("lo")
    t = o.select(y.alias("y"), "seg", "price")
    return S.conditional_cuts(t, "price", ["seg"], ["hi", "lo"])


@query("ln_kdb_cdram")
def ln_kdb_cdram(spark, d):
    """The same with a least number of rows: smaller groups take the cuts of the longest prefix that has enough."""
    o = B.orders_problem(spark, d)
    t = o.select(F.when(F.col("price") > 150000, "hi").otherwise("lo").alias("y"), "seg", "region", "price")
    return S.conditional_cuts(t, "price", ["seg", "region"], ["hi", "lo"], min_rows=50, backoff=True)


@query("ms_binom")
def ms_binom(spark, d):
    from ..functions.measures import binomial_tail

    return spark.createDataFrame([(k, round(binomial_tail(k, 20), 9)) for k in range(21)], "k int, p double")
