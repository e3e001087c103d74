"""Queries: filters, discretisers, samples and splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import discretise as D
from ..operators import filters as L
from ..operators import rules as R
from ..operators import sampling as S
from ..sources import bindings as B
from .registry import query
from .sqltext import cube_sql, hash_sql, with_inst

ORDERS, LINES, HASH_SPACE = B.ORDERS_SQL, B.LINES_SQL, C.HASH_SPACE


@query("flt_class", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'Negative' END AS y FROM orders")
def flt_class(spark, d):
    df = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"))
    return L.class_filter(df, "F")


@query("flt_normalise", with_inst(ORDERS) + " SELECT id, round((price - lp) / (hp - lp), 6) AS price, round((bal - lb) / (hb - lb), 6) AS bal FROM inst, (SELECT min(price) AS lp, max(price) AS hp, min(bal) AS lb, max(bal) AS hb FROM inst)")
def flt_normalise(spark, d):
    df = B.orders_problem(spark, d)
    t = L.normalise(df, L.fit_minmax(df, ["price", "bal"]))
    return t.select("id", F.round("price", 6).alias("price"), F.round("bal", 6).alias("bal"))


@query("flt_normalise_sym", with_inst(ORDERS) + " SELECT id, round(2 * (price - lp) / (hp - lp) - 1, 6) AS price FROM inst, (SELECT min(price) AS lp, max(price) AS hp FROM inst)")
def flt_normalise_sym(spark, d):
    df = B.orders_problem(spark, d)
    return L.normalise(df, L.fit_minmax(df, ["price"]), symmetric=True).select("id", F.round("price", 6).alias("price"))


@query("flt_quadratic", with_inst(ORDERS) + """ SELECT id, round(bal * price, 4) AS "bal*price", CASE WHEN region = '0' THEN price ELSE 0 END AS "region=0*price", CASE WHEN region = '0' THEN bal ELSE 0 END AS "region=0*bal",
  CASE WHEN region = '1' THEN price ELSE 0 END AS "region=1*price", CASE WHEN region = '1' THEN bal ELSE 0 END AS "region=1*bal" FROM inst""")
def flt_quadratic(spark, d):
    t = L.quadratic(B.orders_problem(spark, d), ["price", "bal"], {"region": ["0", "1"]}, ["id"])
    return t.withColumn("bal*price", F.round(F.col("`bal*price`"), 4))


@query("flt_quadratic_cats", with_inst(ORDERS) + " SELECT id, concat_ws('|', prio, seg) AS \"prio*seg\" FROM inst")
def flt_quadratic_cats(spark, d):
    return L.quadratic(B.orders_problem(spark, d), [], {"prio": [], "seg": []}, ["id"])


@query("flt_chain", with_inst(ORDERS) + " SELECT id, CASE WHEN y = 'F' THEN 'F' ELSE 'Negative' END AS y, round((price - lo) / (hi - lo), 6) AS price FROM inst, (SELECT min(price) AS lo, max(price) AS hi FROM inst)")
def flt_chain(spark, d):
    steps = [lambda t: L.class_filter(t, "F"), lambda t: L.normalise(t, L.fit_minmax(t, ["price"]))]
    return L.chain(B.orders_problem(spark, d), steps).select("id", "y", F.round("price", 6).alias("price"))


FOLD = f"CAST({hash_sql(1)} % 10 AS INT)"


@query("smp_fold", with_inst(ORDERS) + f" SELECT {FOLD} AS fold, count(*) AS n FROM inst GROUP BY 1")
def smp_fold(spark, d):
    return B.orders_problem(spark, d).groupBy(C.fold_of("id", 10, 1).alias("fold")).agg(F.count("*").alias("n"))


@query("flt_fold_train", with_inst(ORDERS) + f" SELECT id, y FROM inst WHERE {FOLD} <> 3")
def flt_fold_train(spark, d):
    return B.orders_problem(spark, d).where(C.fold_of("id", 10, 1) != 3).select("id", "y")


@query("flt_fold_test", with_inst(ORDERS) + f" SELECT id, y FROM inst WHERE {FOLD} = 3")
def flt_fold_test(spark, d):
    return B.orders_problem(spark, d).where(C.fold_of("id", 10, 1) == 3).select("id", "y")


@query("flt_cat_eq", with_inst(ORDERS) + " SELECT id, y FROM inst WHERE seg = 'BUILDING'")
def flt_cat_eq(spark, d):
    return B.orders_problem(spark, d).where("seg = 'BUILDING'").select("id", "y")


NULLED = "CASE WHEN id % 17 <> 0 THEN price END"


def _nulled(spark, d):
    return B.orders_problem(spark, d).withColumn("price", F.when(F.col("id") % 17 != 0, F.col("price")))


@query("flt_num_split", with_inst(ORDERS) + f" SELECT branch, count(*) AS n FROM (SELECT CASE WHEN {NULLED} IS NULL THEN 2 WHEN {NULLED} < 100000 THEN 0 ELSE 1 END AS branch FROM inst) GROUP BY branch")
def flt_num_split(spark, d):
    return _nulled(spark, d).groupBy(L.three_way(F.col("price"), 100000).alias("branch")).agg(F.count("*").alias("n"))


@query("flt_missing", with_inst(ORDERS) + f" SELECT id FROM inst WHERE {NULLED} IS NULL")
def flt_missing(spark, d):
    return _nulled(spark, d).where("price is null").select("id")


@query("flt_feature_rules", with_inst(ORDERS) + " SELECT id, CASE WHEN seg = 'BUILDING' AND price > 50000 AND price <= 150000 THEN 't' ELSE 'f' END AS f1, CASE WHEN region = '2' AND coalesce(bal > 0, false) THEN 't' ELSE 'f' END AS f2 FROM inst")
def flt_feature_rules(spark, d):
    f1 = L.conjunction([("seg", "=", "BUILDING", None), ("price", "in", 50000, 150000)])
    f2 = L.conjunction([("region", "=", "2", None), ("bal", "in", 0, None)])
    return B.orders_problem(spark, d).select("id", f1.alias("f1"), f2.alias("f2"))


A3 = ["ls", "tax", "disc"]


def _rules_sql(atts: list[str], k: int) -> str:
    """Every itemset of up to three attributes, held against those with one item less by a sum of hypergeometric terms."""
    sets = []
    for size in range(len(atts) + 1):
        for s in combinations(atts, size):
            cols = ", ".join(f"'{a}=' || {a} AS i{i}" if a in s else f"NULL AS i{i}" for i, a in enumerate(atts))
            sets.append(f"SELECT {size} AS size, {cols}, y, count(*) AS n FROM inst GROUP BY ALL")
    ids = [f"i{i}" for i in range(len(atts))]
    key = ", ".join(ids)
    same = lambda out: " AND ".join(f"q.i{i} IS NOT DISTINCT FROM {'NULL' if i == out else f'r.i{i}'}" for i in range(len(atts)))
    parts = " UNION ALL ".join(f"SELECT r.*, q.n AS pn, q.cover AS pcover FROM r JOIN s q ON q.y = r.y AND q.size = r.size - 1 AND {same(i)} WHERE r.i{i} IS NOT NULL" for i in range(len(atts)))
    choose = lambda n, m: f"lgamma({n} + 1) - lgamma({m} + 1) - lgamma({n} - ({m}) + 1)"
    term = f"exp({choose('pn', 'x')} + {choose('(pcover - pn)', '(cover - x)')} - ({choose('pcover', 'cover')}))"
    return f"""{with_inst(LINES)}, tot AS (SELECT CAST(count(*) AS DOUBLE) AS nn FROM inst), ny AS (SELECT y, count(*) AS ny FROM inst GROUP BY y),
s0 AS ({' UNION ALL '.join(sets)}), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY size, {key}) AS BIGINT) AS cover FROM s0),
r AS (SELECT s.*, n / nn - cover / nn * ny / nn AS leverage FROM s JOIN ny USING (y) CROSS JOIN tot WHERE size > 0 AND n / nn - cover / nn * ny / nn > 0),
p AS ({parts}),
t AS (SELECT size, {key}, y, n, cover, leverage, max(list_sum(list_transform(range(n, least(pn, cover) + 1), lambda x: {term}))) AS p, bool_or(pcover = cover) AS implied FROM p GROUP BY ALL)
SELECT concat_ws('&', {key}) AS items, y, cover, CAST(n AS BIGINT) AS n, round(leverage, 6) AS leverage, round(least(p, 1), 6) AS p FROM t WHERE p <= 0.05 AND NOT implied ORDER BY round(t.leverage, 9) DESC, items, y LIMIT {k}"""


@query("ms_opus", _rules_sql(A3, 25))
def ms_opus(spark, d):
    """The 25 productive rules of most leverage, of any length."""
    rules = R.find_rules(C.cuboid(B.lines_problem(spark, d), A3), A3, 25)
    return rules.select(F.array_join("items", "&").alias("items"), "y", "cover", F.col("support").alias("n"), F.round("value", 6).alias("leverage"), F.round("p", 6).alias("p"))


@query("flt_mined_features")
def flt_mined_features(spark, d):
    """How often each feature that the rule search found, on categories and cut numbers, holds in each class."""
    df = B.lines_problem(spark, d)
    features, _ = R.mine_features(df, ["ls", "tax"], ["qty", "price"], 8)
    marks = F.array(*(F.struct(F.lit(name).alias("feature"), test.alias("value")) for name, test in features.items()))
    return df.select("y", F.explode(marks).alias("f")).groupBy("f.feature", "f.value", "y").agg(F.count("*").alias("n"))


# --- discretisers

NUMS = ["qty", "price"]
VC = "vc AS (SELECT 'qty' AS att, qty AS value, y, count(*) AS n FROM inst GROUP BY ALL UNION ALL SELECT 'price', price, y, count(*) FROM inst GROUP BY ALL)"
RANKED = "rk AS (SELECT att, value, row_number() OVER (PARTITION BY att ORDER BY value) AS r, count(*) OVER (PARTITION BY att) AS nn, max(value) OVER (PARTITION BY att) AS top FROM (SELECT 'qty' AS att, qty AS value FROM inst UNION ALL SELECT 'price', price FROM inst))"


def _depth(k: str) -> str:
    # place i * nn / k is hit by row r when ceil(r * k / nn) names an i whose floor comes back to r
    return with_inst(LINES, RANKED) + f", g AS (SELECT *, CAST({k} AS BIGINT) AS k FROM rk), h AS (SELECT *, CAST(ceil(r * k / nn) AS BIGINT) AS i0 FROM g) SELECT DISTINCT att, value AS cut FROM h WHERE value < top AND ((i0 BETWEEN 1 AND k - 1 AND nn * i0 // k = r) OR (i0 + 1 BETWEEN 1 AND k - 1 AND nn * (i0 + 1) // k = r))"


def _counts(spark, d):
    return D.value_counts(B.lines_problem(spark, d), NUMS)


@query("dsc_eqdepth", _depth("10"))
def dsc_eqdepth(spark, d):
    return D.equal_depth(_counts(spark, d), 10)


@query("dsc_pkid", _depth("floor(sqrt(nn) + 1e-9)"))
def dsc_pkid(spark, d):
    return D.equal_depth(_counts(spark, d), root=2)


@query("dsc_pkid3", _depth("floor(pow(nn, 1.0 / 3) + 1e-9)"))
def dsc_pkid3(spark, d):
    return D.equal_depth(_counts(spark, d), root=3)


@query("dsc_npkid", _depth("floor(pow(nn, 1.0 / 4) + 1e-9)"))
def dsc_npkid(spark, d):
    return D.equal_depth(_counts(spark, d), root=4)


ENT = lambda side, n: " - ".join(["0.0"] + [f"CASE WHEN {side}{c} > 0 THEN {side}{c} / {n} * log2({side}{c} / {n}) ELSE 0 END" for c in "anr"])
CUT = with_inst(LINES, VC) + f""", per AS (SELECT att, value, {', '.join(f"sum(CASE WHEN y = '{c.upper()}' THEN n ELSE 0 END)::DOUBLE AS c{c}" for c in 'anr')} FROM vc GROUP BY att, value),
run AS (SELECT att, value, lead(value) OVER w AS nxt, {', '.join(f'sum(c{c}) OVER w AS l{c}, sum(c{c}) OVER (PARTITION BY att) - sum(c{c}) OVER w AS r{c}' for c in 'anr')} FROM per WINDOW w AS (PARTITION BY att ORDER BY value)),
e AS (SELECT att, (value + nxt) / 2 AS cut, value, round(((la + ln + lr) * ({ENT('l', '(la + ln + lr)')}) + (ra + rn + rr) * ({ENT('r', '(ra + rn + rr)')})) / (la + ln + lr + ra + rn + rr), 9) AS entropy FROM run WHERE nxt IS NOT NULL)
SELECT att, round(cut, 6) AS cut, round(entropy, 6) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY att ORDER BY entropy, value DESC) AS rn FROM e) WHERE rn = 1"""


@query("dsc_mdl2", CUT)
def dsc_mdl2(spark, d):
    return D.binary_cut(_counts(spark, d), ["A", "N", "R"]).select("att", F.round("cut", 6).alias("cut"), F.round("entropy", 6).alias("entropy"))


@query("win_entropy_prefix", with_inst(LINES, VC) + ", t AS (SELECT att, value, y, sum(n) AS n FROM vc WHERE att = 'qty' GROUP BY ALL) SELECT att, value, y, CAST(sum(n) OVER (PARTITION BY att, y ORDER BY value) AS BIGINT) AS upto FROM t")
def win_entropy_prefix(spark, d):
    t = _counts(spark, d).where("att = 'qty'")
    return t.select("att", "value", "y", F.sum("n").over(Window.partitionBy("att", "y").orderBy("value")).alias("upto"))


@query("dsc_mdl")
def dsc_mdl(spark, d):
    o = B.orders_problem(spark, d)
    # a learnable target: whether the price is in one of two bands
    t = o.select(F.when((F.col("price") > 60000) & (F.col("price") <= 200000), "in").otherwise("out").alias("y"), "price", "bal")
    return D.mdl(D.value_counts(t, ["price", "bal"]), ["in", "out"])


@query("dsc_apply", with_inst(LINES) + " SELECT y, CAST(q AS INT) AS q, count(*) AS n FROM (SELECT y, CASE WHEN qty <= 10 THEN 0 WHEN qty <= 25 THEN 1 WHEN qty <= 40 THEN 2 ELSE 3 END AS q FROM inst) GROUP BY ALL")
def dsc_apply(spark, d):
    t = B.lines_problem(spark, d).select("y", D.code(F.col("qty"), [10.0, 25.0, 40.0]).alias("q"))
    return t.groupBy("y", "q").agg(F.count("*").alias("n"))


@query("dsc_apply_missing", with_inst(ORDERS) + f" SELECT CAST(c AS INT) AS c, count(*) AS n FROM (SELECT CASE WHEN {NULLED} IS NULL THEN 3 WHEN {NULLED} <= 50000 THEN 0 WHEN {NULLED} <= 150000 THEN 1 ELSE 2 END AS c FROM inst) GROUP BY c")
def dsc_apply_missing(spark, d):
    return _nulled(spark, d).groupBy(D.code(F.col("price"), [50000.0, 150000.0]).alias("c")).agg(F.count("*").alias("n"))


# --- samples



@query("smp_reservoir", with_inst(ORDERS) + f" SELECT id, y FROM inst ORDER BY {hash_sql(0)}, id LIMIT 500")
def smp_reservoir(spark, d):
    return S.hash_sample(B.orders_problem(spark, d), "id", 500).select("id", "y")


@query("smp_cache", with_inst(ORDERS) + f" SELECT id FROM inst ORDER BY {hash_sql(7)}, id LIMIT 1000")
def smp_cache(spark, d):
    return S.hash_sample(B.orders_problem(spark, d), "id", 1000, 7).select("id")


@query("smp_holdout", with_inst(ORDERS) + f" SELECT id FROM inst WHERE id NOT IN (SELECT id FROM inst ORDER BY {hash_sql(3)}, id LIMIT 300)")
def smp_holdout(spark, d):
    df = B.orders_problem(spark, d)
    return df.join(S.hash_sample(df, "id", 300, 3).select("id"), "id", "left_anti").select("id")


@query("smp_shuffle", with_inst(ORDERS) + f" SELECT id, row_number() OVER (ORDER BY {hash_sql(5)}, id) AS place FROM inst")
def smp_shuffle(spark, d):
    return S.shuffled(B.orders_problem(spark, d), "id", 5).select("id", "place")


@query("smp_weighted", with_inst(ORDERS) + f" SELECT id FROM inst WHERE price > 0 ORDER BY round(ln(({hash_sql(0)} + 0.5::DOUBLE) / {HASH_SPACE}::DOUBLE) / price, 12) DESC, id LIMIT 200")
def smp_weighted(spark, d):
    return S.weighted_sample(B.orders_problem(spark, d), "id", "price", 200).select("id")


POISSON = " + ".join(f"CASE WHEN u >= '{s}'::DOUBLE THEN 1 ELSE 0 END" for s in S.poisson_steps())


@query("smp_bootstrap", with_inst(ORDERS) + f", b AS (SELECT bag, id, {POISSON} AS times FROM (SELECT id, bag, ({hash_sql("'0.' || bag")} + 0.5::DOUBLE) / {HASH_SPACE}::DOUBLE AS u FROM inst, range(0, 5) r(bag))) SELECT CAST(bag AS INT) AS bag, count(*) AS n_rows, CAST(sum(times) AS BIGINT) AS drawn FROM b WHERE times > 0 GROUP BY bag")
def smp_bootstrap(spark, d):
    return S.bootstrap_counts(B.orders_problem(spark, d), "id", 5).groupBy("bag").agg(F.count("*").alias("n_rows"), F.sum("times").alias("drawn"))


@query("smp_resample_w", "WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w FROM part), r AS (SELECT id, w, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER () AS s FROM p) SELECT id, times FROM (SELECT id, CAST(floor(round(hi * 1000 / s, 6)) - floor(round((hi - w) * 1000 / s, 6)) AS BIGINT) AS times FROM r) WHERE times > 0")
def smp_resample_w(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"))
    return S.systematic_resample(p, "id", "w", 1000).select("id", "times")


@query("smp_bv_split", with_inst(ORDERS) + f", t AS (SELECT id FROM inst ORDER BY {hash_sql(0)}, id LIMIT 400), r AS (SELECT id FROM inst WHERE id NOT IN (SELECT id FROM t) ORDER BY {hash_sql(3)}, id LIMIT 600) SELECT id, 'test' AS part FROM t UNION ALL SELECT id, 'train' FROM r")
def smp_bv_split(spark, d):
    return S.bias_variance_split(B.orders_problem(spark, d), "id", 600, 400, 2).select("id", "part")


@query("smp_rng")
def smp_rng(spark, d):
    """Two streams of draws, as whole numbers and between 0 and 1, for the orders by id."""
    o = B.orders_problem(spark, d).select("id")
    t = S.mersenne_draws(S.placed(o, [S.ranges(o, "id").alias("_k0")], [F.col("id")]), "place", 1)
    return t.withColumn("uniform", F.col("draw") / float(1 << 32))


@query("smp_fold_drawn")
def smp_fold_drawn(spark, d):
    """Folds by the generator's draws in the order of ids."""
    o = B.orders_problem(spark, d).select("id", "y")
    return S.drawn_folds(S.placed(o, [S.ranges(o, "id").alias("_k0")], [F.col("id")]), "place", 10, 1).select("id", "fold")


@query("srt_num", "SELECT o_orderkey AS id, o_totalprice AS price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def srt_num(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return S.placed(o, [S.ranges(o, "price").alias("_k0")], [F.col("price"), F.col("id")])


@query("srt_indirect", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS place FROM orders")
def srt_indirect(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_totalprice")
    # the priorities are named "1-..." to "5-...", the last comes first
    first = -F.ascii("o_orderpriority")
    return S.placed(o, [first.alias("_k0"), S.ranges(o, "o_totalprice").alias("_k1")], [F.col("o_totalprice"), F.col("id")]).select("id", "place")


@query("argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY o_custkey")
def argmax(spark, d):
    o = B.table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("worst"))
