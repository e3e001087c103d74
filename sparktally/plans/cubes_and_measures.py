"""Queries: count cubes and the entropy family, on lineitem, orders and events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import counts as C
from ..sources import bindings as B
from .registry import query
from .sqltext import cube_sql, entropy_sql, info_sql, with_inst

LINES, ORDERS, EVENTS = B.LINES_SQL, B.ORDERS_SQL, B.EVENTS_SQL
LA, OA, EA = B.LINE_ATTS, B.ORDER_ATTS, B.EVENT_ATTS


def line_cells(spark, d):
    return C.cuboid(B.lines_problem(spark, d), LA)


def order_cells(spark, d):
    return C.cuboid(B.orders_problem(spark, d), OA)


@query("agg_y", with_inst(LINES) + " SELECT y, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM inst GROUP BY y")
def agg_y(spark, d):
    t = B.lines_problem(spark, d).groupBy("y").agg(F.count("*").alias("n"))
    return t.select("y", "n", F.round(F.col("n") / M._over([]), 6).alias("share"))


def _cube(k, spark, d):
    return C.cube(line_cells(spark, d), LA, k)


for _k, _name in enumerate(("agg_xy", "agg_xxy", "agg_xxxy", "agg_xxxxy"), 1):
    query(_name, with_inst(LINES) + " " + cube_sql(LA, _k))(partial(_cube, _k))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names or ("value",)})


def measure(name: str, k: int, body: str, *names: str):
    """A measure over the k-cube of lineitem; ``body`` is the SQL over a table named c."""
    sql = with_inst(LINES, f"c AS ({cube_sql(LA, k)})") + f" SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names or ('value',))}) FROM ({body})"

    def add(f):
        return query(name, sql)(lambda spark, d: _rounded(f(C.cube(line_cells(spark, d), LA, k)), *names))

    return add


Y_SQL = "SELECT 'y' AS a1, y AS v1, n FROM c WHERE a1 = 'ls'"


@measure("ms_entropy", 1, entropy_sql("c", ["a1"], ["v1"]))
def ms_entropy(c):
    return M.entropy(c, ["a1"], ["v1"])


@measure("ms_infogain", 1, f"SELECT a1, hy - hc AS value FROM ({entropy_sql('c', ['a1'], ['y'], 'hy')}) JOIN (SELECT a1, sum(-n / tot * log2(n / nv)) AS hc FROM (SELECT *, sum(n) OVER (PARTITION BY a1) AS tot, sum(n) OVER (PARTITION BY a1, v1) AS nv FROM c) GROUP BY a1) USING (a1)")
def ms_infogain(c):
    return M.entropy(c, ["a1"], ["y"], "_hy").join(M.conditional_entropy(c, ["a1"], ["y"], ["v1"], "_hc"), "a1").select("a1", (F.col("_hy") - F.col("_hc")).alias("value"))


@measure("ms_splitinfo", 1, entropy_sql("c", ["a1"], ["v1"]))
def ms_splitinfo(c):
    return M.entropy(c, ["a1"], ["v1"])


@measure("ms_gainratio", 1, f"SELECT a1, CASE WHEN h > 0 THEN i / h ELSE 0 END AS value FROM ({info_sql('c', ['a1'], ['v1'], ['y'], name='i')}) JOIN ({entropy_sql('c', ['a1'], ['v1'], 'h')}) USING (a1)")
def ms_gainratio(c):
    h = M.entropy(c, ["a1"], ["v1"], "_h")
    return M.information(c, ["a1"], ["v1"], ["y"], name="_i").join(h, "a1").select("a1", F.when(F.col("_h") > 0, F.col("_i") / F.col("_h")).otherwise(0.0).alias("value"))


@measure("ms_mi", 1, info_sql("c", ["a1"], ["v1"], ["y"]))
def ms_mi(c):
    return M.information(c, ["a1"], ["v1"], ["y"])


def _su(by, x, y):
    b = ", ".join(by)
    return f"SELECT {b}, CASE WHEN hx + hy > 0 THEN 2 * i / (hx + hy) END AS value FROM ({info_sql('c', by, x, y, name='i')}) JOIN ({entropy_sql('c', by, x, 'hx')}) USING ({b}) JOIN ({entropy_sql('c', by, y, 'hy')}) USING ({b})"


@measure("ms_su", 1, _su(["a1"], ["v1"], ["y"]))
def ms_su(c):
    return M.symmetric_uncertainty(c, ["a1"], ["v1"], ["y"])


P = ["a1", "a2"]


@measure("ms_su_pair", 2, _su(P, ["v1"], ["v2"]))
def ms_su_pair(c):
    return M.symmetric_uncertainty(c, P, ["v1"], ["v2"])


@measure("ms_cmi", 2, info_sql("c", P, ["v1"], ["v2"], ("y",)))
def ms_cmi(c):
    return M.information(c, P, ["v1"], ["v2"], ("y",))


@measure("ms_ami", 2, info_sql("c", P, ["v1"], ["v2"]))
def ms_ami(c):
    return M.information(c, P, ["v1"], ["v2"])


@measure("ms_acmi", 2, info_sql("c", P, ["v1"], ["y"], ("v2",)))
def ms_acmi(c):
    return M.information(c, P, ["v1"], ["y"], ("v2",))


@measure("ms_pmi", 2, info_sql("c", P, ["v1", "v2"], ["y"]))
def ms_pmi(c):
    return M.information(c, P, ["v1", "v2"], ["y"])


@measure("ms_both", 2, f"SELECT a1, a2, cmi, acmi FROM ({info_sql('c', P, ['v1'], ['v2'], ('y',), 'cmi')}) JOIN ({info_sql('c', P, ['v1'], ['y'], ('v2',), 'acmi')}) USING (a1, a2)", "cmi", "acmi")
def ms_both(c):
    return M.information(c, P, ["v1"], ["v2"], ("y",), "cmi").join(M.information(c, P, ["v1"], ["y"], ("v2",), "acmi"), P)


def _ce_sql(by, x, z, name):
    b = ", ".join(by)
    return f"SELECT {b}, sum(-n / tot * log2(n / nz)) AS {name} FROM (SELECT *, sum(n) OVER (PARTITION BY {b}) AS tot, sum(n) OVER (PARTITION BY {b}, {z}) AS nz FROM (SELECT {b}, {x}, {z}, sum(n) AS n FROM c GROUP BY ALL)) GROUP BY {b}"


@measure("ms_csu", 2, f"SELECT a1, a2, CASE WHEN h1 + h2 > 0 THEN 2 * i / (h1 + h2) END AS value FROM ({info_sql('c', P, ['v1'], ['v2'], ('y',), 'i')}) JOIN ({_ce_sql(P, 'v1', 'y', 'h1')}) USING (a1, a2) JOIN ({_ce_sql(P, 'v2', 'y', 'h2')}) USING (a1, a2)")
def ms_csu(c):
    i = M.information(c, P, ["v1"], ["v2"], ("y",), "_i").join(M.conditional_entropy(c, P, ["v1"], ["y"], "_a"), P).join(M.conditional_entropy(c, P, ["v2"], ["y"], "_b"), P)
    h = F.col("_a") + F.col("_b")
    return i.select(*P, F.when(h > 0, 2 * F.col("_i") / h).alias("value"))


T = ["a1", "a2", "a3"]


@measure("ms_mcmi", 3, info_sql("c", T, ["v1"], ["v2"], ("v3", "y")))
def ms_mcmi(c):
    return M.information(c, T, ["v1"], ["v2"], ("v3", "y"))


@measure("ms_tmi", 3, info_sql("c", T, ["v1", "v2", "v3"], ["y"]))
def ms_tmi(c):
    return M.information(c, T, ["v1", "v2", "v3"], ["y"])


CHI = """SELECT a1, sum((coalesce(n, 0) - nv * ny / tot) ** 2 / (nv * ny / tot)) AS chi2, CAST((count(DISTINCT v1) - 1) * (count(DISTINCT y) - 1) AS BIGINT) AS df
FROM (SELECT a1, v1, sum(n) AS nv FROM c GROUP BY ALL) JOIN (SELECT a1, y, sum(n) AS ny FROM c GROUP BY ALL) USING (a1) LEFT JOIN c USING (a1, v1, y) JOIN (SELECT a1, sum(n) AS tot FROM c GROUP BY a1) USING (a1) GROUP BY a1"""


@query("ms_chisq", with_inst(LINES, f"c AS ({cube_sql(LA, 1)})") + f" SELECT a1, round(chi2, 6) AS chi2, df FROM ({CHI})")
def ms_chisq(spark, d):
    return _rounded(M.chi_square(C.cube(line_cells(spark, d), LA, 1), ["a1"], "v1", "y"), "chi2")


@query("ms_chisq_p")
def ms_chisq_p(spark, d):
    return _rounded(M.chi_square_p(M.chi_square(C.cube(line_cells(spark, d), LA, 1), ["a1"], "v1", "y")), "chi2", "p")


@measure("ms_errordiff", 2, """SELECT a1, a2, sum(abs(pi / spi - pj)) AS value FROM (SELECT *, sum(pi) OVER (PARTITION BY a1, a2, v1, v2) AS spi FROM (
  SELECT a1, a2, v1, v2, y, n1 / ny * n2 AS pi, n / nn AS pj FROM (SELECT *, sum(n) OVER (PARTITION BY a1, a2, v1, y) AS n1, sum(n) OVER (PARTITION BY a1, a2, v2, y) AS n2,
  sum(n) OVER (PARTITION BY a1, a2, y) AS ny, sum(n) OVER (PARTITION BY a1, a2, v1, v2) AS nn FROM c))) GROUP BY a1, a2""")
def ms_errordiff(c):
    # class distribution of a pair against the one that independence gives, over the seen cells
    o = M._over
    t = c.select(*P, "v1", "v2", (o([*P, "v1", "y"]) / o([*P, "y"]) * o([*P, "v2", "y"])).alias("pi"), (F.col("n") / o([*P, "v1", "v2"])).alias("pj"))
    t = t.withColumn("spi", F.sum("pi").over(M.Window.partitionBy(*P, "v1", "v2")))
    return t.groupBy(*P).agg(F.sum(F.abs(F.col("pi") / F.col("spi") - F.col("pj"))).alias("value"))


@query("srt_attr_by_measure", with_inst(LINES, f"c AS ({cube_sql(LA, 1)})") + f" SELECT a1, round(value, 6) AS value, CAST(row_number() OVER (ORDER BY round(value, 9) DESC, a1) AS INT) AS rank FROM ({info_sql('c', ['a1'], ['v1'], ['y'])})")
def srt_attr_by_measure(spark, d):
    mi = M.information(C.cube(line_cells(spark, d), LA, 1), ["a1"], ["v1"], ["y"])
    rank = F.row_number().over(M.Window.orderBy(F.round("value", 9).desc(), "a1"))
    return mi.select("a1", F.round("value", 6).alias("value"), rank.alias("rank"))


@query("top_k_pairs", with_inst(LINES, f"c AS ({cube_sql(LA, 2)})") + f" SELECT a1, a2, round(value, 6) AS value FROM ({info_sql('c', P, ['v1', 'v2'], ['y'])}) ORDER BY round(value, 9) DESC, a1, a2 LIMIT 3")
def top_k_pairs(spark, d):
    return M.information(C.cube(line_cells(spark, d), LA, 2), P, ["v1", "v2"], ["y"]).orderBy(F.round("value", 9).desc(), "a1", "a2").limit(3).withColumn("value", F.round("value", 6))


@query("top_k_factor", with_inst(LINES, f"c AS ({cube_sql(LA, 1)})") + f" SELECT a1, round(value, 6) AS value FROM ({info_sql('c', ['a1'], ['v1'], ['y'])}) ORDER BY round(value, 9) DESC, a1 LIMIT 2")
def top_k_factor(spark, d):
    mi = M.information(C.cube(line_cells(spark, d), LA, 1), ["a1"], ["v1"], ["y"])
    return mi.orderBy(F.round("value", 9).desc(), "a1").limit(len(LA) // 2).withColumn("value", F.round("value", 6))


PARENTS = f""", mi AS (SELECT a1 AS a, row_number() OVER (ORDER BY round(value, 9) DESC, a1) AS r FROM ({info_sql('c1', ['a1'], ['v1'], ['y'])})),
cm AS ({info_sql('c2', P, ['v1'], ['v2'], ('y',))}), sym AS (SELECT a1 AS child, a2 AS parent, value FROM cm UNION ALL SELECT a2, a1, value FROM cm)
SELECT child, parent, round(value, 6) AS value, CAST(place AS INT) AS place FROM (SELECT sym.*, row_number() OVER (PARTITION BY child ORDER BY round(value, 9) DESC, p.r) AS place
FROM sym JOIN mi c ON c.a = child JOIN mi p ON p.a = parent WHERE p.r < c.r) WHERE place <= 2"""


@query("top_k_parents", with_inst(LINES, f"c1 AS ({cube_sql(LA, 1)})", f"c2 AS ({cube_sql(LA, 2)})") + PARENTS)
def top_k_parents(spark, d):
    cells = line_cells(spark, d)
    mi = M.information(C.cube(cells, LA, 1), ["a1"], ["v1"], ["y"]).select(F.col("a1").alias("a"), F.row_number().over(M.Window.orderBy(F.round("value", 9).desc(), "a1")).alias("r"))
    cm = M.information(C.cube(cells, LA, 2), P, ["v1"], ["v2"], ("y",))
    sym = cm.select(F.col("a1").alias("child"), F.col("a2").alias("parent"), "value").union(cm.select("a2", "a1", "value"))
    t = sym.join(mi.select(F.col("a").alias("child"), F.col("r").alias("rc")), "child").join(mi.select(F.col("a").alias("parent"), F.col("r").alias("rp")), "parent").where("rp < rc")
    place = F.row_number().over(M.Window.partitionBy("child").orderBy(F.round("value", 9).desc(), "rp"))
    return t.select("child", "parent", F.round("value", 6).alias("value"), place.alias("place")).where("place <= 2")
