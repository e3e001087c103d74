"""Queries: the experiment warehouse, its relational reads and rank statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import filters as L
from ..sources import bindings as B
from .registry import query


def sql(body: str, *more: str) -> str:
    return f"WITH batches AS ({B.BATCHES_SQL}), runs AS ({B.RUNS_SQL}), metrics AS ({B.METRICS_SQL})" + "".join(f", {m}" for m in more) + " " + body


TIME = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
TIME_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def list_runs(runs, dataset=None, learner=None, mode=None, batch_id=None, limit=100):
    """Runs by optional filters, newest first."""
    if dataset:
        runs = runs.where(F.col("dataset").contains(dataset))
    if learner:
        runs = runs.where(F.exists("learners", lambda x: x.contains(learner)))
    if mode:
        runs = runs.where(F.col("mode") == mode)
    if batch_id is not None:
        runs = runs.where(F.col("batch_id") == batch_id)
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


@query("flt_runs", sql(f"SELECT id, dataset, mode, {TIME_SQL.format(c='created_at')} FROM (SELECT * FROM runs WHERE dataset LIKE '%set3%' AND mode = 'xval' ORDER BY created_at DESC, id DESC LIMIT 20)"))
def flt_runs(spark, d):
    return list_runs(B.runs(spark, d), dataset="set3", mode="xval", limit=20).select("id", "dataset", "mode", TIME("created_at"))


@query("flt_runs_ui", sql("SELECT id, batch_id, dataset FROM runs WHERE batch_id IS NOT NULL AND lower(dataset) LIKE '%t1%' AND learner LIKE '%build%'"))
def flt_runs_ui(spark, d):
    r = B.runs(spark, d).where(F.col("batch_id").isNotNull() & F.lower("dataset").contains("t1"))
    return r.where(F.exists("learners", lambda x: x.contains("build"))).select("id", "batch_id", "dataset")


@query("flt_sys_sample", sql("SELECT id, value FROM metrics, (SELECT greatest(CAST(ceil(count(*) / 400.0) AS BIGINT), 1) AS step FROM metrics) WHERE id % step = 0"))
def flt_sys_sample(spark, d):
    return L.systematic_sample(B.metrics(spark, d), "id", 400).select("id", "value")


@query("flt_pooled", sql("SELECT id, run_id, metric, value FROM metrics WHERE fold = -1"))
def flt_pooled(spark, d):
    return B.metrics(spark, d).where("fold = -1").select("id", "run_id", "metric", "value")


@query("flt_folds", sql("SELECT id, fold, value FROM metrics WHERE fold >= 0"))
def flt_folds(spark, d):
    return B.metrics(spark, d).where("fold >= 0").select("id", "fold", "value")


@query("lim_top", sql("SELECT id FROM runs ORDER BY created_at DESC, id DESC LIMIT 10"))
def lim_top(spark, d):
    return list_runs(B.runs(spark, d), limit=10).select("id")


@query("join_runs_batches", sql("SELECT r.id, r.dataset, b.name AS batch FROM runs r LEFT JOIN batches b ON b.id = r.batch_id"))
def join_runs_batches(spark, d):
    b = B.batches(spark, d).select(F.col("id").alias("batch_id"), F.col("name").alias("batch"))
    return B.runs(spark, d).join(b, "batch_id", "left").select("id", "dataset", "batch")


@query("join_batch_counts", sql("SELECT b.id, b.name, count(r.id) AS n_runs FROM batches b LEFT JOIN runs r ON r.batch_id = b.id GROUP BY b.id, b.name"))
def join_batch_counts(spark, d):
    n = B.runs(spark, d).where("batch_id is not null").groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n_runs"))
    return B.batches(spark, d).join(n, "id", "left").select("id", "name", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


@query("join_run_detail", sql("SELECT r.id, r.dataset, m.metric, m.fold, m.value FROM runs r JOIN metrics m ON m.run_id = r.id"))
def join_run_detail(spark, d):
    r = B.runs(spark, d).select(F.col("id").alias("run_id"), "dataset")
    return r.join(B.metrics(spark, d).select("run_id", "metric", "fold", "value"), "run_id").select(F.col("run_id").alias("id"), "dataset", "metric", "fold", "value")


@query("join_dataset_meta", sql("SELECT r.id, r.dataset, k.n_runs FROM runs r JOIN (SELECT dataset, count(*) AS n_runs FROM runs GROUP BY dataset) k USING (dataset)"))
def join_dataset_meta(spark, d):
    r = B.runs(spark, d)
    return r.join(r.groupBy("dataset").agg(F.count("*").alias("n_runs")), "dataset").select("id", "dataset", "n_runs")


@query("join_product", sql("SELECT d.dataset, l.learner FROM (SELECT DISTINCT dataset FROM runs) d, (SELECT DISTINCT learner FROM runs) l"))
def join_product(spark, d):
    """The grid of jobs: every data set with every learner, both lists of distinct names."""
    r = B.runs(spark, d)
    return r.select("dataset").distinct().crossJoin(F.broadcast(r.select(F.explode("learners").alias("learner")).distinct()))


@query("join_fk_cascade", sql("SELECT m.id FROM metrics m WHERE m.run_id NOT IN (SELECT id FROM runs WHERE batch_id = 3)"))
def join_fk_cascade(spark, d):
    gone = B.runs(spark, d).where("batch_id = 3").select(F.col("id").alias("run_id"))
    return B.metrics(spark, d).join(gone, "run_id", "left_anti").select("id")


@query("agg_datasets", sql(f"SELECT dataset, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM runs GROUP BY dataset"))
def agg_datasets(spark, d):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return B.runs(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.date_format(F.min("created_at"), fmt).alias("first_at"), F.date_format(F.max("created_at"), fmt).alias("last_at"))


@query("agg_batch_progress", sql("SELECT b.id, total_jobs, failed_jobs, least(n, total_jobs) AS done, round(100.0 * least(n + failed_jobs, total_jobs) / total_jobs, 2) AS percent FROM batches b JOIN (SELECT b.id, count(r.id) AS n FROM batches b LEFT JOIN runs r ON r.batch_id = b.id GROUP BY b.id) k ON k.id = b.id"))
def agg_batch_progress(spark, d):
    n = B.runs(spark, d).where("batch_id is not null").groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n"))
    t = B.batches(spark, d).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    done = F.least(F.col("n") + F.col("failed_jobs"), "total_jobs")
    return t.select("id", "total_jobs", "failed_jobs", F.least("n", "total_jobs").alias("done"), F.round(100.0 * done / F.col("total_jobs"), 2).alias("percent"))


@query("agg_count_filter", sql("SELECT count(*) AS n FROM metrics WHERE run_id = 7"))
def agg_count_filter(spark, d):
    return B.metrics(spark, d).where("run_id = 7").agg(F.count("*").alias("n"))


@query("agg_distinct_learner", sql("SELECT DISTINCT learner FROM metrics WHERE learner <> ''"))
def agg_distinct_learner(spark, d):
    return B.metrics(spark, d).where("learner <> ''").select("learner").distinct()


@query("agg_curve_summary", sql("SELECT learner, fold, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM metrics WHERE fold >= 0 GROUP BY learner, fold"))
def agg_curve_summary(spark, d):
    return B.metrics(spark, d).where("fold >= 0").groupBy("learner", "fold").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("agg_mean", sql("SELECT learner, round(avg(value), 4) AS mean FROM metrics GROUP BY learner"))
def agg_mean(spark, d):
    return B.metrics(spark, d).groupBy("learner").agg(F.round(F.avg("value"), 4).alias("mean"))


@query("agg_sd", sql("SELECT learner, round(stddev_samp(value), 4) AS sd FROM metrics GROUP BY learner"))
def agg_sd(spark, d):
    return B.metrics(spark, d).groupBy("learner").agg(F.round(F.stddev_samp("value"), 4).alias("sd"))


@query("agg_pooled_metric", sql("SELECT run_id, learner, metric, round(coalesce(max(CASE WHEN fold = -1 THEN value END), avg(CASE WHEN fold >= 0 THEN value END)), 6) AS value FROM metrics GROUP BY ALL"))
def agg_pooled_metric(spark, d):
    """The pooled value where there is one, else the mean over folds."""
    v = F.coalesce(F.max(F.when(F.col("fold") == -1, F.col("value"))), F.avg(F.when(F.col("fold") >= 0, F.col("value"))))
    return B.metrics(spark, d).groupBy("run_id", "learner", "metric").agg(F.round(v, 6).alias("value"))


# --- rank statistics: data sets are nations, learners market segments, values mean balances

VALUES = "SELECT 'n' || c_nationkey AS dataset, c_mktsegment AS learner, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL"
FULL = f"m AS (SELECT * FROM ({VALUES}) WHERE dataset IN (SELECT dataset FROM ({VALUES}) GROUP BY dataset HAVING count(*) = (SELECT count(DISTINCT c_mktsegment) FROM customer)))"
RANKS = FULL + ", r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS rk FROM m)"
MEANS = RANKS + ", a AS (SELECT learner, avg(rk) AS avg_rank FROM r GROUP BY learner), s AS (SELECT (SELECT count(*) FROM a) AS k, (SELECT count(DISTINCT dataset) FROM r) AS n)"
CD = MEANS + ", cd AS (SELECT 2.728 * sqrt(k * (k + 1) / (6.0 * n)) AS cd FROM s)"


def values(spark, d):
    c = B.table(spark, d, "customer")
    return c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("dataset"), F.col("c_mktsegment").alias("learner")).agg(F.round(F.avg("c_acctbal"), 4).alias("value"))


def ranked(spark, d):
    return X.average_ranks(X.complete_matrix(values(spark, d)))


@query("agg_matrix", f"WITH {FULL} SELECT dataset, learner, value FROM m")
def agg_matrix(spark, d):
    return X.complete_matrix(values(spark, d))


@query("agg_matrix_wide", f"WITH {FULL} SELECT dataset, {', '.join(f'''max(CASE WHEN learner = '{s}' THEN value END) AS {s.lower()}''' for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM m GROUP BY dataset")
def agg_matrix_wide(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = X.complete_matrix(values(spark, d)).groupBy("dataset").pivot("learner", names).agg(F.max("value"))
    return wide.select("dataset", *(F.col(n).alias(n.lower()) for n in names))


@query("win_avg_rank", f"WITH {RANKS} SELECT dataset, learner, value, rk AS rank FROM r")
def win_avg_rank(spark, d):
    return ranked(spark, d)


@query("agg_avg_rank", f"WITH {MEANS} SELECT learner, round(avg_rank, 6) AS avg_rank FROM a")
def agg_avg_rank(spark, d):
    return X.mean_ranks(ranked(spark, d)).withColumn("avg_rank", F.round("avg_rank", 6))


@query("agg_friedman", f"WITH {MEANS} SELECT n, k, round(12.0 * n / (k * (k + 1)) * ((SELECT sum(avg_rank * avg_rank) FROM a) - k * (k + 1) * (k + 1) / 4), 6) AS chi2, 9.488::DOUBLE AS critical, 12.0 * n / (k * (k + 1)) * ((SELECT sum(avg_rank * avg_rank) FROM a) - k * (k + 1) * (k + 1) / 4) > 9.488 AS significant FROM s")
def agg_friedman(spark, d):
    return X.friedman(ranked(spark, d)).withColumn("chi2", F.round("chi2", 6))


@query("agg_nemenyi_cd", f"WITH {CD} SELECT n, k, round(cd, 6) AS cd FROM s, cd")
def agg_nemenyi_cd(spark, d):
    return X.critical_difference(ranked(spark, d)).withColumn("cd", F.round("cd", 6))


@query("agg_nemenyi_cd_10", f"WITH {CD.replace('2.728', '2.459')} SELECT n, k, round(cd, 6) AS cd FROM s, cd")
def agg_nemenyi_cd_10(spark, d):
    return X.critical_difference(ranked(spark, d), 0.10).withColumn("cd", F.round("cd", 6))


@query("agg_cd_groups", f"WITH {CD}, g AS (SELECT *, avg_rank - lag(avg_rank) OVER (ORDER BY avg_rank, learner) AS gap FROM a), h AS (SELECT g.*, sum(CASE WHEN gap > cd THEN 1 ELSE 0 END) OVER (ORDER BY avg_rank, learner) AS grp FROM g, cd) SELECT CAST(grp AS BIGINT) AS \"group\", learner, round(avg_rank, 6) AS avg_rank FROM h WHERE grp IN (SELECT grp FROM h GROUP BY grp HAVING count(*) > 1)")
def agg_cd_groups(spark, d):
    return X.cd_groups(ranked(spark, d)).withColumn("avg_rank", F.round("avg_rank", 6))


@query("agg_wdl", f"WITH {FULL} SELECT a.learner AS a, b.learner AS b, count(*) FILTER (a.value < b.value) AS win, count(*) FILTER (a.value = b.value) AS draw, count(*) FILTER (a.value > b.value) AS loss FROM m a JOIN m b USING (dataset) WHERE a.learner < b.learner GROUP BY ALL")
def agg_wdl(spark, d):
    return X.win_draw_loss(X.complete_matrix(values(spark, d)))


@query("agg_pairwise_sig", f"WITH {CD} SELECT x.learner AS a, y.learner AS b, round(abs(x.avg_rank - y.avg_rank), 6) AS gap, abs(x.avg_rank - y.avg_rank) > cd AS significant FROM a x JOIN a y ON x.learner < y.learner, cd")
def agg_pairwise_sig(spark, d):
    return X.pairwise_significance(ranked(spark, d)).withColumn("gap", F.round("gap", 6))


@query("set_union_learners", sql("SELECT learner FROM runs UNION SELECT learner FROM metrics"))
def set_union_learners(spark, d):
    return B.runs(spark, d).select(F.explode("learners").alias("learner")).union(B.metrics(spark, d).select("learner")).distinct()


@query("set_distinct", sql("SELECT DISTINCT dataset, mode FROM runs"))
def set_distinct(spark, d):
    return B.runs(spark, d).select("dataset", "mode").distinct()


@query("set_unique_learners_ui", sql("SELECT learner, count(DISTINCT dataset) AS datasets FROM runs GROUP BY learner"))
def set_unique_learners_ui(spark, d):
    return B.runs(spark, d).select("dataset", F.explode("learners").alias("learner")).groupBy("learner").agg(F.count_distinct("dataset").alias("datasets"))


@query("sort_ds", sql("SELECT dataset, n, CAST(row_number() OVER (ORDER BY n DESC, dataset) AS INT) AS place FROM (SELECT dataset, count(*) AS n FROM runs GROUP BY dataset)"))
def sort_ds(spark, d):
    t = B.runs(spark, d).groupBy("dataset").agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "dataset")))


# --- data profiles

@query("agg_class_dist", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang")
def agg_class_dist(spark, d):
    t = B.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return t.select("lang", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


@query("agg_minmax", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def agg_minmax(spark, d):
    return B.table(spark, d, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("agg_gauss", f"WITH inst AS ({B.ORDERS_SQL}) SELECT y, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS sd, count(price) AS n FROM inst GROUP BY y")
def agg_gauss(spark, d):
    return B.orders_problem(spark, d).groupBy("y").agg(F.round(F.avg("price"), 4).alias("mean"), F.round(F.stddev_samp("price"), 4).alias("sd"), F.count("price").alias("n"))


@query("agg_missing", f"WITH inst AS ({B.ORDERS_SQL}) SELECT att, missing, round(100.0 * missing / n, 4) AS percent FROM (SELECT 'price' AS att, count(*) FILTER (id % 17 = 0) AS missing, count(*) AS n FROM inst UNION ALL SELECT 'seg', count(*) FILTER (seg = 'BUILDING'), count(*) FROM inst)")
def agg_missing(spark, d):
    t = B.orders_problem(spark, d).select(F.when(F.col("id") % 17 != 0, F.col("price")).alias("price"), F.when(F.col("seg") != "BUILDING", F.col("seg")).alias("seg"))
    t = t.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in ("price", "seg")))
    long = t.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("att"), F.col(c).alias("missing")) for c in ("price", "seg")))).alias("e"))
    return long.select("e.att", "e.missing", F.round(100.0 * F.col("e.missing") / F.col("n"), 4).alias("percent"))


@query("agg_longest_run", f"WITH inst AS ({B.LINES_SQL}) SELECT att, arg_max(value, (n, -value)) AS value, max(n) AS n FROM (SELECT 'qty' AS att, qty AS value, count(*) AS n FROM inst GROUP BY qty UNION ALL SELECT 'price', price, count(*) FROM inst GROUP BY price) GROUP BY att")
def agg_longest_run(spark, d):
    """The most frequent value of each number and how often it occurs; the least of equals."""
    t = B.lines_problem(spark, d)
    long = t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("att"), F.col(c).alias("value")) for c in ("qty", "price")))).alias("e")).select("e.*")
    n = long.groupBy("att", "value").agg(F.count("*").alias("n"))
    return n.groupBy("att").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"), F.max("n").alias("n"))


@query("agg_data_stats", f"WITH inst AS ({B.ORDERS_SQL}) SELECT count(*) AS n_rows, 6::BIGINT AS n_atts, (count(DISTINCT prio) + count(DISTINCT seg) + count(DISTINCT region) + count(DISTINCT month)) / 4 AS avg_values, count(DISTINCT y) AS n_classes FROM inst")
def agg_data_stats(spark, d):
    from ..operators.evaluate import data_stats

    return data_stats(B.orders_problem(spark, d), B.ORDER_ATTS, ["price", "bal"])


@query("ln_datastat", f"WITH inst AS ({B.ORDERS_SQL}) SELECT 'prio' AS a1, prio AS v1, y, count(*) AS n FROM inst GROUP BY prio, y UNION ALL SELECT 'seg', seg, y, count(*) FROM inst GROUP BY seg, y")
def ln_datastat(spark, d):
    from ..operators.counts import cube, cuboid

    return cube(cuboid(B.orders_problem(spark, d), ["prio", "seg"]), ["prio", "seg"], 1)


PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS dataset, {a}::BIGINT AS n_attributes, count(DISTINCT {y}) AS n_classes, count(*) AS n_records FROM {t}" for t, a, y in (("customer", 5, "c_mktsegment"), ("orders", 6, "o_orderstatus"), ("part", 6, "p_type")))


@query("agg_dataset_profile", PROFILE)
def agg_dataset_profile(spark, d):
    out = None
    for t, y in (("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("part", "p_type")):
        df = B.table(spark, d, t)
        one = df.agg(F.lit(t).alias("dataset"), F.lit(len(df.columns)).cast("long").alias("n_attributes"), F.count_distinct(y).alias("n_classes"), F.count("*").alias("n_records"))
        out = one if out is None else out.union(one)
    return out
