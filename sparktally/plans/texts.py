"""Queries: sources, exporters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..sources import bindings as B
from ..sources import exporters as X
from ..sources import pmeta as P
from ..sources import readers as R
from .registry import query

PART_META = """:: parts as a learning problem
:class: p_type : {types}
p_brand : {brands}
p_size : numeric
p_retailprice : numeric, ?
"""


def _part_schema(spark, d):
    p = B.table(spark, d, "part")
    names = lambda c: ", ".join(sorted(r[0] for r in p.select(c).distinct().collect()))
    return P.parse_pmeta(PART_META.format(types=names("p_type"), brands=names("p_brand")))


def _part_lines(spark, d):
    p = B.table(spark, d, "part")
    price = F.when(F.col("p_partkey") % 17 == 0, "?").otherwise(F.format_string("%.2f", "p_retailprice"))
    return p.select(F.concat_ws(" , ", "p_type", "p_brand", F.col("p_size").cast("string"), price).alias("value"))


@query("src_pmeta", "SELECT * FROM (VALUES ('p_type', 'class', true, false), ('p_brand', 'predictor', true, false), ('p_size', 'predictor', false, false), ('p_retailprice', 'predictor', false, true)) t(name, role, categorical, missing)")
def src_pmeta(spark, d):
    s = _part_schema(spark, d)
    return spark.createDataFrame([(f.name, f.metadata["role"], "domain" in f.metadata, f.metadata["missing"]) for f in s.fields], "name string, role string, categorical boolean, missing boolean")


@query("src_meta_py", "SELECT 'class' AS role, 1::BIGINT AS n UNION ALL SELECT 'predictor', 3")
def src_meta_py(spark, d):
    return src_pmeta(spark, d).groupBy("role").agg(F.count("*").alias("n"))


@query("src_pdata", "SELECT p_type, p_brand, CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice, 2) END AS p_retailprice FROM part")
def src_pdata(spark, d):
    return R.parse_delimited(_part_lines(spark, d), _part_schema(spark, d))


@query("src_declared", "SELECT p_type, p_brand, CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice, 2) END AS p_retailprice FROM part")
def src_declared(spark, d):
    """The parts written by the data source and read back by ranges of bytes."""
    from uuid import uuid4

    from ..operators.session import shared_dir
    from ..sources import datasource

    datasource.register(spark)
    schema, path = P.format_pmeta(_part_schema(spark, d)), f"{shared_dir(spark)}/declared-{uuid4().hex}"
    rows = R.parse_delimited(_part_lines(spark, d), _part_schema(spark, d))
    names = P.parse_pmeta(schema).fieldNames()
    rows.select(*names).write.format("declared").option("declaration", schema).mode("append").save(path)
    return spark.read.format("declared").option("declaration", schema).option("bytes", 1 << 16).load(path).select("p_type", "p_brand", "p_size", "p_retailprice")


@query("src_libsvm", "SELECT event_type AS class, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value, 4) END AS DOUBLE) AS a_1, 0.0::DOUBLE AS a_2, CAST(user_id AS DOUBLE) AS a_3 FROM events")
def src_libsvm(spark, d):
    e = B.table(spark, d, "events")
    one = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("1:"), F.format_string("%.4f", "value")))
    lines = e.select(F.concat_ws(" ", "event_type", one, F.concat(F.lit("3:"), F.col("user_id").cast("string"))).alias("value"))
    return R.parse_sparse(lines, 3)


@query("src_fixedwidth", "SELECT o_orderstatus AS y, CAST(o_custkey AS DOUBLE) AS cust FROM orders")
def src_fixedwidth(spark, d):
    o = B.table(spark, d, "orders")
    lines = o.select(F.concat("o_orderstatus", F.lpad(F.col("o_custkey").cast("string"), 9, " ")).alias("value"))
    classes = ", ".join(sorted(r[0] for r in o.select("o_orderstatus").distinct().collect()))
    return R.parse_fixed_width(lines, P.parse_pmeta(f":class: :width=1: y : {classes}\n:width=9: cust : numeric\n"))


@query("src_count", "SELECT count(*) AS n FROM lineitem")
def src_count(spark, d):
    return B.table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("src_store", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def src_store(spark, d):
    return B.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("src_datasets", "SELECT 'iris' AS name, 'a/iris.pmeta' AS declaration, 'a/iris.pdata' AS data")
def src_datasets(spark, d):
    return spark.createDataFrame(R.list_datasets(["a/iris.pmeta", "a/iris.pdata", "a/lost.pmeta", "b/alone.pdata"]), "name string, declaration string, data string")


@query("snk_meta")
def snk_meta(spark, d):
    return spark.createDataFrame([(x,) for x in P.format_pmeta(_part_schema(spark, d)).splitlines()], "value string")


@query("snk_disc_meta", "SELECT * FROM (VALUES (0, '<=10'), (1, '(10,25]'), (2, '(25,40]'), (3, '>40'), (4, 'unknown')) t(code, label)")
def snk_disc_meta(spark, d):
    from ..operators.discretise import interval_labels

    return spark.createDataFrame(list(enumerate(interval_labels([10.0, 25.0, 40.0], True))), "code int, label string")


SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
INST = f"WITH inst AS ({B.ORDERS_SQL})"
SEG_CODE = "CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], seg) {m} AS VARCHAR)"
Y_CODE = "CAST(list_position(['F', 'O', 'P'], y) {m} AS VARCHAR)"


@query("snk_sampler", f"{INST} SELECT {SEG_CODE.format(m='- 1')} || ',' || printf('%.4f', price) || ',' || {Y_CODE.format(m='- 1')} AS value FROM (SELECT * FROM inst ORDER BY id LIMIT 200)")
def snk_sampler(spark, d):
    top = B.orders_problem(spark, d).orderBy("id").limit(200)
    return X.code_rows(top, {"seg": SEGS}, ["price"], ["F", "O", "P"])


@query("snk_codes", f"{INST} SELECT {SEG_CODE.format(m='- 1')} || ',' || printf('%.4f', price) || ',' || {Y_CODE.format(m='- 1')} AS value FROM inst")
def snk_codes(spark, d):
    return X.code_rows(B.orders_problem(spark, d), {"seg": SEGS}, ["price"], ["F", "O", "P"])


@query("snk_svmsgd", f"{INST} SELECT CASE WHEN y = 'O' THEN '+1' ELSE '-1' END || ' ' || {SEG_CODE.format(m='')} || ':1' AS value FROM inst WHERE y <> 'P'")
def snk_svmsgd(spark, d):
    return X.svm_rows(B.orders_problem(spark, d).where("y <> 'P'"), {"seg": SEGS}, [], ["F", "O"])


@query("snk_omclp", f"{INST} SELECT {SEG_CODE.format(m='- 1')} || ' ' || {Y_CODE.format(m='- 1')} AS value FROM inst")
def snk_omclp(spark, d):
    return X.code_rows(B.orders_problem(spark, d), {"seg": SEGS}, [], ["F", "O", "P"], sep=" ")


@query("snk_arff", f"{INST} SELECT seg || ',' || region || ',' || CASE WHEN id % 17 = 0 THEN '?' ELSE printf('%.4f', price) END || ',' || y AS value FROM inst")
def snk_arff(spark, d):
    df = B.orders_problem(spark, d).withColumn("price", F.when(F.col("id") % 17 != 0, F.col("price")))
    return X.arff_rows(df, ["seg", "region"], ["price"])


@query("snk_vw", f"{INST} SELECT {Y_CODE.format(m='')} || ' | seg=' || seg || ' price:' || printf('%.4f', price) AS value FROM inst")
def snk_vw(spark, d):
    return X.vw_rows(B.orders_problem(spark, d), ["seg"], ["price"], ["F", "O", "P"])


@query("snk_svm", f"{INST} SELECT {Y_CODE.format(m='')} || ' ' || {SEG_CODE.format(m='')} || ':1 6:' || printf('%.4f', price) AS value FROM inst")
def snk_svm(spark, d):
    return X.svm_rows(B.orders_problem(spark, d), {"seg": SEGS}, ["price"], ["F", "O", "P"])


@query("snk_json")
def snk_json(spark, d):
    return X.result_document(B.metrics(spark, d))


MET = f"WITH metrics AS ({B.METRICS_SQL})"


@query("src_ingest", f"{MET} SELECT run_id, learner, metric, trial, fold, value FROM metrics")
def src_ingest(spark, d):
    docs = X.result_document(B.metrics(spark, d))
    return X.ingest(docs)["metrics"]


@query("fn_json_ingest", f"{MET} SELECT run_id, metric, count(*) AS n FROM metrics GROUP BY ALL")
def fn_json_ingest(spark, d):
    return X.ingest(X.result_document(B.metrics(spark, d)))["metrics"].groupBy("run_id", "metric").agg(F.count("*").alias("n"))


@query("src_reset", f"{MET} SELECT * FROM metrics WHERE false")
def src_reset(spark, d):
    return spark.createDataFrame([], B.metrics(spark, d).schema)


# --- scalar functions, each over a column of the tables

def fn(name, sql, table, *cols):
    query(name, sql)(lambda spark, d: B.table(spark, d, table).select(*(c() if callable(c) else c for c in cols)))


r4 = lambda c, n: F.round(c, 6).alias(n)
PRICES = lambda: F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount")))
fn("fn_streq", "SELECT p_partkey, lower(p_brand) = lower(upper(p_brand)) AS same FROM part", "part", "p_partkey", lambda: S.same_text(F.col("p_brand"), F.upper("p_brand")).alias("same"))
fn("fn_trim", "SELECT p_partkey, rtrim(p_name || '  ') AS name FROM part", "part", "p_partkey", lambda: S.trimmed(F.concat("p_name", F.lit("  "))).alias("name"))
fn("fn_underscore", "SELECT p_partkey, regexp_replace(p_name, '[ -]', '_', 'g') AS name FROM part", "part", "p_partkey", lambda: S.underscored(F.col("p_name")).alias("name"))
fn("fn_fmt4", "SELECT p_partkey, printf('%.4f', p_retailprice) AS s FROM part", "part", "p_partkey", lambda: S.four_places(F.col("p_retailprice")).alias("s"))
fn("fn_parse_num", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 100.0::DOUBLE END AS v FROM part", "part", "p_partkey", lambda: S.parse_number(F.when(F.col("p_partkey") % 5 == 0, "?").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("E2")))).alias("v"))
fn("fn_parse_ints", "SELECT p_partkey, p_size + 10 + 2 AS total FROM part", "part", "p_partkey", lambda: F.aggregate(S.parse_ints(F.concat(F.col("p_size").cast("string"), F.lit(", 10,2"))), F.lit(0), lambda a, b: a + b).alias("total"))
fn("fn_normalise", "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_tax + l_discount), 6) AS share FROM lineitem", "lineitem", "l_orderkey", "l_linenumber", lambda: r4(S.normalised(PRICES())[0], "share"))
fn("fn_sum_mean_max", "SELECT l_orderkey, round(l_quantity + l_tax + l_discount, 6) AS s, round((l_quantity + l_tax + l_discount) / 3, 6) AS m, greatest(l_quantity, l_tax, l_discount) AS top FROM lineitem", "lineitem", "l_orderkey", lambda: r4(S.array_mean(PRICES()) * 3, "s"), lambda: r4(S.array_mean(PRICES()), "m"), lambda: F.array_max(PRICES()).alias("top"))
fn("fn_math", "SELECT p_partkey, round(log2(p_retailprice), 6) AS l, round(exp(p_size / 100), 6) AS e, round(pow(p_size, 2), 6) AS p, round(sqrt(p_size), 6) AS s, abs(-p_size) AS a FROM part", "part", "p_partkey", lambda: r4(F.log2("p_retailprice"), "l"), lambda: r4(F.exp(F.col("p_size") / 100), "e"), lambda: r4(F.pow("p_size", F.lit(2)), "p"), lambda: r4(F.sqrt("p_size"), "s"), lambda: F.abs(-F.col("p_size")).alias("a"))
fn("fn_logsumexp", "SELECT l_orderkey, round(ln(exp(l_quantity) + exp(l_tax) + exp(l_discount)), 6) AS v FROM lineitem", "lineitem", "l_orderkey", lambda: r4(S.log_sum_exp(PRICES()), "v"))
fn("fn_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS v FROM customer", "customer", "c_custkey", lambda: r4(S.sigmoid(F.col("c_acctbal") / 1000), "v"))
fn("fn_gauss_pdf", "SELECT c_custkey, round(exp(-pow((c_acctbal / 1000 - 4) / 3, 2) / 2) / (3 * sqrt(2 * pi())), 6) AS v FROM customer", "customer", "c_custkey", lambda: r4(S.gauss_pdf(F.col("c_acctbal") / 1000, F.lit(4.0), F.lit(3.0)), "v"))
fn("fn_mestimate", "SELECT p_partkey, round((p_size + 1.0 / 4) / (100 + 1.0), 6) AS v, round((p_size + 0.3 * 1.0) / (100 + 1.0), 6) AS e FROM part", "part", "p_partkey", lambda: r4((F.col("p_size") + 1.0 / 4) / F.lit(101.0), "v"), lambda: r4(S.empirical_m_estimate(F.col("p_size"), F.lit(100), F.lit(0.3)), "e"))
fn("fn_discretise", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END AS code FROM part", "part", "p_partkey", lambda: __import__("sparktally.operators.discretise", fromlist=["code"]).code(F.col("p_size").cast("double"), [10.0, 20.0]).alias("code"))
fn("fn_json_write", "SELECT p_partkey, p_name AS back FROM part", "part", "p_partkey", lambda: F.get_json_object(F.to_json(F.struct(F.col("p_name").alias("n"))), "$.n").alias("back"))
fn("fn_json_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events", "event_id", lambda: F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k"))
fn("fn_matrix_unflatten", "SELECT p_partkey, p_size * 4 AS n FROM part", "part", "p_partkey", lambda: F.filter(S.unflatten(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * F.col("p_size")), F.lit(3)), lambda x: (x["t"] == 1) & (x["p"] == 1))[0]["n"].alias("n"))
fn("fn_array_get", "SELECT l_orderkey, l_tax AS a, 0.0::DOUBLE AS b FROM lineitem", "lineitem", "l_orderkey", lambda: S.get_or_zero(PRICES(), 1).alias("a"), lambda: S.get_or_zero(PRICES(), 7).alias("b"))
fn("fn_basename", "SELECT url, split_part(url, '/', -1) AS tail FROM pages", "pages", "url", lambda: S.basename(F.col("url")).alias("tail"))
fn("fn_regex_progress", "SELECT p_partkey, p_size AS fold FROM part", "part", "p_partkey", lambda: S.progress_fold(F.concat(F.lit("running Fold : "), F.col("p_size").cast("string"), F.lit(" of 50"))).alias("fold"))
fn("fn_now_tz", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS at FROM orders", "orders", "o_orderkey", lambda: S.to_shanghai(F.col("o_orderdate")).alias("at"))


@query("fn_transpose", "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity)[1] AS first, count(*) AS n FROM lineitem GROUP BY 1")
def fn_transpose(spark, d):
    t = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    return t.select("l_orderkey", F.col("a")[0]["l_quantity"].alias("first"), F.size("a").cast("long").alias("n"))


@query("fn_nl_plan", "SELECT 'nb' AS learner, 'auc' AS metric, 'xval' AS mode, 20 AS folds")
def fn_nl_plan(spark, d):
    p = S.plan_from_text("Compare nb on iris by AUC with 50-fold cross validation", ["iris"], ["nb", "aode"])
    return spark.createDataFrame([(p["learners"][0], p["metric"], p["mode"], p["folds"])], "learner string, metric string, mode string, folds int")


@query("fn_state_machine", "SELECT * FROM (VALUES ('cancelled'), ('done'), ('failed')) t(state)")
def fn_state_machine(spark, d):
    return spark.createDataFrame(sorted((S.next_state("running", s),) for s in S.TRANSITIONS["running"]), "state string")


@query("flt_valid_cmd", "SELECT * FROM (VALUES ('selective-kdb', true), ('rm -rf', false)) t(learner, valid)")
def flt_valid_cmd(spark, d):
    from ..operators.filters import valid_job

    return spark.createDataFrame([(x, valid_job({"learners": [x]})) for x in ("selective-kdb", "rm -rf")], "learner string, valid boolean")


@query("smp_pairs", "SELECT 6::BIGINT AS n")
def smp_pairs(spark, d):
    from ..operators.sampling import attribute_subsets

    return spark.createDataFrame([(len(attribute_subsets(B.ORDER_ATTS, 2, 10)),)], "n long")
