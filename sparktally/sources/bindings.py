"""Learning problems and result warehouses laid over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Categorical attributes of each problem, in order.
ORDER_ATTS = ["prio", "seg", "region", "month"]
EVENT_ATTS = ["u8", "hour", "wday", "k4"]
LINE_ATTS = ["ls", "ln", "tax", "disc"]


def orders_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y = order status, four categorical attributes, price and balance. The dimension joins broadcast by size."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderstatus").alias("y"),
            F.col("o_orderpriority").alias("prio"),
            F.col("c_mktsegment").alias("seg"),
            F.col("n_regionkey").cast("string").alias("region"),
            F.month("o_orderdate").cast("string").alias("month"),
            F.col("o_totalprice").alias("price"),
            F.col("c_acctbal").alias("bal"),
        )
    )


def events_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (arrival order), y = event type, four categorical attributes and a number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("y"),
        (F.col("user_id") % 8).cast("string").alias("u8"),
        F.hour("ts").cast("string").alias("hour"),
        ((F.dayofweek("ts") + 6) % 7).cast("string").alias("wday"),
        (F.get_json_object("props", "$.k").cast("long") % 4).cast("string").alias("k4"),
        F.col("value").alias("value"),
    )


def lines_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = return flag and four categorical attributes; no id."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y"),
        F.col("l_linestatus").alias("ls"),
        F.col("l_linenumber").cast("string").alias("ln"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("disc"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
    )


#: The same problems for the SQL twins: bodies of a CTE named inst.
ORDERS_SQL = """SELECT o_orderkey AS id, o_orderstatus AS y, o_orderpriority AS prio, c_mktsegment AS seg,
  CAST(n_regionkey AS VARCHAR) AS region, CAST(month(o_orderdate) AS VARCHAR) AS month, o_totalprice AS price, c_acctbal AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
EVENTS_SQL = """SELECT event_id AS id, event_type AS y, CAST(user_id % 8 AS VARCHAR) AS u8, CAST(hour(ts) AS VARCHAR) AS hour,
  CAST(dayofweek(ts) AS VARCHAR) AS wday, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR) AS k4, value FROM events"""
LINES_SQL = """SELECT l_returnflag AS y, l_linestatus AS ls, CAST(l_linenumber AS VARCHAR) AS ln,
  CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) AS tax, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS disc,
  l_quantity AS qty, l_extendedprice AS price FROM lineitem"""


# --- an experiment warehouse: batches, runs, metrics, confusion counts and predictions


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 9 + 1).cast("long").alias("total_jobs"), (F.col("n_nationkey") % 3).cast("long").alias("failed_jobs"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("long")).alias("batch_id"),
        F.concat(F.lit("set"), F.col("c_custkey") % 7).alias("dataset"),
        F.element_at(F.array(F.lit("xval"), F.lit("curves"), F.lit("stream")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("mode"),
        F.array(F.lower("c_mktsegment")).alias("learners"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 3600).alias("created_at"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy metric values: fold -1 is the pooled one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("run_id"),
        F.lower("c_mktsegment").alias("learner"),
        F.element_at(F.array(F.lit("0-1_loss"), F.lit("rmse"), F.lit("auc")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("metric"),
        (F.col("o_orderkey") % 6 - 1).cast("int").alias("fold"),
        (F.col("o_orderkey") % 2).cast("int").alias("trial"),
        F.col("o_totalprice").alias("value"),
    )


BATCHES_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey % 9 + 1 AS BIGINT) AS total_jobs, CAST(n_nationkey % 3 AS BIGINT) AS failed_jobs FROM nation"
RUNS_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS batch_id, 'set' || (c_custkey % 7) AS dataset,
  CASE c_custkey % 3 WHEN 0 THEN 'xval' WHEN 1 THEN 'curves' ELSE 'stream' END AS mode, lower(c_mktsegment) AS learner,
  make_timestamp((1704067200 + c_custkey * 3600) * 1000000) AS created_at FROM customer"""
METRICS_SQL = """SELECT o_orderkey AS id, o_custkey AS run_id, lower(c_mktsegment) AS learner,
  CASE o_orderkey % 3 WHEN 0 THEN '0-1_loss' WHEN 1 THEN 'rmse' ELSE 'auc' END AS metric,
  CAST(o_orderkey % 6 - 1 AS INT) AS fold, CAST(o_orderkey % 2 AS INT) AS trial, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey"""
