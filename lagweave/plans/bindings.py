"""Panels and edge tables over the given tables, in Spark and as SQL text of the same meaning for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import densify

#: Methods of the edge table whose scores have a sign.
SIGNED = ("AFRICA", "ASIA", "EUROPE")
METHODS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENTS = ("click", "error", "purchase", "signup", "view")
RUNS = 9
TRUTH = (("1-URGENT", "AUTOMOBILE", 0), ("2-HIGH", "BUILDING", 1), ("3-MEDIUM", "FURNITURE", 2), ("5-LOW", "MACHINERY", 3), ("AUTOMOBILE", "1-URGENT", 1))
RULES = (
    (1, "1-URGENT", "AUTOMOBILE", None, "strong", 0.8, "soft", None), (2, "1-URGENT", "AUTOMOBILE", 0, "weak", 0.4, "hard", None),
    (3, "2-HIGH", "BUILDING", 1, "none", 1.0, "hard", 0.0), (4, "3-MEDIUM", "FURNITURE", 2, "none", 0.5, "soft", None), (5, "5-LOW", "MACHINERY", 3, "inverse", 0.9, "soft", 0.7),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of value per event type."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    rows = read(spark, sf_dir, "events").select(day.alias("t"), F.col("event_type").alias("variable"), "value")
    return rows.groupBy(F.lit(0).cast("long").alias("traj_id"), "t", "variable").agg(F.sum("value").alias("value"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals per priority, absent cells 0."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1995 * 12 - 1).cast("long")
    rows = read(spark, sf_dir, "orders").select(month.alias("t"), F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"))
    return densify(rows.groupBy(F.lit(0).cast("long").alias("traj_id"), "t", "variable").agg(F.sum("value").alias("value")))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums per event type of eight user groups, absent cells 0."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("traj_id"), day.alias("t"), F.col("event_type").alias("variable"), "value")
    return densify(rows.groupBy("traj_id", "t", "variable").agg(F.sum("value").alias("value")))


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge table drawn from all orders: run 0 is the base sample, the method is the customer's region."""
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    o = read(spark, sf_dir, "orders")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "r_name")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        (F.col("o_orderkey") % RUNS).cast("int").alias("run_id"), F.col("r_name").alias("method"), F.col("o_orderpriority").alias("source"), F.col("c_mktsegment").alias("target"),
        (F.quarter("o_orderdate") - 1).cast("int").alias("lag"), ((F.col("o_totalprice") - 250000.0) / 100000.0).alias("score"), ((F.col("o_custkey") % 97) / F.lit(100.0)).alias("p_value"),
    )


def run_table(spark: SparkSession) -> DataFrame:
    return spark.range(RUNS).select(F.col("id").cast("int").alias("run_id")).withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUTH), "source string, target string, lag int")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_ord int, source string, target string, lag int, relation string, confidence double, constraint string, prior_probability double")


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, 1.0) for m in METHODS], "method string, weight double")


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def _dense(raw: str) -> str:
    return f"""SELECT g.traj_id, g.t, v.variable, coalesce(r.value, 0.0) AS value FROM (SELECT DISTINCT traj_id, t FROM ({raw})) g
      CROSS JOIN (SELECT DISTINCT variable FROM ({raw})) v LEFT JOIN ({raw}) r ON r.traj_id = g.traj_id AND r.t = g.t AND r.variable = v.variable"""


_DAY = "date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT"
SQL = {
    "ev": f"SELECT 0::BIGINT AS traj_id, {_DAY} AS t, event_type AS variable, sum(value) AS value FROM events GROUP BY ALL",
    "ord": _dense("SELECT 0::BIGINT AS traj_id, (year(o_orderdate) * 12 + month(o_orderdate) - 1995 * 12 - 1)::BIGINT AS t, o_orderpriority AS variable, sum(o_totalprice) AS value FROM orders GROUP BY ALL"),
    "traj": _dense(f"SELECT user_id % 8 AS traj_id, {_DAY} AS t, event_type AS variable, sum(value) AS value FROM events GROUP BY ALL"),
    "edges": f"""SELECT (o_orderkey % {RUNS})::INT AS run_id, r_name AS method, o_orderpriority AS source, c_mktsegment AS target, (quarter(o_orderdate) - 1)::INT AS lag,
      (o_totalprice - 250000.0) / 100000.0 AS score, (o_custkey % 97) / 100.0::DOUBLE AS p_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey""",
    "truth": f"SELECT * FROM (VALUES {_values(TRUTH)}) x(source, target, lag)",
    "rules": f"SELECT * FROM (VALUES {_values(RULES)}) x(rule_ord, source, target, lag, relation, confidence, kind, prior)",
    "methods": f"SELECT *, 1.0::DOUBLE AS weight FROM (VALUES {_values([(m, i) for i, m in enumerate(METHODS)])}) x(method, method_ord)",
}


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
