"""How the test tables stand for entities, steps and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: entity, step (days from the first of January 2024), signal value, kind."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("step"), (F.col("value") * 0.7310585786).alias("value"), F.col("event_type").alias("kind"), "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: entity (supplier), step (line number), kind (return flag), x quantity, y price in thousands."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


DAILY = "daily AS (SELECT user_id AS entity, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, value * 0.7310585786::DOUBLE AS value, event_type AS kind, event_id FROM events)"
SERIES = DAILY + ", series AS (SELECT entity, step, avg(value) AS v FROM daily GROUP BY entity, step)"
SAMPLES = "samples AS (SELECT l_suppkey AS entity, l_linenumber AS step, l_returnflag AS kind, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"
