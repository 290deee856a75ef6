"""The library's inputs as views of the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import LOAD, PRICE

#: Instants before are for training, the others for evaluation.
CUTOFFS = {LOAD: "2024-01-22 00:00:00", PRICE: "2000-01-01 00:00:00"}
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour(column: str):
    return F.date_trunc("hour", column).cast("timestamp_ntz")


def load_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load of each consumer."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("consumer_id"), _hour("ts").alias("timestamp")).agg(F.sum("value").alias("value_mw"))


def price_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of each market in one currency."""
    orders = table(spark, sf_dir, "orders")
    amount = F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount_per_mwh")
    day = F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp")
    return orders.groupBy(F.col("o_orderpriority").alias("market_id"), day).agg(amount).withColumn("currency", F.lit("AMD"))


def load_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single readings cut to the hour, so that some instants repeat."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("consumer_id"), _hour("ts").alias("timestamp"), F.col("value").alias("value_mw"), F.col("event_id").alias("pos"))


LOAD_SQL = "(SELECT event_type AS consumer_id, date_trunc('hour', ts) AS timestamp, sum(value) AS value_mw FROM events GROUP BY ALL)"
PRICE_SQL = "(SELECT o_orderpriority AS market_id, 'AMD' AS currency, CAST(o_orderdate AS TIMESTAMP) AS timestamp, max(CAST(o_totalprice AS DECIMAL(18,2))) AS amount_per_mwh FROM orders GROUP BY ALL)"
RAW_SQL = "(SELECT CAST(user_id AS VARCHAR) AS consumer_id, date_trunc('hour', ts) AS timestamp, value AS value_mw, event_id AS pos FROM events)"
