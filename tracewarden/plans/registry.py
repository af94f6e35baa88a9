"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.timeline import micros

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Log times are UTC, so the session is fixed to it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table of long texts, spread over the cores.

    A small file is one task, which would do all the pattern matching alone; tables that
    come in more files than there are cores are left as they are.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Request stand-in: user_id = client, event_type = endpoint, value = risk, k = parameter."""
    e = table(spark, folder, "events")
    return e.withColumn("us", micros(F.col("ts"))).withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )


# The same view for the checking SQL.
EVENTS_SQL = """ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
