"""Readers and writers of request logs, block logs, counters and state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One block: time, client, URI and message, as text. Lines of another shape are no blocks.
BLOCK_LINE = r"^([\d\-]+ [\d:]+) \| IP: ([^|]+) \| URI: ([^|]+) \| Msg: (.+)$"

PARAM = T.StructType([T.StructField("position", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("ip", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("body", T.StringType()), T.StructField("content_type", T.StringType()),
])
CORRUPT = "_corrupt_record"


def write_block_log(df: DataFrame, path: str, time: Column, ip: Column, uri: Column, msg: Column) -> None:
    """Appends block lines as text, one folder per day."""
    line = F.concat(time, F.lit(" | IP: "), ip, F.lit(" | URI: "), uri, F.lit(" | Msg: "), msg)
    df.select(line.alias("value"), F.substring(time, 1, 10).alias("dt")).write.partitionBy("dt").mode("append").text(path)


def read_block_log(spark: SparkSession, path: str, as_of: Column, days: int = 7) -> DataFrame:
    """Blocks of the trailing days; only their folders are opened."""
    raw = spark.read.schema("value string, dt date").text(path)
    raw = raw.filter((F.col("dt") > F.date_sub(as_of, days)) & (F.col("dt") <= as_of)).filter(F.col("value").rlike(BLOCK_LINE))

    def part(i: int) -> Column:
        return F.trim(F.regexp_extract("value", BLOCK_LINE, i))

    return raw.select(F.regexp_extract("value", BLOCK_LINE, 1).cast("timestamp").alias("ts"), part(2).alias("ip"), part(3).alias("uri"),
                      part(4).alias("msg"), "dt")


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests with the fixed schema; broken JSON lines keep their text in ``_corrupt_record``."""
    if fmt == "json":
        schema = T.StructType([*REQUEST.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(REQUEST).format(fmt).load(path)


def read_pairs(spark: SparkSession, path: str, key: str = "ip", number: str = "expire") -> DataFrame:
    """``a|b`` lines of counters and bans; lines of another shape are dropped."""
    raw = spark.read.text(path)
    parts = F.split("value", r"\|")
    return raw.filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias(key), F.get(parts, F.lit(1)).try_cast("bigint").alias(number)) \
        .filter(F.col(number).isNotNull())


def read_state_map(spark: SparkSession, path: str, member: str, value_type: str, key: str = "id") -> DataFrame:
    """A JSON document per line whose ``member`` is a map: one row per map entry."""
    raw = spark.read.schema(f"{member} map<string, {value_type}>").json(path)
    return raw.select(F.explode(member).alias(key, "v")).select(key, "v.*")


def append_daily(df: DataFrame, path: str, day: str = "dt") -> None:
    """Verdict or block rows, appended to one folder per day."""
    df.write.partitionBy(day).mode("append").parquet(path)


def alerts(df: DataFrame, score: str, limit: float, message: Column) -> DataFrame:
    """Rows from the limit on with the text of their message."""
    return df.filter(F.col(score) >= limit).withColumn("message", message)


def write_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows without the keys that are new, and the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
