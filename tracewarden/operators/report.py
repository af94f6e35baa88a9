"""Dashboard summaries and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.joins import range_lookup


def summary(df: DataFrame, client: str, kind: str, day: str) -> DataFrame:
    """Total and counts by class, by day and by client in one pass: (part, item, n)."""
    g = df.groupingSets([[], [kind], [day], [client]], kind, day, client).agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid"))
    part = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "type").when(F.col("gid") == 5, "day").otherwise("client")
    item = F.coalesce(F.col(kind).cast("string"), F.col(day).cast("string"), F.col(client).cast("string"), F.lit("all"))
    return g.select(part.alias("part"), item.alias("item"), "n")


def dashboard(df: DataFrame, client: str, kind: str, day: str, top: int = 10) -> DataFrame:
    """The summary with the clients cut to the ``top`` busiest."""
    s = summary(df, client, kind, day)
    w = Window.partitionBy("part").orderBy(F.desc("n"), "item")
    clients = s.filter(F.col("part") == "client").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")
    return s.filter(F.col("part") != "client").unionByName(clients)


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, smaller values first on ties."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def latest(df: DataFrame, t: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(t), F.desc(tie)).limit(n)


def rate_per_minute(df: DataFrame, t: str, as_of: Column, minute: int = 60_000_000) -> DataFrame:
    """Rows of the minute before ``as_of`` and the hourly rate they make."""
    d = df.filter((F.col(t) > as_of - F.lit(minute)) & (F.col(t) <= as_of)).agg(F.count("*").alias("per_minute"))
    return d.withColumn("per_hour", F.col("per_minute") * 60)


def recent_risky_clients(df: DataFrame, client: str, t: str, tie: str, risk: str, least: float, clients: int = 20, rows: int = 5) -> DataFrame:
    """The clients with the newest risky rows, each with its last rows of any kind."""
    hot = df.filter(F.col(risk) >= least).groupBy(client).agg(F.max(F.struct(t, tie)).alias("_m")).orderBy(F.desc("_m")).limit(clients)
    # At most ``clients`` rows, so a broadcast fits.
    own = df.join(F.broadcast(hot.select(client)), client, "left_semi")
    w = Window.partitionBy(client).orderBy(F.desc(t), F.desc(tie))
    return own.withColumn("pos", F.row_number().over(w).cast("bigint")).filter(F.col("pos") <= rows)


def top_paths(df: DataFrame, uri: str, n: int = 10) -> DataFrame:
    """Busiest paths, the query cut off."""
    return top_n(df.select(F.substring_index(uri, "?", 1).alias("path")), "path", n)


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per combination of the columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def panels(df: DataFrame, address: str, t: str, tie: str, ranges: DataFrame, rate: DataFrame, width: int, countries: int = 20, newest: int = 20) -> DataFrame:
    """Rows of the dashboard beside its summary: panel, item, n.

    The busiest countries, the newest rows with their country (``n`` is the row's id), and the rate of
    `rate_per_minute`. ``ranges`` tells countries from numbers; width is that of `range_lookup`.
    """
    placed = range_lookup(df.select(address), address, ranges, width).filter(F.col("value").isNotNull()).withColumnRenamed("value", "item")
    top = top_n(placed, "item", countries).select(F.lit("country").alias("panel"), "item", "n")
    last = range_lookup(latest(df.select(address, t, tie), t, tie, newest), address, ranges, width)
    last = last.select(F.lit("latest").alias("panel"), F.coalesce("value", F.lit("UNKNOWN")).alias("item"), F.col(tie).cast("bigint").alias("n"))
    out = top.unionByName(last)
    for name in ("per_minute", "per_hour"):
        out = out.unionByName(rate.select(F.lit(name).alias("panel"), F.lit("all").alias("item"), F.col(name).alias("n")))
    return out
