"""Watermarked window queries. Every function takes the watermark delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.timeline import micros



def tumbling_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, delay: str, limit: int | None = None) -> DataFrame:
    """Rows per key and fixed window, windows aligned to the epoch; only those over the limit."""
    return sliding_counts(df, ts, keys, width, width, delay, limit)


def sliding_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str, delay: str, limit: int | None = None) -> DataFrame:
    g = df.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    g = g.select(micros(F.col("w.start")).alias("start_us"), *keys, "n")
    return g if limit is None else g.filter(F.col("n") > limit)


def session_counts(df: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """Sessions per key: first and last row and their number."""
    g = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    return g.select(*keys, micros(F.col("a")).alias("first_us"), micros(F.col("b")).alias("last_us"), "n")


def deduplicated(df: DataFrame, ts: str, keys: Sequence[str], width: str, delay: str) -> DataFrame:
    """First row of each signature in each fixed window; a window's signatures are held until the delay has passed."""
    return df.withWatermark(ts, delay).withColumn("w", F.window(ts, width)).dropDuplicates([*keys, "w"])


def duplicate_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, delay: str) -> DataFrame:
    """Per fixed window: rows, different signatures and repeats. Two aggregates in a row: by signature, then by window."""
    own = df.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    g = own.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(F.sum("n").alias("n"), F.count("*").alias("signatures"))
    return g.select(micros(F.col("w.start")).alias("start_us"), "n", "signatures", (F.col("n") - F.col("signatures")).alias("duplicates"))


def enriched(df: DataFrame, table: DataFrame, on: str, allowed: DataFrame | None = None) -> DataFrame:
    """Stream rows with the columns of a static table, rows of allowlisted keys left out."""
    out = df.join(table, on, "left")
    return out if allowed is None else out.join(allowed, allowed.columns, "left_anti")
