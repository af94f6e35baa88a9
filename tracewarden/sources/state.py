"""Tables in the shared folder that hold state: they survive lost executors and retries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTable:
    """A table rewritten as a new version each time; old versions stay readable.

    Writing version n twice gives the same table, so a repeated micro-batch does no harm,
    and reading version n - 1 while writing n never overlaps.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str):
        self.spark, self.root, self.schema = spark, root, schema

    def path(self, version: int) -> str:
        return f"{self.root}/v{version}"

    def read(self, version: int) -> DataFrame:
        """The version, empty below 0."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(version))

    def write(self, df: DataFrame, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(version))
        return self.read(version)


@dataclass(frozen=True)
class Bucket:
    """Where a bucket's rows are, how many there are and when the first and the last of them expire."""

    version: int
    rows: int
    first: int | None
    last: int | None


class BucketedState:
    """Keyed rows in hash buckets, of which a version rewrites only those that it touches.

    A version lists for each bucket the version that wrote it. Rows expire at the event time
    `expire`; a bucket is rewritten without its expired rows when a batch touches it, or else once
    its first row has been expired for `slack`, and it goes unread once all its rows are expired.
    What is held so follows the live keys, and what is written follows the batch.
    """

    _LIST = "bucket int, version bigint, rows bigint, first bigint, last bigint"

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64, expire: Column | None = None, slack: int = 0):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, list(keys)
        self.buckets, self.expire, self.slack = buckets, expire, slack
        self.lists = VersionedTable(spark, f"{root}/lists", self._LIST)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def listed(self, version: int) -> dict[int, Bucket]:
        """At most one entry a bucket."""
        return {r["bucket"]: Bucket(r["version"], r["rows"], r["first"], r["last"]) for r in self.lists.read(version).collect()}

    def _path(self, bucket: int, entry: Bucket) -> str:
        return f"{self.root}/v{entry.version}/b={bucket}"

    def _rows(self, entries: dict[int, Bucket]) -> DataFrame:
        paths = [self._path(b, e) for b, e in entries.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int) -> DataFrame:
        """All rows of a version, those not yet removed included."""
        return self._rows(self.listed(version))

    def touched(self, version: int, batch: DataFrame, now: int | None) -> tuple[set[int], DataFrame]:
        """Numbers and rows of the buckets that a batch on top of `version` rewrites."""
        entries = self.listed(version)
        own = {r[0] for r in batch.select(self.bucket()).distinct().collect()}
        if now is not None:
            own |= {b for b, e in entries.items() if e.first is not None and e.first + self.slack < now}
        return own, self._rows({b: e for b, e in entries.items() if b in own})

    def write(self, version: int, own: set[int], rows: DataFrame, now: int | None) -> None:
        """A new version: the rows of the rewritten buckets, and all others as the version before has them."""
        before = self.listed(version - 1)
        if self.expire is not None and now is not None:
            rows = rows.filter(self.expire >= now)
        path = f"{self.root}/v{version}"
        # split by size as well, should one key hold most rows
        rows.withColumn("b", self.bucket()).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(path)
        expire = F.lit(None) if self.expire is None else self.expire
        kept = {b: e for b, e in before.items() if b not in own and not (now is not None and e.last is not None and e.last < now)}
        if own:
            new = self.spark.read.schema(self.rows_schema()).option("basePath", path).parquet(path)
            stats = new.groupBy("b").agg(F.count("*"), F.min(expire).cast("bigint"), F.max(expire).cast("bigint")).collect()
            kept |= {b: Bucket(version, n, first, last) for b, n, first, last in stats}
        self.lists.write(self.spark.createDataFrame([(b, e.version, e.rows, e.first, e.last) for b, e in sorted(kept.items())], self._LIST).coalesce(1), version)
        self._sweep(version - 1, before)

    def rows_schema(self) -> StructType:
        schema = self.spark.createDataFrame([], self.schema).schema
        return StructType([*schema.fields, *self.spark.createDataFrame([], "b int").schema.fields])

    def _sweep(self, version: int, current: dict[int, Bucket]) -> None:
        """Remove what `version` itself had replaced; a repeat of the version after it doesn't need that."""
        if version < 1:
            return
        for b, e in self.listed(version - 1).items():
            if current.get(b) != e:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(b, e))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
