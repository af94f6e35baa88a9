"""Running streams to completion over files, and keyed state carried between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewarden.session import new_path
from tracewarden.sources.state import BucketedState, VersionedTable


def file_stream(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet", per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if per_trigger:
        r = r.option("maxFilesPerTrigger", str(per_trigger))
    return r.load(path)


def run_to_table(streams: DataFrame | Iterable[DataFrame], name: str) -> tuple[DataFrame, list]:
    """Runs an append stream over all that arrives into a table; also its progress records."""
    out, checkpoint, progress = None, None, []
    for df in [streams] if isinstance(streams, DataFrame) else streams:
        spark = df.sparkSession
        if out is None:
            out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
        q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()
        q.awaitTermination()
        progress += q.recentProgress
    return spark.read.schema(df.schema).parquet(out), progress


def late_rows(progress: list) -> int:
    """Rows that came after the watermark and were dropped."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])


@dataclass(frozen=True)
class Context:
    """What a step may use beside its rows: the clock, and tables that are written once and read where needed."""

    now: int | None
    keep: Callable[[DataFrame], DataFrame]


Step = Callable[[DataFrame, DataFrame, Context], tuple[DataFrame, DataFrame]]


class Arrivals:
    """Tables that arrive one after the other as files of a folder; each is one micro-batch."""

    def __init__(self, parts: Sequence[DataFrame]):
        self.parts, self.spark = list(parts), parts[0].sparkSession
        self.path = new_path(self.spark, "arrivals")

    def __iter__(self) -> Iterator[DataFrame]:
        """The stream over the folder, again after every arrival."""
        for part in self.parts:
            part.write.mode("append").parquet(self.path)
            yield file_stream(self.spark, self.path, self.parts[0].schema)


@dataclass
class Outcome:
    """All output rows, the rows still held, and (batch, late): the rows of each batch that came too late."""

    rows: DataFrame
    state: DataFrame
    late: DataFrame
    lists: list[dict]


_CLOCK = "now bigint"


def run_keyed(streams: DataFrame | Iterable[DataFrame], name: str, step: Step, state_schema: StructType | str, keys: Sequence[str], *, time: str | None = None, delay: int = 0, expire: Column | None = None, slack: int = 0, buckets: int = 64, prepare: Callable[[DataFrame], DataFrame] | None = None, finish: bool = False) -> Outcome:
    """Runs ``step(batch, state, context) -> (output, new state)`` over all that arrives.

    Output, state and what waits are written tables with a version per batch id, so a repeated
    batch overwrites its own version only. ``prepare`` shapes a batch first. The batch forms of the operators spread a hot key over
    tasks, which keyed state in one task per key could not. State lies in buckets by key
    (`BucketedState`); a step gets the rows of the buckets that its batch touches and gives them back.

    With ``time`` (microseconds) the clock is the newest time seen less ``delay``. Rows go through the
    step once the clock has reached them, so in order of time however they arrive; rows that come
    when the clock has already passed them, and rows without a time, are left out and counted by batch.
    State rows go when the clock has passed their time ``expire``. With ``finish`` what still waits
    when nothing more arrives goes through the step as a last batch.
    """
    streams = [streams] if isinstance(streams, DataFrame) else streams
    root, state, seen = None, None, []

    def on_batch(batch: DataFrame, n: int) -> None:
        # a plain read of the batch's rows: they are read more than once
        batch = _kept(batch if prepare is None else prepare(batch), f"{root}/batch/v{n}")
        now, late = None, 0
        if time is not None:
            before = clock.read(n - 1).first()
            last = before["now"] if before else None
            passed = F.lit(False) if last is None else F.col(time) <= last
            newest, late = batch.agg(F.max(time), F.count_if(F.col(time).isNull() | passed)).first()
            now = max((x for x in (last, None if newest is None else newest - delay) if x is not None), default=None)
            clock.write(batch.sparkSession.createDataFrame([(now,)], _CLOCK).coalesce(1), n)
            known = batch.filter(F.col(time).isNotNull() & ~passed).unionByName(waiting.read(n - 1))
            ready = F.lit(False) if now is None else F.col(time) <= now
            waiting.write(known.filter(~ready), n)
            batch = _kept(known.filter(ready), f"{root}/ready/v{n}")
        advance(batch, n, now, late)

    def advance(batch: DataFrame, n: int, now: int | None, late: int) -> None:
        own, held = state.touched(n - 1, batch, now)
        number = count()
        out, new = step(batch, held, Context(now, lambda df: _kept(df, f"{root}/work/v{n}/{next(number)}")))
        out.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        state.write(n, own, new, now)
        batch.sparkSession.createDataFrame([(late,)], "late bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/late/batch={n}")
        seen.append(n)

    for df in streams:
        spark = df.sparkSession
        if root is None:
            root = new_path(spark, name)
            state = BucketedState(spark, f"{root}/state", state_schema, keys, buckets, expire, slack)
            clock = VersionedTable(spark, f"{root}/clock", _CLOCK)
            waiting = VersionedTable(spark, f"{root}/waiting", df.schema)
        df.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if finish and seen:
        rest = waiting.read(max(seen))
        newest = rest.agg(F.max(time)).first()[0]
        if newest is not None:
            advance(rest, max(seen) + 1, newest, 0)
    late = spark.read.parquet(f"{root}/late").select(F.col("batch").cast("bigint").alias("batch"), "late")
    return Outcome(spark.read.parquet(f"{root}/out"), state.read(max(seen)), late, [state.listed(n) for n in seen])


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
