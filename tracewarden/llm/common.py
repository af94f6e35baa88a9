"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import new_path

#: Rows up to which a table of ids is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 1 << 20
#: The same where many arrays of eight bytes a byte of text stand at once.
STEP_BYTES = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; one file of few row groups is dealt out over the cores by its bytes."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def stored_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Like `stored`, with a folder for each value of the column."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for root in {f"{f.rsplit('/tracewarden/', 1)[0]}/tracewarden/{f.rsplit('/tracewarden/', 1)[1].split('/')[0]}" for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


def join_ids(big: DataFrame, ids: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with a table of ids: broadcast if it was counted and is small, else by shuffle."""
    rows = ids.count() if rows is None else rows
    return big.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names near the given ones that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; a null has no bytes."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole rows, about `size` bytes at a time."""
    data, off = raw_bytes(column)
    at, n = 0, len(column)
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = 0x5851F42D4C957F2D
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python process, and is never sent along with a function."""
    home = sys.modules.setdefault("tracewarden_worker_cache", types.ModuleType("tracewarden_worker_cache"))
    return home.__dict__.setdefault(name, {})


def powers(base: int, n: int) -> np.ndarray:
    known = worker_cache("powers")
    if base not in known or len(known[base]) < n:
        known[base] = _powers(base, max(2 * n, 1 << 16))
    return known[base][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of one chunk: polynomial in an odd base by prefix sums, then mixed."""
    n = len(data)
    inverse = pow(STEP, -1, 1 << 64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(STEP, n), out=total[1:])
    return mixed((total[end] - total[start]) * powers(inverse, n + 1)[start] + (end - start).astype(np.uint64) * MIX)


#: White space of `bytes.split`: tab, line feed, vertical tab, form feed, return, space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk; row borders end words too."""
    n = len(data)
    gap = SPACE[data]
    first = np.empty(n + 1, bool)
    first[0], first[n] = True, False
    first[1:n] = gap[:-1]
    inner = off[(off > 0) & (off < n)]
    first[inner] = True
    start = np.flatnonzero(first[:n] & ~gap)
    last = np.zeros(n + 1, bool)
    last[1:] |= ~gap
    stop = np.ones(n + 1, bool)
    stop[:n] = gap
    stop[inner] = True
    return start, np.flatnonzero(last & stop)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """`mapInArrow` for functions of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut at whole groups: (rows, starts of the groups and their end).

    Memory is one batch and the rows of one group, so groups must be bounded beforehand
    (`bounded_groups`).
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts([batch], key)
        if held and _same(held[-1], batch, key):
            if len(starts) == 1:
                held.append(batch)
                continue
        elif held:
            yield _cut(held, key)
            held = []
        cut = int(starts[-1])
        if cut or held:
            if cut:
                held.append(batch.slice(0, cut))
            yield _cut(held, key)
        held = [batch.slice(cut)]
    if held:
        yield _cut(held, key)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, key: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in key)


def _starts(batches: list[pa.RecordBatch], key: list[str]) -> np.ndarray:
    new = None
    for k in key:
        v = np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches])
        d = np.ones(len(v), bool)
        d[1:] = v[1:] != v[:-1]
        new = d if new is None else new | d
    return np.flatnonzero(new)


def _cut(held: list[pa.RecordBatch], key: list[str]) -> tuple[pa.Table, np.ndarray]:
    starts = _starts(held, key)
    table = pa.Table.from_batches(held)
    return table, np.append(starts, table.num_rows)


def bounded_groups(df: DataFrame, key: str, member: str, limit: int) -> tuple[DataFrame, list[str]]:
    """Groups of any size as tasks of at most about 2 x `limit` rows.

    A group with more rows than `limit` is cut into blocks by a hash of the member, and every
    pair of blocks becomes one task, so that all its rows still meet. Returns the rows with
    two block columns and the new key; `df` must be cheap to read twice (a stored table).
    """
    counts = df.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).alias("_nb"))
    counts = stored(counts, "hot-groups")
    rows = join_ids(df, counts, [key], "left")
    nb = F.coalesce("_nb", F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), member), nb).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), nb - 1)))
    rows = rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_nb", "_own", "_other")
    return rows, [key, "_i", "_j"]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of the edges (a, b): columns v, label.

    Labels spread to neighbours and then jump along labels until no label changes. Every round
    is a written table; sums by node are combined before the shuffle, so that hubs do no harm.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label"))
    labels = stored(labels.withColumn("moved", F.lit(True)), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        # a label's own node learns what those that carry the label have seen
        seen = labels.select("v", F.col("label").alias("old")).join(near, "v")
        hook = seen.groupBy(F.col("old").alias("v")).agg(F.min("near").alias("hook"))
        step = seen.join(hook, "v", "left").select("v", "old", F.least("old", "near", "hook").alias("new"))
        step = stored(step, f"{name}-step")
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("far"))
        new = step.join(jump, "new", "left").select("v", F.least("new", "far").alias("label"), "old")
        labels = stored(new.select("v", "label", (F.col("label") != F.col("old")).alias("moved")), f"{name}-labels")
        if labels.where("moved").isEmpty():
            return labels.select("v", "label")
