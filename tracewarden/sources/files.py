"""File inventories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a file that a task holds at a time.
CHUNK = 8 << 20


def with_digests(listing: DataFrame, path: str = "path", chunk: int = CHUNK) -> DataFrame:
    """Adds the ``md5`` of each listed file, read piece by piece, so that any file fits in memory.

    The paths are dealt out anew, as reading is the work. A file that is gone by then has no md5.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for rows in batches:
            out = []
            for p in rows[path]:
                home, name = (fs.LocalFileSystem(), p[len("file:") :]) if p.startswith("file:") else fs.FileSystem.from_uri(quote(p, safe=":/"))
                if p.startswith("file:///"):
                    name = p[len("file://") :]
                total = hashlib.md5()
                try:
                    with home.open_input_stream(name) as f:
                        while piece := f.read(chunk):
                            total.update(piece)
                    out.append(total.hexdigest())
                except FileNotFoundError:
                    out.append(None)
            yield rows.assign(md5=out)

    spread = listing.repartition(listing.sparkSession.sparkContext.defaultParallelism * 4, path)
    return spread.mapInPandas(digests, StructType([*spread.schema.fields, StructField("md5", StringType())]))


def inventory(spark: SparkSession, path: str, pattern: str = "*", excluded: Sequence[str] = (), content: bool = False) -> DataFrame:
    """Path, md5, size and time of the files below a folder.

    ``excluded`` are folder names to leave out. The digests are taken in pieces, whatever the size of
    a file; ``content`` adds the whole text, which must fit into a row.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    for name in excluded:
        f = f.filter(~F.contains("path", F.lit(f"/{name}/")))
    meta = [F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")]
    if content:
        return f.select("path", F.md5("content").alias("md5"), *meta, F.col("content").cast("string").alias("content"))
    return with_digests(f.select("path", *meta)).select("path", "md5", "size", "mtime")
