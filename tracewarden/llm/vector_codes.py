"""Product quantisation of integer vectors by member-resident Lloyd rounds.

Every vector is cut into `PARTS` consecutive parts and every part position has a codebook of up to
`ENTRIES` entries. A part is a row that lives with its owner, (position, entry, salt): after the first
assignment the parts are dealt out by their owners once, and stay there as files. In each further round
a task reads the parts that reside with it, finds each one's nearest entry and writes those that stay
where they are; only parts whose entry has changed go through a shuffle, to their new owners. Owners then
sum their resident members, so a round moves movers and a few sums, and what reaches the driver is the
codebooks alone. The salt is a hash of the row, with so many values that an owner holds about
`OWNER_ROWS` parts at most, however many parts are nearest to one entry.

A component x is the integer floor(4096 * x). Distances are squared Euclidean, ties go to the lower
index; an entry becomes the componentwise floor of its members' mean and stays if it has none. The
first entries are the vectors of the smallest ids. All arithmetic is exact: products that could leave
the 53 bits of a double are formed with 64-bit integers, and beyond these with Python's.

Vectors that are null or hold null or non-finite components are left out. Vectors of another length
are coded among themselves, with codebooks of their own; part p of a length d begins at floor(p * d / 8),
and an empty vector has code 0 in each part. Null ids come last, repeated rows are rows of their own,
equal ids are ordered by their components. With fewer rows than entries the codebooks are shorter. An
empty table gives an empty table. Components of 2^62 or more, or errors that a long can't hold, raise
an error. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import discard, join_ids, stored, stored_by

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts that an owner holds at most, about.
OWNER_ROWS = 512
OWNER = ["dim", "pos", "entry", "salt"]
_ROWS = "row long, dim int, pos int, entry int, part array<long>, moved boolean, distance decimal(38,0)"
#: {(length, position): entries}
Books = dict[tuple[int, int], list[list[int]]]


def quantised(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, dim, q of the vectors that take part; written once."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists("x", lambda x: F.abs(x * SCALE) >= float(1 << 62))
    v = v.where(F.col("x").isNotNull() & ~bad)
    q = F.when(large, F.raise_error(F.lit("a component does not fit"))).otherwise(F.transform("x", lambda x: F.floor(x * F.lit(float(SCALE)))))
    return stored(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dim"), q.cast("array<long>").alias("q")), "codes-vectors")


def bounds(dim: int) -> list[int]:
    return [p * dim // PARTS for p in range(PARTS + 1)]


def first_books(vectors: DataFrame) -> Books:
    """The parts of the smallest ids of each length; tasks send their own smallest only."""
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "q", "row")
    first = vectors.withColumn("k", F.row_number().over(order)).where(F.col("k") <= ENTRIES)
    books: Books = {}
    for r in sorted(first.select("dim", "k", "q").collect()):
        cut = bounds(r["dim"])
        for p in range(PARTS):
            books.setdefault((r["dim"], p), []).append(list(r["q"][cut[p] : cut[p + 1]]))
    return books


def parts(vectors: DataFrame) -> DataFrame:
    """One row a part, without an entry yet."""
    begin = lambda p: F.floor(F.col("dim") * p / PARTS).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice("q", begin(p) + 1, begin(p + 1) - begin(p)))
    return vectors.select("row", "dim", F.posexplode(cut).alias("pos", "part")).select("row", "dim", "pos", F.lit(-1).alias("entry"), "part")


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Index of the nearest entry of each row and the squared distance to it, exactly."""
    n, m = x.shape
    top = max(int(np.abs(x).max(initial=0)), max((abs(c) for e in book for c in e), default=0))
    room = (2 * top) ** 2 * max(m, 1)
    if room < 1 << 53:
        a, c = x.astype(np.float64), np.array(book, np.float64).reshape(len(book), m)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        kind = np.int64 if room < 1 << 63 else object
        a, c = x.astype(kind), np.array(book, kind).reshape(len(book), m)
        d = np.stack([((a - e) ** 2).sum(1) for e in c], 1) if m else np.zeros((n, len(book)), np.int64)
    best = np.array(d.argmin(1), np.int64)
    return best, [int(v) for v in d[np.arange(n), best]]


def _groups(batch: pa.RecordBatch, *more: str):
    """(key, row numbers, matrix of the parts) for every length, position and further column of a batch."""
    keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "pos", *more)], 1)
    values, offsets = batch.column("part").flatten().to_numpy(), batch.column("part").offsets.to_numpy()
    offsets = offsets - offsets[0]
    kinds, own = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(own.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(own.ravel(), minlength=len(kinds)))
    for key, s, e in zip(kinds.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        at = order[s:e]
        m = int(offsets[at[0] + 1] - offsets[at[0]])
        yield key, at, values[offsets[at][:, None] + np.arange(m)]


def assigned(rows: DataFrame, books: Books) -> DataFrame:
    """The rows with their nearest entries, whether these are new to them, and the distances."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            entry, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, object)
            for (dim, pos), at, x in _groups(b):
                entry[at], distance[at] = nearest(x, books[dim, pos])
            moved = entry != b.column("entry").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("dim"), b.column("pos"), pa.array(entry), b.column("part"), pa.array(moved), pa.array(distance.tolist(), pa.int64() if max(distance) < 1 << 63 else None).cast(pa.decimal128(38, 0))],
                ["row", "dim", "pos", "entry", "part", "moved", "distance"],
            )

    return rows.select("row", "dim", "pos", "entry", "part").mapInArrow(run, _ROWS)


def updated(rows: DataFrame, books: Books) -> Books:
    """Every entry as the floor of the mean of its members: owners sum what resides with them."""

    def run(batches):
        for b in batches:
            out = []
            for (dim, pos, entry), _, x in _groups(b, "entry"):
                wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
                sums = x.astype(object).sum(0) if wide else x.sum(0)
                out += [(dim, pos, entry, i, int(s), len(x)) for i, s in enumerate(sums)]
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int32()] * 4 + [pa.decimal128(38, 0), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["dim", "pos", "entry", "i", "s", "n"])

    sums = rows.select("dim", "pos", "entry", "part").mapInArrow(run, "dim int, pos int, entry int, i int, s decimal(38,0), n long")
    new = {k: [list(e) for e in v] for k, v in books.items()}
    for r in sums.groupBy("dim", "pos", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        new[r["dim"], r["pos"]][r["entry"]][r["i"]] = int(r["s"]) // r["n"]
    return new


def _at_owners(rows: DataFrame, salts: int) -> DataFrame:
    """The rows dealt out to the tasks of their owners."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(salts)))
    return salted.repartition(*OWNER).select("row", "dim", "pos", "entry", "part")


def learnt(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Books, DataFrame]:
    """Codebooks after the rounds, and the parts as they reside by then."""
    books = first_books(vectors)
    salts = max(1, -(-vectors.count() // OWNER_ROWS))
    held = [stored(_at_owners(assigned(parts(vectors), books), salts), "codes-parts")]
    books = updated(held[0], books) if rounds else books
    for _ in range(rounds - 1):
        spent = held
        resident = held[0] if len(held) == 1 else held[0].unionByName(held[1])
        split = stored_by(assigned(resident, books).drop("distance"), "moved", "codes-round")
        stay, movers = (split.where(F.col("moved") == m).drop("moved") for m in (False, True))
        came = stored(_at_owners(movers, salts), "codes-moved")
        held = [stay, came]
        books = updated(stay.unionByName(came), books)
        discard(*spent)
    return books, held[0] if len(held) == 1 else held[0].unionByName(held[1])


def digest(books: Books, dim: int) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    text = ",".join(str(c) for p in range(PARTS) for e in books[dim, p] for c in e)
    return hashlib.sha256(text.encode()).hexdigest()


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of every vector that takes part."""
    vectors = quantised(vectors)
    books, resident = learnt(vectors, rounds)
    ends = assigned(resident, books).select("row", "pos", "entry", "distance")
    places = F.array_sort(F.collect_list(F.struct("pos", "entry")))
    hexed = F.array_join(F.transform(places, lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    codes = ends.groupBy("row").agg(hexed.alias("code"), F.sum("distance").cast("long").alias("error"))
    sums = {d: digest(books, d) for d in {d for d, _ in books}}
    sha = F.create_map(*(F.lit(v) for kv in sums.items() for v in kv))[F.col("dim")] if sums else F.lit(None).cast("string")
    return vectors.join(codes, "row").select("vec_id", "label", "code", "error", sha.alias("codebooks_sha256"))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """The rows with `label_error`, the error summed over equal labels, nulls together."""
    rows = stored(rows, "codes-rows")
    key: Column = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    sums = stored(rows.groupBy(key.alias("_key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "codes-labels")
    return join_ids(rows.withColumn("_key", key), sums, ["_key"], "left").drop("_key")
