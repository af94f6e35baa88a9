"""Exact top-k by integer inner product over a bit-sliced index.

Every component of a vector is quantised to an integer. The index cuts the vectors into blocks and
keeps, for each block and component, one bitmap per binary digit (two's complement) over the
block's rows. The scores of a query against a whole block are themselves bit slices: for every
digit of every component of the query the component's slices are added, shifted, with full adders
on bitmaps (non-adjacent digits -1, 0, 1 keep the additions few). The top rows are then selected
from the most significant score slice downward, and of the rows that tie at the border the
smallest ids are taken. Only each block's best rows per query leave a task.

Nulls: rows with a null id or vector, an empty vector, or a vector with null or non-finite components
take no part. Vectors of different lengths have no inner product: each length is searched among
itself, in blocks of its own. A component of any size is held with as many slices as its block needs;
a best score that passes 64 bits, or a component that passes 62, is an error; none is left out. A query is not its own
candidate: rows with its id are left out. Repeated rows count as separate candidates. Further
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import runs, stored

#: Rows of one block of the index, and queries sent together to a block.
BLOCK = 1 << 15
QUERY_BLOCK = 1024
SCALE = 1024


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, q (array of long): floor(scale * x) of every usable vector."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(2.0**62)
    fits = lambda x: F.when(F.abs(x.cast("double") * scale) < most, x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component passes 62 bits")).cast("double"))
    q = F.transform("embedding", lambda x: F.floor(fits(x)).cast("long"))
    return vectors.where(ok & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), q.alias("q"))


def slices_of(q: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (component, digit, word) of a matrix of integers, two's complement; number of digits."""
    bits = int(max(int(q.max(initial=0)), -int(q.min(initial=0)) - 1, 0)).bit_length() + 1
    n = len(q)
    words = (n + 63) // 64
    out = np.zeros((q.shape[1], bits, words), np.uint64)
    flat = q.astype(np.int64)
    for b in range(bits):
        digit = np.zeros((q.shape[1], words * 64), np.uint8)
        digit[:, :n] = ((flat >> b) & 1).T
        out[:, b] = np.packbits(digit, axis=1, bitorder="little").view(np.uint64)
    return out, bits


def digits(x: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (place, 1 or -1) of the non-zero digits."""
    out, place = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((place, d))
            x -= d
        x >>= 1
        place += 1
    return out


class Adder:
    """Sum of shifted bit-sliced numbers by carry-save: per weight at most two bitmaps wait for a third."""

    def __init__(self, places: int, words: int):
        self.wait: list[list[np.ndarray]] = [[] for _ in range(places)]
        self.words = words
        self.constant = 0

    def put(self, place: int, bitmap: np.ndarray) -> None:
        while place < len(self.wait):
            held = self.wait[place]
            held.append(bitmap)
            if len(held) < 3:
                return
            a, b, c = held
            ab = a ^ b
            held[:] = [ab ^ c]
            bitmap = (a & b) | (ab & c)
            place += 1

    def add(self, number: np.ndarray, shift: int, sign: int) -> None:
        """number: its digits' bitmaps, the last one being the sign."""
        top = len(number) - 1
        for b in range(top):
            # -x is the inverted digits plus a constant, and so is the sign's negative weight
            self.put(shift + b, number[b] if sign > 0 else ~number[b])
        self.put(shift + top, ~number[top] if sign > 0 else number[top])
        if sign > 0:
            self.constant -= 1 << (shift + top)
        else:
            self.constant -= ((1 << top) - 1) << shift

    def total(self) -> list[np.ndarray]:
        """Digits of the sum, least first, with the constant added (modulo the number of places)."""
        ones = np.full(self.words, ~np.uint64(0))
        constant = self.constant % (1 << len(self.wait))
        for place in range(len(self.wait)):
            if constant >> place & 1:
                self.put(place, ones)
        out, carry = [], None
        for held in self.wait:
            terms = held + ([carry] if carry is not None else [])
            carry = None
            if not terms:
                out.append(np.zeros(self.words, np.uint64))
            elif len(terms) == 1:
                out.append(terms[0])
            elif len(terms) == 2:
                out.append(terms[0] ^ terms[1])
                carry = terms[0] & terms[1]
            else:
                a, b, c = terms
                out.append(a ^ b ^ c)
                carry = (a & b) | ((a ^ b) & c)
        return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def places(size: int, bits: int, query_bits: int) -> int:
    return bits + query_bits + max(1, size).bit_length() + 1


def block_scores(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Score slices of a query against a block, offset so that all are non-negative."""
    widest = int(np.abs(query.astype(np.int64)).max(initial=0)).bit_length() + 1
    n = places(len(query), index.shape[1], widest)
    adder = Adder(n + 1, index.shape[2])
    for component, x in zip(index, query.tolist()):
        for place, sign in digits(x):
            adder.add(component, place, sign)
    adder.constant += 1 << n
    return adder.total()


def select(scores: list[np.ndarray], open_: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores among the open ones, ties to the smaller row."""
    sure, tied = np.zeros_like(open_), open_.copy()
    if count(tied) > k:
        have = 0
        for digit in reversed(scores):
            more = tied & digit
            n = have + count(more)
            if n > k:
                tied = more
            elif n < k:
                sure |= more
                have = n
                tied &= ~digit
            else:
                sure |= more
                return rows_of(sure)
        # the rows left tie at the border in all digits
        return np.concatenate([rows_of(sure), rows_of(tied)[: k - have]])
    return rows_of(tied)


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return some[r] * 64 + c


def values(scores: list[np.ndarray], rows: np.ndarray, offset: int) -> np.ndarray:
    """Scores of some rows, read from the slices; an error if one doesn't fit in 64 bits."""
    if len(scores) > 62:
        bits = [((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).tolist() for digit in scores]
        out = [sum(b << place for place, b in enumerate(x)) - offset for x in zip(*bits)]
        if any(not -(1 << 63) <= x < 1 << 63 for x in out):
            raise ValueError("scores pass 64 bits")
        return np.array(out, np.int64)
    out = np.zeros(len(rows), np.int64)
    for place, digit in enumerate(scores):
        out += ((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << place
    return out - offset


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy().reshape(-1, size)


def build(vectors: DataFrame) -> DataFrame:
    """Blocks of the index: block, size (length of its vectors), n, ids (binary), bits, slices (binary).

    Blocks never leave their partition. At most BLOCK vectors are held, whatever their lengths.
    """

    def run(batches):
        held, n = {}, 0

        def blocks():
            for size, parts in sorted(held.items()):
                ids, q = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(ids, kind="stable")
                index, bits = slices_of(q[order])
                cols = [pa.array([x], pa.int32()) for x in (size, len(ids), bits)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([ids[order].tobytes()]), pa.array([index.tobytes()])], ["size", "n", "bits", "ids", "slices"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, min(BLOCK - n, b.num_rows - at))
                lengths = part.column("q").value_lengths().to_numpy()
                for size in np.unique(lengths).tolist():
                    own = part.take(pa.array(np.flatnonzero(lengths == size)))
                    held.setdefault(size, []).append((own.column("id").to_numpy(), matrix(own.column("q"), size)))
                n, at = n + part.num_rows, at + part.num_rows
                if n == BLOCK:
                    yield from blocks()
                    held, n = {}, 0
        yield from blocks()

    return vectors.mapInArrow(run, "size int, n int, bits int, ids binary, slices binary").withColumn("block", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query (id, q) among the vectors of its length."""
    spark = vectors.sparkSession
    index = stored(build(vectors), "bit-slices")
    blocks = index.select("block", "size")
    chosen = queries.select(F.col("id").alias("query_id"), F.col("q"), F.size("q").alias("size"))
    groups = max(1, -(-chosen.count() // QUERY_BLOCK))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    # every block of queries goes to every block of the index of its length: the stated query set against all rows
    numbered = blocks.join(F.broadcast(spark.range(groups).select(F.col("id").cast("int").alias("part"))))
    asked = chosen.join(numbered, ["part", "size"]).select("block", "part", "query_id", "q")
    both = asked.select("block", "part", "query_id", "q", F.lit(None).cast("int").alias("bits"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("slices"))
    told = index.join(numbered.select("block", "part"), "block").select("block", "part", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("q"), "bits", "ids", "slices")
    rows = told.unionByName(both).repartition("block", "part").sortWithinPartitions("block", "part", F.col("query_id").asc_nulls_first())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["block", "part"]):
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                first = table.slice(s, 1).to_pylist()[0]
                if first["slices"] is None or e - s == 1:
                    continue
                ids = np.frombuffer(first["ids"], np.int64)
                words = (len(ids) + 63) // 64
                block = np.frombuffer(first["slices"], np.uint64).reshape(-1, first["bits"], words)
                every = np.packbits(np.arange(block.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
                asked_ids = table.column("query_id").slice(s + 1, e - s - 1).to_numpy()
                for query_id, query in zip(asked_ids.tolist(), matrix(table.column("q").slice(s + 1, e - s - 1), len(block))):
                    open_ = every.copy()
                    for own in range(*np.searchsorted(ids, [query_id, query_id + 1])):
                        open_[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    scores = block_scores(block, query)
                    best = select(scores, open_, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query_id)), pa.array(ids[best]), pa.array(values(scores, best, 1 << (len(scores) - 1)))], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
