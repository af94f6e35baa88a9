"""Phrases of two to five words that hold together, mined by sampling (Toivonen).

Texts are lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line ends and the pieces into words
at spaces and tabs; a phrase lies within one piece. Everything is counted per language.

A sample of the texts proposes phrases: those that are frequent in it at a lowered threshold. A phrase
of which both the first n-1 and the last n-1 words are proposed belongs to the proposed phrases or to
their negative border; single words always do. The full pass counts all of these exactly, over all texts: a
first scan adds up the counts of 64-bit hashes, which are too high where hashes collide and never too
low, a second one counts the phrases themselves whose hashes reach the threshold. If a frequent phrase
turns up in the border, the sample had missed it: the proposed phrases become the frequent ones, and an
expansion pass counts what has come into reach, longer phrases around new ones included. It ends when no
frequent phrase is outside, and then every frequent phrase has been counted, since parts of frequent
phrases are frequent.

Proposed phrases reach the tasks as a bit table of a size bounded by `MOST_BITS`. Chance hits in it only
add phrases to what is counted; counts belong to the phrases themselves. Within a batch, equal words are
told by two independent 64-bit hashes.

A null text is an empty text, a null language is `und`. Repeated rows count each. Texts of any length are
taken whole; a piece may be as long as a text. An empty table gives an empty table. Columns other than
text, lang and doc_id don't matter; doc_id only helps to draw the sample, nulls included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewarden.llm.common import MIX, STEP, chunks, join_ids, mixed, powers, span_hashes, stored, text_or_empty

WORDS, LEAST, TOP, COVER = 5, 100, 2000, 100
#: One text in so many is in the sample; a phrase is proposed at this share of the count expected there.
SAMPLE, LOWERED = 8, 0.5
#: Bits of the table of proposed phrases: a power of two, at least 16 times their number within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Bytes of text that are counted at a time.
CHUNK = 1 << 19
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of a chunk, and the number of each one's piece."""
    n = len(data)
    stop = _BREAK[data]
    apart = stop | _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = ~apart
    first[1:] &= apart[:-1] | edge[1:n]
    last = ~apart
    last[:-1] &= apart[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    piece = np.cumsum(stop)[start] if n else np.zeros(0, np.int64)
    return start, end, row, piece


_OTHER = mixed(np.arange(1001, 1257, dtype=np.uint64) * MIX)


def _check_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes with other values of the bytes, so that words of equal `span_hashes` can be told apart."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OTHER[data] * powers(STEP, len(data)), out=total[1:])
    return (total[end] - total[start]) * powers(pow(STEP, -1, 1 << 64), len(data) + 1)[start]


def _ids(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one occurrence of each different key, number of each occurrence's key)"""
    _, at, own = np.unique(keys, return_index=True, return_inverse=True)
    return at, own


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    out = np.zeros(len(langs), np.uint64)
    for a, e, data, off in chunks(langs):
        out[a:e] = span_hashes(data, off[:-1], off[1:])
    return out


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mixed(hashes * MIX + words)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - (bits.bit_length() - 1))


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    s = slots(hashes, len(table) * 64)
    return (table[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Counter:
    """Phrases of one chunk: how often each occurs, level by level."""

    def __init__(self, data: np.ndarray, off: np.ndarray, seeds: np.ndarray):
        self.data = _LOWER[data]
        self.start, self.end, self.row, self.piece = _tokens(self.data, off)
        h = span_hashes(self.data, self.start, self.end)
        at, own = _ids(mixed(h ^ seeds[self.row] * MIX))
        check = _check_hashes(self.data, self.start, self.end)
        if (check != check[at][own]).any():  # two words share a hash: number the words by both
            at, own = _ids(mixed(check ^ seeds[self.row]) * MIX ^ h)
        self.word_at, self.word = at, own
        self.word_hash = mixed(h ^ seeds[self.row] * MIX)

    def words(self) -> pa.Array:
        """The different words as strings."""
        s, e = self.start[self.word_at], self.end[self.word_at]
        size = e - s
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.data[np.repeat(s - ends[:-1], size) + np.arange(ends[-1])] if len(s) else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

    def levels(self, tables: list[np.ndarray], only: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, place of an occurrence, count, hash) of the phrases that the last table reaches.

        A table reaches single words, and phrases of which it reaches both parts of n-1 words and holds
        them, or else is the first to reach them and is not the first table. Phrases that an earlier
        table reaches have been counted before. With `only`, one length is given.
        """
        count = len(self.start)
        ids, hashes, at = self.word, self.word_hash[self.word_at], self.word_at
        places = np.arange(count)
        reached = np.ones((len(tables), len(at)), bool)
        for n in range(1, WORDS + 1):
            keep = ~reached[:-1].any(0) & reached[-1]
            if only in (None, n) and keep.any():
                yield n, at[keep], np.bincount(ids, minlength=len(at))[keep], hashes[keep]
            if n in (only, WORDS):
                return
            held = np.stack([r & (_among(hashes, t) | (k > 0) & ~reached[:k].any(0)) for k, (r, t) in enumerate(zip(reached, tables))])
            number = np.full(count + 1, -1, np.int64)
            alive = held[-1][ids]
            to = places[alive]
            number[to] = ids[alive]
            to = to[to + n < count]
            to = to[(number[to + 1] >= 0) & (self.piece[to] == self.piece[to + n]) & (self.row[to] == self.row[to + n])]
            if not len(to):
                return
            one, ids = _ids(number[to] * np.int64(count + 1) + self.word[to + n])
            at, places = to[one], to
            first, rest = number[at], number[at + 1]
            hashes = extended(hashes[first], self.word_hash[at + n])
            reached = held[:, first] & held[:, rest]

    def phrases(self, n: int, at: np.ndarray, words: pa.Array) -> pa.Array:
        parts = [words.take(pa.array(self.word[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def _cut(data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about CHUNK bytes (bytes, offsets, rows); a longer text is cut between pieces only."""
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
        s, e = int(off[at]), int(off[end])
        if e - s <= 2 * CHUNK:
            yield data[s:e], off[at : end + 1] - s, rows[at:end]
        else:
            breaks = s + np.flatnonzero(_BREAK[data[s:e]]) + 1
            while s < e:
                k = int(np.searchsorted(breaks, s + CHUNK))
                stop = int(breaks[k]) if k < len(breaks) else e
                yield data[s:stop], np.array([0, stop - s]), rows[at:end]
                s = stop
        at = end


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, _Counter]]:
    """(languages of the batch, rows, phrases) of every run of texts."""
    for b in batches:
        langs = b.column("lang")
        seeds = _seeds(langs)
        for a, e, data, off in chunks(b.column("text"), CHUNK):
            for part, cut, rows in _cut(data, off, np.arange(a, e)):
                yield langs, rows, _Counter(part, cut, seeds[rows])


def _counts(docs: DataFrame, tables: list[np.ndarray], only: int | None = None, among: np.ndarray | None = None) -> DataFrame:
    """lang, n, phrase and its count c, added up within tasks before the shuffle; n = 0: all words.

    With `among`, phrases whose hashes are not in this table are left out.
    """

    def run(batches):
        for langs, rows, found in _parts(batches):
            total = np.bincount(found.row, minlength=len(rows))
            yield _batch(langs.take(pa.array(rows)), 0, pa.array([""] * len(rows)), total)
            words = found.words()
            for n, at, count, hashes in found.levels(tables, only):
                if among is not None:
                    ok = _among(hashes, among)
                    at, count = at[ok], count[ok]
                yield _batch(langs.take(pa.array(rows[found.row[at]])), n, found.phrases(n, at, words), count)

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, n byte, phrase string, c long")
    return rows.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c"))


def _hash_counts(docs: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Hashes h of the phrases that the last table reaches, and their counts c."""

    def run(batches):
        for _, _, found in _parts(batches):
            for _, _, count, hashes in found.levels(tables):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count)], ["h", "c"])

    return docs.select("text", "lang").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _batch(lang: pa.Array, n: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), n, np.int8)), phrase, pa.array(count)], ["lang", "n", "phrase", "c"])


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def hashes_of(phrases: DataFrame) -> DataFrame:
    """The phrases (lang, phrase) with their hashes h."""

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            seeds = _seeds(b.column("lang")) * MIX
            for a, e, data, off in chunks(b.column("phrase"), CHUNK):
                start, end, row, _ = _tokens(data, off)
                h = mixed(span_hashes(data, start, end) ^ seeds[a + row])
                first = np.searchsorted(row, np.arange(e - a))
                size = np.bincount(row, minlength=e - a)
                value = h[first]
                for k in range(1, WORDS):
                    more = np.flatnonzero(size > k)
                    value[more] = extended(value[more], h[first[more] + k])
                out[a:e] = value
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], [*b.schema.names, "h"])

    return phrases.mapInArrow(run, StructType([*phrases.schema.fields, StructField("h", LongType())]))


def table_of(hashed: DataFrame, bits: int | None = None) -> np.ndarray:
    """Bit table of the hashes h; at most MOST_BITS, whatever their number."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, hashed.count()) - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    slot = F.shiftrightunsigned("h", shift)
    cells = hashed.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def proposed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Phrases that are frequent in the sample, with their hashes; longer ones only if their parts are."""
    some = stored(docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(SAMPLE)) == 0), "phrases-sample")
    enough = max(2, int(least / SAMPLE * LOWERED))
    found, table = None, np.zeros(LEAST_BITS // 64, np.uint64)
    for n in range(1, WORDS):
        rows = _counts(some, [table], n).where((F.col("c") >= enough) & (F.col("n") == n)).select("lang", "phrase")
        rows = stored(hashes_of(rows), "phrases-proposed")
        found = rows if found is None else found.unionByName(rows)
        table = table_of(found)
    return found


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to WORDS words with their counts of `least` or more, and the word total of each language."""
    docs = texts(docs)
    members, tables, counted, totals = proposed(docs, least), [], None, None
    while True:
        tables.append(table_of(members))
        # the full pass reaches very many rare phrases, so their hashes are counted before they are themselves
        among = None if counted is not None else table_of(stored(_hash_counts(docs, tables).where(F.col("c") >= least).select("h"), "phrases-hashes"))
        rows = stored(_counts(docs, tables, among=among).where((F.col("c") >= least) | (F.col("n") == 0)), "phrases-counted")
        totals = rows.where("n = 0").select("lang", F.col("c").alias("total")) if totals is None else totals
        new = stored(hashes_of(rows.where("n > 0")), "phrases-frequent")
        counted = new if counted is None else counted.unionByName(new)
        if new.where(F.col("n") < WORDS).mapInArrow(_outside(tables[-1]), new.schema).isEmpty():
            return counted.drop("h"), totals
        members = counted.select("lang", "phrase", "h")


def _outside(table: np.ndarray):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~_among(b.column("h").to_numpy().view(np.uint64), table)))

    return run


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    counted, totals = frequent(docs, least)
    size = counted.count()
    words = F.split("phrase", " ")
    phrases = counted.where("n > 1").select("lang", "n", "phrase", F.col("c").alias("a"))
    part = lambda first, length: F.array_join(F.slice(words, first, length), " ")
    lookup = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("c").alias(count))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    cuts = join_ids(join_ids(cuts, lookup("left", "l"), ["lang", "left"], "inner", size), lookup("right", "r"), ["lang", "right"], "inner", size)
    cuts = join_ids(cuts, totals, ["lang"], "inner")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("total").cast("decimal(15,0)"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "n").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("m"))
    best = best.select("lang", "phrase", "n", "m.a", "m.l", "m.r", F.col("m.total").alias("total"), "m.score")
    inner = phrases.where("n > 2").select("lang", F.col("a").alias("held"), F.explode(_inner(words, F.col("n"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < cover * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _inner(words: Column, n: Column) -> Column:
    """The shorter phrases of two words or more that lie in a phrase."""
    runs = F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda s: F.array_join(F.slice(words, s, m), " ")))
    return F.array_distinct(F.flatten(runs))
