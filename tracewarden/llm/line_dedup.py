"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its words (white space apart, bytes compared). It is removed if an earlier
line has Jaccard similarity of at least `threshold`, earlier by (doc_id, hash of the text, line
number), whether or not that line is itself removed. Lines without words stay.

Words are ordered by rarity, counted over all documents in a fixed number of hash buckets (any
one order for all lines is right; rare words first makes it fast). Two similar lines must share a
word among the first few of each (prefix filter), must be of similar size (length filter), and
the words behind a shared one must suffice for the overlap (positional filter). A 64-bit parity
mask of each set bounds the difference as well. Only lines that have a partner behind all filters
are fetched again as whole sets and verified. Equal sets are one node throughout. Lines of one
prefix word are handled in bounded blocks that meet pairwise, however many they are, and a block
says once for each line which earlier line it matches, so that no list of pairs arises.

Nulls: a null text is an empty text (one line without words); a null doc_id comes last. Rows with
equal doc_id and equal text are one document and keep or lose the same lines. Further columns of
the documents are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import STEP_BYTES, bounded_groups, chunks, fresh, join_ids, mixed, runs, span_hashes, stored, text_or_empty, words

THRESHOLD = 0.8
#: Hash buckets that word counts are kept in; the table of them is what is sent to the executors.
BUCKETS = 1 << 16
#: Lines of one prefix word that one task takes at a time.
BLOCK = 1 << 15
#: Rows of the scan that numpy looks at in one go; a step for each distance costs the same for few rows.
SCAN_ROWS = 1 << 17
#: Runs longer than this go to verification whole, without a look at the masks.
LONG_RUN = 4096
#: Bits of a sort key that hold the line within a chunk; word keys have the other 50.
LINE_BITS = 14
#: Places in which a task remembers sets that it has sent; a set that has lost its place is sent again.
SENT = 1 << 18
WIDE = ["w0", "w1", "w2", "w3"]


def tokenised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the line (counted over the chunk) of each, and the first line of each row."""
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(breaks, off)  # line feeds before each row
    start, end = words(data, off)
    row = np.searchsorted(off, start, "right") - 1
    line = np.searchsorted(breaks, start) + row
    return span_hashes(data, start, end), line, own[:-1] + np.arange(len(off) - 1)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Words in each hash bucket over all documents. Each task sends one vector per bucket range."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, data, off in chunks(b.column("text"), STEP_BYTES):
                start, end = words(data, off)
                total += np.bincount((span_hashes(data, start, end) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(text_or_empty().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Place of each bucket when the rarest come first."""
    out = np.empty(BUCKETS, np.uint64)
    out[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS, dtype=np.uint64)
    return out


def ranked(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Word keys of 50 bits whose order is that of rarity: the bucket's place and more of the hash."""
    low = h & np.uint64(BUCKETS - 1)
    return (place[low] << np.uint64(34)) | (h >> np.uint64(30))


def line_sets(data: np.ndarray, off: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word keys by (line, rarity); borders of each line with words; that line; first lines of rows."""
    h, line, first = tokenised(data, off)
    key = ranked(h, place)
    step = np.append(True, line[1:] != line[:-1])[: len(line)]  # words come line by line
    named, dense = line[step], np.cumsum(step) - 1
    if len(named) <= 1 << LINE_BITS:  # one sort of one number
        both = np.sort((dense.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | key)
        line, key = named[(both >> np.uint64(64 - LINE_BITS)).astype(np.int64)], both & np.uint64((1 << (64 - LINE_BITS)) - 1)
    else:
        order = np.lexsort((key, line))
        key, line = key[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[new], line[new]
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    return key, np.append(begin, len(key)), line[begin] if len(line) else begin, first


def set_ids(key: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each set, and its parity mask."""
    size = np.diff(border)
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    m = mixed(key + np.uint64(0x1234567))
    total = np.add.reduceat(m, border[:-1])
    other = np.bitwise_xor.reduceat(mixed(m), border[:-1])
    mask = np.bitwise_xor.reduceat(np.uint64(1) << (m >> np.uint64(58)), border[:-1])
    return mixed(total ^ mixed(other + size.astype(np.uint64))), mask


def slices(values: np.ndarray, start: np.ndarray, size: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """List array of the given spans of an array of keys."""
    size = size if null is None else np.where(null, 0, size)
    off = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values[index].view(np.int64)), mask=None if null is None else pa.array(null))


def wide_masks(key: np.ndarray, border: np.ndarray) -> list[np.ndarray]:
    """Parity masks of 256 bits as four columns: for large sets 64 bits tell too little."""
    m = mixed(key + np.uint64(0x1234567))
    bit, part = np.uint64(1) << (m >> np.uint64(58)), (m >> np.uint64(40)) & np.uint64(3)
    return [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), border[:-1]) if len(border) > 1 else np.zeros(0, np.uint64) for k in range(4)]


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of the rarest words two similar sets can't both miss."""
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def no_sets(places: int) -> np.ndarray:
    """Places that hold no set yet: each has an id that belongs in another place."""
    out = np.zeros(places, np.uint64)
    out[0] = 1
    return out


def unsent(sent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks the first of each id that is not remembered, and remembers these ids."""
    found, first = np.unique(ids, return_index=True)
    place = (found & np.uint64(len(sent) - 1)).astype(np.int64)
    new = sent[place] != found
    sent[place[new]] = found[new]
    out = np.zeros(len(ids), bool)
    out[first[new]] = True
    return out


def line_table(docs: DataFrame, place: np.ndarray, threshold: float) -> DataFrame:
    """A row for each line with words: doc_id, th, line, id, n, mask, prefix (null for an id that the
    task has sent before, and for sets so small that only equal sets are similar)."""

    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_line_rows(place, threshold), f"doc_id {kind}, th long, line int, id long, n int, mask long, prefix array<long>")


def _line_rows(place: np.ndarray, threshold: float):
    def run(batches):
        sent = no_sets(SENT)
        for b in batches:
            doc, th = b.column("doc_id"), b.column("th")
            for at, end, data, off in chunks(b.column("text"), STEP_BYTES):
                key, border, line, first = line_sets(data, off, place)
                ids, mask = set_ids(key, border)
                size = np.diff(border)
                row = np.searchsorted(first, line, "right") - 1
                take = prefix_size(size, threshold)
                skip = size / (size + 1) < threshold - 1e-9  # only an equal set is similar to so small a set
                some = np.flatnonzero(~skip)
                skip[some] = ~unsent(sent, ids[some])
                index = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(index), th.take(index), pa.array((line - first[row]).astype(np.int32)), pa.array(ids.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(mask.view(np.int64)), slices(key, border[:-1], take, skip)],
                    ["doc_id", "th", "line", "id", "n", "mask", "prefix"],
                )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))


def allowed(n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of two sets of these sizes that are similar."""
    return np.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)


def suspects(table: DataFrame, threshold: float) -> DataFrame:
    """id, words: lines that share a prefix word with another line behind all filters, and those words."""
    rows = table.where(F.col("prefix").isNotNull()).select("id", "mask", "n", F.posexplode("prefix").alias("pos", "word"))
    rows = rows.select("word", "id", "mask", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("meta"))

    return rows.repartition("word").sortWithinPartitions("word", "id").mapInArrow(_scan(threshold), "id long, word long").groupBy("id").agg(F.collect_set("word").alias("words"))


def _scan(threshold: float):
    """Ids with a partner, from rows sorted by word and id; memory is `SCAN_ROWS`, a batch and part of a run."""

    def run(batches):
        held, more = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("word", "id", "mask", "meta")])
            more += b.num_rows
            if more < SCAN_ROWS:
                continue
            cols, more = _joined(held), 0
            last = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
            if len(cols[0]) - last > LONG_RUN:
                # a long run is suspect as a whole; enough rows are held for the rest of it to count as long
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][last:]), pa.array(cols[0][last:])], ["id", "word"])
                held = [[x[last:][-LONG_RUN - 1 :] for x in cols]]
            else:
                held = [[x[last:] for x in cols]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _paired(*(x[:last] for x in cols), threshold))), ["id", "word"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _paired(*_joined(held), threshold))), ["id", "word"])

    return run


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sorted parts as one, without the sets that several tasks sent."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    new = np.ones(len(cols[0]), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return [x[new] for x in cols]


def _paired(word: np.ndarray, ident: np.ndarray, mask: np.ndarray, meta: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, word) of rows that have a partner of the same word behind the filters; all rows of long runs."""
    if not len(word):
        return ident[:0], word[:0]
    every = word
    mask = mask.view(np.uint64)
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(start, len(word)))
    out = np.repeat(size > LONG_RUN, size)
    n, pos = (meta >> 32).astype(np.float64), (meta & 0xFFFFFFFF).astype(np.float64)
    some = np.flatnonzero(np.repeat((size > 1) & (size <= LONG_RUN), size))
    word, mask, n, pos = word[some], mask[some], n[some], pos[some]
    hit = np.zeros(len(some), bool)
    left = np.arange(len(some))
    for d in range(1, LONG_RUN):
        left = left[left + d < len(some)]
        left = left[word[left] == word[left + d]]
        if not len(left):
            break
        a = left[~(hit[left] & hit[left + d])]
        b = a + d
        need = allowed(n[a], n[b], threshold)
        ok = (np.minimum(n[a], n[b]) >= need) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b]) >= need)
        ok &= np.bitwise_count(mask[a] ^ mask[b]) <= n[a] + n[b] - 2 * need
        hit[a[ok]] = hit[b[ok]] = True
    out[some[hit]] = True
    return ident[out], every[out]


def fetched(docs: DataFrame, lines: DataFrame, place: np.ndarray, threshold: float) -> DataFrame:
    """Sets of the given lines (doc_id, th, line, id), read again from the texts: id, doc_id, th, line, words."""
    spread = keyed(docs).withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))})
    wanted = lines.groupBy(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "th").agg(F.collect_set("line").alias("lines"))
    wanted = stored(wanted, "lines-wanted")
    rows = join_ids(spread, wanted, ["_none", "_id", "th"], "inner").select("doc_id", "th", "text", "lines")

    def run(batches):
        for b in batches:
            for at, end, data, off in chunks(b.column("text"), STEP_BYTES):
                key, border, line, first = line_sets(data, off, place)
                ids, _ = set_ids(key, border)
                row = np.searchsorted(first, line, "right") - 1
                asked = b.column("lines").slice(at, end - at)
                flat = asked.flatten().to_numpy() + first[np.repeat(np.arange(end - at), asked.value_lengths().to_numpy())]
                pick = np.flatnonzero(np.isin(line, flat))
                index = pa.array(row[pick] + at)
                sets = slices(key, border[:-1][pick], np.diff(border)[pick])
                wide = [pa.array(x[pick].view(np.int64)) for x in wide_masks(key, border)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(index), b.column("th").take(index), pa.array((line - first[row])[pick].astype(np.int32)), pa.array(ids[pick].view(np.int64)), sets, *wide], ["doc_id", "th", "line", "id", "words", *WIDE])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # rows with equal doc_id and text give their lines twice
    return rows.mapInArrow(run, f"doc_id {kind}, th long, line int, id long, words array<long>, w0 long, w1 long, w2 long, w3 long").dropDuplicates(["id"])


def candidates(rows: DataFrame, threshold: float, most: int | None, open_: DataFrame | None) -> DataFrame:
    """(id, o, by): for each line the first earlier lines (at most `most` of a word) behind the filters.

    rows: word, id, n, w0 to w3 (wide mask), o (order). open_: ids that still look for a match; all if not given.
    """
    asks = F.lit(True)
    if open_ is not None:
        rows = rows.join(open_.withColumn("asks", F.lit(True)), "id", "left")
        asks = F.coalesce("asks", F.lit(False))
    rows, key = bounded_groups(rows.select("word", "id", "n", *WIDE, "o", asks.alias("asks")), "word", "id", BLOCK)

    def run(batches):
        for table, starts in runs(batches, key):
            ids, n, asking, *wide = (table.column(c).to_numpy() for c in ("id", "n", "asks", *WIDE))
            later, earlier = _earlier(starts, n.astype(np.int64), [w.view(np.uint64) for w in wide], asking, threshold, most)
            later, earlier = later[ids[later] != ids[earlier]], earlier[ids[later] != ids[earlier]]
            o = pa.concat_arrays(table.column("o").take(pa.array(earlier)).chunks) if len(earlier) else table.column("o").slice(0, 0).combine_chunks()
            o = pa.concat_arrays(o.chunks) if isinstance(o, pa.ChunkedArray) and o.num_chunks else o
            if len(later):
                yield pa.RecordBatch.from_arrays([pa.array(ids[later]), o, pa.array(ids[earlier])], ["id", "o", "by"])

    out = rows.repartition(*key).sortWithinPartitions(*key, "o").select(*key, "id", "n", *WIDE, "asks", "o")
    return out.mapInArrow(run, out.select("id", "o").withColumn("by", F.lit(0).cast("long")).schema)


def _earlier(starts: np.ndarray, n: np.ndarray, masks: list[np.ndarray], asks: np.ndarray, threshold: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row of its group) behind the length and mask filters, the first ones of each row."""

    def near(a, b):
        need = allowed(n[a], n[b], threshold)
        differ = sum(np.bitwise_count(m[a] ^ m[b]).astype(np.int16) for m in masks)
        return (np.minimum(n[a], n[b]) >= need) & (differ <= n[a] + n[b] - 2 * need)

    size = np.diff(starts)
    later, earlier = [], []
    if most == 1:
        small = np.repeat(size <= LONG_RUN, size)
        place = np.arange(len(n)) - np.repeat(starts[:-1], size)
        found = np.full(len(n), -1)
        left = np.flatnonzero(small & asks & (place > 0))
        for d in range(1, LONG_RUN):
            left = left[place[left] >= d]
            if not len(left):
                break
            ok = left[near(left, left - d)]
            found[ok] = ok - d  # the last one found is the earliest
        hit = np.flatnonzero(found >= 0)
        later.append(hit)
        earlier.append(found[hit])
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if most == 1 and e - s <= LONG_RUN:
            continue
        for at in range(s, e, 256):
            x = np.arange(at, min(at + 256, e))
            x = x[asks[x]]
            left = np.full(len(x), most if most is not None else e)
            for y0 in range(s, min(at + 256, e), 1024):
                if not len(x):
                    break
                y = np.arange(y0, min(y0 + 1024, at + 256, e))
                ok = near(x[:, None], y[None, :]) & (y[None, :] < x[:, None])
                ok &= np.cumsum(ok, axis=1) <= left[:, None]
                i, j = np.nonzero(ok)
                later.append(x[i])
                earlier.append(y[j])
                left = left - ok.sum(1)
                x, left = x[left > 0], left[left > 0]
    none = np.zeros(0, np.int64)
    return (np.concatenate(later), np.concatenate(earlier)) if later else (none, none)


def verified(flagged: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Ids of lines that an earlier line matches.

    flagged: id, words, n, o. sets: id, words, w0 to w3. First every line is held against the earliest
    line behind the filters, which settles most groups of near copies with one pair a line; lines
    without a match are held against more, and at last against all that are left.
    """
    rows = flagged.join(sets.select("id", *WIDE), "id").select(F.explode("words").alias("word"), "id", "n", *WIDE, "o")
    rows = stored(rows, "line-words")
    whole = sets.select("id", F.col("words").alias("set"))
    other = whole.select(F.col("id").alias("by"), F.col("set").alias("with"))
    open_, done = None, None
    for most in (1, 32, None):
        found = candidates(rows, threshold, most, open_)
        if most == 1:  # the earliest over all words
            found = found.groupBy("id").agg(F.min(F.struct("o", "by")).alias("m")).select("id", "m.by")
        else:
            found = found.select("id", "by").distinct()
        common = F.size(F.array_intersect("set", "with"))
        tested = whole.join(found, "id").join(other, "by").select("id", (common >= F.lit(threshold) * (F.size("set") + F.size("with") - common) - 1e-9).alias("ok"))
        tested = stored(tested.groupBy("id").agg(F.max("ok").alias("ok")), "lines-tested")
        hits = tested.where("ok").select("id")
        done = hits if done is None else done.unionByName(hits)
        open_ = stored(tested.where(~F.col("ok")).select("id"), "lines-open")
        if open_.isEmpty():
            break
    return done


def removals(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, lines: the numbers of the lines to remove, for documents that have any."""
    place = rarity(word_counts(docs))
    table = stored(line_table(docs, place, threshold), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")
    flags = stored(suspects(table, threshold), "lines-suspect")
    count = flags.count()
    first = table.groupBy("id").agg(F.min(order).alias("o"))
    own = join_ids(table.select("id", "n", order.alias("o")), flags, ["id"], "inner", count)
    flagged = stored(own.groupBy("id").agg(F.min("o").alias("o"), F.first("n").alias("n"), F.first("words").alias("words")), "lines-flagged")
    sets = stored(fetched(docs, flagged.select("id", "o.*").drop("none"), place, threshold), "line-sets")
    similar = verified(flagged, sets, threshold).withColumn("similar", F.lit(True))
    known = join_ids(first, similar, ["id"], "left")
    every = table.select("id", "doc_id", "th", "line").join(known, "id")
    gone = every.where(F.coalesce("similar", F.lit(False)) | ~order.eqNullSafe(F.col("o")))
    # repeated rows name a line twice
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def without(text, lines):
    """Text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")


def marked(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """All rows of the documents with an array column of the lines to remove (null if none)."""
    none, first, th, lines = fresh(docs, "_none", "_first", "_th", "_lines")
    gone = removals(docs, threshold)
    gone = gone.select(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(first), F.col("th").alias(th), F.col("lines").alias(lines))
    tagged = docs.withColumns({none: F.col("doc_id").isNull(), first: F.coalesce("doc_id", F.lit(0)), th: F.xxhash64(text_or_empty())})
    return tagged.join(gone, [none, first, th], "left").drop(none, first, th), lines


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the removed lines; documents of which no words are left are dropped,
    unless they had none to begin with. A column n_chars follows the text."""
    rows, lines = marked(docs, threshold)
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(lines)))
    rows = rows.withColumn("text", text).where(F.col(lines).isNull() | F.col("text").rlike(r"[^\t-\r ]"))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(changed))
    return rows.select(*docs.columns)
