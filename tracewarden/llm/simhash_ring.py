"""SimHash near-duplicates found with pigeonring filtering.

A document's fingerprint has the bits that are set in over half of its shingle hashes (XXH64,
seed 42). Fingerprints link at `distance` or fewer differing bits. The 64 bits are cut into
distance + 1 segments laid out as a ring. If two fingerprints differ in at most `distance` bits,
some start exists from which every chain of l segments differs in at most
floor(l * distance / segments) bits: none in the first, at most one in the first two, and so on.
Each fingerprint is filed under its first two segments from every start, and looked up there and
under the variants with one bit of the second segment changed; longer chains prune what meets,
then the whole Hamming distance decides.

Equal fingerprints are one node before any pair is looked at. A bucket emits a spanning forest of
its links and not its pairs; buckets of any size are cut into bounded blocks that meet pairwise.

Nulls: a null text is an empty text (fingerprint zero, linked like any other). A null doc_id takes
part; component_id is the smallest doc_id that is not null. Repeated rows are linked like copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import bounded_groups, chunks, components, fresh, runs, stored, text_or_empty

SEED = 42
WORDS = 3
DISTANCE = 3
#: Rows of a bucket that one task takes at a time.
BLOCK = 2048
_BATCH = 1 << 16


def simhash(raw: bytes, words: int = WORDS) -> int:
    """Fingerprint of one text (UTF-8) as an unsigned 64-bit number."""
    w = raw.lower().split()  # bytes: A-Z only, and the ASCII white space
    if not w:
        return 0
    text = b" ".join(w)
    k = min(words, len(w))
    length = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(w) - k + 1]
    end = end[k - 1 :]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, len(start), _BATCH):
        h = np.array([digest(text[s:e], SEED) for s, e in zip(start[at : at + _BATCH].tolist(), end[at : at + _BATCH].tolist())], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(start), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), fp (fingerprint as a signed long) of every row; written once."""

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for at, end, data, off in chunks(b.column("text")):
                raw = data.tobytes()
                out[at:end] = [simhash(raw[s:e], words) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(out.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    return stored(rows.mapInArrow(run, rows.select("doc_id", "th").schema.add("fp", "long")), "simhash")


def bounds(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments."""
    m = distance + 1
    cut = [64 * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def ring_keys(distance: int) -> Column:
    """All (key, filed) of a fingerprint: filed under its own key, looked up under the changed ones."""
    segs = bounds(distance)
    part = lambda s: F.shiftrightunsigned("fp", s[0]).bitwiseAND(F.lit((1 << s[1]) - 1))
    out = []
    for i, first in enumerate(segs):
        second = segs[(i + 1) % len(segs)]
        for flip in [0, *(1 << b for b in range(second[1]))]:
            key = F.xxhash64(F.lit(i), part(first), part(second).bitwiseXOR(F.lit(flip)))
            out.append(F.struct(key.alias("key"), F.lit(not flip).alias("filed"), F.lit(i).cast("byte").alias("at")))
    return F.array(*out)


def masks(distance: int, at: int) -> list[tuple[np.uint64, int]]:
    """(mask, most differing bits) of the chains that start at a segment, the whole ring last."""
    segs = bounds(distance)
    m, out, mask = len(segs), [], 0
    for n in range(1, m + 1):
        shift, width = segs[(at + n - 1) % m]
        mask |= ((1 << width) - 1) << shift
        out.append((np.uint64(mask), n * distance // m))
    return out


def near(a: np.ndarray, b: np.ndarray, at: int, distance: int) -> np.ndarray:
    """Matrix of the links between fingerprints, by chains from one start and then the whole distance."""
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 20) // max(1, len(b)))
    for s in range(0, len(a), step):
        x = a[s : s + step, None] ^ b[None, :]
        ok = np.ones(x.shape, bool)
        for mask, most in masks(distance, at):
            ok &= np.bitwise_count(x & mask) <= most
        out[s : s + step] = ok
    return out


def forest(filed: np.ndarray, every: np.ndarray, at: int, distance: int) -> list[tuple[int, int]]:
    """Spanning links (node, smallest node) of a bucket; `filed` is a part of `every`, both sorted."""
    link = near(filed, every, at, distance)
    place = np.full(len(every), -1)
    place[np.searchsorted(every, filed)] = np.arange(len(filed))
    seen, out = np.zeros(len(every), bool), []
    for k in range(len(filed)):
        if seen[np.searchsorted(every, filed[k])]:
            continue
        group, todo = np.zeros(len(every), bool), np.array([k])
        while len(todo):
            new = link[todo].any(0) & ~group
            group |= new
            rows = place[np.flatnonzero(new)]
            todo = rows[rows >= 0]
        # a node that is only looked up may touch two groups; both keep their link to it
        seen |= group
        ids = every[group]
        out += [(int(v), int(ids[0])) for v in ids[1:]]
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all that are near one another."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the few different fingerprints are dealt out before each becomes many keys
    keys = fps.select("fp").distinct().repartition(parts, "fp").select("fp", F.explode(ring_keys(distance)).alias("k")).select("fp", "k.*")
    keys = stored(keys, "simhash-keys")
    rows, key = bounded_groups(keys, "key", "fp", BLOCK)

    def run(batches):
        for table, starts in runs(batches, key):
            fp = table.column("fp").to_numpy().view(np.uint64)
            filed, at = (table.column(c).to_numpy() for c in ("filed", "at"))
            a, b = [], []
            big = np.flatnonzero(np.diff(starts) > 1)
            for s, e in zip(starts[big].tolist(), starts[big + 1].tolist()):
                own = fp[s:e]
                mine = np.unique(own[filed[s:e]])
                if len(mine) and (own != own[0]).any():
                    found = forest(mine, np.unique(own), int(at[s]), distance)
                    a += [x for x, _ in found]
                    b += [x for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return rows.repartition(*key).sortWithinPartitions(*key).select(*key, "fp", "filed", "at").mapInArrow(run, "a long, b long")


def group(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, th, fp and label (equal for all documents that links connect) of every row."""
    fps = fingerprints(docs, words)
    label = components(links(fps, distance), "simhash")
    return fps.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("doc_id", "th", "fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    rows = stored(group(docs, words, distance), "simhash-groups")
    first = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "label").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One document of each group: the smallest doc_id (null ids last), its own columns only."""
    return first_of_groups(docs, group(docs, words, distance))


def first_of_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The first document of each label of the rows (doc_id, th, label)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    keep = rows.groupBy("label").agg(F.min(order).alias("k"))
    none, first, th = fresh(docs, "_none", "_first", "_th")
    keep = keep.select(F.col("k.none").alias(none), F.coalesce("k.doc_id", F.lit(0)).alias(first), F.col("k.th").alias(th)).distinct()
    tagged = docs.withColumns({none: F.col("doc_id").isNull(), first: F.coalesce("doc_id", F.lit(0)), th: F.xxhash64(text_or_empty())})
    return tagged.join(keep, [none, first, th], "left_semi").dropDuplicates([none, first, th]).select(*docs.columns)
