"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of words (white space apart, long ones cut into pieces). Every `k` words in a
row give a hash; of every `window` hashes in a row the smallest is marked, the rightmost of equal
ones, and a fingerprint is the list of marked hashes with their positions. Two texts that share
window + k - 1 words in a row share at least one marked hash, and what is marked there depends on
these words alone. Shorter texts have one window, or one hash of all their words.

A mark is one long: the upper bits are the hash, the lower ones count positions from the far end,
so that the smallest long is the smallest hash and the rightmost of equal ones.

Nulls: a null text is an empty text and has an empty fingerprint; two empty fingerprints are alike
(1.0). Null ids come last in the order of documents. Repeated rows follow one another; a single
document is its own next one. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import text_or_empty

K = 5
WINDOW = 8
#: Code points of one word piece at most.
PIECE = 16
#: Bits of a mark that hold the position: texts of up to 67 million words.
PLACE_BITS = 26


def marks(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Marked hashes of a text in order of position, one long each."""
    words = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    # nested so that each list is made once
    return F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform(F.array(_grams(w, k)), lambda g: _minima(g, window)))))


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    last = F.greatest(n - k + 1, F.least(n, F.lit(1)))
    far = (1 << PLACE_BITS) - 1
    coded = lambda i: F.xxhash64(F.slice(words, i, F.lit(k))).bitwiseAND(F.lit(~far)).bitwiseOR((F.lit(far) - i).cast("long"))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), coded)).otherwise(F.array().cast("array<long>"))


def _minima(grams: Column, window: int) -> Column:
    n = F.size(grams)
    last = F.greatest(n - window + 1, F.lit(1))
    least = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_min(F.slice(grams, i, F.lit(window))))
    return F.when(n > 0, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))


def hashes(fingerprint: Column) -> Column:
    """Different hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, PLACE_BITS)))


def positions(fingerprint: Column) -> Column:
    """Positions of a fingerprint's hashes, from 0."""
    far = (1 << PLACE_BITS) - 1
    return F.transform(fingerprint, lambda x: F.lit(far - 1) - x.bitwiseAND(F.lit(far)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def place(cuts: list[int], value: Column, step: int = 128) -> Column:
    """How many of the sorted cuts are at most the value, in two steps."""
    if not cuts:
        return F.lit(0)
    lit = lambda x: F.array(*map(F.lit, x)).cast("array<long>")
    below = lambda x: F.size(F.filter(x, lambda c: c <= value))
    if len(cuts) <= step:
        return below(lit(cuts))
    rough = below(lit(cuts[step - 1 :: step]))
    return rough * step + below(F.slice(lit(cuts), rough * step + 1, F.lit(step)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next smaller doc_id, for the smallest that of the largest.

    The ids are cut into ranges of about equal numbers of rows; the first row of a range is also
    sent to the end of the range before, so that each range is complete by itself.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(20 * ranges))).first()[0]
    rows = rows.withColumn("range", F.coalesce(place(sorted(set(cuts or [])), F.col("doc_id")), F.lit(-1)))
    # one row a range, ids and hashes only
    heads = sorted(rows.groupBy("range").agg(F.max(F.struct("doc_id", "th")).alias("k")).collect())
    before = [(h["k"]["doc_id"] is None, h["k"]["doc_id"] or 0, h["k"]["th"], heads[(i + 1) % len(heads)]["range"]) for i, h in enumerate(heads)]
    if not before:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    targets = F.broadcast(spark.createDataFrame(before, "none boolean, id long, th long, to int"))
    tagged = rows.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    ghosts = tagged.join(targets, ["none", "id", "th"]).select("doc_id", "text", "th", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    every = rows.select("doc_id", "text", "th", "range", F.lit(False).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("th"))
    return every.withColumn("next_text", F.lead("text").over(order)).where(~F.col("ghost")).select("doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by as many first code points of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and the marks of each text."""
    return docs.select("doc_id", marks(text_or_empty(), k, window).alias("marks"))


def compared(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, edited text, the marks of both and of the next text."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", "text", "edited", *(marks(F.col(c), k, window).alias(m) for c, m in (("text", "marks"), ("edited", "edited_marks"), ("next_text", "next_marks"))))
