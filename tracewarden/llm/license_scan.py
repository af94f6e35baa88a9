"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike (lower case, everything but letters and digits as one
space). The units of a document are its lines, its blocks between blank lines, and the whole of it.
Texts without any of a few words that no match can lack are left at once. Two sets of a and b bigrams can reach a Dice coefficient of t only if t / (2 - t) * b <= a <=
(2 - t) / t * b: by this bound most units meet no template at all, and the others only those of
about their size. All of it is DataFrame functions; the templates are constants of the plan.

Nulls: a null text is an empty text; units of fewer than two words have no bigrams and match
nothing. Documents without a match give no row. Repeated rows give their matches again. Further
columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import text_or_empty

THRESHOLD = 0.8
#: English words too common to look for.
COMMON = set("a an and any are as at be but by for from has if in is it its may must no not of on or other such than that the their this to under use with without you your".split())


@dataclass(frozen=True)
class Template:
    """A licence text or notice; `licence` is its SPDX id."""

    licence: str
    form: str
    text: str

    @property
    def bigrams(self) -> frozenset[str]:
        w = normalised(self.text).split(" ")
        return frozenset(f"{a} {b}" for a, b in zip(w, w[1:]))


def normalised(text: str) -> str:
    return re.sub(r"[^a-z0-9ß-ɏ]+", " ", text.lower()).strip()


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9ß-ɏ]+", " "))


def bigrams(words: Column) -> Column:
    """Different pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach the threshold with a template of this size."""
    low, high = threshold / (2 - threshold) * size, (2 - threshold) / threshold * size
    return int(-(-low // 1)) if low % 1 > 1e-9 else int(low), int(high + 1e-9)


def anchors(templates: list[Template], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold holds one.

    Such a unit has at least t / (2 - t) of a template's bigrams. So if more bigrams than the rest
    of them hold one of the words, the unit has at least one of these. Long words that serve many
    templates are taken first.
    """
    need = {t: len(t.bigrams) - threshold / (2 - threshold) * len(t.bigrams) + 1e-9 for t in templates if t.bigrams}
    left = {t: set(t.bigrams) for t in need}
    known = sorted({w for t in need for b in t.bigrams for w in b.split(" ")})
    chosen: list[str] = []
    while open_ := [t for t in need if len(t.bigrams) - len(left[t]) <= need[t]]:

        def gain(word: str) -> float:
            return sum(min(need[t], sum(word in b.split(" ") for b in left[t])) / need[t] for t in open_) * min(len(word), 8) ** 3 * (1e-6 if word in COMMON else 1)

        best = max((w for w in known if w not in chosen), key=lambda w: (gain(w), w))
        chosen.append(best)
        for t in left:
            left[t] = {b for b in left[t] if best not in b.split(" ")}
    return chosen


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit (line, block, text), number, body: what is compared; blocks and texts that equal a line or a block are left out."""
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"))
    of = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), x.alias("body")))
    none = F.array().cast("array<struct<unit:string,number:int,body:string>>")
    lines = F.split("text", "\n")
    gaps = F.split("text", r"\n\s*\n")
    every = F.concat(of("line", lines), F.when(F.size(gaps) > 1, of("block", gaps)).otherwise(none), F.when(F.size(lines) > 1, of("text", F.array("text"))).otherwise(none))
    return rows.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.*")


def scan(docs: DataFrame, templates: list[Template], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, number, licence, form, dice: the best template of every unit that reaches the threshold."""
    known = [(t, *bounds(len(t.bigrams), threshold)) for t in sorted(templates, key=lambda t: (t.licence, t.form)) if t.bigrams]
    least, most = min((k[1] for k in known), default=1), max((k[2] for k in known), default=0)
    words = anchors([k[0] for k in known], threshold)

    def may_match(text: Column) -> Column:
        low = F.lower(text)
        long, short = [w for w in words if len(w) > 4], [w for w in words if len(w) <= 4]
        found = F.exists(F.array(*map(F.lit, long)), lambda w: F.contains(low, w)) if long else F.lit(False)
        return found | low.rlike(rf"(?:^|[^a-z0-9])(?:{'|'.join(short)})(?:[^a-z0-9]|$)") if short else found

    # a set of n bigrams needs n + 1 words of a letter and a space at least
    rows = units(docs.where(may_match(text_or_empty()))).where((F.length("body") >= 2 * least + 1) & may_match(F.col("body")))
    rows = rows.select("doc_id", "unit", "number", F.split(normal(F.col("body")), " ").alias("words"))
    rows = rows.where(F.size("words") > least)
    rows = rows.select("doc_id", "unit", "number", bigrams(F.col("words")).alias("b")).withColumn("n", F.size("b"))
    rows = rows.where(F.col("n").between(least, most))

    def dice(t: Template, low: int, high: int) -> Column:
        size = len(t.bigrams)
        common = F.size(F.array_intersect(F.col("b"), F.array(*map(F.lit, sorted(t.bigrams)))))
        return F.when(F.col("n").between(low, high), 2.0 * common / (F.col("n") + size))

    scores = [F.struct(dice(*k).alias("dice"), F.lit(-i).alias("order"), F.lit(k[0].licence).alias("licence"), F.lit(k[0].form).alias("form")) for i, k in enumerate(known)]
    if not scores:
        return rows.select("doc_id", "unit", "number", F.lit("").alias("licence"), F.lit("").alias("form"), F.lit(0.0).alias("dice")).where(F.lit(False))
    best = F.array_max(F.array(*scores))
    return rows.select("doc_id", "unit", "number", best.alias("t")).where(F.col("t.dice") >= threshold - 1e-12).select("doc_id", "unit", "number", "t.licence", "t.form", "t.dice")
