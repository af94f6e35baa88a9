import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tracewarden.llm import winnowing as W


def brute(text, k, window):
    words = re.findall(rf"[^\x20\x09-\x0d]{{1,{W.PIECE}}}", text or "")
    if not words:
        return []
    grams = []
    for i in range(max(1, len(words) - k + 1)):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        signed = h - (1 << 64) if h >> 63 else h
        grams.append(signed >> W.PLACE_BITS)
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        best = max(j for j, g in enumerate(part) if g == min(part))
        if (i + best, part[best]) not in out:
            out.append((i + best, part[best]))
    return out


@pytest.mark.parametrize("k,window", [(5, 8), (1, 1), (2, 3)])
def test_marks(awkward, k, window):
    rows = awkward.select("text", W.marks(F.coalesce("text", F.lit("")), k, window).alias("m")).select("text", W.positions(F.col("m")).alias("at"), F.transform("m", lambda x: F.shiftright(x, W.PLACE_BITS)).alias("h"))
    for r in rows.where("text is null or length(text) < 50000").collect():
        assert list(zip(r["at"], r["h"])) == brute(r["text"], k, window)


def test_rightmost_of_equal_hashes(spark):
    got = spark.range(1).select(W.positions(W.marks(F.lit("a a a a a a"), 1, 3)).alias("p")).first()["p"]
    assert got == [2, 3, 4, 5]


def test_shared_passage_shares_a_mark(spark):
    passage = " ".join(f"p{i}" for i in range(W.K + W.WINDOW - 1))
    a, b = (f"{x} {passage} {y}" for x, y in (("u v w", "k l"), ("s t " * 20, "m " * 30)))
    r = spark.range(1).select(*(W.hashes(W.marks(F.lit(t))).alias(n) for t, n in ((a, "a"), (b, "b")))).first()
    assert set(r["a"]) & set(r["b"])


def test_next_and_edited(awkward, no_docs, spark):
    rows = W.compared(awkward).collect()
    assert len(rows) == awkward.count()
    ids = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    once = sorted({d for d, _ in ids if d is not None}, reverse=True)
    assert sum(r["doc_id"] is None for r in rows) == 2
    by = {r["doc_id"]: r for r in rows}
    text = dict(ids)
    for d, following in zip(once, once[1:]):
        if d != 2:  # a repeated row follows itself
            half = len(text[d]) // 2
            assert by[d]["edited"] == text[d][: len(text[d]) - half] + text[following][:half]
    assert W.compared(no_docs).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert W.compared(one).first()["edited"] == "abab"


def test_query_over_given_tables(spark):
    from tracewarden.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op3_winnowing"](spark, folder).collect()
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: -r["doc_id"])
    text = {d["doc_id"]: d["text"] for d in docs}
    follows = {d["doc_id"]: docs[(k + 1) % len(docs)]["text"] for k, d in enumerate(docs)}
    import hashlib

    seen = {}
    for r in rows:
        t = text[r["doc_id"]]
        half = len(t) // 2
        e = t[: len(t) - half] + follows[r["doc_id"]][:half]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert seen.setdefault(e, r["edited_fingerprint"]) == r["edited_fingerprint"]
        a, b = ({h for _, h in brute(x, W.K, W.WINDOW)} for x in (t, e))
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
    long = [r for r in rows if r["n_chars"] > 500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) / len(long) > 0.95
