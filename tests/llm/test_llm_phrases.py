import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        words = [w for w in re.split("[\x20\x09]+", piece) if w]
        if words:
            yield words


def brute(rows, least, top=P.TOP, cover=P.COVER):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    cands = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, p), f in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * f >= cover * count[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = {}
    for (lang, p), a in cands.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def ours(spark, rows, **more):
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for name in ("n", "phrase", "c", "h", "a", "l", "r", "score", "rank", "total"):
        df = df.withColumn(name, df["doc_id"])
    return sorted(tuple(r) for r in P.collocations(df, **more).collect())


def corpus(seed, docs=60, vocabulary=9):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "ß", "Ab", "aB"]
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " \r\n", ";"]
    return [("".join(str(rng.choice(words)) + str(rng.choice(seps)) for _ in range(int(rng.integers(0, 60)))), [None, "en", "und", "de"][int(rng.integers(0, 4))]) for _ in range(docs)]


texts = st.lists(st.text(st.sampled_from("abAB é\t.,\n"), max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 64))
def test_counter_counts_every_phrase(rows, chunk):
    data = b"".join(t.encode() for t in rows)
    off = np.cumsum([0, *(len(t.encode()) for t in rows)])
    got = Counter()
    full = np.full(1, ~np.uint64(0))
    keep, P.CHUNK = P.CHUNK, chunk
    try:
        for part, cut, own in P._cut(np.frombuffer(data, np.uint8), off, np.arange(len(rows))):
            found = P._Counter(part, cut, np.zeros(len(own), np.uint64))
            words = found.words()
            for n, at, count, _ in found.levels([full]):
                for p, c in zip(found.phrases(n, at, words).to_pylist(), count.tolist()):
                    assert len(p.split(" ")) == n
                    got[p] += c
    finally:
        P.CHUNK = keep
    want = Counter(" ".join(w[i : i + n]) for t in rows for w in pieces(t) for n in range(1, 6) for i in range(len(w) - n + 1))
    assert got == want


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 8), (3, 30)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(seed)
    rows += [(None, "en"), ("", None), ("...", "de"), (rows[3][0], rows[3][1]), ("zz yy " * 400, "en")]
    assert ours(spark, rows, least=least) == brute(rows, least)


def test_a_sample_that_misses_everything(spark, monkeypatch):
    """Border failures alone must find all phrases, whatever the sample proposed."""
    monkeypatch.setattr(P, "SAMPLE", 1 << 40)
    rows = corpus(5)
    assert ours(spark, rows, least=5) == brute(rows, 5)


def test_a_crowded_table(spark, monkeypatch):
    """Chance hits of a table that is far too small change no result."""
    monkeypatch.setattr(P, "LEAST_BITS", 64)
    monkeypatch.setattr(P, "MOST_BITS", 64)
    monkeypatch.setattr(P, "SAMPLE", 40)
    rows = corpus(6, 80, 30)
    assert ours(spark, rows, least=4) == brute(rows, 4)


def test_top_and_cover(spark):
    rows = corpus(7)
    assert ours(spark, rows, least=3, top=5, cover=60) == brute(rows, 3, 5, 60)


def test_empty(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, None), ("", "en")], least=1) == []


def test_wide_products(spark):
    from pyspark.sql import functions as F

    big = 10**12
    row = spark.createDataFrame([(big, 10**14, big, big + 1)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = row.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)"), wide("l") * wide("r"))).first()[0]
    assert got == 1000 * big * 10**14 // (big * (big + 1))


def test_equal_hashes_of_words(monkeypatch):
    monkeypatch.setattr(P, "span_hashes", lambda data, s, e: np.ones(len(s), np.uint64))
    data = np.frombuffer(b"a b a c", np.uint8)
    found = P._Counter(data, np.array([0, 7]), np.zeros(1, np.uint64))
    words = found.words().to_pylist()
    assert sorted(words) == ["a", "b", "c"] and [words[i] for i in found.word] == ["a", "b", "a", "c"]
    assert isinstance(found.words(), pa.Array)
