import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracewarden.llm import line_dedup as L


def brute(rows, threshold=0.8):
    """(doc_id, text) -> numbers of removed lines; rows with equal id and text are one document."""
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    docs = sorted({(d is None, d or 0, signed(t), d, t or "") for d, t in rows}, key=lambda r: r[:3])
    seen, out = [], {}
    for _, _, _, d, t in docs:
        for k, line in enumerate(t.split("\n")):
            s = set(line.encode().split())
            if not s:
                continue
            if any(len(s & x) >= threshold * len(s | x) - 1e-9 for x in seen):
                out.setdefault((d, t), []).append(k)
            seen.append(s)
    return out


def found(docs):
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    text = {(r["doc_id"], signed(r["text"])): r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    return {(r["doc_id"], text[r["doc_id"], r["th"]]): list(r["lines"]) for r in L.removals(docs).collect()}


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k] = rng.choice(["", f"n{rng.randrange(50)}", out[k] + " extra"])
    return " ".join(out)


@pytest.mark.parametrize("seed,long_run", [(1, 512), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, long_run):
    monkeypatch.setattr(L, "LONG_RUN", long_run)
    monkeypatch.setattr(L, "BLOCK", 8)  # groups are cut into blocks
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    rows = [(rng.randrange(40), "\n".join(mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(4)
    assert found(docs) == brute(rows)


def test_awkward_rows(awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = brute(rows)
    assert found(awkward) == want
    kept = L.dedup(awkward)
    assert kept.columns == awkward.columns
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    left = []
    for d, t in rows:
        gone = want.get((d, t or ""), [])
        text = t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or text.split():
            left.append((d, text, None if text is None else len(text)))
    assert sorted(out, key=str) == sorted(left, key=str)
    assert L.dedup(no_docs).count() == 0


def test_two_words_of_a_pair_settle_the_border(spark):
    # 4 of 5 words is similarity 0.8 exactly; 3 of 4 is less
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e"), (3, "k l m"), (4, "k l m n"), (5, "n m l k")], "doc_id long, text string")
    assert found(docs) == {(2, "a b c d e"): [0], (5, "n m l k"): [0]}


def line_batch(docs, lines):
    texts = ["\n".join(" ".join(f"{w}{d}x{k}" for w in "abcdef") for k in range(lines)) for d in range(docs)]
    return pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array(range(docs)), pa.array(texts)], ["doc_id", "th", "text"])


def test_line_rows_hold_little_beside_their_batch():
    # with steps of 1 MB, and a set of all ids sent, 2.7 MB of text took some 60 MB
    batch, place = line_batch(600, 80), L.rarity(np.zeros(L.BUCKETS, np.int64))
    rows = L._line_rows(place, 0.8)
    next(rows(iter([line_batch(1, 1)])))
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in rows(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 600 * 80
    assert peak < 20 << 20


def test_sets_that_were_sent_are_remembered_or_sent_again():
    sent = L.no_sets(4)
    ids = np.array([0, 5, 0, 1, 7], np.uint64)  # 5 and 1 share a place
    assert L.unsent(sent, ids).tolist() == [True, True, False, True, True]
    assert L.unsent(sent, np.array([0, 7], np.uint64)).tolist() == [False, False]
    again = L.unsent(sent, np.array([1, 5], np.uint64))
    assert again.any()  # whichever lost the place


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 17])
def test_scan_steps_find_the_same(monkeypatch, step):
    monkeypatch.setattr(L, "LONG_RUN", 6)
    monkeypatch.setattr(L, "SCAN_ROWS", step)
    rng = np.random.default_rng(4)
    word = np.sort(np.append(rng.integers(0, 60, 150), [7] * 40))
    ident = np.arange(len(word)) // 2 * 2  # some sets come twice
    mask, meta = rng.integers(0, 4, len(word)), (rng.integers(4, 9, len(word)) << 32) + rng.integers(0, 2, len(word))
    new = np.append(True, (word[1:] != word[:-1]) | (ident[1:] != ident[:-1]))
    want = set(zip(*(x.tolist() for x in L._paired(word[new], ident[new], mask[new], meta[new], 0.8))))
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (word, ident, mask, meta)], ["word", "id", "mask", "meta"])
    found = [b for b in L._scan(0.8)(iter([rows.slice(k, 5) for k in range(0, len(word), 5)]))]
    assert {(i, w) for b in found for i, w in zip(b.column("id").to_pylist(), b.column("word").to_pylist())} == {(i, w) for i, w in want}
