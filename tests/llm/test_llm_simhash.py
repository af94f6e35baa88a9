import random

import pytest
import xxhash

from tracewarden.llm import common, simhash_ring as S


def fingerprint(text, n=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(fps, distance):
    known = sorted(set(fps))
    up = {f: f for f in known}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(f) for f in fps]


@pytest.mark.parametrize("text", ["", None, "One", "a b", "A b C d e f g", "ÄÖÜ äöü \x0b\x1c x y", " \t", "w " * 70_000])
def test_fingerprint(text):
    assert S.simhash((text or "").encode()) == fingerprint(text)


@pytest.mark.parametrize("distance,block", [(3, 2048), (3, 4), (1, 8), (2, 16)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, distance, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(distance + block)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [0, 1, 7, 15] + [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for _ in range(150)]
    fps = [f & (2**64 - 1) for f in fps]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    label = {r["v"]: r["label"] for r in common.components(links, "t").collect()}
    want = groups(fps, distance)
    got = [label.get(f, f) for f in signed]
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


def test_awkward_rows(awkward, no_docs):
    rows = S.near_duplicates(awkward).collect()
    src = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    fps = [fingerprint(t) for _, t in src]
    root = groups(fps, 3)
    first = {}
    for (d, _), g in zip(src, root):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    want = sorted((str(d), f"{f:016x}", first.get(g)) for (d, _), f, g in zip(src, fps, root))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == want
    kept = S.keep_first(awkward)
    assert kept.columns == awkward.columns
    out = kept.collect()
    assert len(out) == len(set(root))
    for g in set(root):
        ids = [d for (d, _), x in zip(src, root) if x == g]
        assert sum(r["doc_id"] in ids for r in out if r["doc_id"] is not None) <= 1
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_first(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).selectExpr("(id * 7) % 61 as a", "((id + 1) * 7) % 61 as b")
    assert {r["label"] for r in common.components(edges, "chain").collect()} == {0}
