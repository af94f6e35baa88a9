import pytest

from tracewarden.llm import license_scan as S
from tracewarden.llm.licence_texts import TEXTS


def grams(text):
    w = S.normalised(text).split(" ")
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(text, threshold):
    import re

    lines, gaps = text.split("\n"), re.split(r"\n\s*\n", text)
    units = [("line", k, x) for k, x in enumerate(lines)] + [("block", k, x) for k, x in enumerate(gaps) if len(gaps) > 1] + ([("text", 0, text)] if len(lines) > 1 else [])
    out = []
    for unit, k, body in units:
        g = grams(body)
        scores = [(2 * len(g & grams(t.text)) / (len(g) + len(grams(t.text))), -i, t) for i, t in enumerate(sorted(TEXTS, key=lambda t: (t.licence, t.form))) if g]
        if scores and (best := max(scores, key=lambda s: s[:2]))[0] >= threshold - 1e-12:
            out.append((unit, k, best[2].licence, best[2].form, round(best[0], 9)))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_against_brute_force(spark, awkward, no_docs, threshold):
    mit, isc = (next(t.text for t in TEXTS if t.licence == x) for x in ("MIT", "ISC"))
    texts = {1: mit, 2: "Copyright 2020 Someone\n\n" + mit.upper() + "\n\n\n" + isc, 3: "prose\nLicensed under CC  BY-NC 4.0!\nreleased under the mit license", 4: mit.replace("sublicense", "sell").replace("\n", " "), 5: "", 6: mit[: len(mit) // 2], 7: mit[: len(mit) // 3], 8: "MIT", 9: "License"}
    docs = spark.createDataFrame([*texts.items(), (10, None), (None, mit), (1, mit)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["unit"], r["number"], r["licence"], r["form"], round(r["dice"], 9)) for r in S.scan(docs, TEXTS, threshold).collect())
    want = [(str(d), *x) for d, t in [*texts.items(), (None, mit), (1, mit)] for x in brute(t, threshold)]
    assert got == sorted(want)
    assert S.scan(awkward, TEXTS, threshold).count() == 0 == S.scan(no_docs, TEXTS, threshold).count()
    assert S.scan(docs, [], threshold).count() == 0


def test_bounds_hold():
    for size in range(1, 60):
        low, high = S.bounds(size, 0.8)
        for n in range(1, 120):
            assert (low <= n <= high) == (2 * min(n, size) / (n + size) >= 0.8 - 1e-12)
