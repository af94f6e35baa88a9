import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import secret_labels as L
from tracewarden.llm import secret_scan as S


@pytest.fixture(scope="module")
def findings(spark):
    return L.labelled_findings(spark, 3000)


@pytest.fixture(scope="module")
def net(findings):
    return S.train(findings)


def brute(text):
    """The contract's patterns, tried at every place in turn."""
    assign = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for kind, pattern, ok in (
        (0, assign, lambda m: len(m.group(1)) >= 6 and m.group().split(m.group(1))[0].isascii()),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    ):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m:
                out += [(m.start(), kind, m.end())] if ok(m) else []
            at = m.end() if m else at + 1
    return sorted(out)


piece = st.sampled_from(["password", "PassWd", "Secret", "TOKEN", "api_key", "apikey", "API_Key", "=", ":", " ", '"', "'", "abc", "x1", "=abc.def-12", "AKIA", "A" * 16, "0123456789abcdef", "deadbeef0", "\n", "é", "世", "zz_9"])


@settings(max_examples=500, deadline=None)
@given(st.lists(piece, max_size=14).map("".join))
def test_base_spans(text):
    assert S.base_spans(text) == brute(text)


def test_other_letters_are_no_keywords():
    assert S.base_spans("to\u212aen=abcdef pa\u017f\u017fword=abcdef") == []
    assert S.base_spans("😀 toKen = 'abcdef'") == [(2, 0, 17)]


def test_gradients():
    rng = np.random.default_rng(0)
    windows = [S.window(f"see {'ab1' * k} and {'x' * k}", 4, 4 + 3 * k) for k in (2, 5, 9)]
    y = np.array([1, 0, 1], np.float32)
    w = {k: a.astype(np.float64) for k, a in S._start(rng).items()}
    loss = lambda: np.mean(np.logaddexp(0, -(2 * y - 1) * S.raw_scores(windows, w)))
    g = S._gradients(windows, y, w)
    for name in w:
        for _ in range(12):
            i = tuple(int(rng.integers(n)) for n in w[name].shape)
            old, h = w[name][i], 1e-6
            w[name][i] = old + h
            up = loss()
            w[name][i] = old - h
            down = loss()
            w[name][i] = old
            assert abs((up - down) / (2 * h) - g[name][i]) < 2e-4, name


def test_long_candidates_are_read_whole(monkeypatch):
    w = S._start(np.random.default_rng(3))
    rng = np.random.default_rng(4)
    texts = ["key " + "".join(rng.choice(list("abcXYZ019"), n)) + " end" for n in (700, 90, 3000, 40)]
    windows = [S.window(t, 4, len(t) - 4) for t in texts]
    whole = S.raw_scores(windows, w)
    monkeypatch.setattr(S, "POSITIONS", 128)
    assert np.allclose(S.raw_scores(windows, w), whole, atol=1e-4)


def test_held_out_findings(findings, net):
    """Recall and false alarms on labelled findings that neither fit nor calibration has seen."""
    rest = [r for r in S.split(findings) if r[4] >= 8]
    p = S.calibrated(S.raw_scores([S.window(*r[:3]) for r in rest], net.weights), net)
    hit = np.array([v >= net.thresholds[S.shape(r[0][r[1] : r[2]])] for v, r in zip(p, rest)])
    secret = np.array([r[3] for r in rest])
    assert hit[secret].mean() >= 0.85 and hit[~secret].mean() <= 0.03


def test_thresholds_keep_recall():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 500)
    p, shapes = rng.random(500), rng.integers(0, 3, 500)
    for k, t in enumerate(S.thresholds(p, y, shapes, 0.9)):
        own = p[(y > 0) & (shapes == k)]
        assert (own >= t).mean() >= 0.9 and (own > t).mean() < 0.9


def test_scan(spark, awkward, no_docs, net):
    key = "ghp_9fQ2xLr7ZtB4kW1mVn8sYc3HdP6uJe5A0gTq"
    more = spark.createDataFrame([(50, f"the access key {key}. and more"), (51, f"token = {key}"), (52, "plain words and www.example.com/page_12/index.html")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in S.scan(more, net).collect()}
    assert got[50] == [("net", 15, 15 + len(key))]
    assert got[51] == [("assign", 0, 8 + len(key))] and got[52] == []
    rows = S.scan(awkward, net).collect()
    assert len(rows) == awkward.count() and all(r["spans"] is not None for r in rows)
    assert S.scan(no_docs, net).count() == 0


def test_without_labels(spark, awkward):
    none = spark.createDataFrame([("some text", 0, 4, True), (None, 0, 1, False), ("x", 3, 9, False)], "text string, start int, end int, secret boolean")
    assert S.train(none) is None
    assert S.scan(awkward, None).count() == awkward.count()


def test_query_against_brute_force(spark):
    from tracewarden.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_secret_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("net")]
        assert kept == [f"{S.KINDS[k]}:{s}:{e}" for s, k, e in want]
