"""Token counts of the text model against plain Python."""

from collections import Counter

import pytest

from tracewarden.operators import bayes

TEXTS = ["Select * FROM  union ", "", None, "abc", "AB", "日本語 😀😀x", "<script>alert(1)</script> ../etc/", "a\x00b\x00a", "  padded text  "]
ROWS = [(None if k % 5 == 0 else k % 7, t, ["attack", "normal", None][k % 3]) for k, t in enumerate(TEXTS * 4)]
MARKS = {"select": "__sql_keyword__", "<script>": "__xss_pattern__", "../": "__path_trav__"}


def tokens(text):
    t = (text or "").strip(" ").lower()
    if len(t) < 4:
        return [t] if t else []
    return [t[i : i + k] for k in (2, 3) for i in range(len(t) - k + 1)] + [m for p, m in MARKS.items() if p in t]


@pytest.mark.parametrize("step", [10, 200, 1 << 20])
def test_counts_are_those_of_plain_python(spark, monkeypatch, step):
    monkeypatch.setattr(bayes, "STEP", step)
    df = spark.createDataFrame(ROWS, "id long, text string, label string")
    by_id, by_class = Counter(), Counter()
    for i, t, c in ROWS:
        by_id.update((i, x) for x in tokens(t))
        by_class.update((c, x) for x in tokens(t))
    got = [tuple(r) for r in bayes.token_counts(df, ["id"], "text").collect()]
    assert len(got) == len(by_id) and {(i, x): n for i, x, n in got} == dict(by_id)
    assert {(c, x): n for c, x, n in map(tuple, bayes.train(df, "text", "label")[1].collect())} == dict(by_class)


def test_scores_do_not_depend_on_how_the_model_is_joined(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "id long, text string, label string")
    model = bayes.train(df, "text", "label")
    score = lambda: sorted(map(str, bayes.score(df, ["id"], "text", *model).collect()))
    want = score()
    monkeypatch.setattr(bayes, "BROADCAST", 5)
    assert score() == want


def test_a_token_of_every_text_meets_the_model_without_a_shuffle_by_token(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, label string")
    plan = bayes.score(df, ["id"], "text", *bayes.train(df, "text", "label"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
