from collections import Counter
from math import log, sqrt

import pytest

from mentionflow.operators import text

ROWS = [(1, "The cat the dog"), (2, None), (3, "!"), (4, "dog É é cow_1 x"), (1, "cat ünï"), (None, "cat lost"), (5, "cow_1 " * 3000), *((i, f"w{i % 40} w{i % 7} dog") for i in range(10, 2000))]


def weights():
    """Of ROWS, in plain Python."""
    words = [[w for w in (t or "").lower().replace("!", "").split() if len(w) > 1] for _, t in ROWS]
    df = Counter(w for t in words for w in set(t))
    many = Counter(w for t in words for w in t)
    idf = {w: log((1 + len(ROWS)) / (1 + df[w])) + 1 for w in sorted(many, key=lambda w: (-many[w], w))[:30]}
    counts: dict = {}
    for (k, _), t in zip(ROWS, words, strict=True):
        if k is not None:
            counts.setdefault(k, Counter()).update(w for w in t if w in idf)
    return {(k, w): n * idf[w] / sqrt(sum((m * idf[x]) ** 2 for x, m in c.items())) for k, c in counts.items() for w, n in c.items()}


@pytest.mark.parametrize("terms", [100_000, 3])
def test_weights_of_repeated_and_missing_keys(spark, monkeypatch, terms):
    monkeypatch.setattr(text, "TERMS", terms)
    df = spark.createDataFrame(ROWS, "doc long, text string").repartition(3)
    got = {(r["doc"], r["term"]): r["w"] for r in text.tfidf_weights(df, "doc", "text", text.fit_idf(df, "text", 30)).collect()}
    assert got == pytest.approx(weights())


def test_texts_are_weighed_where_they_are(spark):
    df = spark.createDataFrame([(k, t) for k, t in ROWS if k not in (1, None)], "doc long, text string")
    got = text.tfidf_weights(df, "doc", "text", text.fit_idf(df, "text", 30))
    assert got.count() > 4000 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert text.tfidf_weights(df.limit(0), "doc", "text", text.fit_idf(df.limit(0), "text")).count() == 0
