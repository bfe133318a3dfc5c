import itertools

import numpy as np
import pytest

from mentionflow.operators import metrics
from mentionflow.operators.ceaf import best_assignment


def table(spark, true, pred):
    t = {m: i for i, g in enumerate(true) for m in g}
    p = {m: i for i, g in enumerate(pred) for m in g}
    return spark.createDataFrame([(t[m], p[m]) for m in t], "true_id long, pred_id long")


@pytest.mark.parametrize(("true", "pred", "p", "r"), [(["ABCD"], ["AB", "CD"], 1, 2 / 3), (["AB", "CD"], ["ABCD"], 2 / 3, 1), (["ABCD"], ["ABCD"], 1, 1), (["ABC"], ["AC", "B"], 1, 1 / 2)])
def test_muc_goldens(spark, true, pred, p, r):
    got = metrics.muc(table(spark, true, pred)).first()
    assert got["precision"] == pytest.approx(p, abs=1e-5)
    assert got["recall"] == pytest.approx(r, abs=1e-5)


TRUE = ["12345", "67", "89abc"]
CASES = [(["12345", "6789abc"], 0.865, 0.733), (["1234589abc", "67"], 0.737, 0.667), (["123456789abc"], 0.545, 0.294)]


@pytest.mark.parametrize(("pred", "b3", "ceaf"), CASES)
def test_b_cubed_and_ceaf_goldens(spark, pred, b3, ceaf):
    assert metrics.b_cubed(table(spark, TRUE, pred)).first()["f1"] == pytest.approx(b3, abs=1e-3)
    score = np.array([[2 * len(set(a) & set(b)) / (len(a) + len(b)) for b in pred] for a in TRUE])
    best = best_assignment(score)
    p, r = best / len(pred), best / len(TRUE)
    assert 2 * p * r / (p + r) == pytest.approx(ceaf, abs=1e-3)


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(1, 6, 2)
        s = rng.random((a, b))
        small, large = (s, b) if a <= b else (s.T, a)
        best = max(sum(small[i, c] for i, c in enumerate(cols)) for cols in itertools.permutations(range(large), len(small)))
        assert best_assignment(s) == pytest.approx(best)


def test_empty(spark):
    none = spark.createDataFrame([], "true_id long, pred_id long")
    assert metrics.muc(none).first()["f1"] == 0
