from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionflow.operators import sampling, training
from mentionflow.plans import catalogue


def window(left, mention, right, size):
    """Tokens around a mention, room that one side does not need going to the other."""
    room = size - len(mention) - 2
    a = b = room // 2
    if len(left) < a:
        b, a = b + a - len(left), len(left)
    if len(right) < b:
        a, b = a + b - len(right), len(right)
    return left[max(0, len(left) - a) :] if a else [], right[:b]


@pytest.mark.parametrize("size", [8, 11, 16, 40])
def test_encoded(spark, size):
    rng = np.random.default_rng(size)
    rows = [(" ".join("abc"[: rng.integers(0, 4)]) or None, "m n", " ".join("uvwxyz"[: rng.integers(0, 7)])) for _ in range(20)] + [(" ".join(map(str, range(50))), "m", " ".join(map(str, range(50))))]
    df = spark.createDataFrame(rows, "left_context string, mention string, right_context string")
    for r in training.encoded(df, size).collect():
        l, m, t = ((r[c] or "").split() for c in ("left_context", "mention", "right_context"))
        marked = ["[E_START]", *m, "[E_END]"]
        a, b = window(l, marked, t, size)
        want = ["[CLS]", *a, *marked, *b, "[SEP]"]
        assert r["tokens"] == (want + ["[PAD]"] * (size - len(want)))[:max(size, len(want))]
        assert r["attention"] == [int(x != "[PAD]") for x in r["tokens"]]
        assert [x for x, k in zip(r["tokens"], r["mask"], strict=True) if k] == marked
    for r in training.plain_window(df, size).collect():
        assert len(r["tokens"]) <= size and [x for x, k in zip(r["tokens"], r["mask"], strict=True) if k] == r["mention"].split()
    for r in training.quota_window(df, size).collect():
        assert len(r["tokens"]) == size


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, -1e32],), ([500.0, 1.0],), ([0.0],)], "s array<double>")
    got = [tuple(r) for r in df.select(training.nll(F.col("s")), training.first_wins(F.col("s"))).collect()]
    assert [g[1] for g in got] == [False, True, True]
    assert [g[0] for g in got] == pytest.approx([np.log(np.exp(1) + np.exp(2)) - 1, 0, 0], abs=1e-9)
    assert training.linking_report(df.limit(0), "s").first()["loss"] is None


def test_negatives(spark):
    vocab = spark.createDataFrame([(0, 0), (1, 1000), (2, 10), (3, 10), (4, 1)], "idx long, count long")
    rows = spark.createDataFrame([(i, i % 5) for i in range(400)], "seq long, idx long")
    got = training.weighted_negatives(rows, vocab, 2, block=2).collect()
    of: dict = {}
    for r in got:
        of.setdefault(r["seq"], []).append(r["negative"])
    assert len(of) == 400 and all(len(set(v)) == 2 and i % 5 not in v and 0 not in v for i, v in of.items())
    first = Counter(v[0] for i, v in of.items() if i % 5 == 0)
    assert first[1] > 60 and sorted(map(tuple, got)) == sorted(map(tuple, training.weighted_negatives(rows.repartition(3), vocab, 2, block=2).collect()))
    assert training.weighted_negatives(rows, vocab.limit(0), 2).count() == 0
    uniform = training.uniform_negatives(rows, 5, 3).collect()
    assert len(uniform) == 1200 and all(0 <= r["negative"] < 5 and (r["negative"] != r["seq"] % 5 or r["negative"] == 0) for r in uniform)


@pytest.mark.parametrize("name", ["weighted_negatives", "uniform_negatives"])
def test_every_event_draws_negatives(spark, name):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES[name](spark, sf).groupBy("seq").count().collect()
    assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count() and {r["count"] for r in got} == {8}


def test_weighted_draws_follow_the_counts():
    ids, counts, n = np.array([1, 4, 6, 9]), np.array([5, 1, 2, 40]), 40_000
    u, gold = np.random.default_rng(3).random((n, 4)), np.where(np.arange(n) % 2, 4, 7)
    found, there = training._draw_weighted(u, gold, ids, counts)
    assert (there.sum(axis=1) == np.where(gold == 4, 3, 4)).all()
    for own in (4, 7):
        drawn = Counter(tuple(ids[f[:2]]) for f in found[gold == own])
        left = {i: c for i, c in zip(ids.tolist(), counts.tolist(), strict=True) if i != own}
        total = sum(left.values())
        for a in left:
            for b in left:
                chance = 0 if a == b else left[a] / total * left[b] / (total - left[a])
                assert drawn[a, b] / (n / 2) == pytest.approx(chance, abs=0.015)


def test_weighted_negatives_of_many_entities(spark):
    vocab = spark.range(1, 200_001).select(F.col("id").alias("idx"), F.lit(1).alias("count"))
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).alias("idx"))
    got = training.weighted_negatives(rows, vocab, 3)
    assert got.filter("rank = 1").count() == 20_000 and got.select("seq", "negative").distinct().count() == 60_000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # no row meets the entities one by one


def test_training_lowers_the_loss_and_encodes(spark):
    rng = np.random.default_rng(1)
    words = {"e1": "red round ball", "e2": "blue fast car", "e3": "green tall tree"}
    rows = [(i, f"e{1 + i % 3}", " ".join(rng.permutation(words[f"e{1 + i % 3}"].split())[:2]), f"noise{i} the a", "of the") for i in range(60)]
    df = training.encoded(spark.createDataFrame(rows, "seq long, entity_id string, mention string, left_context string, right_context string"), 16)
    sets = training.token_triplets(df, sampling.triplets(df))
    weights, history = training.train_mentions(sets, sets, training.first_weights(256, 16), epochs=12)
    losses = [r["train_loss"] for r in history.orderBy("epoch").collect()]
    assert len(losses) == 12 and losses[-1] < 0.8 * losses[0]
    x = training._grad(weights, [rng.random((4, 256)) for _ in range(3)], 5.0)
    assert x[1].shape == weights.shape
    vectors = training.embed(df, training.hashed_encoder(weights), "seq").collect()
    assert len(vectors) == 60 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 for r in vectors)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    w, rows = rng.normal(size=(6, 4)), [rng.random((3, 6)) for _ in range(3)]
    loss, grad = training._grad(w, rows, 1.0)
    for i, j in ((0, 0), (2, 3), (5, 1)):
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        assert (training._grad(w + step, rows, 1.0)[0] - training._grad(w - step, rows, 1.0)[0]) / 2e-6 == pytest.approx(grad[i, j], abs=1e-5)
    assert loss > 0


def test_link_scores(spark):
    contexts = spark.createDataFrame([(0, [3.0, 4.0])], "seq long, embedding array<double>")
    entities = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [5.0, 0.0])], "idx long, embedding array<double>")
    candidates = spark.createDataFrame([(0, 1, 2), (0, 0, 1), (0, 2, 0)], "seq long, rank int, idx long")
    assert training.link_scores(contexts, entities, candidates, 2.0).first()["scores"] == pytest.approx([1.6, 1.2, -1e32])
