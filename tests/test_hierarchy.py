import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionflow.operators import hierarchy, metrics


def grown(seed, n, **options):
    tree = hierarchy.Hierarchy(**options)
    for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, 3))):
        tree.insert(i, v)
        assert options.get("limit") is None or len(tree.active) <= options["limit"]
    return tree


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from(hierarchy.SIMS), st.sampled_from([None, 3, 6]), st.sampled_from(["similarity", "least_recent"]))
def test_tree_is_whole(seed, sim, limit, pruning):
    tree = grown(seed, 25, sim=sim, limit=limit, pruning=pruning)
    alive = [k for k, p in enumerate(tree.parents) if p != -2]
    assert sum(tree.parents[k] == -1 for k in alive) == 1
    assert sorted(tree.seqs[k] for k in alive if tree.seqs[k] is not None) == list(range(25))
    assert {len(tree.children[k]) for k in alive if tree.seqs[k] is None} == {2}
    for k in alive:
        assert all(tree.parents[c] == k for c in tree.children[k])
        if tree.children[k] and k not in tree.active and all(tree.parents[u] == -1 or u not in tree.active for u in tree.upward(k)):
            assert tree.counts[k] == sum(tree.counts[c] for c in tree.children[k])


@pytest.mark.parametrize("pruning", ["similarity", "least_recent"])
def test_only_the_searched_part_keeps_sums(pruning):
    tree = grown(4, 600, limit=8, pruning=pruning)
    assert sum(s is not None for s in tree.sums) < 2 * 8  # the active nodes and those over them
    above = {u for k in tree.active for u in tree.upward(k)} - set(tree.active)
    for k in above:
        a, b = tree.children[k]
        assert np.array_equal(tree.total(k), tree.total(a) + tree.total(b)) and tree.linkage(k) == tree.centroid(a) @ tree.centroid(b)
    assert sorted(tree.foldable) == sorted(p for p in above if all(c in tree.active for c in tree.children[p]))
    assert tree.ids == sorted(tree.active) and np.array_equal(tree.matrix[: len(tree.ids)], np.stack([tree.active[k] for k in tree.ids]))
    table = tree.table(None)
    below = {k: [u for u in tree.upward(k)] for k in table[table["seq"].notna()]["node"]}
    assert dict(zip(table["node"], table["n_leaves"], strict=True)) == {k: sum(k in up for up in below.values()) for k in table["node"]}


def test_clusters_grow_with_the_threshold(spark):
    x = np.random.default_rng(5).normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, embedding array<double>")
    table = hierarchy.build(df).cache()
    sizes = []
    for t in (-2.0, 0.0, 0.6, 2.0):
        got = hierarchy.flat(table, t).collect()
        assert sorted(r["seq"] for r in got) == list(range(30))
        sizes.append(len({r["cluster_id"] for r in got}))
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] == 30


def test_wrong_options():
    with pytest.raises(ValueError, match="pruning_threshold"):
        hierarchy.Hierarchy(pruning="combined")


@pytest.mark.parametrize(("pred", "f1"), [(["12345", "6789abc"], 0.733), (["1234589abc", "67"], 0.667), (["123456789abc"], 0.294)])
def test_ceaf_goldens(spark, pred, f1):
    t = {m: i for i, g in enumerate(["12345", "67", "89abc"]) for m in g}
    p = {m: i for i, g in enumerate(pred) for m in g}
    df = spark.createDataFrame([(t[m], p[m]) for m in t], "true_id long, pred_id long")
    got = metrics.ceaf_e(df).first()
    swapped = metrics.ceaf_e(df, compat=True).first()
    assert got["f1"] == pytest.approx(f1, abs=1e-3)
    assert (got["precision"], got["recall"]) == (swapped["recall"], swapped["precision"])
    assert metrics.coref_scores(df).first()["ceaf_e_f1"] == got["f1"]


def test_components_are_assigned_apart(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 7), (6, 7), (9, 9)], "true_id long, pred_id long")
    got = {(r["true_id"], r["pred_id"]): r["component"] for r in metrics.overlap_components(metrics.contingency(df)).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (5, 7): 5, (6, 7): 5, (9, 9): 9}
    assert metrics.ceaf_e(df.limit(0)).first()["f1"] == 0
