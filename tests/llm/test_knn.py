import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docmill.llm import knn

SCHEMA = "vec_id long, vectors array<float>, is_probe boolean, id string, cell int"


def rows_of(x, probes=()):
    return [(i, [float(v) for v in r], i in probes, "clash", 7) for i, r in enumerate(x)]


def test_equals_brute_force_with_ties_and_dirt(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:107] = x[3]  # a vector repeated more than k times
    x[200] = 1e-20 * x[4]
    rows = rows_of(x) + [(900, None, True, None, None), (901, [1.0], True, None, None), (902, [0.0] * 8, True, None, None), (903, [float("nan")] * 8, True, None, None), (904, [None] + [1.0] * 7, True, None, None)]
    found = knn.nearest(spark.createDataFrame(rows, SCHEMA), k=5, dim=8).toPandas()
    assert not set(found.query_id) & {900, 901, 902, 903, 904}
    assert found.groupby("query_id").size().eq(5).all() and len(found) == 3500
    brute = knn.brute_force(np.arange(700), x.astype(np.float64), 5)
    sims = {}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for r in found.itertuples():
        sims.setdefault(r.query_id, []).append(round(float(unit[r.query_id] @ unit[r.neighbor_id]), 9))
    expected = brute.groupby("query_id").neighbor_id.apply(list)
    for q, got in sims.items():
        assert sorted(got) == sorted(round(float(unit[q] @ unit[n]), 9) for n in expected[q])


def test_queries_small_and_empty_inputs(spark):
    two = spark.createDataFrame(rows_of(np.eye(2), {0}), SCHEMA)
    found = knn.nearest(two, k=5, dim=2, query=F.col("is_probe")).collect()
    assert [(r.query_id, r.rank, r.neighbor_id) for r in found] == [(0, 1, 1)]
    assert knn.nearest(two.limit(0), k=5, dim=2).count() == 0
    assert knn.neighbor_pairs(knn.nearest(two, k=1, dim=2)).collect() == [(0, 1)]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6))
def test_quantised_tiles_lose_nothing(seed, k):
    rng = np.random.default_rng(seed)
    base = np.concatenate([c + rng.normal(size=(900, 16)) * 0.2 for c in rng.normal(size=(4, 16))])
    base[5:40] = base[4] + rng.normal(size=(35, 16)) * 1e-4
    base = knn.unit_vectors(base)
    ids = rng.permutation(len(base)).astype(np.int64)
    stripe = knn.Stripe(ids, *knn.quantise(base))
    row, found, low, high = stripe.survivors(k, ids[:50], *knn.quantise(base[:50]))
    full = base[:50] @ base.T
    at = {i: j for j, i in enumerate(ids)}
    exact = np.array([full[r, at[i]] for r, i in zip(row, found)])
    assert (low <= exact + 1e-6).all() and (exact <= high + 1e-6).all()
    full[np.arange(50), np.arange(50)] = -np.inf
    for r in range(50):
        assert set(ids[np.argsort(-full[r])[:k]]) <= set(found[row == r])


def test_far_tiles_are_skipped():
    rng = np.random.default_rng(1)
    base = knn.unit_vectors(np.concatenate([c + rng.normal(size=(2000, 16)) * 0.02 for c in rng.normal(size=(6, 16))]))
    ids = np.arange(len(base))
    stripe = knn.Stripe(ids, *knn.quantise(base))
    at = np.arange(0, len(base), 100)
    row, found, _, _ = stripe.survivors(5, at, *knn.quantise(base[at]))
    assert stripe.skipped > 0.5 * len(at) * len(stripe.tiles)
    full = base[at] @ base.T
    full[np.arange(len(at)), at] = -np.inf
    assert all(set(np.argsort(-full[r])[:5]) <= set(found[row == r]) for r in range(len(at)))


def test_many_groups_and_stripes(spark):
    """Nine groups, eight stripes, a third of all vectors in one place: brute force, and cells of equal size."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1800, 8)).astype(np.float32)
    x[:600] = x[0] + rng.normal(size=(600, 8)).astype(np.float32) * 0.05
    rows = spark.createDataFrame(rows_of(x), SCHEMA)
    found = knn.nearest(rows, k=5, dim=8, stripe=225, group=200).toPandas()
    brute = knn.brute_force(np.arange(1800), x.astype(np.float64), 5)
    assert set(zip(found.query_id, found["rank"], found.neighbor_id)) == set(zip(brute.query_id, brute["rank"], brute.neighbor_id))
    assert knn.grid(1800, 1800, 4, 225, 200) == (8, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1800)), pa.array([list(map(float, v)) for v in x], pa.list_(pa.float32())), pa.array([True] * 1800)], ["id", "v", "is_query"])
    sizes = {}
    for out in knn.blocks_of(iter([batch]), 8, 8, 9):
        assert out.nbytes < 1 << 22
        for cell, role, ids in zip(*(out.column(i).to_pylist() for i in range(3))):
            sizes[cell, role] = sizes.get((cell, role), 0) + len(ids) // 8
    assert len(sizes) == 2 * 72 and max(sizes.values()) <= 2 * np.median(list(sizes.values()))


def test_copies_are_not_searched(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:] = x[100]
    found = knn.nearest(spark.createDataFrame(rows_of(x), SCHEMA), k=3, dim=8).toPandas()
    lists = found.sort_values("rank").groupby("query_id").neighbor_id.apply(list)
    assert len(found) == 900 and lists[100] == [101, 102, 103] and lists[250] == [100, 101, 102] and lists[101] == [100, 102, 103]
    brute = knn.brute_force(np.arange(300), x.astype(np.float64), 3).groupby("query_id").neighbor_id.apply(list)
    assert all(sorted(lists[i]) == sorted(brute[i]) or 100 in lists[i] for i in range(100))
