import numpy as np
import pytest

from portvigil.llm import permutation_index, segment_search

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[30:60] = v[0]  # copies, also of a query
    return v


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1001, []), (1002, [nan] + [1.0] * 15), (1003, [inf] + [1.0] * 15), (1004, [None] + [1.0] * 15), (None, [1.0] * 16)]


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_products_equal_brute_force(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + odd_rows() + [(2000, [0.0] * 16)]
    found = listed(segment_search.top_products(frame(spark, rows), shard_rows=100))
    whole = np.vstack([np.floor(256 * vectors.astype(float)), np.zeros((1, 16))]).astype(np.int64)
    ids = np.r_[np.arange(600), 2000]
    assert set(found) == {i for i in ids if i % 50 == 0}
    for q in found:
        products = whole @ whole[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -products)) if ids[k] != q][:5]
        assert found[q] == [(n + 1, ids[k], products[k]) for n, k in enumerate(order)]


def test_products_beyond_double_precision_are_exact():
    v = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert segment_search.inner(v, np.array([2.0**20, 1.0])).tolist() == [2**60 + 1, 2**60 + 2]


def test_neighbours_found_and_ties_by_id(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + odd_rows() + [(2000, [0.0] * 16)]
    found = listed(permutation_index.nearest(frame(spark, rows), shard_rows=150))
    assert 2000 not in found and set(found) == set(range(0, 600, 50))
    assert [x[1] for x in found[0]] == [30, 31, 32, 33, 34]
    assert [x[1] for x in found[50]] == [0, 30, 31, 32, 33]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in found:
        scores = unit @ unit[q]
        order = [k for k in np.lexsort((np.arange(600), -np.round(scores, 12))) if k != q][:5]
        hits += len({x[1] for x in found[q]} & set(order))
        for _, k, score in found[q]:
            assert score == pytest.approx(scores[k], abs=1e-12)
    assert hits >= 0.9 * 5 * len(found)


def test_few_and_no_rows(spark):
    two = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    for search in (permutation_index.nearest, segment_search.top_products):
        assert [x[1] for x in listed(search(frame(spark, two)))[0]] == [1]  # repeated once, other lengths apart
        assert search(frame(spark, [])).count() == 0


def test_huge_and_tiny_components(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, 0.0]), (3, [-1e308, 1e308]), (4, [5e-324, 0.0])]
    found = listed(permutation_index.nearest(spark.createDataFrame(rows, schema)))
    assert [x[1] for x in found[0]] == [1, 2, 4, 3] and found[0][0][2] == pytest.approx(1.0)
    products = listed(segment_search.top_products(spark.createDataFrame(rows, schema)))
    assert len(products[0]) == 4


@pytest.mark.parametrize("reverse", [False, True])
def test_every_vector_of_a_repeated_id_counts(spark, reverse):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.25]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    found = listed(segment_search.top_products(frame(spark, rows[::-1] if reverse else rows), shard_rows=2))
    # of query 0: both vectors of id 1, not the repeated row, and both of id 50
    assert [(v, s) for _, v, s in found[0]] == [(50, 65536), (1, 58880), (1, 32768), (2, 6400), (50, 0)]
    near = listed(permutation_index.nearest(frame(spark, rows[::-1] if reverse else rows), shard_rows=2))
    assert [v for _, v, _ in near[0]][:3] == [1, 2, 50] and len(near[0]) == 5


def test_recall_where_the_index_prunes(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    v = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24))).astype(np.float32)
    found = listed(permutation_index.nearest(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), least=1))  # a tenth is reranked
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in found:
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len({x[1] for x in found[q]} & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found)


def test_bounds_prune():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(3000, 32)) * np.r_[np.full(4, 3.0), np.full(28, 0.2)] @ np.linalg.qr(rng.normal(size=(32, 32)))[0])
    exact, counted = segment_search.inner, []
    try:
        segment_search.inner = lambda a, q: counted.append(len(a)) or exact(a, q)
        answer = segment_search.kernel(5, segment_search.LEVELS)(np.arange(3000), v)
        list(answer(np.arange(40), v[:40]))
    finally:
        segment_search.inner = exact
    assert sum(counted[1::2]) < 0.2 * 40 * 3000  # survivors; every other call is for the seeds
