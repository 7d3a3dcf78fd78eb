import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import neighbours, vectors

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    v = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.99, 0.05, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [NAN, 1.0, 0.0]), (8, [INF, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 2.0, 0.0]), (50, [3.0, 0.0, 0.0]), (100, None)]
    return spark.createDataFrame([(i, x, 0, 7, 0.1) for i, x in v], "vec_id long, embedding array<float>, label int, cell int, score double")


def groups(n=900, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    for k in range(0, n // 2, 30):
        m[k : k + 25] = m[k] + rng.normal(size=(25, dim)) * 0.08
    m[n - 40 :] = m[0]
    return m


def test_links_against_brute_force(spark):
    m = groups()
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = np.arange(len(m))
    for _ in range(50):
        comp = np.array([min(comp[k], comp[linked[k]].min(initial=comp[k])) for k in range(len(m))])
    for cells in (5, 60):
        got = sorted(vectors.near_duplicates(df, per_cell=900 // cells).collect())
        assert [r.n_links for r in got] == linked.sum(axis=1).tolist() and [r.component_id for r in got] == comp.tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_odd_rows(odd):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op5_embedding_dups(odd).collect()}
    assert got[1] == (3, 1, True) and got[2] == got[3] == got[50] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 100))
    assert vectors.op5_embedding_dups(odd.limit(0)).count() == 0


def test_search_odd_rows(odd):
    got = [tuple(r) for r in neighbours.op8_neighbours(odd).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 10)] and got[0][3] == 1.0
    twice = odd.where("vec_id = 50").union(odd.where("vec_id in (50, 10)")).union(odd.where("vec_id = 2").selectExpr("cast(null as long)", "embedding", "label", "cell", "score"))
    assert sorted([(q, r, v or 0) for q, r, v, _ in neighbours.op8_neighbours(twice).collect()]) == sorted([(50, 1, 50), (50, 2, 0), (50, 3, 10)] * 2)
    assert math.isclose(got[3][3], 0.0, abs_tol=1e-12)
    assert neighbours.op8_neighbours(odd.limit(0)).count() == 0


def test_other_lengths_and_extreme_norms(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-310, 1e-310]), (3, [1.0, 1.0]), (4, [1.0, 1.0, 1e-3]), (5, [2.0, 2.0, 0.0]), (50, [3.0, 3.1]), (100, [1.0, 1.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.op5_embedding_dups(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 50: (3, 1), 4: (2, 4), 5: (2, 4), 100: (2, 4), 6: (0, 6)}
    near = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.op8_neighbours(df).collect()}
    assert {near[50, k] for k in (1, 2, 3)} == {1, 2, 3} and near[100, 1] == 5 and near[100, 2] == 4 and len(near) == 5


def test_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "STRIP", 16)
    m = groups(1500, 8, seed=4)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    for per_cell in (400, 5000):
        got = sorted(vectors.near_duplicates(df, per_cell=per_cell).collect())
        assert [r.n_links for r in got] == linked.sum(axis=1).tolist()


def test_parts_in_many_blocks_and_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(6)
    m = np.repeat(rng.normal(size=(40, 12)), 75, axis=0) + rng.normal(size=(3000, 12)) * 0.2
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    router, probes = neighbours.fit_index(u, 100_000, 0.95)
    assert router.shape[1] == 64 and probes <= 6  # clustered vectors need few of the parts
    hits = 0
    for r in neighbours.op8_neighbours(df).collect():
        s = u @ u[r.query_id]
        s[r.query_id] = -9
        hits += r.vec_id in np.argsort(-s, kind="stable")[:5]
    assert hits >= 0.9 * 300


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5000, 64))
    m[200:260] = m[100]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    found = {}
    for r in neighbours.op8_neighbours(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, rows in found.items():
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & {v for _, v, _ in rows})
        assert all(abs(s[v] - x) < 1e-12 for _, v, x in rows)
    assert len(found) == 100 and hits / 500 >= 0.9
    assert [v for _, v, _ in sorted(found[100])] == [200, 201, 202, 203, 204]


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    u = vectors.unit(rng.normal(size=(1024, 8)))
    label = neighbours.balanced_parts(neighbours.neighbour_graph(u), 8)
    assert set(np.bincount(label)) == {128}
