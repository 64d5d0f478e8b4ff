import numpy as np
import pytest
from pyspark.sql import functions as F

from growthpanel.llm import neighbours, vector_dedup

ODD = "vec_id long, embedding array<float>, label int, uid string, part string, score string, `table` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "x", "x", "x") for i, v in rows], ODD)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 24)).astype(np.float32)
    x[1000:1700] = x[5] + rng.normal(scale=0.08, size=(700, 24))  # one very common vector
    x[1700:1800] = x[100:200]
    return x


def test_links_against_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 128)
    found = vector_dedup.vector_components(frame(spark, enumerate(clustered.tolist()))).toPandas().sort_values("vec_id")
    x = clustered.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    counts = np.bincount(a, minlength=len(x)) + np.bincount(b, minlength=len(x))
    assert (found.n_links.to_numpy() <= counts).all()
    assert found.n_links.sum() >= 0.99 * counts.sum() and counts.max() > 500
    label = np.arange(len(x))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    assert (found.component_id.to_numpy() == label).mean() > 0.995
    assert (found.kept == (found.vec_id == found.component_id)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, None), (3, []), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, [2, 0]), (8, [2, 0]), (None, [1, 0]), (9, [1e-30, 0]), (10, [1, 0, 0])]
    found = vector_dedup.vector_components(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id in (1, 8, 9, None)} == {k: (4, 1) for k in (1, 8, 9, None)}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in found if r.vec_id in (2, 3, 4, 5, 6, 7, 10))
    assert vector_dedup.vector_components(frame(spark, rows).limit(0)).count() == 0


def test_copies_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = rng.normal(size=(40, 16)).astype(np.float32)
    some[20:30] = some[:10] * 1.01  # links between groups of copies
    rows = [(i, some[k].tolist()) for i, k in enumerate(np.concatenate([np.zeros(600, int), rng.integers(0, 40, 600)]))]
    compared = []
    monkeypatch.setattr(vector_dedup, "tables_and_bits", lambda n, limit, recall: compared.append(n) or (12, 6))
    found = vector_dedup.vector_components(frame(spark, rows)).toPandas().sort_values("vec_id")
    assert compared == [len({tuple(v) for _, v in rows})]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    assert (found.n_links.to_numpy() == near.sum(1) - 1).all()
    assert (found.component_id.to_numpy() == near.argmax(1)).all()


def test_tables_make_up_for_bits():
    for n in (10, 10_000, 10**9):
        tables, bits = vector_dedup.tables_and_bits(n, 0.95)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.995


def exact(x, ids, q, k):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_neighbours_recall_and_scores(spark, clustered):
    asks = F.col("vec_id") % 50 == 0
    found = neighbours.nearest_neighbours(frame(spark, enumerate(clustered.tolist())), asks, k=10, sample=1500).toPandas()
    hits = total = 0
    for q, g in found.sort_values("rank").groupby("query_id"):
        true = exact(clustered, np.arange(len(clustered)), q, 10)
        assert g["rank"].tolist() == list(range(1, 11)) and g.score.is_monotonic_increasing and q not in set(g.vec_id)
        d = np.sqrt(((clustered[g.vec_id].astype(float) - clustered[q].astype(float)) ** 2).sum(1))
        assert np.allclose(d, g.score, atol=1e-12)
        hits += len(set(g.vec_id) & {i for i, _ in true})
        total += 10
    assert found.query_id.nunique() == 50 and hits / total >= 0.9


def test_few_and_odd_vectors(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, [1, 1]), (3, None), (4, [0, 0]), (100, [float("nan"), 1]), (5, [1, 2, 3]), (None, [3, 0]), (200, [1, 0])]
    found = neighbours.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0] == [(1, 200, 0.0), (2, 1, 1.0), (3, 2, 1.0), (4, None, 2.0)]
    assert {r.query_id for r in found} == {0, 200}
    assert neighbours.nearest_neighbours(frame(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_partition_is_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1003, 8))
    part = neighbours.balanced_partition(x, neighbours.nearest(x, x, 8, np.arange(1003)), 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 2


def test_neighbours_of_very_large_and_small_vectors(spark):
    from math import hypot

    rows = [(0, [3e200, 0.0]), (1, [3e200, 1e200]), (2, [1e-200, 2e-200]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [1.7e308, -1.7e308]), (6, [1.0, 2.0]), (7, [0.0, -1e-300])]
    schema = "vec_id long, embedding array<double>"
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, schema), F.lit(True)).collect()
    assert len(found) == 8 * 7
    given = dict(rows)
    for q in given:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        true = sorted((hypot(given[q][0] - v[0], given[q][1] - v[1]), i) for i, v in rows if i != q)
        assert [r.vec_id for r in mine] == [i for _, i in true]
        assert all(r.score == d or abs(r.score / d - 1) < 1e-14 for r, (d, _) in zip(mine, true))
