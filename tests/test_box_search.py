"""Blocks of vectors searched by boxes: the pairs of all vectors, fewer of them measured as the reference grows."""

import numpy as np
import pyarrow as pa
import pytest

from siftwave.operators import neighbours as M


def plain(x, y, take, metric):
    """All pairs, distances pair by pair, of equals the first in y."""
    if metric == "cosine":
        x, y = M._unit(x), M._unit(y)
    d = np.stack([M.measured(np.broadcast_to(q, y.shape), y, metric) for q in x])
    c = np.argsort(d, axis=1, kind="stable")[:, :take]
    return np.repeat(np.arange(len(x)), c.shape[1]), c.ravel(), np.take_along_axis(d, c, 1).ravel()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["scattered", "grid", "copies", "flat"])
def test_boxes_find_what_all_pairs_find(metric, kind):
    g = np.random.default_rng(3)
    x, y = g.standard_normal((60, 6)), g.standard_normal((9000, 6))
    if kind == "grid":
        x, y = (g.integers(0, 3, a.shape).astype(float) for a in (x, y))
    if kind == "copies":
        x, y = y[:60], np.repeat(y[:9], 1000, axis=0)
    if kind == "flat":
        x, y = x.copy(), y.copy()
        x[:, 2:], y[:, 2:], y[::50] = 0, 0, 0
    assert M.Reference(y, metric).boxes
    for got, wanted in zip(M.top_pairs(x, y, 12, metric), plain(x, y, 12, metric), strict=True):
        assert np.array_equal(got, wanted)


def test_pairs_grow_slower_than_the_reference():
    g = np.random.default_rng(4)
    x, y = g.standard_normal((1024, 10)), g.standard_normal((160_000, 10))
    met = []
    for n in (40_000, 160_000):
        r = M.Reference(y[:n], "l2")
        r.search(x, 11)
        met.append(r.met)
    assert met[1] < 0.4 * len(x) * len(y) and met[1] < 3.5 * met[0]


def test_lists_become_rows_and_bad_ones_are_errors():
    good = pa.chunked_array([pa.array([[1.0, 2.0]]), pa.array([[3.0, 4.0], [5.0, 6.0]]).slice(1)])
    assert M.vectors(good).tolist() == [[1.0, 2.0], [5.0, 6.0]]
    for bad in ([[1.0, None]], [None, [1.0]], [[1.0], [1.0, 2.0]], [[float("nan")]], [[float("inf")]]):
        with pytest.raises(ValueError):
            M.vectors(pa.array(bad, pa.list_(pa.float64())))


@pytest.mark.parametrize("broadcast", [1, 10**9])
def test_queries_of_one_place_share_ranks_and_carried_columns_stay(spark, monkeypatch, broadcast):
    monkeypatch.setattr(M, "BROADCAST", broadcast)
    ref = spark.createDataFrame([(0, i, [float(i), 0.0], None if i == 2 else f"n{i}") for i in range(6)], "channel int, ord long, vec array<double>, name string")
    asked = spark.createDataFrame([(0, 7, [0.1, 0.0]), (0, 7, [4.9, 0.0]), (0, 8, [2.1, 0.0]), (3, 9, [1.0, 1.0])], "channel int, ord long, vec array<double>")
    rows = sorted(map(tuple, M.nearest(asked, ref, 2, carry=("name",)).select("ord", "rank", "train_ord", "name").collect()))
    assert [r[:2] for r in rows] == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert sorted(r[2:] for r in rows if r[0] == 7) == [(0, "n0"), (5, "n5")] and [r[2:] for r in rows if r[0] == 8] == [(2, None), (3, "n3")]
